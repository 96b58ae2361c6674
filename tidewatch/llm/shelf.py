"""Arrays in the shared folder; see tidewatch/shelf.py."""

from tidewatch.shelf import Shelf  # noqa: F401  the operators take it from here
