"""Connected components of a link table, which the rest of the package uses too."""

from __future__ import annotations

from tidewatch.components import connected

__all__ = ["connected"]
