"""Operators by kind. Importing this package registers all of them in tidewatch.catalog."""

from tidewatch.operators import aggregates, alerts, chain, documents, filters, folds, graphs, joins, lifecycle, merging, reads, scalars, sinks, statistics, tasks, vectors, windows

MODULES = (aggregates, alerts, chain, documents, filters, folds, graphs, joins, lifecycle, merging, reads, scalars, sinks, statistics, tasks, vectors, windows)
