"""All named queries, and the SQL of those that SQL can state."""

from flowspark.plans import dataset, files, forecasts, graphs, learning, records, scoring, streams, threat, traffic

_MODULES = [traffic, threat, scoring, dataset, graphs, records, forecasts, files, learning, streams]
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
