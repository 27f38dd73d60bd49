"""Named queries over the given tables, with the same results in SQL."""
from codegrain.catalog import event_queries, example_queries, pruning_queries, statement_queries, text_queries

MODULES = (text_queries, pruning_queries, event_queries, statement_queries, example_queries)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
