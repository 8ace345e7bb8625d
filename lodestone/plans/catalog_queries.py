"""All registered queries outside the training-data operators, with their DuckDB SQL where it exists."""
from lodestone.plans import rule_queries, search_queries, sync_queries, text_queries  # noqa: F401
from lodestone.plans.base import QUERIES, SQL  # noqa: F401
