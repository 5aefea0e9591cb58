"""All queries of the subpackage."""

from grainwise.llm import model_queries, native_queries, transform_queries  # noqa: F401
from grainwise.llm.registry import ORACLES, QUERIES  # noqa: F401
