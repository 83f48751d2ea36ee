"""Custom-score top-k retrieval over flat numeric records, on Spark DataFrames."""

from .operators.topk import Query, score_all, top_k
from .plans.expression import parse

__all__ = ["Query", "parse", "score_all", "top_k"]
