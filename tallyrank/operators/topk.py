"""Top-k retrieval by a scoring tree.

A row answers a query if it has every field that the tree names; rows with a
NaN score are never returned, infinite scores are.  Best first; of equal scores
the higher document id comes first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import field_columns, to_column
from ..plans.expression import Expr, Field, Scale, Sum, narrow, parse

DOC, ID = "_doc_id", "id"


@dataclass(frozen=True)
class Query:
    """``min_score`` None means no floor. ``offset_mode`` "page" skips the best ``offset`` rows.

    "compat" answers as engines that keep the best offset + limit rows and then
    let go of the ``offset`` worst of them.
    """

    score: Expr
    limit: int = 10
    offset: int = 0
    min_score: float | None = None
    offset_mode: str = "page"

    def __post_init__(self):
        if not isinstance(self.score, Expr):
            object.__setattr__(self, "score", parse(self.score))
        for name in ("limit", "offset"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise ValueError(f"{name} must be a whole number of 0 or more, got {value!r}")
        if self.min_score is not None and (isinstance(self.min_score, bool) or not isinstance(self.min_score, (int, float)) or math.isnan(self.min_score)):
            raise ValueError(f"min_score must be a number, got {self.min_score!r}")
        if self.offset_mode not in ("page", "compat"):
            raise ValueError(f"offset_mode is 'page' or 'compat', not {self.offset_mode!r}")


def scored_rows(df: DataFrame, score: Expr | list | str, min_score: float | None = None, doc: str = DOC, ident: str = ID) -> DataFrame:
    """As :func:`score_all`, with the id in its own type: most rows are dropped before anyone reads it."""
    score = parse(score) if not isinstance(score, Expr) else score
    names = score.fields()
    columns = field_columns(df, names)
    complete = F.lit(True)
    for n in names:
        complete = complete & columns[n].isNotNull()
    scored = df.filter(complete).select(F.col(doc).cast("long").alias(DOC), F.col(ident).alias(ID), to_column(score, columns).alias("score"))
    scored = scored.filter(~F.isnan("score"))
    if min_score is not None and min_score != -math.inf:
        scored = scored.filter(F.col("score") >= F.lit(min_score).cast("float"))
    return scored


def score_all(df: DataFrame, score: Expr | list | str, min_score: float | None = None, doc: str = DOC, ident: str = ID) -> DataFrame:
    """(_doc_id, id, score) of every row that answers, in no order: a scan without any shuffle."""
    return scored_rows(df, score, min_score, doc, ident).withColumn(ID, F.col(ID).cast("string"))


def best_first(scored: DataFrame, query: Query) -> DataFrame:
    """(rank, id, score) of scored rows. The sort keeps no more than offset + limit rows of a partition."""
    order = [F.desc("score"), F.desc(DOC)]
    ranked = W.orderBy(*order)
    if query.offset_mode == "page":
        top = scored.orderBy(*order).offset(query.offset).limit(query.limit) if query.offset else scored.orderBy(*order).limit(query.limit)
        top = top.withColumn("rank", F.row_number().over(ranked))
    else:
        top = scored.orderBy(*order).limit(query.offset + query.limit if query.limit else 0)
        top = top.withColumns({"rank": F.row_number().over(ranked), "__n": F.count("*").over(W.partitionBy())})
        top = top.filter(F.col("rank") <= F.col("__n") - query.offset)
    return top.select(F.col("rank").cast("long").alias("rank"), F.col(ID).cast("string").alias(ID), "score")


def top_k(df: DataFrame, query: Query, doc: str = DOC, ident: str = ID) -> DataFrame:
    """(rank, id, score) of the best rows of ``df`` (columns ``doc``, ``ident`` and the fields)."""
    return best_first(scored_rows(df, query.score, query.min_score, doc, ident), query)


def collect(result: DataFrame) -> dict[str, list]:
    """The answer as parallel lists, best first. It has ``limit`` rows at most."""
    rows = result.orderBy("rank").collect()
    return {"Ids": [r["id"] for r in rows], "Scores": [float(r["score"]) for r in rows]}


def linear_query(weights: dict[str, float], limit: int, min_score: float | None = 0.0) -> Query:
    """Weighted sum of fields, with a floor of 0 unless told otherwise."""
    if not weights:
        raise ValueError("a linear query needs a weight at least")
    parts = tuple(Scale(Field(name), narrow(w, f"the weight of {name}")) for name, w in weights.items())
    return Query(Sum(parts), limit=limit, min_score=min_score)


def parse_weights(text: str) -> dict[str, float]:
    """Weights of "field=weight,field=weight"."""
    out: dict[str, float] = {}
    for part in text.split(","):
        name, eq, weight = part.partition("=")
        name = name.strip()
        if not eq or not name:
            raise ValueError(f"expected field=weight, got {part!r}")
        try:
            out[name] = float(weight)
        except ValueError as e:
            raise ValueError(f"expected a number after {name}=, got {weight!r}") from e
    return out
