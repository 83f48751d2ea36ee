"""Top-k with bound propagation: a known score threshold becomes filters on stored fields.

A seed is any subset of the rows: its k-th best score is not above the whole
table's, so every row of the answer scores at least that.  Inverting the scoring
tree at that threshold gives a range (or the only values) per field; those are
plain comparisons on the stored columns, which Parquet uses to skip row groups.
The exact query then runs over what is left.

The answer is the same with any seed and any statistics that hold; a seed with
fewer than k rows falls back on the query's own floor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import field_columns
from ..plans.bounds import SLACK, Interval, Needs, invert
from ..plans.expression import Expr
from .topk import DOC, ID, Query, best_first, scored_rows


def measured_stats(df: DataFrame, names: list[str]) -> dict[str, Interval]:
    """Least and greatest 32-bit value of each field, in one pass; for tables without a manifest."""
    columns = field_columns(df, names)
    if not names:
        return {}
    row = df.agg(*[f(columns[n]).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for i, n in enumerate(names):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        # NaN sorts above all in Spark: an upper bound of NaN is none.
        out[n] = Interval() if lo is None or math.isnan(lo) else Interval(lo, math.inf if math.isnan(hi) else hi)
    return out


def condition(needs: Needs, columns: dict[str, Column]) -> Column | None:
    """The needs as one filter; None where they ask for nothing."""
    if needs.empty:
        return F.lit(False)
    parts = []
    for name, r in needs.ranges.items():
        if r.lo > -math.inf:
            parts.append(columns[name] >= F.lit(_down(r.lo)).cast("float"))
        if r.hi < math.inf:
            parts.append(columns[name] <= F.lit(_up(r.hi)).cast("float"))
    for name, values in needs.values.items():
        parts.append(columns[name].isin([F.lit(v).cast("float") for v in sorted(values)]))
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _down(v: float) -> float:
    import numpy as np

    f = np.float32(v)
    return float(f if float(f) <= v else np.nextafter(f, np.float32(-np.inf)))


def _up(v: float) -> float:
    return -_down(-v)


def threshold(seed: DataFrame, query: Query, doc: str = DOC, ident: str = ID) -> float | None:
    """Score that the k-th best row of the answer reaches at least; None where nothing is known."""
    k = query.offset + query.limit
    floor = query.min_score if query.min_score is not None else -math.inf
    row = scored_rows(seed, query.score, query.min_score, doc, ident).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
    found = row["s"] if k and row["n"] >= k else -math.inf
    best = max(float(found), floor)
    return None if best == -math.inf else best


def prune(df: DataFrame, score: Expr, tau: float, stats: dict[str, Interval], slack: float = SLACK) -> DataFrame:
    """Rows of ``df`` that may score ``tau`` or more."""
    needs = invert(score, Interval(tau, math.inf), stats, slack)
    names = sorted({*needs.ranges, *needs.values})
    found = condition(needs, field_columns(df, names))
    return df if found is None else df.filter(found)


#: Rows that are read for a first threshold where no seed is given, besides twenty for each of the answer.
SEED_ROWS = 1000
#: Share of surviving rows above which a filter is not worth its cost.
MOST_SURVIVORS = 0.5


def pruned_top_k(df: DataFrame, query: Query, seed: DataFrame | None = None, stats: dict[str, Interval] | None = None, doc: str = DOC, ident: str = ID) -> DataFrame:
    """The answer of ``top_k`` over ``df``, by two passes: a seed for the threshold, then the rest that can reach it.

    Without a ``seed`` the first rows of each partition are taken, which stops
    its scan early; without ``stats`` the fields' ranges are measured.  Where
    over MOST_SURVIVORS of the seed would pass the filter, the plain query runs.
    """
    if query.limit == 0:
        return best_first(scored_rows(df, query.score, query.min_score, doc, ident), query)
    fields = query.score.fields()
    if seed is None:
        seed = df.limit(SEED_ROWS + 20 * (query.offset + query.limit))
    seed = seed.select(*dict.fromkeys([doc, ident, *(n for n in fields if n in seed.columns)])).persist()
    try:
        tau = threshold(seed, query, doc, ident)
        if tau is not None:
            stats = stats if stats is not None else measured_stats(df, fields)
            count = seed.count()
            if count and prune(seed, query.score, tau, stats).count() <= MOST_SURVIVORS * count:
                df = prune(df, query.score, tau, stats)
    finally:
        seed.unpersist()
    return best_first(scored_rows(df, query.score, query.min_score, doc, ident), query)
