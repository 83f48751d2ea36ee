"""Interval reasoning: fixed cases without slack, and pruned answers equal to unpruned ones."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrank.operators.pruned import prune, pruned_top_k
from tallyrank.operators.topk import Query, collect, top_k
from tallyrank.plans.bounds import Interval, forward, invert
from tallyrank.plans.expression import parse

INF = math.inf
V = ["field", "v"]


def settle(expr, want, child):
    """(child interval, value interval over it) once ``want`` is known."""
    needs = invert(parse(expr), Interval(*want), {"v": Interval(*child)}, slack=0)
    now = needs.ranges.get("v", Interval()).meet(Interval(*child))
    if "v" in needs.values:
        now = now.meet(Interval(min(needs.values["v"]), max(needs.values["v"])))
    out = forward(parse(expr), {"v": now})
    return (now.lo, now.hi), (out.lo, out.hi)


ZIGZAG = ["custom_linear", [[0, 0], [3, 3], [6, 1], [9, 2]], V]


@pytest.mark.parametrize(
    "want,child,outside",
    [((-INF, INF), (-1, 12), (0, 3)), ((0, 4), (-1, 12), (0, 3)), ((0.5, 3), (0.5, 12), (0.5, 3)), ((0.5, 1.5), (0.5, 7.5), (0.5, 3)), ((0.5, 0.9), (0.5, 0.9), (0.5, 0.9))],
)
def test_curve(want, child, outside):
    got = settle(ZIGZAG, want, (-1, 12))
    assert got[0] == pytest.approx(child) and got[1] == pytest.approx(outside)


MAP = ["custom_map", [[-2, -2], [2, 2], [5, 3], [6, 1]], 0, V]


@pytest.mark.parametrize("want,child,outside", [((-INF, INF), (-1, 12), (0, 3)), ((-2, 4), (-1, 12), (0, 3)), ((0.25, 3), (2, 6), (0, 3)), ((0.5, 1.5), (6, 6), (0, 1))])
def test_map(want, child, outside):
    assert settle(MAP, want, (-1, 12)) == (child, outside)


def test_product():
    tree, stats = parse(["product", ["field", "a"], ["field", "b"]]), {"a": Interval(0.2, 0.8), "b": Interval(0.0, 1.0)}
    assert forward(tree, stats) == Interval(0.0, 0.8)
    assert invert(tree, Interval(0.5, 1.0), stats, slack=0).ranges["a"].lo == 0.5


def test_flat_segments_zero_factors_and_impossible_scores():
    assert settle(["custom_linear", [[0, 1], [4, 1], [8, 3]], V], (1, 1), (-5, 20))[0] == (-5, 4)
    assert invert(parse(["scale", 0, V]), Interval(1, INF), {"v": Interval(0, 9)}).empty
    assert not invert(parse(["scale", 0, V]), Interval(-1, INF), {"v": Interval(0, 9)}).empty
    assert invert(parse(["diff", 3, V]), Interval(-INF, -1), {"v": Interval(0, 9)}, 0).empty
    assert invert(parse(MAP), Interval(50, INF), {"v": Interval(0, 9)}).empty
    assert invert(parse(["sum", V, V]), Interval(100, INF), {"v": Interval(0, 9)}).empty
    assert invert(parse(["pow", V, -1]), Interval(0.5, INF), {"v": Interval(0, 9)}, 0).ranges["v"].hi == 2
    assert invert(parse(["sum", V, ["field", "w"]]), Interval(5, INF), {"v": Interval(0, 9)}).ranges == {}


NAMES = ["a", "b", "c"]


def random_tree(rng, depth=3):
    if depth == 0 or rng.random() < 0.2:
        return ["field", rng.choice(NAMES)]
    sub = lambda: random_tree(rng, depth - 1)
    xs = sorted(rng.uniform(-20, 60) for _ in range(rng.randint(1, 4)))
    return rng.choice(
        [
            lambda: ["sum", *(sub() for _ in range(rng.randint(1, 3)))],
            lambda: ["product", *(sub() for _ in range(rng.randint(1, 2)))],
            lambda: ["min", *(sub() for _ in range(rng.randint(1, 3)))],
            lambda: ["scale", rng.choice([-2.5, -1, 0, 0.5, 3]), sub()],
            lambda: ["diff", rng.uniform(-10, 30), sub()],
            lambda: ["diff", sub(), sub()],
            lambda: ["pow", sub(), rng.choice([0.5, 2, -1, 0])],
            lambda: ["custom_map", [[rng.choice([0, 1, 5, 25]), rng.uniform(-9, 9)] for _ in range(3)], rng.uniform(-3, 3), sub()],
            lambda: ["custom_linear", [[x, rng.uniform(-9, 9)] for x in xs], sub()],
        ]
    )()


def evaluate(tree, row):
    """Score of a row in 32-bit numpy, written without the engine."""
    f = np.float32
    head, *args = tree
    with np.errstate(all="ignore"):
        match head:
            case "field":
                return f(row[args[0]])
            case "sum":
                out = evaluate(args[0], row)
                for a in args[1:]:
                    out = f(out + evaluate(a, row))
                return out
            case "product":
                out = evaluate(args[0], row)
                for a in args[1:]:
                    out = f(out * evaluate(a, row))
                return out
            case "min":
                vals = [evaluate(a, row) for a in args]
                real = [v for v in vals if not np.isnan(v)]
                return min(real) if real else f(np.nan)
            case "scale":
                return f(evaluate(args[1], row) * f(args[0]))
            case "diff":
                left = evaluate(args[0], row) if isinstance(args[0], list) else f(args[0])
                return f(abs(f(evaluate(args[1], row) - left)))
            case "pow":
                return f(np.power(np.float64(evaluate(args[0], row)), np.float64(f(args[1]))))
            case "custom_map":
                v = evaluate(args[2], row)
                return {f(x): f(y) for x, y in args[0]}.get(v, f(args[1]))
            case "custom_linear":
                v, pts = evaluate(args[1], row), [(f(x), f(y)) for x, y in args[0]]
                if v <= pts[0][0]:
                    return pts[0][1]
                for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
                    if v <= x1:
                        t = f(f(v - x0) / f(x1 - x0))
                        return f(f(y1 * t) + f(y0 * f(f(1) - t)))
                return pts[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_needs_hold_for_every_row_above_the_threshold(seed):
    """Rows in plain numpy: whatever scores at or over tau fulfils the derived conditions."""
    rng = random.Random(seed)
    tree = random_tree(rng)
    rows = [{n: float(np.float32(rng.choice([0, 1, 5, 25, rng.uniform(-5, 50)]))) for n in NAMES} for _ in range(40)]
    stats = {n: Interval(min(r[n] for r in rows), max(r[n] for r in rows)) for n in NAMES}
    scores = [float(evaluate(tree, r)) for r in rows]
    real = sorted(s for s in scores if not math.isnan(s))
    if not real:
        return
    for tau in {real[-1], real[-min(3, len(real))], real[len(real) // 2]}:
        needs = invert(parse(tree), Interval(tau, INF), stats)
        for r, s in zip(rows, scores):
            if s >= tau:
                assert not needs.empty, (tree, tau)
                assert all(i.lo <= r[n] <= i.hi for n, i in needs.ranges.items()), (tree, tau, r, needs)
                assert all(r[n] in v for n, v in needs.values.items()), (tree, tau, r, needs)


def test_engine_agrees_with_numpy_and_pruned_with_unpruned(spark):
    rng = random.Random(5)
    rows = [{n: float(np.float32(rng.choice([0, 1, 5, 25, rng.uniform(-5, 50)]))) for n in NAMES} for _ in range(400)]
    df = spark.createDataFrame([(i + 1, f"r{i + 1}", r["a"], r["b"], r["c"]) for i, r in enumerate(rows)], "_doc_id long, id string, a float, b float, c float").coalesce(1).cache()
    for _ in range(12):
        tree = random_tree(rng)
        scored = [(float(evaluate(tree, r)), i + 1) for i, r in enumerate(rows)]
        want = sorted(((s, i) for s, i in scored if not math.isnan(s)), reverse=True)[:7]
        query = Query(tree, limit=7)
        got = collect(top_k(df, query))
        assert got["Scores"] == pytest.approx([s for s, _ in want], rel=1e-6, abs=1e-30), tree
        assert collect(pruned_top_k(df, query)) == got, tree


def test_overflow_case(spark):
    df = spark.createDataFrame([(i + 1, f"r{i}", float(1100 - i), 101 + (i % 10) / 10) for i in range(100)], "_doc_id long, id string, age float, height float")
    query = Query(["sum", ["field", "age"], ["field", "height"]], limit=2)
    assert collect(top_k(df, query))["Ids"] == ["r0", "r1"]
    assert collect(pruned_top_k(df, query))["Ids"] == ["r0", "r1"]


def test_nan_below_min_and_curve_binds_nothing():
    stats = {"a": Interval(-4, 9), "b": Interval(0, 5)}
    root = ["pow", ["field", "a"], 0.5]
    assert invert(parse(["min", root, ["field", "b"]]), Interval(3, INF), stats, 0).ranges == {"b": Interval(3, INF)}
    assert invert(parse(["custom_linear", [[0, 0], [2, 5]], root]), Interval(4, INF), stats, 0).ranges == {}


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id as _doc_id", "cast(id as string) as id", "cast(id as float) as v").write.parquet(path)
    cut = prune(spark.read.parquet(path), parse(["scale", 2, V]), 1900.0, {"v": Interval(0, 999)})
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v," in plan
    assert cut.count() == 50
