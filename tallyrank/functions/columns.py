"""Scoring trees to native Spark columns, with a 32-bit value at every node.

Spark divides and raises floats in double precision, so those results are
narrowed again.  Long tables of points become balanced nests of CASE, whose
depth and cost per row are logarithmic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import expression as x


def _f32(value: float) -> Column:
    return F.lit(value).cast("float")


def _tree(v: Column, cuts: list[float], leaves: list[Column]) -> Column:
    """leaves[k] where k cuts are less than v; there is one leaf more than cuts."""
    if not cuts:
        return leaves[0]
    mid = len(cuts) // 2
    return F.when(v <= _f32(cuts[mid]), _tree(v, cuts[:mid], leaves[: mid + 1])).otherwise(_tree(v, cuts[mid + 1 :], leaves[mid + 1 :]))


def _curve(v: Column, points: tuple[tuple[float, float], ...]) -> Column:
    xs = [p[0] for p in points]
    leaves = [_f32(points[0][1])]
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x0 == x1:  # never reached: the cut before it takes this x
            leaves.append(_f32(y1))
            continue
        t = ((v - _f32(x0)) / (_f32(x1) - _f32(x0))).cast("float")
        leaves.append(_f32(y1) * t + _f32(y0) * (_f32(1.0) - t))
    leaves.append(_f32(points[-1][1]))
    return _tree(v, xs, leaves)


def _lookup(v: Column, points: tuple[tuple[float, float], ...], default: float) -> Column:
    if not points:
        return F.when(v.isNotNull(), _f32(default))
    leaves = [F.when(v == _f32(px), _f32(py)).otherwise(_f32(default)) for px, py in points] + [_f32(default)]
    return _tree(v, [p[0] for p in points], leaves)


def to_column(node: x.Expr, columns: dict[str, Column]) -> Column:
    """Column of a tree; ``columns`` gives each field's 32-bit column."""
    below = [to_column(c, columns) for c in node.children]
    match node:
        case x.Field(name):
            return columns[name]
        case x.Sum():
            return reduce(lambda a, b: a + b, below)
        case x.Product():
            return reduce(lambda a, b: a * b, below)
        case x.Min():
            return F.least(*below) if len(below) > 1 else below[0]
        case x.Scale():
            return below[0] * _f32(node.factor)
        case x.Diff():
            return F.abs(below[0] - _f32(node.center))
        case x.Distance():
            return F.abs(below[0] - below[1])
        case x.Pow():
            return F.pow(below[0].cast("double"), F.lit(node.exponent)).cast("float")
        case x.Lookup():
            return _lookup(below[0], node.points, node.default)
        case x.Curve():
            return _curve(below[0], node.points)
    raise TypeError(f"not a scoring node: {node!r}")


def field_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """The named fields of ``df`` as 32-bit columns; a field that it does not have is null. Names are matched exactly."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    out = {}
    for n in names:
        if n not in kinds:
            out[n] = F.lit(None).cast("float")
        else:
            own = F.col("`" + n.replace("`", "``") + "`")
            out[n] = own if kinds[n] == "float" else own.cast("float")
    return out
