"""The scoring language: nested arrays to an immutable tree.

Every node's value is a 32-bit float.  Constants may be ints or floats and are
narrowed to 32 bits at parse time, so that the plan carries exact values.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np

#: Kilometres per degree of latitude, as a 32-bit value.
EARTH_KM_PER_DEGREE = float(np.float32(6371 * math.pi / 180))


class Expr:
    """A node. ``children`` are its inputs in argument order."""

    children: tuple[Expr, ...] = ()

    def fields(self) -> list[str]:
        """Names of all fields below, each once, in order of appearance."""
        seen: dict[str, None] = {}
        stack: list[Expr] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, Field):
                seen.setdefault(node.name)
            stack.extend(reversed(node.children))
        return list(seen)


@dataclass(frozen=True)
class Field(Expr):
    name: str


@dataclass(frozen=True)
class _Unary(Expr):
    child: Expr

    @property
    def children(self) -> tuple[Expr, ...]:
        return (self.child,)


@dataclass(frozen=True)
class _Variadic(Expr):
    parts: tuple[Expr, ...]

    @property
    def children(self) -> tuple[Expr, ...]:
        return self.parts


class Sum(_Variadic):
    pass


class Product(_Variadic):
    pass


class Min(_Variadic):
    pass


@dataclass(frozen=True)
class Scale(_Unary):
    factor: float


@dataclass(frozen=True)
class Diff(_Unary):
    """Distance of the child from a constant."""

    center: float


@dataclass(frozen=True)
class Distance(Expr):
    """Distance of two expressions from each other."""

    left: Expr
    right: Expr

    @property
    def children(self) -> tuple[Expr, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class Pow(_Unary):
    exponent: float


@dataclass(frozen=True)
class Lookup(_Unary):
    """Value of the point at exactly the child's value, else ``default``. Points have distinct x, ascending."""

    points: tuple[tuple[float, float], ...]
    default: float


@dataclass(frozen=True)
class Curve(_Unary):
    """Piecewise linear through the points (x ascending), constant beyond both ends."""

    points: tuple[tuple[float, float], ...]


def narrow(value: object, what: str = "a number") -> float:
    """A constant as a 32-bit value. Booleans, strings, null and non-finite results are rejected."""
    if isinstance(value, bool) or not isinstance(value, (int, float, np.integer, np.floating)):
        raise ValueError(f"expected {what}, got {value!r}")
    with np.errstate(over="ignore"):
        out = float(np.float32(value))
    if not math.isfinite(out):
        raise ValueError(f"{what} {value!r} is not a finite 32-bit number")
    return out


def _points(value: object) -> list[tuple[float, float]]:
    if not isinstance(value, (list, tuple)):
        raise ValueError(f"expected a list of [x, y] points, got {value!r}")
    out = []
    for p in value:
        if not isinstance(p, (list, tuple)) or len(p) != 2:
            raise ValueError(f"expected an [x, y] point, got {p!r}")
        out.append((narrow(p[0], "x"), narrow(p[1], "y")))
    return out


def _name(value: object) -> str:
    if not isinstance(value, str) or not value:
        raise ValueError(f"expected a field name, got {value!r}")
    return value


def _arity(head: str, args: list, n: int) -> None:
    if len(args) != n:
        raise ValueError(f"{head} takes {n} argument{'s' * (n != 1)}, got {len(args)}")


def _parse_field(args: list) -> Expr:
    _arity("field", args, 1)
    return Field(_name(args[0]))


def _parse_scale(args: list) -> Expr:
    _arity("scale", args, 2)
    return Scale(build(args[1]), narrow(args[0], "the factor of scale"))


def _parse_diff(args: list) -> Expr:
    _arity("diff", args, 2)
    first, second = args
    if isinstance(first, (list, tuple)):
        return Distance(build(first), build(second))
    return Diff(build(second), narrow(first, "the constant of diff"))


def _parse_pow(args: list) -> Expr:
    _arity("pow", args, 2)
    return Pow(build(args[0]), narrow(args[1], "the exponent of pow"))


def _parse_lookup(args: list) -> Expr:
    _arity("custom_map", args, 3)
    last = {x + 0.0: y for x, y in _points(args[0])}  # -0.0 is 0.0; a later x replaces an earlier one
    return Lookup(build(args[2]), tuple(sorted(last.items())), narrow(args[1], "the default of custom_map"))


def _parse_curve(args: list) -> Expr:
    _arity("custom_linear", args, 2)
    points = _points(args[0])
    if not points:
        raise ValueError("custom_linear needs a point at least")
    if any(a[0] > b[0] for a, b in zip(points, points[1:])):
        raise ValueError("the points of custom_linear must ascend by x")
    return Curve(build(args[1]), tuple(points))


def _parse_geo(args: list) -> Expr:
    """Flat-map distance in km, from the query's latitude: root of the squared degrees, times km per degree."""
    _arity("geo_distance", args, 4)
    lat, lng = narrow(args[0], "latitude"), narrow(args[1], "longitude")
    shrink = float(np.float32(math.cos(lat * math.pi / 180)))
    north = Pow(Diff(Field(_name(args[2])), lat), 2.0)
    east = Pow(Scale(Diff(Field(_name(args[3])), lng), shrink), 2.0)
    return Scale(Pow(Sum((north, east)), 0.5), EARTH_KM_PER_DEGREE)


def _variadic(kind: type, head: str):
    def parse_parts(args: list) -> Expr:
        if not args:
            raise ValueError(f"{head} needs an argument at least")
        return kind(tuple(build(a) for a in args))

    return parse_parts


_HEADS = {
    "field": _parse_field,
    "scale": _parse_scale,
    "sum": _variadic(Sum, "sum"),
    "product": _variadic(Product, "product"),
    "min": _variadic(Min, "min"),
    "diff": _parse_diff,
    "pow": _parse_pow,
    "custom_map": _parse_lookup,
    "custom_linear": _parse_curve,
    "geo_distance": _parse_geo,
}


def build(node: object) -> Expr:
    """Tree of one nested array."""
    if isinstance(node, Expr):
        return node
    if not isinstance(node, (list, tuple)) or not node or not isinstance(node[0], str):
        raise ValueError(f"a scoring expression is an array that starts with a function name, got {node!r}")
    head, *args = node
    if head not in _HEADS:
        raise ValueError(f"Scoring function '{head}' is not recognized")
    return _HEADS[head](args)


def parse(source: object) -> Expr:
    """Tree of a nested array, or of its JSON text. Anything malformed raises ValueError."""
    if isinstance(source, (str, bytes)):
        try:
            source = json.loads(source)
        except json.JSONDecodeError as e:
            raise ValueError(f"not JSON: {e}") from e
    return build(source)
