"""Merging the variables of parallel branches, by a strategy a variable."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import values as V
from .values import Value


def _last(old: Value | None, new: list[Value]) -> Value:
    return new[-1]


def _first(old: Value | None, new: list[Value]) -> Value:
    return V.choose(old.col.isNotNull(), old, new[0]) if old is not None and old.kind != "N" else new[0]


def _extreme(pick):  # noqa: ANN001, ANN202
    def merge(old: Value | None, new: list[Value]) -> Value:
        values = [v for v in ([old] if old is not None else []) + new if v.kind in "ID"]
        if not values:
            return old or new[-1]
        t = values[0].type
        for v in values[1:]:
            t = V.common(t, v.type)
        return Value(pick(*[V.cast(v, t) for v in values]) if len(values) > 1 else V.cast(values[0], t), t)

    return merge


def _fold(step):  # noqa: ANN001, ANN202
    def merge(old: Value | None, new: list[Value]) -> Value:
        values = ([old] if old is not None and old.kind != "N" else []) + new
        out = values[0]
        for v in values[1:]:
            out = step(out, v)
        return out

    return merge


def _concat(a: Value, b: Value) -> Value:
    if a.kind == b.kind and a.kind in "SA":
        return Value(F.coalesce(F.concat(a.col, b.col), b.col, a.col), a.type)
    return b


def _sum(a: Value, b: Value) -> Value:
    """The sum; what was there stays where the sum overflows or is none."""
    if {a.kind, b.kind} <= {"I"}:
        return Value(F.coalesce(F.try_add(a.col.cast("long"), b.col.cast("long")), a.col.cast("long")), V.LONG)
    if {a.kind, b.kind} <= {"I", "D"}:
        return Value(F.coalesce(a.col.cast("double") + b.col.cast("double"), a.col.cast("double")), V.DOUBLE)
    return a


def _avg(a: Value, b: Value) -> Value:
    """Pairwise in branch order, not the mean of all."""
    if {a.kind, b.kind} <= {"I", "D"}:
        return Value(F.coalesce((a.col.cast("double") + b.col.cast("double")) / 2, a.col.cast("double"), b.col.cast("double")), V.DOUBLE)
    return a


STRATEGIES = {"last": _last, "first": _first, "min": _extreme(F.least), "max": _extreme(F.greatest), "concat": _fold(_concat), "sum": _fold(_sum), "avg": _fold(_avg)}


def merge_branches(outer: dict[str, Value], branches: list[dict[str, Value]], strategies: dict[str, str]) -> dict[str, Value]:
    names = dict.fromkeys(n for b in branches for n in b)
    return {n: STRATEGIES[strategies.get(n, "last")](outer.get(n), [b[n] for b in branches if n in b]) for n in names}
