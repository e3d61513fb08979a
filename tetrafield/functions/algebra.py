"""Composition of samples: the "over" operator, its ordered fold, and interpolation weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COMPONENTS, QUALITY

TRANSPARENT = 2.0**-23  # opacities below are nothing: single precision's epsilon
SATURATED = 1e-4  # an opacity so close to 1 hides what lies under it


def _weighted_q(weights: Sequence[Column], v: Sequence[Column], q: Sequence[Column]) -> Column:
    """Q that follows velocity: sum(w v) / sum(w v / Q), or the harmonic mean where no velocity is left. Q = 0 counts as total loss."""
    total = sum((w * x for w, x in zip(weights[1:], v[1:], strict=True)), weights[0] * v[0])
    wv = [w * x for w, x in zip(weights, v, strict=True)]
    bound = F.struct(total.alias("total"), *(x.alias(f"w{n}") for n, x in enumerate(wv)))
    return let(bound, lambda s: F.when(s["total"] > 0, _harmonic([s[f"w{n}"] for n in range(len(wv))], q, s["total"])).otherwise(_harmonic(weights, q, F.lit(1.0))))


def _harmonic(weights: Sequence[Column], q: Sequence[Column], over: Column) -> Column:
    # a term without weight has no part, whatever its Q
    parts = [F.when(w == 0, F.lit(0.0)).when(x == 0, F.lit(float("inf"))).otherwise(F.try_divide(w, x)) for w, x in zip(weights, q, strict=True)]
    below = sum(parts[1:], parts[0])
    return F.when(below == 0, F.lit(0.0)).otherwise(F.try_divide(over, below))


def following_q(weights: Sequence[Column], v: Sequence[Column], q: Sequence[Column], total: Column) -> Column:
    """The same where sum(w v) is a column already: no lambda, so it compiles."""
    return F.when(total > 0, _harmonic([w * x for w, x in zip(weights, v, strict=True)], q, total)).otherwise(_harmonic(weights, q, F.lit(1.0)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once: expressions that name an operand many times don't multiply when they nest."""
    return F.get(F.transform(F.array(value), then), 0)


def over(top: Column, under: Column) -> Column:
    """top composited over under (structs). A transparent one leaves the other as it is."""
    return let(F.struct(top.alias("top"), under.alias("under")), lambda p: _over(p["top"], p["under"]))


def _over(top: Column, under: Column) -> Column:
    covers = lambda al: F.struct((top["alpha"] / al).alias("a"), (under["alpha"] * (1 - top["alpha"]) / al).alias("b"), al.alias("alpha"))

    def mixed(m: Column) -> Column:
        a, b = m["a"], m["b"]

        def q(c: str, v: str) -> Column:
            return _weighted_q((a, b), (top[v], under[v]), (top[c], under[c]))

        mean = lambda c: (a * top[c] + b * under[c]).alias(c)
        return F.struct(mean("rho"), mean("vp"), mean("vs"), q("qp", "vp").alias("qp"), q("qs", "vs").alias("qs"), m["alpha"].alias("alpha"))

    # neither is transparent here, so the opacity isn't 0
    both = let(top["alpha"] + under["alpha"] * (1 - top["alpha"]), lambda al: let(covers(al), mixed))
    return F.when(top["alpha"] < TRANSPARENT, under).when(under["alpha"] < TRANSPARENT, top).otherwise(both)


def saturated(q: Column) -> Column:
    return F.abs(q["alpha"] - 1) <= SATURATED


def fold(contributions: Column, existing: Column | None = None, stop: bool = True) -> Column:
    """Composites an array of structs with a field `q`, already in order, under `existing`; NULL where nothing contributes.

    With `stop`, nothing is added once the result is opaque.
    """
    start = F.lit(None).cast(QUALITY) if existing is None else existing

    def add(done: Column, x: Column) -> Column:
        grown = F.when(done.isNull(), x["q"]).otherwise(_over(done, x["q"]))
        return F.when(done.isNotNull() & saturated(done), done).otherwise(grown) if stop else grown

    return F.aggregate(contributions, start, add)


def blend_where(mask: Column, top: Column, under: Column) -> Column:
    return F.when(mask, over(top, under)).otherwise(under)


def barycentric(corners: Sequence[Column], weights: Sequence[Column]) -> Column:
    """A sample between the corners of a cell; Q follows velocity."""

    def mean(c: str) -> Column:
        return sum((w * x[c] for w, x in zip(weights[1:], corners[1:], strict=True)), weights[0] * corners[0][c])

    def q(c: str, v: str) -> Column:
        return _weighted_q(weights, [x[v] for x in corners], [x[c] for x in corners])

    values = {"rho": mean("rho"), "vp": mean("vp"), "vs": mean("vs"), "qp": q("qp", "vp"), "qs": q("qs", "vs"), "alpha": mean("alpha")}
    return F.struct(*(values[c].alias(c) for c in COMPONENTS))


def or_zero(q: Column) -> Column:
    """The contract for a miss: six zeros."""
    return let(q, lambda v: F.struct(*(F.coalesce(v[c], F.lit(0.0)).alias(c) for c in COMPONENTS)))
