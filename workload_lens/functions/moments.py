"""Pooling of (count, mean, deviation) triples with plain aggregates.

Squares of large means that lie close together have no digits left for their differences, so
sums are kept against a *shift*: the mean rounded to a few leading bits. Triples of one key
and shift add up in any order and over any split. A key has few shifts; they are re-based to
the common mean where its parts meet, which takes one more shuffle of what is left by then.
The variance *within* the triples is kept apart from that *between* them, so that a group
whose means are all equal (in particular a group of one) keeps its deviation exactly.

``ddof`` is 0 for population and 1 for sample deviations.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Leading bits of a mean that its shift keeps.
SHIFT_BITS = 12
PARTS = ["n", "off", "sq", "within", "lo", "hi"]
_FOLD = {"lo": "min", "hi": "max"}


def moment_shift(mean: str) -> Column:
    """The mean rounded to ``SHIFT_BITS`` leading bits; rows of a key are first added up by it."""
    step = f"pow(2D, floor(log2(abs({mean}))) - {SHIFT_BITS})"
    return F.expr(f"coalesce(rint(try_divide({mean}, {step})) * {step}, 0D)")


def moment_parts(
    n: str, mean: str, deviation: str, shift: str = "shift", prefix: str = "", ddof: int = 0
) -> list[Column]:
    """Aggregates over raw triples of one key and shift."""
    aggregates = {
        "n": f"sum({n})",
        "off": f"sum({n} * ({mean} - {shift}))",
        "sq": f"sum({n} * ({mean} - {shift}) * ({mean} - {shift}))",
        "within": f"sum(greatest({n} - {float(ddof)}D, 0D) * {deviation} * {deviation})",
        "lo": f"min(case when {n} > 0 then {mean} end)",
        "hi": f"max(case when {n} > 0 then {mean} end)",
    }
    return [F.expr(f"{aggregates[p]} as {prefix}{p}") for p in PARTS]


def combine_parts(prefix: str = "") -> list[Column]:
    """Aggregates that merge parts of equal shift to a coarser key."""
    return [F.expr(f"{_FOLD.get(p, 'sum')}({prefix}{p}) as {prefix}{p}") for p in PARTS]


def with_centre(parts: DataFrame, keys: list[str], shift: str = "shift", prefix: str = "") -> DataFrame:
    """Add ``<prefix>centre``, the mean of all parts of a key; an aggregation by the key needs no further shuffle."""
    of_key = Window.partitionBy(*keys)
    total = F.sum(F.expr(f"{prefix}n * {shift} + {prefix}off")).over(of_key)
    count = F.sum(f"{prefix}n").over(of_key)
    return parts.withColumn(f"{prefix}centre", F.coalesce(F.try_divide(total, count), F.lit(0.0)))


def pooled_parts(shift: str = "shift", prefix: str = "") -> list[Column]:
    """Aggregates by key over parts with their centre: ``n``, ``mean``, ``within`` and ``between``."""
    n, off, sq, within, lo, hi = (prefix + p for p in PARTS)
    moved = f"({shift} - {prefix}centre)"
    about_centre = f"sum({sq} + 2D * {off} * {moved} + {n} * {moved} * {moved})"
    return [
        F.expr(f"sum({n}) as {n}"),
        F.expr(f"first({prefix}centre) as {prefix}mean"),
        F.expr(f"sum({within}) as {within}"),
        F.expr(f"case when min({lo}) < max({hi}) then greatest({about_centre}, 0D) else 0D end as {prefix}between"),
    ]


def pooled_deviation(prefix: str = "", ddof: int = 0) -> Column:
    spread = f"({prefix}within + {prefix}between)"
    freedom = f"({prefix}n - {float(ddof)}D)"
    return F.expr(f"case when {freedom} > 0 then sqrt({spread} / {freedom}) else 0D end")
