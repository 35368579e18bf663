"""Constants and column expressions of the mining semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-10
#: Below this log probability an element underflows and is dropped.
LOG_FLOOR = -700.0
DEFAULT_PROBABILITY = 1.0


def at_least(value: Column, bound) -> Column:
    """``value >= bound`` with the tolerance used everywhere."""
    return value >= F.lit(bound) - EPSILON


def expected_utility() -> Column:
    """Whole numbers, whose sums are exact, and what they leave, so long sums keep their last places in any order."""
    x = F.col("u") * F.exp("lp")
    return F.sum(F.rint(x)) + F.sum(x - F.rint(x))


def existential_probability() -> Column:
    """1 - product of P(X, T): an itemset certain in every transaction gets 0 (kept on purpose)."""
    return 1 - F.exp(F.sum("lp"))


def upper_bound(rem: str = "rem") -> Column:
    """No extension within the subtree can exceed this: losses count 0, gains count in full."""
    return F.sum(F.greatest(F.lit(0.0), F.col("u") + F.col(rem)) * F.exp("lp"))


def growth_bound() -> Column:
    """No itemset that adds later items can exceed this; tighter than ``upper_bound``.

    Added items Y multiply every probability by theirs: what is there keeps at
    most its share by the likeliest of them, and each of them gains at most its
    own utility times its own probability.
    """
    later = F.greatest(F.lit(0.0), F.col("u")) * F.col("p_max") + F.col("rem_p")
    return F.sum(F.least(F.greatest(F.lit(0.0), F.col("u") + F.col("rem")), later) * F.exp("lp"))


def items_key(items: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x.cast("string")), ",")


def items_json(items: Column) -> Column:
    return F.to_json(F.array_sort(items))


def braces(items: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(items), lambda x: x.cast("string")), ", "), F.lit("}"))


def truncated(text: Column, width: int) -> Column:
    """At most ``width`` characters, the last three of them dots if cut."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def truncate_error(message: Column) -> Column:
    return F.coalesce(truncated(message, 1000), F.lit("Unknown error"))


def contains_all(items: Column, subset: Column) -> Column:
    return F.size(F.array_except(subset, items)) == 0
