"""Answer extraction, rewards and policy terms as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def final_int(text: Column) -> Column:
    """The integer after the first ``####``, else the last integer, else null.

    ASCII digits; an integer beyond 64 bits is null.
    """
    marked = F.regexp_extract(text, r"####\s*(-?\d+)", 1)
    numbers = F.regexp_extract_all(text, F.lit(r"-?\d+"), F.lit(0))
    return F.coalesce(F.nullif(marked, F.lit("")), F.try_element_at(numbers, F.lit(-1))).try_cast("bigint")


def format_score(text: Column, terminated: Column, n_new: Column, max_new: Column) -> Column:
    """Mean of: an integer can be read, the text ended, and 0 < n_new <= max_new."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return (flag(final_int(text).isNotNull()) + flag(terminated) + flag((n_new > 0) & (n_new <= max_new))) / 3.0


def correctness(text: Column, gold: Column) -> Column:
    return F.coalesce(final_int(text) == gold, F.lit(False)).cast("double")


def reward(text: Column, gold: Column, terminated: Column, n_new: Column, max_new: Column, w_correct: float = 1.0, w_format: float = 0.5) -> Column:
    return w_correct * correctness(text, gold) + w_format * format_score(text, terminated, n_new, max_new)


def group_advantage(value: Column, *group: str, eps: float = 1e-6) -> Column:
    """(value - mean) / (population deviation + eps) in the group; exactly 0 in a constant one."""
    w = Window.partitionBy(*group)
    same = F.max(value).over(w) == F.min(value).over(w)
    return F.when(same, F.lit(0.0)).otherwise((value - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + F.lit(eps)))


def clipped_surrogate(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    """min(ratio A, clip(ratio) A) of one token."""
    bounded = F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip))
    return F.least(ratio * advantage, bounded * advantage)


def masked_loss(term: Column, mask: Column) -> Column:
    """Aggregate: minus the masked mean, 0 where nothing is masked in."""
    return -F.sum(term * mask) / F.greatest(F.lit(1.0), F.sum(mask))
