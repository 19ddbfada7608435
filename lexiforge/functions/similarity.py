"""Indel similarity (100 * 2 * LCS / sum of lengths) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK_BITS = 62


def _lcs_masks(a: str, b: str) -> str:
    """Bit-parallel LCS length for |b| <= 62: one bit a character of b, one step a character of a."""
    full = f"(shiftleft(1L, length({b})) - 1L)"
    mask = f"aggregate(sequence(0, length({b}) - 1), 0L, (m, j) -> m | (case when substring({b}, j + 1, 1) = ch then shiftleft(1L, j) else 0L end))"
    step = f"((v + (v & {mask})) | (v - (v & {mask}))) & {full}"
    return f"(length({b}) - bit_count(aggregate(split({a}, ''), {full}, (v, ch) -> {step})))"


def _lcs_rows(a: str, b: str) -> str:
    """Row-wise dynamic programme for longer strings; one row of the table a character of a."""
    cell = "array_append(acc, greatest(acc[j - 1], prev[j], prev[j - 1] + (case when substring({b}, j, 1) = ch then 1 else 0 end)))".replace("{b}", b)
    row = f"aggregate(sequence(1, length({b})), array(0), (acc, j) -> {cell})"
    return f"element_at(aggregate(split({a}, ''), array_repeat(0, length({b}) + 1), (prev, ch) -> {row}), -1)"


def lcs_length(a: str, b: str) -> Column:
    """Length of the longest common subsequence of two string columns; null if one is null."""
    return F.expr(
        f"case when {a} is null or {b} is null then null when length({a}) = 0 or length({b}) = 0 then 0"
        f" when length({b}) <= {MASK_BITS} then {_lcs_masks(a, b)} when length({a}) <= {MASK_BITS} then {_lcs_masks(b, a)}"
        f" else {_lcs_rows(a, b)} end"
    )


def indel_ratio(a: str, b: str) -> Column:
    """0 to 100; two empty strings are equal (100)."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_length(a, b) / total)


def may_reach(a: str, b: str, threshold: float) -> Column:
    """Cheap necessary conditions for a ratio of ``threshold``: lengths, then the thresholded edit distance."""
    la, lb = F.length(a), F.length(b)
    reach = F.least(la, lb) * 200.0 >= threshold * (la + lb)
    budget = f"cast(floor((length({a}) + length({b})) * {1 - threshold / 100.0} + 1e-9) as int)"
    return reach & F.expr(f"levenshtein({a}, {b}, {budget}) >= 0")  # -1 as soon as the budget is spent
