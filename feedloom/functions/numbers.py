"""Rounding and safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(x: Column) -> Column:
    """Two places, half to even, decided on the exact binary value (0 <= x < 8, the range of scores).

    A double in [1, 8) times 2**52 is a whole number, and below 1 times 2**56 is, so the tie test is integer
    arithmetic. Values outside the range fall back to rounding the printed decimal.
    """

    def scaled(bits: int) -> Column:
        hundred = F.floor(x * F.lit(float(2**bits))) * F.lit(100)
        base = F.shiftright(hundred, bits)
        rest = hundred - F.shiftleft(base, bits)
        half = F.lit(2 ** (bits - 1))
        up = (rest > half) | ((rest == half) & (F.pmod(base, F.lit(2)) == 1))
        return (base + up.cast("long")) / F.lit(100.0)

    return (
        F.when((x >= 1) & (x < 8), scaled(52)).when((x >= 0) & (x < 1), scaled(56)).otherwise(half_even(x, 2))
    )


def half_even(x: Column, places: int) -> Column:
    """Half to even on the scaled double; the same arithmetic is available in any SQL engine."""
    scale = float(10**places)
    return F.bround(x * scale, 0) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b).cast("double"))


def exact_mean(x: Column) -> Column:
    """Mean of doubles through a decimal sum, so the result does not depend on the order of partial sums."""
    return F.sum(x.cast("decimal(20,12)")).cast("double") / F.count(x)


# The same formulas as SQL text, for the checks.
def sql_round2(x: str) -> str:
    def scaled(bits: int) -> str:
        m = f"CAST(floor(({x}) * {float(2**bits)!r}) AS HUGEINT) * 100"
        b = 2**bits
        base, rest = f"(({m}) // {b})", f"(({m}) % {b})"
        return (
            f"CAST({base} + CASE WHEN {rest} > {b // 2} OR ({rest} = {b // 2} AND {base} % 2 = 1) "
            f"THEN 1 ELSE 0 END AS DOUBLE) / 100.0"
        )

    return (
        f"(CASE WHEN ({x}) >= 1 AND ({x}) < 8 THEN {scaled(52)} WHEN ({x}) >= 0 AND ({x}) < 1 THEN {scaled(56)} "
        f"ELSE {sql_half_even(x, 2)} END)"
    )


def sql_half_even(x: str, places: int) -> str:
    return f"(round_even(({x}) * {10**places}.0::DOUBLE, 0) / {10**places}.0::DOUBLE)"


def sql_exact_mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(20,12))) AS DOUBLE) / count({x}))"


def sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0) END)"
