"""Column expressions shared by the operators; all of them stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlens.functions.constants import AGE_BINS, AGE_TOP, DAY_US, PRICE_BAND_EDGES

# Fixed values of the integer draw: a quadratic step modulo a Mersenne prime, plain enough to repeat in any SQL engine.
DRAW_MODULUS = 2_147_483_647
DRAW_FACTORS = (7919, 104_729, 1_299_709, 15_485_863)
DRAW_MULTIPLIER = 48_271
DRAW_SHIFT = 12_345


def ts_lit(micros: int) -> Column:
    """A timestamp literal from epoch microseconds; independent of the driver's time zone."""
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def day_number(c: Column | str) -> Column:
    """Whole days since the epoch."""
    return F.floor(micros(c) / F.lit(DAY_US)).cast("bigint")


def days_between(end: Column, start: Column) -> Column:
    """Fractional days from start to end."""
    return (micros(end) - micros(start)) / F.lit(float(DAY_US))


def whole_days_between(end: Column, start: Column) -> Column:
    """Days from start to end, rounded down."""
    return F.floor((micros(end) - micros(start)) / F.lit(float(DAY_US))).cast("bigint")


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is null where the divisor is 0 or null."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def null_if_infinite(c: Column) -> Column:
    """Infinite and not-a-number values become null."""
    value = c.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)


def at_least_zero(c: Column) -> Column:
    """Negative values become 0 and null stays null (greatest() alone would turn null into 0)."""
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def log1p_or_zero(c: Column) -> Column:
    return F.log1p(F.coalesce(c.cast("double"), F.lit(0.0)))


def same_region(user_pref: Column, item_pref: Column) -> Column:
    """1 where both regions are known and equal, else 0."""
    return F.coalesce(user_pref == item_pref, F.lit(False)).cast("int")


def age_bucket(age: Column) -> Column:
    """Right-closed age bins; an unknown age has no bin."""
    out = F.when(age <= AGE_BINS[0][0], AGE_BINS[0][1])
    for top, name in AGE_BINS[1:]:
        out = out.when(age <= top, name)
    return out.when(age.isNotNull(), AGE_TOP)


def price_band(log_price: Column) -> Column:
    """Index of the right-closed log-price bin."""
    out = F.when(log_price <= PRICE_BAND_EDGES[0], 0)
    for i, edge in enumerate(PRICE_BAND_EDGES[1:], 1):
        out = out.when(log_price <= edge, i)
    return out.otherwise(len(PRICE_BAND_EDGES)).cast("int")


def as_number(c: Column, dtype: str) -> Column:
    """An id as a non-negative integer below the draw modulus; texts go through crc32 first."""
    number = c.cast("bigint") if dtype in ("tinyint", "smallint", "int", "bigint") else F.crc32(c.cast("string"))
    return F.pmod(number, F.lit(DRAW_MODULUS).cast("bigint"))


def draw(parts: list[Column], seed: int) -> Column:
    """A reproducible pseudo-random integer in [0, DRAW_MODULUS) from up to three non-negative integers."""
    terms = [p.cast("bigint") * F.lit(f).cast("bigint") for p, f in zip(parts, DRAW_FACTORS)]
    mixed = reduce(lambda a, b: a + b, terms) + F.lit(seed * DRAW_FACTORS[3]).cast("bigint")
    h = F.pmod(mixed, F.lit(DRAW_MODULUS).cast("bigint"))
    return F.pmod(h * h + h * F.lit(DRAW_MULTIPLIER) + F.lit(DRAW_SHIFT), F.lit(DRAW_MODULUS).cast("bigint"))


def stratum_position(j: Column, strata: Column, size: Column, drawn: Column) -> Column:
    """The j-th of `strata` draws without replacement from positions 0..size-1: one random place per equal stratum.

    Positions of different strata never meet, so no second look at earlier draws is needed; with strata == size every
    position is taken once.
    """
    low = F.floor(j * size / strata)
    high = F.floor((j + 1) * size / strata)
    return (low + F.pmod(drawn, F.greatest(high - low, F.lit(1)))).cast("bigint")
