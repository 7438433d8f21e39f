"""Column expressions shared by the plans.  All of them stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from fieldtally.settings import LIMIT_PATTERN, UTC_OFFSET


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def choose(branches, default=None) -> Column:
    """Ordered multi-branch choice: first true condition wins."""
    (cond, value), *rest = branches
    chain = F.when(cond, value)
    for cond, value in rest:
        chain = chain.when(cond, value)
    return chain.otherwise(default)


def clip(c, low, high) -> Column:
    """Bound to [low, high]; a NULL stays NULL (least/greatest alone would skip it)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def safe_div(a, b) -> Column:
    """a / b, NULL when the divisor is zero (ANSI mode would raise)."""
    return col(a) / F.nullif(col(b), F.lit(0))


def first_of(*columns) -> Column:
    return F.coalesce(*[col(c) for c in columns])


def is_distinct(a, b) -> Column:
    return ~col(a).eqNullSafe(b)


def to_type(c, name: str, safe: bool = False) -> Column:
    return col(c).try_cast(name) if safe else col(c).cast(name)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def ratio_of_sums(a, b, scale: float = 1.0) -> Column:
    """scale * sum(a) / sum(b); ratios are never averaged."""
    return F.lit(scale) * F.sum(col(a)) / F.nullif(F.sum(col(b)), F.lit(0))


FILL_BANDS = ((20, "0–19%"), (40, "20–39%"), (60, "40–59%"), (80, "60–79%"))


def fill_band(c) -> Column:
    """Five fill bands of 20 points, and a band for missing telemetry."""
    c = col(c)
    bands = [(c.isNull(), F.lit("Missing"))] + [(c < top, F.lit(name)) for top, name in FILL_BANDS]
    return choose(bands, F.lit("80–100%"))


def fill_band_sort(c) -> Column:
    c = col(c)
    order = [(c.isNull(), F.lit(6))] + [
        (c < top, F.lit(i)) for i, (top, _) in enumerate(FILL_BANDS, 1)
    ]
    return choose(order, F.lit(5))


def global_key(city, *parts) -> Column:
    """``city:part[:part…]``, the key that stays unique across tenants."""
    return F.concat_ws(":", col(city), *[col(p).cast("string") for p in parts])


def null_unless(c, cond: Column) -> Column:
    return F.when(cond, col(c))


def to_local(ts) -> Column:
    return col(ts) + F.expr(UTC_OFFSET)


def hours_between(start, end) -> Column:
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(3.6e9)


def week_start(d) -> Column:
    """Monday of the date's week."""
    return F.date_sub(col(d), F.weekday(col(d)))


def iso_weekday(d) -> Column:
    return F.weekday(col(d)) + 1


def sunday_zero(d) -> Column:
    return F.dayofweek(col(d)) - 1


def is_weekend(d) -> Column:
    return F.weekday(col(d)) >= 5


def dow_flags(d, prefix: str = "target_dow_") -> list[Column]:
    """Seven 0/1 columns, Monday = 0."""
    return [(F.weekday(col(d)) == i).cast("int").alias(f"{prefix}{i}") for i in range(7)]


def reason_list(flags, empty: str = "below_rules") -> Column:
    """Names of the true flags in the given order, joined by ``;``."""
    joined = F.concat_ws(";", *[F.when(F.col(f), F.lit(f)) for f in flags])
    return F.when(joined == "", F.lit(empty)).otherwise(joined)


def numeric_limit(c) -> Column:
    """Number in a limit tag such as ``12 t`` or ``3.5 m``.

    Missing or empty text gives NULL; text that is not one number with an
    optional unit gives -1 so that callers can treat it as unresolved.
    """
    c = col(c)
    number = F.regexp_extract(c, LIMIT_PATTERN, 1)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("double")).otherwise(
        F.coalesce(number.try_cast("double"), F.lit(-1.0))
    )


def lookup(c, table: dict) -> Column:
    """Constant mapping as a literal map (the table is part of the code)."""
    pairs = reduce(lambda acc, kv: acc + [F.lit(kv[0]), F.lit(kv[1])], table.items(), [])
    return F.try_element_at(F.create_map(*pairs), col(c))


def speed_of(road_class, maxspeed, table: dict) -> Column:
    """Assumed speed of the class, capped by the first word of a posted limit."""
    posted = F.try_element_at(F.split(F.trim(col(maxspeed)), r"\s+"), F.lit(1)).try_cast("double")
    return F.least(lookup(road_class, table).cast("double"), posted)


def consecutive_pairs(arr) -> Column:
    """[a, b, c] -> [{u: a, v: b}, {u: b, v: c}]."""
    arr = col(arr)
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.transform(
        F.arrays_zip(F.slice(arr, F.lit(1), n).alias("u"), F.slice(arr, F.lit(2), n).alias("v")),
        lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v")),
    )


def parse_coords(text) -> Column:
    """``"lon,lat[,alt] lon,lat"`` -> array<struct<lon,lat>>."""
    tokens = F.filter(F.split(F.trim(col(text)), r"\s+"), lambda t: t != "")
    return F.transform(
        tokens,
        lambda t: F.struct(
            F.split(t, ",")[0].cast("double").alias("lon"),
            F.split(t, ",")[1].cast("double").alias("lat"),
        ),
    )


def normal_two_sided_p(z) -> Column:
    """Two-sided normal tail probability, accurate in the far tail.

    Spark SQL has no erfc.  The tail integral is a continued fraction for
    |z| >= 2 and the series of erf below, each as a fold over a short sequence.
    """
    a = F.abs(col(z)).cast("double")
    density = F.exp(-a * a / 2) / F.lit(2.5066282746310002)
    levels = F.sequence(F.lit(60), F.lit(1), F.lit(-1))
    far = 2 * density / F.aggregate(levels, a, lambda acc, k: a + k.cast("double") / acc)
    start = F.struct(a.alias("term"), a.alias("total"))

    def add(acc, k):
        term = acc["term"] * a * a / (2 * k + 1).cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    near = 1 - 2 * density * F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, add)["total"]
    return F.when(a >= 2, far).when(a < 2, near)
