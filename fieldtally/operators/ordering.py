"""Order-dependent results that never put one key's rows into one task.

A window over ``partitionBy(key)`` sends everything a key owns to one task.  At
reading grain a key may own a large part of the table, so positions, quantiles,
lags and running sums are computed in two levels: rows are ordered inside
bounded chunks, and a small table of chunk totals supplies what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtally.session import cut_lineage


def match_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys; keeps the left copies."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    on = cond[0]
    for extra in cond[1:]:
        on = on & extra
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def split_points(value: str, parts: int) -> Column:
    """Sketched quantiles of a column (a bounded, mergeable state per group)."""
    return F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 10000)


def part_of(value: str, edges: str) -> Column:
    """Number of split points below the value: never decreases along the values."""
    v = F.col(value).cast("double")
    return F.size(F.filter(edges, lambda e: e < v)).cast("bigint")


def in_ranges(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """Rows with the number of their range (``__part``) and their place in it (``__at``, from 0).

    Ranges are cut by Spark's sample of the order columns taken together, so many equal values
    of the first column spread over ranges as far as the later ones tell them apart.  A range is sorted
    where it lies, and its rows are numbered as they come.  The result is stored, since another
    run would sample other ranges.
    """
    per_range = F.lit((1 << 33) - 1)  # lower bits of an increasing id: the row's number within its partition
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    numbered = ranged.withColumns(
        {"__part": F.shiftright("__id", 33).cast("int"), "__at": F.col("__id").bitwiseAND(per_range)}
    )
    return cut_lineage(numbered.drop("__id"))


def total_position(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Place of every row in the order of the whole table, from 1.

    ``order`` has to name a row: rows equal in all of it stay in one range, in no fixed order.
    One shuffle by ranges; what earlier ranges hold is a table of one row a range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = in_ranges(df, order, parts)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = (
        rows.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    placed = rows.join(F.broadcast(before), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str | Column,
    probs: dict[str, float],
    how: str = "linear",
    buckets: int = 256,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per key; ``how`` is ``linear`` or ``higher``.

    ``weight`` names a count column when the input is already value counts.

    1. equal values collapse to (value, count) before the shuffle;
    2. sketched split points cut each key's distinct values into ``buckets``
       about equal parts, whatever their distribution, and the counts per part
       locate the wanted positions;
    3. only the values of the parts so found are ordered.

    The split points decide how work spreads, never the result.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    count = F.lit(1) if weight is None else F.col(weight)
    src = df.select(*keys, value.cast("double").alias("__v"), count.cast("bigint").alias("__w"))
    if not keys:
        keys_in = ["__all"]
        src = src.withColumn("__all", F.lit(0))
    else:
        keys_in = keys
    base = (
        src.where(F.col("__v").isNotNull())
        .groupBy(*keys_in, "__v")
        .agg(F.sum("__w").alias("__c"))
    )
    base = cut_lineage(base)  # value counts, read by every step below
    # stored too: a sketch depends on the order in which parts arrive, and both readers below need the same edges
    span = cut_lineage(
        base.groupBy(*keys_in).agg(split_points("__v", buckets).alias("__edges"), F.sum("__c").alias("__n"))
    )
    binned = match_keys(base, span, keys_in).select(
        *keys_in, "__v", "__c", "__n", part_of("__v", "__edges").alias("__b")
    )
    hist = binned.groupBy(*keys_in, "__b").agg(
        F.sum("__c").alias("__bc"), F.max("__n").alias("__n")
    )
    earlier = Window.partitionBy(*keys_in).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    hist = hist.withColumn("__before", F.coalesce(F.sum("__bc").over(earlier), F.lit(0)))

    def at(p: float) -> Column:
        return (F.col("__n") - 1) * F.lit(float(p))

    wanted = []
    for p in probs.values():
        wanted += [F.ceil(at(p) - 1e-9)] + ([F.floor(at(p))] if how == "linear" else [])
        if how == "linear":
            wanted.append(F.ceil(at(p)))
    hits = hist.select(
        *keys_in,
        "__b",
        "__n",
        "__before",
        F.explode(
            F.filter(
                F.array_distinct(F.array(*wanted)),
                lambda x: (x >= F.col("__before")) & (x < F.col("__before") + F.col("__bc")),
            )
        ).alias("__pos"),
    )
    inside = match_keys(hits, binned.drop("__n"), keys_in + ["__b"])
    upto = (
        Window.partitionBy(*keys_in, "__pos")
        .orderBy("__v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    located = (
        inside.withColumn("__cum", F.col("__before") + F.sum("__c").over(upto))
        .where(F.col("__cum") > F.col("__pos"))
        .groupBy(*keys_in, "__pos")
        .agg(F.min("__v").alias("__x"), F.max("__n").alias("__n"))
    )
    per_key = located.groupBy(*keys_in).agg(
        F.max("__n").alias("__n"),
        F.map_from_entries(F.collect_list(F.struct("__pos", "__x"))).alias("__m"),
    )
    out = []
    for name, p in probs.items():
        if how == "higher":
            out.append(F.element_at("__m", F.ceil(at(p) - 1e-9)).alias(name))
            continue
        low, high = F.floor(at(p)), F.ceil(at(p))
        lo, hi = F.element_at("__m", low), F.element_at("__m", high)
        out.append((lo + (hi - lo) * (at(p) - low)).alias(name))
    return per_key.select(*keys, *out)


def split_position(
    df: DataFrame,
    part: list[str],
    coarse: list[Column],
    order: list[Column],
    name: str,
    kind: str = "row_number",
) -> DataFrame:
    """Position of each row inside ``part`` under ``order``, in two levels.

    ``coarse`` lists ascending columns that never disagree with ``order``
    (for example ``floor(score)``); rows that tie under ``order`` must share
    their coarse values.  ``kind`` is row_number, rank or average (tie mean).
    """
    ks = [f"__k{i}" for i in range(len(coarse))]
    tagged = df.select("*", *[c.alias(k) for c, k in zip(coarse, ks)])
    counts = tagged.groupBy(*part, *ks).agg(F.count(F.lit(1)).alias("__cnt"))
    before = (
        Window.partitionBy(*part)
        .orderBy(*[F.col(k).asc_nulls_first() for k in ks])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *part, *ks, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off")
    )
    inner = Window.partitionBy(*part, *ks).orderBy(*order)
    if kind == "row_number":
        pos = F.row_number().over(inner)
    elif kind == "rank":
        pos = F.rank().over(inner)
    else:
        ties = inner.rangeBetween(Window.currentRow, Window.currentRow)
        pos = F.rank().over(inner) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    placed = match_keys(tagged.withColumn("__p", pos), offsets, part + ks)
    return placed.withColumn(name, F.col("__off") + F.col("__p")).drop("__off", "__p", *ks)


def rank_average(df: DataFrame, part: list[str], value: str, name: str, buckets: int = 256):
    """Average-tie rank of ``value`` (NULL gets no rank).

    Ranks belong to values, so value counts are ordered, over about equal parts of the values,
    and rows look theirs up: however many rows tie, no task orders them.
    """
    known = df.where(F.col(value).isNotNull())
    dummy = part or ["__all"]
    if not part:
        known = known.withColumn("__all", F.lit(0))
    span = known.groupBy(*dummy).agg(split_points(value, buckets).alias("__edges"))
    counts = known.groupBy(*dummy, value).agg(F.count(F.lit(1)).alias("__n"))
    counts = cut_lineage(match_keys(counts, span, dummy).withColumn("__b", part_of(value, "__edges")).drop("__edges"))
    parts = counts.groupBy(*dummy, "__b").agg(F.sum("__n").alias("__t"))
    earlier = Window.partitionBy(*dummy).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*dummy, "__b", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__off"))
    below = Window.partitionBy(*dummy, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("__lo", F.coalesce(F.sum("__n").over(below), F.lit(0)))
    ranks = match_keys(inside, offsets, [*dummy, "__b"]).select(
        *dummy, value, (F.col("__off") + F.col("__lo") + (F.col("__n") + 1) / 2.0).alias(name)
    )
    return match_keys(known, ranks, [*dummy, value]).drop(*([] if part else ["__all"]))


def lag_split(
    df: DataFrame, part: list[str], order: list[str], columns: list[str], chunk: Column
) -> DataFrame:
    """Previous row's ``columns`` as ``prev_<c>``, ordering only inside chunks.

    ``chunk`` must not decrease along ``order`` (a month, a day).  The first row
    of a chunk takes its values from the last row of the previous chunk.
    """
    tagged = df.withColumn("__chunk", chunk)
    w = Window.partitionBy(*part, "__chunk").orderBy(*order)
    local = tagged.select(
        "*",
        F.row_number().over(w).alias("__rn"),
        F.lag(F.struct(*columns)).over(w).alias("__local"),
    )
    last = tagged.groupBy(*part, "__chunk").agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("__last")
    )
    chain = Window.partitionBy(*part).orderBy("__chunk")
    carried = last.select(*part, "__chunk", F.lag("__last").over(chain).alias("__carry"))
    joined = match_keys(local, carried, part + ["__chunk"])
    prev = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__local"))
    return joined.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in columns])


def running_sum_split(
    df: DataFrame, part: list[str], order: str, value: str, name: str, chunk_rows: int = 1024, parts: int | None = None
) -> DataFrame:
    """Running sum along an integer sequence column, in chunks of the sequence.

    What earlier chunks hold goes ahead of a chunk's rows as one more row, so nothing is joined
    and a part that ends in its first chunk adds no row.  ``parts`` sets the number of tasks that order
    chunks, where the session's shuffle partitions are too few for the input.
    """
    tagged = df.withColumns({"__chunk": F.floor(F.col(order) / F.lit(chunk_rows)), "__row": F.lit(True)})
    totals = tagged.groupBy(*part, "__chunk").agg(F.sum(value).alias("__t"))
    chain = Window.partitionBy(*part).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *part, "__chunk", F.sum("__t").over(chain).alias(value), F.lit(False).alias("__row")
    ).where(F.col(value).isNotNull())
    w = (
        Window.partitionBy(*part, "__chunk")
        .orderBy("__row", order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = tagged.unionByName(carried, allowMissingColumns=True)
    if parts is not None:
        rows = rows.repartition(parts, *part, "__chunk")
    return rows.withColumn(name, F.sum(value).over(w)).where("__row").drop("__chunk", "__row")
