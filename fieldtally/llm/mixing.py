"""Mixing sources to target weights, in DataFrame operations only.

``water_fill`` turns weights into targets: every source takes its share of the total, but at
most ``max_epochs`` times its own size; what is cut off goes to the others by weight, again
and again until no source stands above its limit.  One round is one aggregate over the table
of sources; the driver keeps two numbers, the total left and the weight left.

``mix_documents`` draws the target from each source.  With target t and source size s, every
document is taken ``t div s`` whole times; the rest ``t mod s`` goes to documents in the order
of a seeded hash, whole ones until the document that crosses the rest, which gives a fraction
of its words.  So a source's words meet its rounded target exactly, no document exceeds
``ceil(max_epochs)`` times its size, and reruns agree.  Running sums go over hash ranges (a
range's total, then rows inside a range), so a source with a third of all rows is no one task's.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; null or repeated doc_ids are drawn like others (rows that tie in everything share one
position, see ``mix_documents``); an empty table gives an empty result; a source of size 0 gets
target 0; other columns are carried along and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.ordering import match_keys
from fieldtally.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
ROWS_PER_RANGE = 2000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    # every word becomes one mark, everything else goes; counting marks needs no array of words
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "\u0001"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: Sequence[float] = WEIGHTS, name: str = "source") -> DataFrame:
    """Adds ``weight``: the sources in code-point order, null last, take the weights in turn.

    The order is a position in two levels, so many sources do not meet in one task.
    """
    ranged = sources.repartitionByRange(F.col(name).isNull(), F.col(name)).withColumn("__part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").count()  # one row per partition
    offsets = parts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__part").orderBy(F.col(name).asc_nulls_last())
    rank = F.col("__off") + F.row_number().over(inside) - 1
    list_of = F.array(*[F.lit(float(w)) for w in weights])
    return (
        ranged.join(offsets, "__part")
        .withColumn("weight", F.element_at(list_of, (rank % len(weights) + 1).cast("int")))
        .drop("__part", "__off")
    )


def water_fill(sources: DataFrame, total: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` (double) to rows with ``source_size`` and ``weight``.

    ``total`` defaults to the sum of all sizes.  A total above what all sources may give is
    cut to that.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    table = cut_lineage(sources)
    whole = table.agg(F.sum("source_size").alias("s"), F.sum(cap).alias("cap")).first()
    total = float(whole["s"] or 0) if total is None else float(total)
    total = min(total, float(whole["cap"] or 0))
    level, clamped = 0.0, -1
    while True:
        # a source is clamped once its limit does not exceed the level so far; levels only rise
        full = cap <= F.col("weight") * F.lit(level)
        got = table.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if got["n"] == clamped or got["weight"] == 0:
            break
        clamped = got["n"]
        level = (total - got["used"]) / got["weight"]
    full = cap <= F.col("weight") * F.lit(level)
    return table.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * F.lit(level)))


def mix_documents(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``repeats``.

    ``taken`` is in words, ``repeats`` the whole repetitions; ``keep`` names further (narrow) columns
    to carry.  The draw orders documents by md5 of seed and key, then key, then size; rows equal in
    all of these are exchangeable, and the rest is dealt among them in any order.
    """
    draw = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    sized = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(F.col(text)).alias("size"),
        draw.alias("__draw"),
        *keep,
    )
    sized = cut_lineage(sized)  # a few bytes a row, so texts are read once
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    targets = water_fill(cycled_weights(per_source, weights), max_epochs=max_epochs).withColumn(
        "__ranges", F.greatest(F.lit(1), F.ceil(F.col("__rows") / ROWS_PER_RANGE))
    )
    aim = F.least(F.round("target").cast("long"), F.col("source_size") * F.lit(max_epochs))
    targets = targets.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0).cast("long").alias("repeats"),
        F.when(F.col("source_size") > 0, aim % F.col("source_size")).otherwise(0).cast("long").alias("__rest"),
        "__ranges",
    )
    share = F.conv(F.substring("__draw", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    placed = match_keys(sized, targets, ["source"]).withColumn("__range", F.floor(share * F.col("__ranges")).cast("long"))
    totals = placed.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    chain = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "__range", F.coalesce(F.sum("__sum").over(chain), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("source", "__range").orderBy("__draw", "doc_id", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, -1)
    located = match_keys(
        placed.withColumn("__before", F.coalesce(F.sum("size").over(upto), F.lit(0))), offsets, ["source", "__range"]
    )
    left = F.col("__rest") - F.col("__off") - F.col("__before")
    part = F.least(F.col("size"), F.greatest(F.lit(0), left))
    return located.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats") + part).cast("long").alias("taken"),
        "repeats",
        *keep,
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each document as often as it is taken, in its own columns.

    A fractional repetition carries the leading words that the mix takes.  An empty document
    has no words to take and appears as often as its source is taken whole.  Rows equal in all
    columns are counted as one row first, so texts are shuffled once at most.
    """
    columns = docs.columns
    prints = ["__p1", "__p2"]  # never null, so one shuffle of the texts serves both steps below
    marked = docs.select("*", F.xxhash64(*columns).alias("__p1"), F.hash(*columns).alias("__p2"))
    mixed = mix_documents(marked, keep=prints, **options)
    rest = F.col("taken") - F.col("size") * F.col("repeats")
    whole = F.col("repeats") + F.when((rest == F.col("size")) & (rest > 0), 1).otherwise(0)
    share = mixed.groupBy(*prints).agg(
        F.sum(whole).alias("__whole"), F.sum(F.when(rest < F.col("size"), rest).otherwise(0)).alias("__words")
    )
    distinct = marked.groupBy(*prints).agg(F.first(F.struct(*columns)).alias("__row"))
    both = distinct.join(share.where("__whole > 0 OR __words > 0"), prints)
    text = F.col("__row.text")
    words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, 1, F.col("__words").cast("int")), "")
    copies = F.concat(
        F.array_repeat(text, F.col("__whole").cast("int")),
        F.when(F.col("__words") > 0, F.array(head)).otherwise(F.array().cast("array<string>")),
    )
    out = []
    for c in columns:
        if c == "text":
            out.append(F.col("__copy").alias(c))
        elif c == "n_chars":
            out.append(F.length("__copy").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"__row.`{c}`").alias(c))
    return both.select("__row", F.explode(copies).alias("__copy")).select(*out)
