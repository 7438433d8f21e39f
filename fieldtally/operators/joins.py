"""Join shapes.  No side is hinted for broadcast: Spark broadcasts what its size
check admits and shuffles the rest, with AQE splitting skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_truth(obs: DataFrame, truth: DataFrame, key: str = "reading_id") -> DataFrame:
    """1:1 join of observed and latent measures; columns both carry come from ``obs``."""
    extra = [c for c in truth.columns if c == key or c not in obs.columns]
    return obs.join(truth.select(*extra), key)


def join_dim(fact: DataFrame, dim: DataFrame, key: str | list[str]) -> DataFrame:
    return fact.join(dim, key)


def left_keep(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left")


def orphans(child: DataFrame, parent: DataFrame, key: str | list[str]) -> DataFrame:
    return child.join(parent, key, "left_anti")


def missing_parent(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Orphan count in the outer-join form; NULL keys count as orphans."""
    known = parent.select(F.col(key).alias("__parent"))
    joined = child.join(known, child[key] == known["__parent"], "left")
    return joined.where(F.col("__parent").isNull()).agg(F.count(F.lit(1)).alias("orphans"))


def restrict_to(a: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return a.join(keys, key, "left_semi")


def cross_city_equal_share(df: DataFrame, city_a: str, city_b: str, on: list[str], measure: str) -> DataFrame:
    """Share of equal values between two tenants' rows that meet on the same keys.

    Both sides first collapse to (keys, value, count), so copies of one key
    meet as counts and pairs are never enumerated.
    """
    counts = (
        df.where(F.col("city_id").isin(city_a, city_b) & F.col(measure).isNotNull())
        .groupBy("city_id", *on, measure)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    a = counts.where(F.col("city_id") == city_a).drop("city_id")
    b = counts.where(F.col("city_id") == city_b).drop("city_id")
    totals = (
        a.groupBy(*on).agg(F.sum("n").alias("na")).join(b.groupBy(*on).agg(F.sum("n").alias("nb")), on)
    ).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("pairs"))
    equal = a.join(b.withColumnRenamed("n", "m"), [*on, measure]).agg(
        F.sum(F.col("n") * F.col("m")).alias("equal_pairs")
    )
    one = lambda d: d.withColumn("__one", F.lit(1))
    return (
        one(totals)
        .join(one(equal), "__one")
        .select(
            "pairs",
            F.coalesce("equal_pairs", F.lit(0)).alias("equal_pairs"),
            (F.coalesce("equal_pairs", F.lit(0)) / F.nullif("pairs", F.lit(0))).alias("equal_share"),
        )
    )


def star_count(fact: DataFrame, dims: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Row count before and after joining every dimension; equal means no fan-out or loss."""
    joined = fact
    for dim, keys in dims:
        joined = joined.join(dim.select(*keys), keys)
    before = fact.agg(F.count(F.lit(1)).alias("fact_rows")).withColumn("__one", F.lit(1))
    after = joined.agg(F.count(F.lit(1)).alias("joined_rows")).withColumn("__one", F.lit(1))
    return before.join(after, "__one").drop("__one")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def join_checked(a: DataFrame, b: DataFrame, keys: list[str], cardinality: str = "one_to_one", how: str = "inner"):
    """Join that refuses a key repeated on a side declared unique."""
    unique_sides = {"one_to_one": (a, b), "many_to_one": (b,), "one_to_many": (a,)}[cardinality]
    for side in unique_sides:
        if repeated_keys(side, keys).limit(1).count():
            raise ValueError(f"join on {keys} is not {cardinality}")
    return a.join(b, keys, how)


def join_aggregates(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Join tables already reduced to the same grain."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys)
    return out


def union_by_name(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_union(*dfs: DataFrame) -> DataFrame:
    """UNION ALL of each input's distinct rows."""
    out = dfs[0].distinct()
    for d in dfs[1:]:
        out = out.union(d.distinct())
    return out


def is_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: members of ``a`` missing from ``b`` and whether there are none."""
    missing = a.select(key).distinct().join(b, key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing")).withColumn("subset", F.col("missing") == 0)


def sym_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key stands on one side only, and which side."""
    left = a.select(*keys).distinct().withColumn("__a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("__b", F.lit(True))
    return (
        left.join(right, keys, "full_outer")
        .where(F.col("__a").isNull() | F.col("__b").isNull())
        .select(*keys, F.when(F.col("__b").isNull(), "left_only").otherwise("right_only").alias("side"))
    )


def sum_path(paths: DataFrame, edges: DataFrame, path_id: list[str], nodes: str) -> DataFrame:
    """Length and time of node paths, from consecutive pairs looked up in the edge table."""
    n = F.greatest(F.size(nodes) - 1, F.lit(0))
    hops = paths.select(
        *path_id,
        F.explode(F.arrays_zip(F.slice(nodes, F.lit(1), n).alias("u"), F.slice(nodes, F.lit(2), n).alias("v"))).alias("h"),
    ).select(*path_id, F.col("h.u").alias("u"), F.col("h.v").alias("v"))
    return (
        hops.join(edges.select("u", "v", "length_m", "travel_seconds"), ["u", "v"], "left")
        .groupBy(*path_id)
        .agg(
            F.count(F.lit(1)).alias("hops"),
            F.count("length_m").alias("known_hops"),
            F.sum("length_m").alias("length_m"),
            F.sum("travel_seconds").alias("travel_seconds"),
        )
    )
