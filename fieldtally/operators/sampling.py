"""Exact stratified sampling without replacement, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SPREAD = 64


def _smallest(df: DataFrame, stratum: list[str], k: int) -> DataFrame:
    """k smallest draw keys per stratum, first inside 64 salts of it, then over the survivors."""
    salted = Window.partitionBy(*stratum, "__salt").orderBy("__draw", "__id")
    final = Window.partitionBy(*stratum).orderBy("__draw", "__id")
    few = df.withColumn("__r", F.row_number().over(salted)).where(F.col("__r") <= k)
    return few.withColumn("__r", F.row_number().over(final)).where(F.col("__r") <= k)


def stratified_sample(
    df: DataFrame, stratum: str, id_col: str, k: int, seed: int, top_up: bool = True
) -> tuple[DataFrame, DataFrame]:
    """k rows per stratum in md5 order of ``seed|id``, and the shortfall per stratum.

    With ``top_up`` the total shortfall is drawn, in the same order, from rows
    not yet chosen anywhere.
    """
    keyed = df.withColumns(
        {
            "__draw": F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))),
            "__id": F.col(id_col),
            "__salt": F.pmod(F.xxhash64(id_col), F.lit(SPREAD)),
        }
    )
    chosen = _smallest(keyed, [stratum], k)
    short = (
        df.groupBy(stratum)
        .agg(F.count(F.lit(1)).alias("available"))
        .where(F.col("available") < k)
        .withColumn("shortfall", F.lit(k) - F.col("available"))
    )
    helpers = ["__draw", "__id", "__salt", "__r"]
    result = chosen.drop(*helpers)
    if top_up:
        need = short.agg(F.coalesce(F.sum("shortfall"), F.lit(0)).alias("n")).first()["n"]
        if need:
            rest = keyed.join(chosen.select(id_col), id_col, "left_anti")
            extra = rest.orderBy("__draw", "__id").limit(int(need)).drop(*helpers[:3])
            result = result.unionByName(extra)
    return result, short
