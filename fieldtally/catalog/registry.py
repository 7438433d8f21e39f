"""Register a Spark query together with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from fieldtally.bindings import World
from fieldtally.catalog.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def fixed(c: Column, digits: int) -> Column:
    """Round half away from zero in double arithmetic (no decimal objects per row)."""
    scaled = c.cast("double") * F.lit(10.0**digits)
    near = F.rint(scaled)
    tie = F.abs(scaled - near) == 0.5
    return F.when(tie, scaled + F.signum(scaled) * 0.5).otherwise(near) / F.lit(10.0**digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that two engines' summation orders agree."""
    return df.select(
        *[
            fixed(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Decorator: ``fn(world) -> DataFrame`` becomes ``queries()[name]``.

    ``doubles`` names the floating columns, which both sides round alike.
    """

    def wrap(fn: Callable[[World], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(World(spark, sf_dir)), digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql, tuple(doubles.split()), digits)
        return fn

    return wrap
