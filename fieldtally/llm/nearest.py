"""Exact nearest neighbours by cosine: a block matrix join on int8 with error bounds.

Vectors are cut into blocks by a hash, queries and candidates apart, and every pair of a query
block and a candidate block is one tile.  In a tile the unit vectors are rounded to int8; the
integer product and the known rounding errors give a lower and an upper bound of each cosine.
Only candidates whose upper bound reaches the k-th largest lower bound of their query are
computed again in double precision from the original vectors.  Each tile keeps k rows per
query, and heaps merge these lists per query.  Nothing is approximate: the bounds are strict.

Equal vectors form one class first: a class is searched once, and stands in results for its k + 1
smallest ids, so thousands of copies cost no more than one vector.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component take
no part, nor do rows with a null id; vectors of different lengths are no candidates for each
other; rows with equal id and vector count once; equal scores go to the smaller id; a table
without queries or candidates gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.text import map_arrow
from fieldtally.session import cut_lineage

BLOCK = 4096
SPREAD = 16  # parts over which queries of one class are spread


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, some not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of doubles, all of one length, scaled by powers of two so that squares stay finite."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    _, exponent = np.frexp(np.abs(rows).max(1))
    return np.ldexp(rows, -exponent[:, None])


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 times a scale per row, and the length of the rounding error of each."""
    unit = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))
    return codes.astype(np.int8), scale, error * (1 + 1e-9) + 1e-12


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows with rows in double precision."""
    dot = (a * b).sum(1)
    return dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def search_tile(queries: np.ndarray, candidates: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: rows of the candidates that can be among its k best here, with their exact cosine."""
    qc, qs, qe = quantise(queries)
    cc, cs, ce = quantise(candidates)
    cf = cc.astype(np.float32).T
    for start in range(0, len(queries), 256):
        part = slice(start, min(start + 256, len(queries)))
        if queries.shape[1] <= 1024:  # sums of products below 2**24 are exact in float32
            product = (qc[part].astype(np.float32) @ cf).astype(np.float64)
        else:
            product = qc[part].astype(np.float64) @ cf.astype(np.float64)
        near = product * qs[part, None] * cs[None, :]
        # |cos - near| <= |q - q'| |c'| + |c - c'| with |c'| <= 1 + |c - c'|
        slack = qe[part, None] * (1 + ce[None, :]) + ce[None, :]
        low, high = near - slack, near + slack
        if low.shape[1] > k:
            least = np.partition(low, -k, axis=1)[:, -k]
        else:
            least = np.full(len(low), -np.inf)
        for i in range(len(low)):
            rows = np.flatnonzero(high[i] >= least[i])
            q = queries[start + i]
            yield start + i, rows, exact(np.broadcast_to(q, (len(rows), len(q))), candidates[rows])


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of largest cosine for every query row.

    ``is_query`` is a condition on ``vec_id``.  A query is no neighbour of itself.
    """
    double = F.col(vector).cast("array<double>")
    clean = vectors.select(F.col(key).cast("long").alias("vec_id"), double.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # one -0.0 for 0.0, then the class of a vector is its content
    clean = clean.withColumn("v", F.transform("v", lambda x: x + 0.0)).dropDuplicates()
    ids = _least_ids(clean, k + 1)
    classes = cut_lineage(
        ids.withColumn("class", F.col("ids")[0]).withColumn("dims", F.size("v"))
    )
    query_rows = clean.where(is_query).join(classes.select("v", "class"), "v").select("vec_id", "class")
    query_rows = cut_lineage(query_rows)
    wanted = query_rows.select("class").distinct().join(classes, "class")
    wanted = cut_lineage(wanted)
    n_candidates, n_queries = classes.count(), wanted.count()
    blocks_c, blocks_q = max(1, -(-n_candidates // block)), max(1, -(-n_queries // block))
    block_of = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    right = classes.select(
        "class", "v", "ids", "dims", block_of(blocks_c).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))).alias("q")
    )
    left = wanted.select(
        "class", "v", "ids", "dims", block_of(blocks_q).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks_c - 1))).alias("c")
    )
    tiles = (
        left.groupBy("q", "c", "dims")
        .cogroup(right.groupBy("q", "c", "dims"))
        .applyInArrow(
            lambda a, b: _tile(a, b, k), "class long, near array<struct<score: double, vec_id: long>>"
        )
    )
    best = merge_heaps(tiles, k + 1)
    spread = best.select("class", "near", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    asked = query_rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int"))
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    joined = asked.join(spread, ["class", "part"]).select(F.col("vec_id").alias("query_id"), others.alias("near"))
    return joined.select("query_id", F.posexplode("near").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def _least_ids(clean: DataFrame, n: int) -> DataFrame:
    """``v, ids``: the n smallest ids of each distinct vector, ascending.

    The rank limit is applied within tasks before the shuffle, so copies of one vector are cut
    down to n per task before they meet.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = clean.withColumn("place", place).where(F.col("place") <= n)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _tile(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    """The k best classes of a tile per query class, expanded to ids."""
    keys, near = [], []
    if len(queries) and len(candidates):
        q, c = (_matrix(t["v"].combine_chunks()) for t in (queries, candidates))
        classes, ids = queries["class"].to_pylist(), candidates["ids"].to_pylist()
        first = np.array([i[0] for i in ids])
        for i, rows, score in search_tile(q, c, k + 1):
            order = np.lexsort((first[rows], -score))
            # every class at least as near as the (k+1)-th may hold smaller ids among equals
            keep = order[score[order] >= score[order[min(k, len(order) - 1)]]]
            found = [(-float(s), v) for s, r in zip(score[keep], rows[keep], strict=True) for v in ids[r]]
            keys.append(classes[i])
            near.append([{"score": -s, "vec_id": v} for s, v in heapq.nsmallest(k + 1, found)])
    kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
    return pa.table({"class": pa.array(keys, pa.int64()), "near": pa.array(near, kind)})


def merge_heaps(lists: DataFrame, n: int) -> DataFrame:
    """Merges sorted lists per class with heaps of n entries; rows of a class meet in one task."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for key, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                heap = heaps.setdefault(key, [])
                for hit in near:
                    entry = (hit["score"], -hit["vec_id"])
                    if len(heap) < n:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
        keys = list(heaps)
        rows = [[{"score": s, "vec_id": -i} for s, i in sorted(heaps[key], reverse=True)] for key in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, kind)], ["class", "near"])

    placed = lists.select("class", "near").repartition("class")
    return map_arrow(placed, step, "class long, near array<struct<score: double, vec_id: long>>")
