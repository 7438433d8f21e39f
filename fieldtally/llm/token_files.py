"""Token-id files: each document is one zstandard frame, all frames share one trained dictionary.

A folder holds ``dictionary`` (the dictionary's bytes) and shards in ascending key order.  A
shard is: the magic, the frames one after another, the index, a JSON header and its length
(4 bytes) with the magic again.  The header names the SHA-256 of the dictionary, the bytes per
id, the number of documents and ids, and where the index begins.  The index has four arrays of
8-byte integers: key, 1 if the key is null, ids in the document, and the frame's offset; so one
short document is read with the tail of the file and its own frame (``read_document``).

The dictionary is trained on the serialised ids of a bounded sample (``SAMPLE_DOCS`` documents,
none over ``SAMPLE_BYTES`` of text), all other work covers every document.  A task writes its
shard under a name of its own and reports it when it is complete; the table of reported shards
is the folder's manifest, so what a lost executor left half-written is never read.

Defined cases: a null text counts as empty and still has its end id; an empty table gives a
folder without documents; rows with the same key stay separate, in the order of their texts'
hashes; null keys come last; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.llm.text import map_arrow
from fieldtally.llm.tokens import encoder
from fieldtally.session import scratch_path

END_ID = 2
SHARD_BYTES = 16 << 20  # bytes of text in a shard, about
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 1 << 16
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
MAGIC = b"IDSHARD1"


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where samples are too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class ShardWriter:
    """Collects the frames of one shard; ``finish`` gives the file's bytes."""

    def __init__(self, dictionary: bytes, width: int):
        self.dictionary, self.width = dictionary, width
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary), write_checksum=True)
        self.frames = [MAGIC]
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.offsets = [len(MAGIC)]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        frame = self.press.compress(ids.astype(f"<u{self.width}").tobytes())
        self.frames.append(frame)
        self.keys.append(key)
        self.counts.append(len(ids))
        self.offsets.append(self.offsets[-1] + len(frame))

    def finish(self) -> bytes:
        index = [[k or 0 for k in self.keys], [int(k is None) for k in self.keys], self.counts, self.offsets[:-1]]
        header = {
            "dictionary_sha256": hashlib.sha256(self.dictionary).hexdigest(),
            "width": self.width,
            "documents": len(self.keys),
            "ids": int(sum(self.counts)),
            "index": self.offsets[-1],
        }
        text = json.dumps(header).encode()
        arrays = [np.array(x, "<i8").tobytes() for x in index]
        return b"".join([*self.frames, *arrays, text, len(text).to_bytes(4, "little"), MAGIC])


class ShardReader:
    """Random access to the documents of a shard in an open file."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        size = file.size()
        file.seek(max(0, size - 12))
        tail = file.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not a shard, or cut off")
        n = int.from_bytes(tail[:4], "little")
        file.seek(size - 12 - n)
        self.header = json.loads(file.read(n))
        if self.header["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the shard was written with another dictionary")
        docs = self.header["documents"]
        file.seek(self.header["index"])
        index = np.frombuffer(file.read(32 * docs), "<i8").reshape(4, docs)
        self.keys, self.nulls, self.counts = index[0], index[1].astype(bool), index[2]
        self.offsets = np.append(index[3], self.header["index"])
        self.expand = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        frame = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
        return np.frombuffer(self.expand.decompress(frame), f"<u{self.header['width']}").astype("<u4")


def _read(filesystem: pafs.FileSystem, path: str) -> bytes:
    with filesystem.open_input_file(path) as file:
        return file.read()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
) -> str:
    """Writes the ids of every whole text; returns the folder (a new shared one by default)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = narrow.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, -(-(total["b"] + 8 * total["n"]) // SHARD_BYTES))
    end = np.array([end_id], "<u4").tobytes()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, samples = encoder(tokenizer), []
        kind = "<u2" if max(made.size, end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for ids in made.encode(batch.column(0).to_pylist()):
                samples.append(np.frombuffer(ids + end, "<u4").astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([train_dictionary(samples)], pa.binary())], ["dictionary"])

    every = max(1, total["n"] // SAMPLE_DOCS)
    chosen = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(every)) == 0) & (F.octet_length("text") <= SAMPLE_BYTES)
    sample = narrow.where(chosen).select("text").limit(4 * SAMPLE_DOCS).coalesce(1)
    dictionary = map_arrow(sample, train, "dictionary binary").first()
    dictionary = bytes(dictionary["dictionary"]) if dictionary else b""
    filesystem, root = pafs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)
    with filesystem.open_output_stream(f"{root}/dictionary") as file:
        file.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, shard, order = encoder(tokenizer), None, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                if shard is None:
                    width = 2 if max(made.size, end_id + 1) <= 1 << 16 else 4
                    shard, order = ShardWriter(dictionary, width), part.column(2)[0].as_py()
                for k, ids in zip(part.column(0).to_pylist(), made.encode(part.column(1).to_pylist()), strict=True):
                    shard.add(k, np.frombuffer(ids + end, "<u4"))
        if shard is not None:
            name = f"shard-{order:08d}-{uuid.uuid4().hex}"
            target, base = pafs.FileSystem.from_uri(folder)
            with target.open_output_stream(f"{base}/{name}") as file:
                file.write(shard.finish())
            yield pa.RecordBatch.from_arrays(
                [pa.array([order], pa.int64()), pa.array([name]), pa.array([sum(shard.counts)], pa.int64())],
                ["shard", "name", "ids"],
            )

    ordering = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    ranged = (
        narrow.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, *ordering)
        .sortWithinPartitions(*ordering)
        .select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    )
    written = map_arrow(ranged, write, "shard long, name string, ids long")
    written.write.mode("overwrite").parquet(f"{folder}/manifest")
    return folder


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, and its ``ids`` if asked for.

    ``start`` counts the ids before the document; ``ids`` are little-endian 4-byte integers, of
    which ``ids_crc32`` is the checksum.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    manifest = spark.read.parquet(f"{folder}/manifest").select(
        "name", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    )
    many = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = pafs.FileSystem.from_uri(folder)
        dictionary = _read(filesystem, f"{root}/dictionary")
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(f"{root}/{name}") as file:
                    shard = ShardReader(file, dictionary)
                    starts = base + np.cumsum(shard.counts) - shard.counts
                    for a in range(0, len(shard.keys), 256):
                        b = min(a + 256, len(shard.keys))
                        ids = [shard.ids(k) for k in range(a, b)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.keys[a:b], pa.int64(), mask=shard.nulls[a:b]),
                                pa.array(starts[a:b], pa.int64()),
                                pa.array([len(x) for x in ids], pa.int64()),
                                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                                *([pa.array([x.tobytes() for x in ids], pa.binary())] if with_ids else []),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
                        )

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return map_arrow(manifest.repartition(many, "name"), read, schema)


def read_document(folder: str, name: str, position: int) -> np.ndarray:
    """Ids of one document of a shard, with two small reads and its own frame."""
    filesystem, root = pafs.FileSystem.from_uri(folder)
    with filesystem.open_input_file(f"{root}/{name}") as file:
        return ShardReader(file, _read(filesystem, f"{root}/dictionary")).ids(position)
