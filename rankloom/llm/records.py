"""Length-delimited binary token records with masked checksums and a separate offset index.

A data shard is a run of frames, in ascending doc_id order over all shards::

    length   u64   bytes of the payload
    check    u32   masked CRC-32 of the eight length bytes
    payload        doc_id i64, has_id u8, id width u8 (2 or 4), then the ids
    check    u32   masked CRC-32 of the payload
    end      0x0A

All numbers are little-endian. A masked check is the CRC rotated right by 15 bits plus a constant, so that a
check stored among other data does not look like the check of that data. An index shard holds 32-byte entries
(shard u64, offset u64, doc_id i64, has_id u32, n_tokens u32), each followed by the same end byte.

One pass writes both, to ``kind=data`` and ``kind=index``, through Spark's own committed writer, so a lost executor
or a repeated task leaves no half shard, and any file system that Spark reaches will do. A task that passes
``roll_bytes`` goes on in another file, so no shard comes near the 2 GB that a reader holds, whatever the lengths.

Nulls: a null text is empty (its record holds the end id alone); null doc_ids come first and are marked in the
frame. Repeated doc_ids keep one record each, ordered by the first 64 characters of their text and then by place in
the input, which also splits any number of equal or null ids over shards. Very long texts make one long frame. An
empty table gives no shards and no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common, tokens

MASK_ADD = 0xA282EAD8
_LENGTH, _CHECK, _HEAD, _ENTRY = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB"), struct.Struct("<QQqII")
END = b"\n"
#: Bytes of stored input for one shard.
SHARD_BYTES = 16_000_000
#: Bytes of one data file, give or take a frame.
ROLL_BYTES = 256_000_000
#: A shard's number: the task's, then which of its files.
_ROLL_BITS = 20
#: Bytes of frames that a task hands on at once.
_HANDED = 1_000_000


class BrokenRecord(ValueError):
    """A frame whose checks or lengths do not hold."""


def masked(data: bytes) -> int:
    c = zlib.crc32(data) & 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record; ids are little-endian unsigned 32-bit."""
    stored = ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _HEAD.pack(doc_id or 0, doc_id is not None, width) + stored
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload))))


def entry(shard: int, offset: int, doc_id: int | None, n_tokens: int) -> bytes:
    return _ENTRY.pack(shard, offset, doc_id or 0, doc_id is not None, n_tokens)


def parse_at(data: bytes | memoryview, at: int) -> tuple[int | None, bytes, int]:
    """doc_id, ids as unsigned 32-bit bytes, and where the next frame starts."""
    if at + 12 > len(data):
        raise BrokenRecord(f"{len(data) - at} bytes left at {at}")
    head = bytes(data[at : at + 8])
    if _CHECK.unpack_from(data, at + 8)[0] != masked(head):
        raise BrokenRecord(f"length check at {at}")
    (n,) = _LENGTH.unpack(head)
    stop = at + 12 + n
    if stop + 5 > len(data):
        raise BrokenRecord(f"frame at {at} is cut off")
    payload = bytes(data[at + 12 : stop])
    if _CHECK.unpack_from(data, stop)[0] != masked(payload) or data[stop + 4 : stop + 5] != END:
        raise BrokenRecord(f"payload check at {at}")
    doc_id, has_id, width = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=_HEAD.size).astype("<u4").tobytes()
    return doc_id if has_id else None, ids, stop + 5


def parse(data: bytes) -> Iterator[tuple[int, int | None, bytes]]:
    """(offset, doc_id, ids) of every frame of a shard."""
    at, view = 0, memoryview(data)
    while at < len(view):
        doc_id, ids, following = parse_at(view, at)
        yield at, doc_id, ids
        at = following


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = tokens.END_ID, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> None:
    """Encode docs (doc_id, text) and write data shards under path/kind=data and the index under path/kind=index."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"), F.monotonically_increasing_id().alias("place"))
    order = (F.col("doc_id").asc_nulls_first(), F.substring("text", 1, 64), F.col("place"))
    rows = rows.repartitionByRange(common.partitions_for(docs, shard_bytes), *order).sortWithinPartitions(*order)
    last = np.array([end_id], "<u4").tobytes()

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
        shard, roll, offset, held = TaskContext.get().partitionId() << _ROLL_BITS, 0, 0, 0
        data, index = [], []

        def handed() -> pa.RecordBatch:
            kinds, n = ["data"] * len(data) + ["index"] * len(index), len(data) + len(index)
            return pa.record_batch([pa.array(data + index, pa.binary()), pa.array(kinds), pa.array([roll] * n, pa.int32())], names=["value", "kind", "roll"])

        for part in parts:
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                ids = encoder.ids(text.as_py()) + last
                data.append(frame(i, ids, width))
                index.append(entry(shard + roll, offset, i, len(ids) // 4))
                offset, held = offset + len(data[-1]) + 1, held + len(data[-1])
                if held >= _HANDED or offset >= roll_bytes:
                    yield handed()
                    data, index, held = [], [], 0
                    if offset >= roll_bytes:
                        roll, offset = roll + 1, 0
        if data:
            yield handed()

    # The writer keeps one file open for each kind and roll of a task, so rows need no sorting by kind; it passes bytes on as they are.
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        framed = rows.select("doc_id", "text").mapInArrow(encode, "value binary, kind string, roll int")
        framed.select(F.col("value").cast("string").alias("value"), "kind", "roll").write.partitionBy("kind", "roll").option("lineSep", "\n").text(path)
    finally:
        spark.conf.set(key, before)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """path and content of all files of a kind; None for an empty table, which has no files."""
    target, files = common.path_and_files(spark, f"{path}/kind={kind}")
    if not files.exists(target):
        return None
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(f"{path}/kind={kind}")


def _shards(spark: SparkSession, path: str) -> DataFrame | None:
    """(shard, content) of every data shard; shards rise in doc_id order."""
    files = _files(spark, path, "data")
    task, roll = (F.regexp_extract("path", x, 1).cast("long") for x in (r"part-(\d+)", r"roll=(\d+)/"))
    return files and files.select(F.shiftleft(task, _ROLL_BITS).bitwiseOR(roll).alias("shard"), "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset, doc_id, n_tokens of every record."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype([("shard", "<u8"), ("offset", "<u8"), ("doc_id", "<i8"), ("has_id", "<u4"), ("n_tokens", "<u4"), ("end", "u1")])
        for part in parts:
            for content in part["content"]:
                found = np.frombuffer(content, kind)
                if (found["end"] != END[0]).any():
                    raise BrokenRecord("index entry")
                ids = pd.array(found["doc_id"].astype("int64"), dtype="Int64")
                ids[found["has_id"] == 0] = pd.NA
                yield pd.DataFrame({"shard": found["shard"].astype("int64"), "offset": found["offset"].astype("int64"), "doc_id": ids, "n_tokens": found["n_tokens"].astype("int64")})

    schema, files = "shard long, offset long, doc_id long, n_tokens long", _files(spark, path, "index")
    return spark.createDataFrame([], schema) if files is None else files.select("content").mapInPandas(unpack, schema)


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every record in place: shard, offset, doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (unsigned 32-bit bytes).

    start counts the tokens of all earlier records. Only one total for each shard goes to the driver, from the index.
    """
    totals = {r["shard"]: r["n"] for r in read_index(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}
    before, so_far = {}, 0
    for shard in sorted(totals):
        before[shard] = so_far
        so_far += totals[shard]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, content in zip(part["shard"], part["content"], strict=True):
                start, rows = before.get(shard, 0), []
                for at, doc_id, ids in parse(content):
                    n = len(ids) // 4
                    rows.append((shard, at, doc_id, start, n, tokens.crc(ids), ids if with_ids else None))
                    start += n
                    if len(rows) == 5000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    schema, shards = "shard long, offset long, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary", _shards(spark, path)
    return spark.createDataFrame([], schema) if shards is None else shards.mapInPandas(scan, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["shard", "offset", "doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return out.assign(doc_id=pd.array([r[2] for r in rows], dtype="Int64"))


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """Records in an order drawn from the seed, each fetched by its offset: order (hash), doc_id, ids.

    Offsets are grouped by shard, so each shard is opened once; rows come back sorted by the drawn key.
    """
    drawn = read_index(spark, path).withColumn("draw", F.xxhash64(F.lit(seed), "shard", "offset"))
    wanted = drawn.groupBy("shard").agg(F.collect_list(F.struct("draw", "offset")).alias("wanted"))  # bounded by a shard's records

    def fetch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content, picks in zip(part["content"], part["wanted"], strict=True):
                view = memoryview(content)
                got = [(p["draw"], *parse_at(view, p["offset"])[:2]) for p in picks]
                yield pd.DataFrame({"draw": [g[0] for g in got], "doc_id": pd.array([g[1] for g in got], dtype="Int64"), "ids": [g[2] for g in got]})

    schema, shards = "draw long, doc_id long, ids binary", _shards(spark, path)
    if shards is None:
        return spark.createDataFrame([], schema)
    return shards.join(wanted, "shard").select("content", "wanted").mapInPandas(fetch, schema).orderBy("draw")
