"""Token counts of whole texts without ids: each distinct pre-token is counted once and joined to its occurrences.

Documents are read in blocks. A block's pre-tokens, each with the documents that hold it and how often, are dealt
to buckets by their hash, one packed row for each block and bucket. A task that holds a bucket has all rows of its
pre-tokens, counts each distinct one once with the tokenizer's own library, joins the counts to the occurrences and
adds them up by block and document. Pre-tokens that over a sixteenth of a block's documents hold would make a few
buckets large, so they go to buckets of their own, salted by block.

A pre-token is a run of white space, as the library knows it, with the text up to the next run, or a special string:
a cut that never changes the library's result and needs no knowledge of its letter classes. Files that are not
byte-level (word pieces, sentence pieces) get each text as its own pre-token, as their normalisers see across cuts.

Nulls: a null text is empty, with 0 bytes and 0 tokens; null doc_ids and repeated rows are kept, one result each.
An empty table gives no rows. Only doc_id and text are read, so other columns may have any name. A very long text is
a block of its own; a very long pre-token is one row of its bucket.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common, tokens

#: A block ends at this many documents (two bytes hold their numbers) or characters, whichever comes first.
BLOCK_DOCS, BLOCK_CHARS = 16_384, 24_000_000
#: Stored input for one bucket; frequent pre-tokens get a fourth of the buckets again.
BUCKET_BYTES = 1_000_000
#: Blocks whose sums one task holds before it hands them on.
HELD_BLOCKS = 500
#: Distinct pre-tokens whose counts one task remembers; in a larger bucket some are counted again.
MOST_PIECES = 2_000_000
_ROWS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])
_SUMS = pa.schema([("block", pa.int64()), ("sums", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64()))])


def _pieces_of(path: str):
    """How this file's texts are cut: a function from text to pre-tokens."""
    if path.endswith(".model"):
        return lambda text: [text] if text else []
    return tokens.encoder(path).pieces


def counter(path: str):
    """A function from texts to their numbers of tokens, by the library for the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    encoder = tokens.Encoder(path, memo_pieces=0)
    return lambda texts: [len(encoder.ids(t)) // 4 for t in texts]


def pack(names: list[bytes], spans: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """Names with the lists of documents and times that belong to each (spans: their lengths)."""
    lens = np.array([len(x) for x in names], "<u4")
    head = np.array([len(names), len(docs)], "<u4")
    return zlib.compress(b"".join((head.tobytes(), lens.tobytes(), spans.astype("<u4").tobytes(), docs.astype("<u2").tobytes(), times.astype("<u4").tobytes(), *names)), 1)


def unpack(packed: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    data = zlib.decompress(packed)
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    lens, spans = np.frombuffer(data, "<u4", n, 8), np.frombuffer(data, "<u4", n, 8 + 4 * n)
    docs, times = np.frombuffer(data, "<u2", m, 8 + 8 * n), np.frombuffer(data, "<u4", m, 8 + 8 * n + 2 * m)
    start = 8 + 8 * n + 6 * m
    ends = (start + np.cumsum(lens, dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([start, *ends], ends, strict=False)], spans, docs, times


def _block(number: int, ids: list, texts: list[str], cut, buckets: int) -> Iterator[pa.RecordBatch]:
    vocabulary: dict[str, int] = defaultdict(count().__next__)
    found = [np.fromiter(map(vocabulary.__getitem__, own := cut(t)), np.int64, len(own)) for t in texts]
    keys = np.concatenate(found) * len(texts) + np.repeat(np.arange(len(texts)), [len(x) for x in found])
    del found
    keys, times = np.unique(keys, return_counts=True)
    which, docs = np.divmod(keys, len(texts))
    edges = np.searchsorted(which, np.arange(len(vocabulary) + 1))
    spans = np.diff(edges)
    yield pa.record_batch([pa.array(x, f.type) for x, f in zip([[-1 - number], [number], [None], [ids], [[len(t.encode()) for t in texts]]], _ROWS, strict=True)], schema=_ROWS)
    names = [x.encode("utf-8", "surrogatepass") for x in vocabulary]
    place = np.fromiter((zlib.crc32(x) for x in names), np.int64, len(names)) % buckets
    place[spans * 16 > max(len(texts), 64)] = buckets + zlib.crc32(number.to_bytes(8, "little")) % max(1, buckets // 4)
    order = np.argsort(place, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(place[order])) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = order[a:b]
        if len(own):
            at = np.repeat(edges[own], spans[own]) + np.arange(spans[own].sum()) - np.repeat(np.cumsum(spans[own]) - spans[own], spans[own])
            packed = pack([names[i] for i in own.tolist()], spans[own], docs[at], times[at])
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip([[int(place[own[0]])], [number], [packed], [None], [None]], _ROWS, strict=True)], schema=_ROWS)


def occurrences(docs: DataFrame, tokenizer: str, buckets: int, block_docs: int = BLOCK_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per block: a row with its documents (bucket below zero), and a packed row for each bucket."""

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number = _pieces_of(tokenizer), TaskContext.get().partitionId() << 32
        ids, texts, chars = [], [], 0
        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if len(texts) >= block_docs or chars >= block_chars:
                    yield from _block(number, ids, texts, cut, buckets)
                    number, ids, texts, chars = number + 1, [], [], 0
        if texts:
            yield from _block(number, ids, texts, cut, buckets)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInArrow(build, "bucket long, block long, packed binary, doc_ids array<long>, n_bytes array<long>")


def _join(tokenizer: str):
    """Count the pre-tokens of each bucket, which comes as consecutive rows, once, and add up by block and document."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = counter(tokenizer)
        held: dict[int, np.ndarray] = {}
        pieces: dict[bytes, int] = {}
        at = None

        def handed():
            for b, sums in held.items():
                at = np.flatnonzero(sums)  # the block's documents that have pre-tokens of this task's buckets
                packed = at.astype("<u2").tobytes() + sums[at].astype("<i8").tobytes()
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip([[b], [packed], [None], [None]], _SUMS, strict=True)], schema=_SUMS)
            held.clear()

        for part in parts:
            for k, bucket in enumerate(part.column("bucket").to_pylist()):
                block = part.column("block")[k].as_py()
                if bucket < 0:
                    yield pa.record_batch([pa.array([block]), pa.nulls(1, pa.binary()), part.column("doc_ids").slice(k, 1), part.column("n_bytes").slice(k, 1)], schema=_SUMS)
                    continue
                if bucket != at:
                    pieces, at = {}, bucket
                names, spans, docs, times = unpack(part.column("packed")[k].as_py())
                if len(pieces) > MOST_PIECES:
                    pieces = {}
                fresh = [x for x in names if x not in pieces]
                pieces.update(zip(fresh, counted([x.decode("utf-8", "surrogatepass") for x in fresh]), strict=True))
                own = np.fromiter(map(pieces.__getitem__, names), np.int64, len(names))
                more = np.bincount(docs, weights=times * np.repeat(own, spans)).astype(np.int64)
                sums = held.get(block)
                if sums is None or len(sums) < len(more):
                    grown = np.zeros(len(more), np.int64)
                    if sums is not None:
                        grown[: len(sums)] = sums
                    held[block] = sums = grown
                sums[: len(more)] += more
            if len(held) > HELD_BLOCKS:
                yield from handed()
        yield from handed()

    return work


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    header = part[part["doc_ids"].notna()].iloc[0]
    total = np.zeros(len(header["doc_ids"]), np.int64)
    for sums in part["sums"].dropna():
        n = len(sums) // 10
        total[np.frombuffer(sums, "<u2", n)] += np.frombuffer(sums, "<i8", n, 2 * n)
    ids = pd.array([None if pd.isna(i) else int(i) for i in header["doc_ids"]], dtype="Int64")
    return pd.DataFrame({"doc_id": ids, "n_bytes": np.array(header["n_bytes"], np.int64), "n_tokens": total})


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document."""
    common.prepare(docs.sparkSession)
    buckets = min(max(common.partitions_for(docs, BUCKET_BYTES), 64), 65_536)
    dealt = occurrences(docs, tokenizer, buckets).repartition(common.shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(_join(tokenizer), "block long, sums binary, doc_ids array<long>, n_bytes array<long>")
    merged = sums.groupBy("block").applyInPandas(_merge, "doc_id long, n_bytes long, n_tokens long")
    return merged.withColumn("over_limit", F.col("n_tokens") > limit)
