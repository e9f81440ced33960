"""Substring deduplication with a log-structured fingerprint index.

A window is ``size`` consecutive words. Each window is filed under its anchor, the smallest hash among its shorter
word runs: equal windows have equal anchors, and neighbouring windows mostly share one, so an index of anchors is a
dozen times smaller than one of windows and misses none. Consecutive windows of one anchor are a block.

The index is a log of immutable runs (fp, n), bucketed and sorted by fp. A batch of documents becomes one run, which
is merge-joined with every earlier run, bucket by bucket without a shuffle; anchors found there, or more than once
within the batch, are candidates. When there are ``most_runs`` runs they are compacted into one before the next.
``deduplicate`` deals a whole table in batches through a log of its own; ``deduplicate_batch`` takes one new batch
against a log that is kept, and the documents that went into it.

Candidates are verified on words. Documents give the 128-bit hash of the words of every block under a candidate
anchor; blocks found twice or more repeat whole. Under anchors with blocks of several kinds, the 128-bit hashes of
the words of single windows are counted as well; each kind gives them at most twice in a batch of rows, as only two
or more matters.

Candidate anchors reach the scan of documents as a bitmap sized by their number (16 bits for each, 16 MB at most).
Beyond that size none is sent, and all blocks are joined with the candidates instead; results are the same.

Nulls: a null text has no words; its result is 0, 0 and the digest of nothing. Null doc_ids and repeated rows are
kept, one result each; repeated rows repeat each other's windows and share one list of hits. An empty table gives no
rows. A very long text is read whole, in room of some twenty times its length. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common

SIZE = 35
#: Words in the runs whose smallest hash is the anchor.
RUN = 12
#: Bits of the largest bitmap (16 MB), and bits for each key that set one up, and that it must have at least.
MOST_BITS, BITS_EACH, LEAST_BITS_EACH = 1 << 27, 16, 4
#: Bytes of text that are worked on together.
_CHUNK = 1_000_000
_B0, _B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(common.SEPARATORS.encode())] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    found = _powers.get(base)
    if found is None or len(found[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(max(n, 65_536), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        found = _powers[base] = (out[0], out[1])
    return found[0][:n], found[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of every k consecutive words, equal wherever the words are."""
    up, down = _power(base, len(h))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)])
    return _mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first smallest of each width consecutive values is."""
    at = np.arange(len(values), dtype=np.int32)

    def merge(step: int) -> None:
        nonlocal values, at
        later = values[step:] < values[:-step]
        values, at = np.where(later, values[step:], values[:-step]), np.where(later, at[step:], at[:-step])

    have = 1
    while 2 * have <= width:
        merge(have)
        have *= 2
    if have < width:
        merge(width - have)
    return at


@dataclass
class Texts:
    """Words of consecutive texts: their bytes with one space after each, where each word starts and ends, and the first word of each text and one beyond the last."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, offsets: np.ndarray) -> Texts:
        """From the bytes of all texts and where each starts (and the last ends)."""
        n = len(raw)
        word = ~_SEPARATOR[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True  # words do not go on into the next text
        gap = np.ones(n + 1, bool)
        gap[1:] = ~word
        begins = np.flatnonzero(word & (gap[:-1] | edge[:-1]))
        gap[:-1], gap[-1] = ~word, True
        lens = np.flatnonzero(word & (gap[1:] | edge[1:])) + 1 - begins
        end = np.cumsum(lens + 1) - 1
        data = np.full(int(lens.sum()) + len(lens), 32, np.uint8)
        letters = np.ones(len(data), bool)
        letters[end] = False
        data[letters] = raw[word]
        return cls(data, end - lens, end, np.searchsorted(begins, offsets))

    @functools.cached_property
    def view(self) -> memoryview:
        return memoryview(self.data)

    def words(self, a: int, b: int) -> memoryview:
        """The words from a to b (exclusive), joined by one space."""
        return self.view[self.start[a] : self.end[b - 1]] if b > a else self.view[:0]

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):
            low = int(self.start[at])
            upto = max(int(np.searchsorted(self.end, low + _CHUNK)), at + 1)
            part = self.data[low : int(self.end[upto - 1])]
            up, down = _power(_B0, len(part))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
            start = self.start[at:upto] - low
            out[at:upto] = _mix((total[self.end[at:upto] - low] - total[start]) * down[start])
            at = upto
        return out

    def blocks(self, size: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first word, number of windows and text of every block."""
        none = np.zeros(0, np.int64)
        if len(self.start) < size:
            return none.view(np.uint64), none, none, none
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        windows = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
        if not len(windows):
            return none.view(np.uint64), none, none, none
        small = _rolling(self.hashes(), run, _B1)
        at = _least(small, size - run + 1)[windows]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        return small[at[cuts]], windows[cuts], np.diff(np.append(cuts, len(windows))), text[windows[cuts]]


def _chunks(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    """The texts of a column, about a megabyte at a time (or one longer text): the first one's number, and their words."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = max(int(np.searchsorted(offsets, offsets[at] + _CHUNK, side="right")) - 1, at + 1)
        yield at, Texts.of(raw[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
        at = upto


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, key (128 bits of id and text) and text."""
    text = common.text_or_empty()
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(7), text, doc_id).alias("k2"), text.alias("text"))


def anchors(docs: DataFrame, size: int = SIZE, run: int = RUN) -> DataFrame:
    """fp, n: anchors of all blocks, counted within each batch of rows before they leave the task."""
    common.prepare(docs.sparkSession)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [own.blocks(size, run)[0] for _, own in _chunks(part.column("text"))]
            if found:
                fp, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    return docs.select(common.text_or_empty().alias("text")).mapInArrow(find, "fp long, n long")


class WindowLog:
    """Immutable runs of (fp, n) under one folder, each bucketed and sorted by fp.

    A run's folder tells its number and its buckets, so a log can be opened again by any session. A run is whole once
    Spark's writer has committed it; what a lost driver leaves of an unfinished one is not read. If one is lost while
    it compacts, the old runs and the new one may both stay: anchors are then candidates too often, never too seldom.
    """

    def __init__(self, spark: SparkSession, path: str, most_runs: int = 8):
        self.spark, self.path, self.most_runs = spark, path, most_runs
        target, files = common.path_and_files(spark, path)
        found = sorted(str(x.getPath().getName()) for x in files.listStatus(target)) if files.exists(target) else []
        done = [x for x in found if files.exists(common.path_and_files(spark, f"{path}/{x}/_SUCCESS")[0])]
        self.made = max((int(x.split("-")[1]) + 1 for x in found if x.startswith("run-")), default=0)
        self.tables = {x: f"rankloom_{uuid.uuid4().hex}" for x in done}
        for name, table in self.tables.items():
            where = f"{path}/{name}".replace("'", "''")
            spark.sql(f"CREATE TABLE {table} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {int(name.split('-')[2])} BUCKETS LOCATION '{where}'")

    def _write(self, counted: DataFrame) -> str:
        """A run from rows that are dealt by fp to as many partitions as there are buckets, so that each bucket is one file."""
        buckets = min(common.shuffle_partitions(self.spark), 100_000)
        name, table = f"run-{self.made:06d}-{buckets}", f"rankloom_{uuid.uuid4().hex}"
        self.made += 1
        counted.write.bucketBy(buckets, "fp").sortBy("fp").option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self.tables[name])

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            common.delete(self.spark, f"{self.path}/{name}")

    def compact(self) -> None:
        """Merge all runs into one, bucket by bucket."""
        if len(old := list(self.tables)) < 2:
            return
        merged = self.read(old[0])
        for name in old[1:]:
            more = self.read(name).withColumnRenamed("n", "more")
            n = (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long")
            merged = merged.hint("merge").join(more.hint("merge"), "fp", "full_outer").select("fp", n.alias("n"))
        self._write(merged)
        self.drop(*old)

    def append(self, batch: DataFrame, size: int = SIZE, run: int = RUN) -> tuple[DataFrame, str]:
        """Add the anchors of a batch as one run. Candidates (fp, repeats possible): those that earlier runs hold, by merge join, or the batch holds twice; and their table's path."""
        if len(self.tables) >= self.most_runs:
            self.compact()
        earlier = list(self.tables)
        new = self.read(self._write(anchors(batch, size, run).groupBy("fp").agg(F.sum("n").alias("n"))))
        found = new.filter("n > 1").select("fp")
        for name in earlier:
            found = found.unionByName(new.select("fp").hint("merge").join(self.read(name).select("fp").hint("merge"), "fp", "left_semi"))
        return common.materialize(found, "repeats")


def _bitmap(keys: DataFrame, name: str, most_bits: int = MOST_BITS) -> np.ndarray | None:
    """The bitmap of a column, sized by its number of rows; at most a 64th of its bits come to the driver as rows. None if it would have to be too large."""
    n = keys.count()
    if n * LEAST_BITS_EACH > most_bits:
        return None
    bits = min(1 << max(16, (n * BITS_EACH).bit_length()), most_bits)
    at = F.pmod(F.col(name), F.lit(bits))
    rows = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({name}, {bits}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = rows.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(np.uint64)


def _among(key: np.ndarray, bitmap: np.ndarray | None) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(key), bool)
    at = key.view(np.int64) & np.int64(len(bitmap) * 64 - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _digests(found: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _scan(docs: DataFrame, candidates: DataFrame, emit: Callable, schema: str, size: int, run: int, most_bits: int) -> DataFrame:
    """What emit makes of the blocks whose anchor is among candidates (or, in a bitmap, may be)."""
    bitmap = _bitmap(candidates, "fp", most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys = [part.column(c).to_numpy() for c in ("k1", "k2")]
            for at, own in _chunks(part.column("text")):
                fp, first, n, text = own.blocks(size, run)
                hit = np.flatnonzero(_among(fp, sent.value))
                if len(hit):
                    yield from emit(own, fp[hit].view(np.int64), first[hit], n[hit], (first - own.first[text])[hit], *(k[at + text[hit]] for k in keys))

    found = _texts(docs).select("k1", "k2", "text").mapInArrow(find, schema)
    return found if bitmap is not None else found.join(candidates, "fp", "left_semi")


def candidate_blocks(docs: DataFrame, candidates: DataFrame, size: int = SIZE, run: int = RUN, most_bits: int = MOST_BITS) -> DataFrame:
    """k1, k2, first (word in the text), length (windows), fp, b1, b2 (128 bits of the words) of the blocks of candidate anchors."""

    def emit(own: Texts, fp, first, n, place, k1, k2) -> Iterator[pa.RecordBatch]:
        digests = [xxhash.xxh3_128_digest(own.words(a, b)) for a, b in zip(first.tolist(), (first + n + size - 1).tolist(), strict=True)]
        yield pa.record_batch([pa.array(k1), pa.array(k2), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(fp), *_digests(digests)], names=["k1", "k2", "first", "length", "fp", "b1", "b2"])

    return _scan(docs, candidates, emit, "k1 long, k2 long, first int, length int, fp long, b1 long, b2 long", size, run, most_bits)


def candidate_windows(docs: DataFrame, candidates: DataFrame, size: int = SIZE, run: int = RUN, most_bits: int = MOST_BITS) -> DataFrame:
    """k1, k2, first, w1, w2 (128 bits of the words) of the windows under candidate anchors; of equal blocks side by side two give theirs."""

    def emit(own: Texts, fp, first, n, place, k1, k2) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        kept = []
        for i, (a, b) in enumerate(zip(first.tolist(), (first + n + size - 1).tolist(), strict=True)):
            words = xxhash.xxh3_128_digest(own.words(a, b))
            seen[words] = times = seen.get(words, 0) + 1
            if times <= 2:
                kept.append(i)
        at = np.repeat(kept, n[kept])
        step = np.arange(len(at)) - np.repeat(np.cumsum(n[kept]) - n[kept], n[kept])
        start = (first[at] + step).tolist()
        digests = [xxhash.xxh3_128_digest(own.words(a, a + size)) for a in start]
        yield pa.record_batch([pa.array(k1[at]), pa.array(k2[at]), pa.array((place[at] + step).astype(np.int32)), pa.array(fp[at]), *_digests(digests)], names=["k1", "k2", "first", "fp", "w1", "w2"])

    return _scan(docs, candidates, emit, "k1 long, k2 long, first int, fp long, w1 long, w2 long", size, run, most_bits)


def verified(docs: DataFrame, candidates: DataFrame, size: int = SIZE, run: int = RUN, most_bits: int = MOST_BITS) -> tuple[DataFrame, str]:
    """k1, k2 and hits, (first, length) of windows that start elsewhere too, of the documents that have any; and the table's path."""
    spark = docs.sparkSession
    found, one = common.materialize(candidate_blocks(docs, candidates, size, run, most_bits), "blocks")
    kinds, two = common.materialize(found.groupBy("fp", "b1", "b2").agg(F.count("*").alias("n")), "kinds")
    several = kinds.groupBy("fp").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 AND least = 1").select("fp")
    several, three = common.materialize(several, "several")
    windows, four = common.materialize(candidate_windows(docs, several, size, run, most_bits).drop("fp"), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1")
    single = windows.join(twice, ["w1", "w2"], "left_semi").select("k1", "k2", "first", F.lit(1).alias("length"))
    whole = found.join(kinds.filter("n > 1"), ["fp", "b1", "b2"], "left_semi").select("k1", "k2", "first", "length")
    # A set, as equal rows share a key: a list has no more than the windows of one text.
    hits = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "length")).alias("hits"))
    hits, path = common.materialize(hits, "hits")
    common.delete(spark, one, two, three, four)
    return hits, path


def _row(own: Texts, text: int, gone: np.ndarray | None, with_text: bool) -> tuple:
    """n_words, n_removed, kept_sha256 and kept_text of one text, gone telling which of its words go."""
    a, b = int(own.first[text]), int(own.first[text + 1])
    if gone is None or not gone.any():
        kept, removed = own.words(a, b), 0
    else:
        lens = own.end[a:b] - own.start[a:b] + 1
        kept = memoryview(own.data[own.start[a] : own.end[b - 1] + 1][np.repeat(~gone, lens)])[:-1]
        removed = int(gone.sum())
    return b - a, removed, hashlib.sha256(kept).hexdigest(), bytes(kept) if with_text else None


def _gone(n: int, first: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, first + length - 1 + size, -1)
    return np.cumsum(step)[:n] > 0


_RESULT = ("n_words", "n_removed", "kept_sha256", "kept_text")


def _columns(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()).cast(pa.string())]


def results(docs: DataFrame, hits: DataFrame, size: int = SIZE, with_text: bool = True, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for) of every document.

    Documents that cannot have hits are finished where they are read; only the others' texts are shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(hits, "k1", most_bits))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = _among(part.column("k1").to_numpy(), sent.value)
            clean = part.filter(pa.array(~near))
            rows = [_row(own, i, None, with_text) for _, own in _chunks(clean.column("text")) for i in range(len(own.first) - 1)]
            none = [pa.nulls(len(rows), k) for k in (pa.int64(), pa.int64(), pa.string())]
            yield pa.record_batch([clean.column("doc_id"), *none, *_columns(rows)], names=["doc_id", "k1", "k2", "text", *_RESULT])
            left = part.filter(pa.array(near))
            none = [pa.nulls(len(left), k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string())]
            yield pa.record_batch([left.column(c) for c in ("doc_id", "k1", "k2", "text")] + none, names=["doc_id", "k1", "k2", "text", *_RESULT])

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = part.column("text").is_null()
            yield part.filter(done).select(["doc_id", *_RESULT])
            left = part.filter(pa.compute.invert(done))
            found = left.column("hits")
            offsets, flat = np.asarray(found.offsets), found.values
            first, length = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            rows = []
            for at, own in _chunks(left.column("text")):
                for i in range(len(own.first) - 1):
                    here = slice(offsets[at + i], offsets[at + i + 1])
                    gone = _gone(int(own.first[i + 1] - own.first[i]), first[here], length[here], size) if here.stop > here.start else None
                    rows.append(_row(own, i, gone, with_text))
            yield pa.record_batch([left.column("doc_id"), *_columns(rows)], names=["doc_id", *_RESULT])

    result = "n_words long, n_removed long, kept_sha256 string, kept_text string"
    first = _texts(docs).mapInArrow(judge, f"doc_id long, k1 long, k2 long, text string, {result}")
    return first.join(hits, ["k1", "k2"], "left").select("doc_id", "text", "hits", *_RESULT).mapInArrow(finish, f"doc_id long, {result}")


def deduplicate(docs: DataFrame, batches: int = 3, size: int = SIZE, run: int = RUN, with_text: bool = True, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document, windows judged on all of them.

    Documents enter a log of their own in that many batches; its candidates are the union over the batches' joins.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    runs, tables = common.new_path(spark, "log"), []
    log = WindowLog(spark, runs, most_runs=2)
    for k in range(batches):
        tables.append(log.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), size, run))
    candidates, path = common.materialize(functools.reduce(DataFrame.unionByName, (t for t, _ in tables)).distinct(), "candidates")
    log.drop(*list(log.tables))
    common.delete(spark, runs, *(p for _, p in tables))
    hits, _ = verified(docs, candidates, size, run, most_bits)
    common.delete(spark, path)
    return results(docs, hits, size, with_text, most_bits)


def deduplicate_batch(batch: DataFrame, history: DataFrame, log: WindowLog, size: int = SIZE, run: int = RUN, with_text: bool = True, most_bits: int = MOST_BITS) -> DataFrame:
    """The same for the documents of a new batch alone, judged on it and on history, the documents that are in the log already. The batch enters the log."""
    spark = batch.sparkSession
    common.prepare(spark)
    repeats, before = log.append(batch, size, run)
    candidates, path = common.materialize(repeats.distinct(), "candidates")
    both = batch.select("doc_id", "text").unionByName(history.select("doc_id", "text"))
    hits, _ = verified(both, candidates, size, run, most_bits)
    common.delete(spark, before, path)
    return results(batch, hits, size, with_text, most_bits)


def oracle_sql(size: int = SIZE) -> str:
    """n_words, n_removed and kept_sha256 over documents in DuckDB SQL, from whole windows."""
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
windows AS (SELECT r, i, array_to_string(ws[i : i + {size - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {size - 2})) AS i FROM d WHERE len(ws) >= {size})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM twice CROSS JOIN (SELECT unnest(range({size})) AS k)),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS t, count(*) AS n FROM w LEFT JOIN gone g ON g.r = w.r AND g.i = w.i WHERE g.r IS NULL GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
