"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted similarity.

For a benchmark item of m words, every window of m words of a document that holds one of the item's shingles (five
words; shorter items are one shingle) gets a 64-bit SimHash of its shingles. No other window can be similar at all,
so leaving those out loses nothing. A document of fewer than m words is one window, whole. Fingerprints are looked up
in eight one-byte blocks: an item and a window within ``radius`` (15) bits agree to within one bit in at least one
block, so listing each item under all bytes within one bit of its own finds every pair in the radius, and a quarter of
the others. Pairs within it are verified by weighted shingle similarity: the sum of weight times the smaller count over
that of the larger, at least 0.8. A shingle's weight falls with the number of items that hold it, so that boilerplate
shared by many items counts less. Of windows made from items by one to six edits, 0.990 of those with a similarity of
0.80 to 0.85 lie within the radius, and all with more (measured against the similarity of every pair).

Words are runs of letters and digits in lower case. Items without a word match nothing.

The index of one pass is broadcast. Its size is checked: items are dealt to as many passes as keep each under
``most_chars`` characters of item text (default 8 million), and one item is never larger than that unless its own
text is. Passes run one after another and write what they find, so the driver and the executors hold one index. Weights
are those of the whole benchmark in every pass, counted by one aggregation, so that the number of passes changes no
result. Of a shingle that one item or none holds the weight is the same, so a pass needs the others alone, whichever
items hold them, as they may stand in a window too: 16 bytes each, two words of the benchmark at least.

Nulls: a null text is empty and clean; null doc_ids and repeated rows are kept, one result each; null items are
left out. Items with one id are told apart by text and count as one hit. An empty benchmark makes every document
clean; an empty table gives no rows. Very long texts are read whole, windows some thousands at a time. Extra columns
are not looked at by ``scan`` and kept by ``clean``.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
MOST_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
_MEMO = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < _MEMO:
            self[word] = h
        return h


_hashes = _Hashes()


def shingles(own: list[str], size: int) -> np.ndarray:
    """Hashes of all runs of size words, in order."""
    h = np.fromiter(map(_hashes.__getitem__, own), np.uint64, len(own))
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = (out ^ (h[k : k + n] + np.uint64(k))) * _BASE
        out ^= out >> np.uint64(29)
    return out


def _signs(hashes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1).view("<u8")


class Weights:
    """Weights of shingles in a benchmark of n items, from the shingles that two items or more hold and how many do."""

    def __init__(self, n: int, held: np.ndarray, counts: np.ndarray):
        order = np.argsort(held)
        known, which = np.unique(counts[order], return_inverse=True)
        self.held = held[order]
        self.weights = np.array([math.log1p(n / k) for k in known.tolist()])[which]
        self.rare = math.log1p(n)  # of a shingle that one item or none holds

    def of(self, hashes: list[int]) -> list[float]:
        if not len(self.held):
            return [self.rare] * len(hashes)
        own = np.array(hashes, np.uint64)
        at = np.minimum(np.searchsorted(self.held, own), len(self.held) - 1)
        return np.where(self.held[at] == own, self.weights[at], self.rare).tolist()


class Index:
    """Items by size: shingles, fingerprints and the eight block tables."""

    def __init__(self, items: list[tuple[int, str]], radius: int = RADIUS, whole: Weights | None = None):
        self.radius = radius
        sizes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        holders: Counter = Counter()
        for item_id, text in items:
            own = words(text)
            if own:
                size = min(SHINGLE, len(own))
                found = shingles(own, size)
                sizes[len(own), size].append((item_id, found))
                if whole is None:
                    holders.update(set(found.tolist()))
        if whole is None:
            held = {h: k for h, k in holders.items() if k > 1}
            whole = Weights(sum(map(len, sizes.values())), np.fromiter(held, np.uint64, len(held)), np.fromiter(held.values(), np.int64, len(held)))
        self.weights = whole
        near = [[v for v in range(256) if (v ^ x).bit_count() <= radius // 8] for x in range(256)]
        self.sizes = []
        by_shingle: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, ((m, size), own) in enumerate(sorted(sizes.items())):
            prints = _fingerprints(np.array([_signs(h).sum(axis=0) for _, h in own]))
            blocks = prints.view(np.uint8).reshape(-1, 8)
            lists = []
            for b in range(8):  # each item under every byte near its own: sorted keys, and the items of each
                keys = np.concatenate([near[x] for x in blocks[:, b].tolist()])
                items_ = np.repeat(np.arange(len(own)), [len(near[x]) for x in blocks[:, b].tolist()])
                lists.append((np.searchsorted(np.sort(keys), np.arange(257)), items_[np.argsort(keys, kind="stable")].astype(np.int32)))
            self.sizes.append((m, size, [i for i, _ in own], [Counter(h.tolist()) for _, h in own], prints, lists))
            for _, h in own:
                for x in set(h.tolist()):
                    by_shingle[size][x].append(k)
        self.shingle_sizes = {}
        for size, found in by_shingle.items():
            table = np.zeros(1 << _TABLE_BITS, bool)
            keys = np.array(list(found), np.uint64)
            table[(keys & np.uint64(len(table) - 1)).astype(np.int64)] = True
            self.shingle_sizes[size] = (table, {x: sorted(set(ks)) for x, ks in found.items()})

    def similarity(self, one: Counter, two: Counter) -> float:
        least = most = 0.0
        both = list(one.keys() | two.keys())
        for h, w in zip(both, self.weights.of(both), strict=True):
            a, b = one[h], two[h]
            least += w * min(a, b)
            most += w * max(a, b)
        return least / most

    def find(self, text: str | None, similarity: float = SIMILARITY) -> dict[int, float]:
        """Items that a window of the text is similar to, with the best similarity."""
        own, out = words(text), {}
        for size, (table, holders) in self.shingle_sizes.items():
            if len(own) < size:
                continue
            h = shingles(own, size)
            near = np.flatnonzero(table[(h & np.uint64(len(table) - 1)).astype(np.int64)])
            hits: dict[int, list[int]] = defaultdict(list)
            for p in near.tolist():
                for k in holders.get(int(h[p]), ()):
                    hits[k].append(p)
            for k, at in hits.items():
                self._windows(k, h, np.array(at), similarity, out)
        return out

    @staticmethod
    def candidates(found: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and items that meet in a block's list, each pair once."""
        blocks, pairs = found.view(np.uint8).reshape(-1, 8), []
        for b, (starts, members) in enumerate(lists):
            first, n = starts[blocks[:, b]], np.diff(starts)[blocks[:, b]]
            rows = np.repeat(np.arange(len(found)), n)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            pairs.append(rows.astype(np.int64) << 32 | members[at])
        both = np.unique(np.concatenate(pairs))
        return both >> 32, both & 0xFFFFFFFF

    def _windows(self, k: int, h: np.ndarray, at: np.ndarray, similarity: float, out: dict[int, float]) -> None:
        m, size, ids, counts, prints, lists = self.sizes[k]
        width = min(m - size + 1, len(h))  # shingles of a window; a shorter document is one
        last = len(h) - width
        starts = np.unique((at[:, None] - np.arange(width)).ravel())
        starts = starts[(starts >= 0) & (starts <= last)]
        for part in np.split(starts, range(4096, len(starts), 4096)):
            if not len(part):
                continue
            low, high = int(part[0]), int(part[-1]) + width
            if high - low > 16 * len(part) + 8 * width:  # far apart: one by one is cheaper than all between
                sums = np.array([_signs(h[s : s + width]).sum(axis=0) for s in part.tolist()])
            else:
                total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(h[low:high]), axis=0, dtype=np.int32)])
                sums = total[part - low + width] - total[part - low]
            found = _fingerprints(sums)
            rows, items = self.candidates(found, lists)
            kept = np.bitwise_count(found[rows] ^ prints[items]) <= self.radius
            for r, i in zip(rows[kept].tolist(), items[kept].tolist(), strict=True):
                s = int(part[r])
                value = self.similarity(Counter(h[s : s + width].tolist()), counts[i])
                if value >= similarity and value > out.get(ids[i], 0.0):
                    out[ids[i]] = value


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))


def passes(benchmark: DataFrame, most_chars: int = MOST_CHARS) -> list[Callable[[], Index]]:
    """How to make the index of each pass over the documents; none is made before it is asked for."""
    common.prepare(benchmark.sparkSession)
    items = _items(benchmark)
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-2 * chars // most_chars)) if chars > most_chars else 1
    whole = weights(items) if n > 1 else None

    def make(k: int) -> Index:
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        return Index(sorted((r["item_id"], r["text"]) for r in own.collect()), whole=whole)

    return [functools.partial(make, k) for k in range(n)]


def weights(items: DataFrame) -> Weights:
    """Weights over all items, counted where the items are; only shingles of two items or more reach the driver."""

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text in part["text"]:  # item by item: a batch of long texts needs no more room than one
                found = words(text)
                if found:
                    yield pd.DataFrame({"h": np.unique(shingles(found, min(SHINGLE, len(found)))).view(np.int64)})

    n = items.filter(F.pandas_udf(lambda t: t.map(lambda x: bool(words(x))).astype(bool), "boolean")("text")).count()
    held = items.mapInPandas(own, "h long").groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").toArrow()
    return Weights(n, held.column("h").to_numpy().view(np.uint64), held.column("k").to_numpy())


def scan(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_chars: int = MOST_CHARS) -> DataFrame:
    """doc_id, n_items, item_ids (comma-joined, in order), best_similarity, contaminated of every document.

    Several passes write what each finds, so that one index at a time is held by the driver and the executors.
    """
    spark = docs.sparkSession
    todo = passes(benchmark, most_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    kinds = "item_ids array<long>, similarities array<double>"

    def look(sent, rows: DataFrame, key: str) -> DataFrame:
        def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                hits = [sorted(sent.value.find(t, similarity).items()) for t in part["text"]]
                yield pd.DataFrame({key: part[key], "item_ids": [[i for i, _ in x] for x in hits], "similarities": [[round(s, 6) for _, s in x] for x in hits]})

        return rows.mapInPandas(find, f"{key} long, {kinds}")

    if len(todo) == 1:
        found = look(spark.sparkContext.broadcast(todo[0]()), rows, "doc_id")
    else:
        rows, _ = common.materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts")  # a number ties the passes of a row together
        hits = None
        for make in todo:
            sent = spark.sparkContext.broadcast(make())
            own, _ = common.materialize(look(sent, rows.select("row", "text"), "row").filter(F.size("item_ids") > 0), "hits")
            sent.destroy()
            hits = own if hits is None else hits.unionByName(own)
        hits = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"), F.flatten(F.collect_list("similarities")).alias("similarities"))
        none = F.array().cast("array<long>"), F.array().cast("array<double>")
        found = rows.select("row", "doc_id").join(hits, "row", "left").select("doc_id", F.coalesce("item_ids", none[0]).alias("item_ids"), F.coalesce("similarities", none[1]).alias("similarities"))
    return found.select(
        "doc_id",
        F.size("item_ids").cast("long").alias("n_items"),
        F.array_join(F.array_sort("item_ids").cast("array<string>"), ",").alias("item_ids"),
        F.coalesce(F.array_max("similarities"), F.lit(0.0)).alias("best_similarity"),
        (F.size("item_ids") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_chars: int = MOST_CHARS) -> DataFrame:
    """docs without contaminated documents; all columns stay. Several passes write what each leaves."""
    sparkcontext, todo = docs.sparkSession.sparkContext, passes(benchmark, most_chars)

    def condition(sent) -> Column:
        def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                yield pd.Series([not sent.value.find(t, similarity) for t in part], dtype=bool)

        return F.pandas_udf(judge, "boolean")(F.col("text"))

    if len(todo) == 1:
        return docs.filter(condition(sparkcontext.broadcast(todo[0]())))
    before = None
    for make in todo:
        sent = sparkcontext.broadcast(make())
        docs, path = common.materialize(docs.filter(condition(sent)), "clean")
        sent.destroy()
        if before is not None:
            common.delete(docs.sparkSession, before)
        before = path
    return docs
