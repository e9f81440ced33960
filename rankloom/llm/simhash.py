"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits share at least
five of them, so the index need only bring together pairs that agree on four bytes, if every choice of three
differing bytes leaves one of the indexed groups of four untouched. The fourteen blocks of the quadruple system on
eight points do that with the fewest groups: every three points lie in exactly one block, and the complement of a
block is a block. A list of a block has every pair that shares its four bytes, so each pair starts with a tally of
four (and the other bytes that the whole list shares). The list's other byte positions have postings of their own:
reading a fingerprint's four postings tallies its further matches, and only pairs that reach the guaranteed minimum of
five are retained and verified by their differing bits. The rest of the list is never looked at.

Links only matter for components, so a posting list gives a spanning forest of its links: never more edges than
fingerprints, whatever the size of a group of copies. A list of more than ``most`` fingerprints is indexed once more
by the same fourteen blocks over the nibbles of its other four bytes, which leaves 16 free bits, so no list that one
task holds exceeds 65,536 distinct fingerprints.

Nulls: a null or blank text has fingerprint zero and links like any other; null doc_ids are kept and count as no
candidate for the smallest id of a component. Repeated rows give one result each. An empty table gives no rows. A very
long text is hashed whole, its bits counted in slices. ``deduplicate`` keeps the document with the smallest id of each
component, of several with that id the one whose text has the smallest hash, and of rows equal in both the one whose
columns have the smallest hash; all its columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common, graph

MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
#: Fingerprints in one posting list before it is indexed again.
MOST = 65_536


def _quadruples() -> list[tuple[int, ...]]:
    """The fourteen blocks: four of the eight points of binary 3-space whose labels sum to zero."""
    return [q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


BLOCKS = _quadruples()


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of the 3-word shingles of a text in lower case (A-Z only), repeats included."""
    own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not own:
        return 0
    joined = b" ".join(own)
    digest = xxhash.xxh64_intdigest
    if len(own) <= 3:
        return digest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = [0, *ends[:-3].tolist()]
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)], "<u8")
    # Count set bits in slices, so that a very long text needs no more room than a short one.
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp (signed) of every document."""

    def compute(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "text_hash": part["text_hash"], "fp": np.array([_signed(fingerprint(t)) for t in part["text"]], np.int64)})

    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), common.text_or_empty().alias("text"))
    return rows.mapInPandas(compute, "doc_id long, text_hash long, fp long")


def _part(fp: Column, bits: int, positions: tuple[int, ...]) -> Column:
    """The fields of that many bits at the given positions, side by side."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(positions):
        field = F.shiftrightunsigned(fp, bits * p).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(field, bits * k))
    return out


def postings(fps: DataFrame) -> DataFrame:
    """key, rest, fp: fourteen postings for each distinct fingerprint; rest is what the block leaves out."""
    ways = [
        F.struct((F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(_part(F.col("fp"), 8, q))).alias("key"), _part(F.col("fp"), 8, tuple(p for p in range(8) if p not in q)).alias("rest"))
        for k, q in enumerate(BLOCKS)
    ]
    return fps.select("fp", F.explode(F.array(*ways)).alias("w")).select("w.key", "w.rest", "fp")


def refined(found: DataFrame) -> DataFrame:
    """Postings of too long lists, indexed again over the nibbles of rest."""
    ways = [F.struct(F.lit(k).cast("long").alias("way"), _part(F.col("rest"), 4, q).alias("more")) for k, q in enumerate(BLOCKS)]
    deeper = found.select("key", "fp", F.explode(F.array(*ways)).alias("w"))
    # 36 bits of key, 16 of nibbles and 4 of way fill 56.
    return deeper.select(F.shiftleft("key", 20).bitwiseOR(F.shiftleft("w.way", 16)).bitwiseOR(F.col("w.more")).alias("key"), "fp")


class Postings:
    """The members of one list by byte position and byte, for the positions where they differ."""

    def __init__(self, own: np.ndarray):
        self.own, self.bytes = own, own.view(np.uint8).reshape(-1, 8)
        self.free = np.flatnonzero((self.bytes != self.bytes[0]).any(axis=0)).tolist()
        self.common = 8 - len(self.free)  # positions that all members share
        self.members = [np.argsort(self.bytes[:, p], kind="stable") for p in self.free]
        self.starts = [np.searchsorted(self.bytes[m, p], np.arange(257)) for p, m in zip(self.free, self.members, strict=True)]

    def linked(self, one: int, left: np.ndarray) -> np.ndarray:
        """Members that are left and link to one: tally of shared positions by count filter, then differing bits."""
        if self.common >= MIN_SHARED:
            found = np.flatnonzero(left)
        else:
            mine = self.bytes[one].tolist()
            matches = np.concatenate([m[s[mine[p]] : s[mine[p] + 1]] for p, m, s in zip(self.free, self.members, self.starts, strict=True)])
            matches = matches[left[matches]]
            if self.common == MIN_SHARED - 1:  # one more match is enough
                found = np.unique(matches)
            else:
                found, tally = np.unique(matches, return_counts=True)
                found = found[tally + self.common >= MIN_SHARED]
        return found[np.bitwise_count(self.own[found] ^ self.own[one]) <= MAX_BITS]


def forest(own: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one list: a node is compared with the unreached ones alone."""
    edges = []
    if len(own) == 2:
        one, two = own.tolist()
        return [(_signed(one), _signed(two))] if (one ^ two).bit_count() <= MAX_BITS else []
    postings_, left = Postings(own), np.ones(len(own), bool)
    for first in range(len(own)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            node = queue.pop()
            hit = postings_.linked(node, left)
            left[hit] = False
            queue += hit.tolist()
            edges += [(_signed(int(own[node])), _signed(int(own[x]))) for x in hit]
    return edges


def _forests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of all lists of a task, whose rows come in order of key."""

    def batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    held_keys, held = np.empty(0, np.int64), np.empty(0, np.uint64)
    edges: list[tuple[int, int]] = []
    for part in parts:
        keys = np.concatenate([held_keys, part.column("key").to_numpy()])
        fps = np.concatenate([held, part.column("fp").to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        edges += _edges(keys[:last], fps[:last])
        held_keys, held = keys[last:], fps[last:]
        if len(edges) > 50_000:
            yield batch(edges)
            edges = []
    edges += _edges(held_keys, held)
    if edges:
        yield batch(edges)


def _edges(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    if len(keys) < 2:
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
    out = []
    for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
        out += forest(np.unique(fps[cuts[k] : cuts[k + 1]]))
    return out


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """u, v: forest edges that connect exactly the fingerprints that links connect, from distinct fingerprints."""
    spark = fps.sparkSession
    n = common.shuffle_partitions(spark)
    found = postings(fps)
    long, _ = common.materialize(found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "long_lists")
    if long.isEmpty():
        dealt = found.select("key", "fp")
    else:
        dealt = found.join(long, "key", "left_anti").select("key", "fp").unionByName(refined(found.join(long, "key", "left_semi")))
    return dealt.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_forests, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, text_hash, fp, root (of the component) and component_id (the smallest doc_id reachable) of every document."""
    rows, _ = common.materialize(with_fingerprint(docs), "fingerprints")
    nodes, _ = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = graph.components(links(nodes.select("fp"), most))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids, _ = common.materialize(rooted.join(smallest, "root").select("fp", "root", "component_id"), "component_ids")
    return rows.join(ids, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; of equal ids and texts, the row whose columns have the smallest hash. All columns stay."""
    key, own, row = common.free_name(docs, "text_key"), common.free_name(docs, "id_key"), common.free_name(docs, "whole_row")
    none = F.lit(-(1 << 63)).cast("long")
    found = near_duplicates(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    picked = found.groupBy("root").agg(best.alias("p")).select(F.coalesce("p.doc_id", none).alias(own), F.col("p.text_hash").alias(key))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias(own), F.xxhash64(F.col("text").cast("string")).alias(key), F.struct(*columns).alias(row))
    kept = keyed.join(picked, [own, key], "left_semi").groupBy(own, key).agg(F.min_by(row, F.xxhash64(row)).alias(row))
    return kept.select(f"{row}.*")
