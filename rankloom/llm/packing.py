"""Best-fit packing with certified bin counts.

Texts become pieces of at most ``capacity`` tokens; pieces shorter than that are packed. Items are dealt to
partitions of bounded size, each runs best-fit decreasing, and dual feasible functions give a lower bound on the
bins any packing of its items needs. A partition that meets its bound is certified and final. Of the others, full
bins are final too, and the documents of their open bins are exchanged: dealt anew, over all partitions with a gap,
and packed again, until no gap is left, one partition holds all open items, or ``max_rounds`` have run.

Nulls: a null text is empty, so its piece is the end id alone; null doc_ids are kept. Repeated rows are packed as
often as they occur. Items of one length are packed in order of a number that says where they stood in the input. A
very long text gives as many full pieces as it fills. An empty table gives no rows. Other columns of the input are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common, tokens

CAPACITY = 1024
#: Items that one packing task holds.
ITEMS = 100_000
MAX_ROUNDS = 5
_GROUP_BITS, _BIN_BITS = 32, 26


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if they fit, else full pieces after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and a number of its own for each (uid)."""
    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    last = np.array([end_id], "<u4").tobytes()

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, uid = tokens.encoder(tokenizer), TaskContext.get().partitionId() << 36
        for part in parts:
            out = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                ids = encoder.ids(text) + last
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((None if pd.isna(doc_id) else int(doc_id), k, start, n, tokens.crc(ids[4 * start : 4 * (start + n)]), uid))
                    uid += 1
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "uid"])
            yield frame.assign(doc_id=pd.array([r[0] for r in out], dtype="Int64"))

    return rows.mapInPandas(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, uid long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin.

    Open bins are kept by what is left in them; one bit for each amount finds the tightest bin that takes an item.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left_in: list[int] = []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = by_left[left].pop()
            if not by_left[left]:
                mask &= ~(1 << left)
        else:
            b, left = len(left_in), capacity
            left_in.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        left -= n
        left_in[b] = left
        if left:
            by_left[left].append(b)
            mask |= 1 << left
    return bins, offsets, capacity - np.array(left_in, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of three families of dual feasible functions, in whole numbers.

    A dual feasible function never maps items that fit one bin to a total above 1, so the total over all items,
    rounded up, is a bound. Used: threshold functions (large items to 1, small ones to 0), stair functions that
    round shares down to k-ths, and functions that count the items of a size class that a large item displaces.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    number, area = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    for t in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - t + 1])
        between = int(area[capacity - t + 1] - area[t])
        best = max(best, large + -(-between // capacity))
    for k in range(1, 101):
        shares = (k + 1) * size
        value = np.where(shares % capacity == 0, k * size, capacity * (shares // capacity))  # in (k * capacity)-ths
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    for t in range(1, capacity // 2 + 1):
        most = capacity // t
        value = np.where(2 * size > capacity, most - (capacity - size) // t, np.where(size >= t, 1, 0))  # in most-ths
        best = max(best, -(-int((count * value).sum()) // most))
    return best


def _pack_group(capacity: int, turn: int):
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", kind="stable")
        lengths = part["length"].to_numpy(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        certified = len(fill) == bound
        ids = (turn << (_GROUP_BITS + _BIN_BITS)) | (int(key[0]) << _BIN_BITS) | bins
        return part.assign(sequence_id=ids, offset=offsets, final=certified | (fill[bins] == capacity), bins=np.int64(len(fill)), bound=np.int64(bound))

    return pack


_ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long"
_PACKED = f"grp long, {_ITEM}, sequence_id long, offset long, final boolean, bins long, bound long"


def pack(found: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Pieces (as from ``pieces``) with sequence_id, offset, turn (0: a full piece), and bins and bound of the group it was last packed in.

    found is written to the shared folder first, as its numbers must not change; so is each turn's packing.
    """
    spark = found.sparkSession
    kept, _ = common.materialize(found, "pieces")
    full = kept.filter(F.col("length") == capacity).select(
        *kept.columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("turn"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound")
    )
    done, left = [full], kept.filter(F.col("length") < capacity)
    for turn in range(1, max_rounds + 1):
        n = left.count()
        if not n:
            break
        groups = -(-n // items)
        dealt = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(groups)))
        packed, path = common.materialize(dealt.groupBy("grp").applyInPandas(_pack_group(capacity, turn), _PACKED), f"packed{turn}")
        last = groups == 1 or turn == max_rounds
        own = packed if last else packed.filter("final")
        done.append(own.select(*kept.columns, "sequence_id", "offset", F.lit(turn).alias("turn"), "bins", "bound"))
        if last:
            break
        left = packed.filter(~F.col("final")).select(*kept.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("uid")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID, items: int = ITEMS) -> DataFrame:
    """Tokenise, cut and pack whole texts."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, items)


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences used, and the bound over all pieces from their length counts (capacity counts at most)."""
    counts = {r["length"]: r["n"] for r in packed.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
    used = packed.agg(F.count_distinct("sequence_id").alias("sequences"))
    return used.withColumn("bound", F.lit(lower_bound(lengths, capacity)).cast("long"))
