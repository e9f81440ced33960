import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import packing

from .conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best(lengths, capacity):
    """The fewest bins, by trying all ways."""
    lengths = sorted(lengths, reverse=True)

    def fits(k, bins):
        if k == len(lengths):
            return True
        return any(fits(k + 1, [*bins[:i], b + lengths[k], *bins[i + 1 :]]) for i, b in enumerate(bins) if b + lengths[k] <= capacity and b not in bins[:i])

    n = 1 if lengths else 0
    while not fits(0, [0] * n):
        n += 1
    return n


def test_bound_and_best_fit():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([7, 12, 20, 31])
        lengths = [rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 9))]
        bins, offsets, fill = packing.best_fit_decreasing(np.array(lengths, np.int64), capacity)
        bound, exact = packing.lower_bound(np.array(lengths, np.int64), capacity), best(lengths, capacity)
        assert bound <= exact <= len(fill)
        for b in range(len(fill)):
            own = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
            assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) == fill[b] <= capacity
    assert packing.lower_bound(np.array([6] * 5), 10) == 5
    assert packing.lower_bound(np.array([4] * 5), 10) == 3


def check(rows, pairs, capacity):
    t = Tokenizer.from_file(PATH)
    want = []
    for i, text in pairs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        first = n if n <= capacity else (n % capacity or capacity)
        starts = [0, *range(first, n, capacity)]
        for k, s in enumerate(starts):
            own = ids[s : starts[k + 1] if k + 1 < len(starts) else n]
            want.append((i, k, s, len(own), zlib.crc32(own.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("items", [20, 100_000])
def test_packs_whole_texts(spark, items):
    rng = random.Random(9)
    pairs = [(k, " ".join(rng.choices(["alpha", "of", "zebra,", "x\n"], k=rng.randint(0, 90)))) for k in range(120)]
    pairs += [(5, None), (None, "no id"), (5, ""), (7, "same words"), (7, "same words"), (8, "long " * 700)]
    df = packing.pack_documents(documents(spark, pairs, extra=True), PATH, capacity=64, items=items)
    used = check(df.collect(), pairs, 64)
    row = packing.report(df, 64).first()
    assert row.sequences == used and row.bound <= used <= row.bound * 1.05 + 2


def test_empty(spark):
    assert packing.pack_documents(documents(spark, []), PATH).collect() == []
