import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankloom.llm import common, records, tokens

from .conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n", "a", "the the\tthe", "tail  \n", "<|endoftext|> x<|endoftext|>", "it's 12 o'clock²", "漢字 テスト", "é " * 3000, "x" * 20000, "a b c", "🙂🙂"]


def brute(pairs):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_encoder_equals_library():
    rng, t = random.Random(5), Tokenizer.from_file(PATH)
    encoder = tokens.Encoder(PATH, memo_pieces=50)
    letters = " \n\n  ab'sT'reé9²ª.,!\t ü­ŉ漢🙂$%\x00\x7f\x85"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)] + [x for x in ODD if x]
    for text in texts:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip(spark, extra):
    pairs = [(k * 7 % 50, x) for k, x in enumerate(ODD)] + [(3, "same"), (3, "same"), (3, "other"), (None, "no id")]
    path = common.new_path(spark, "records")
    records.write_records(documents(spark, pairs, extra), path, PATH, shard_bytes=2000)
    got = records.read_records(spark, path)
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == brute(pairs)
    index = {(r.shard, r.offset): r.n_tokens for r in records.read_index(spark, path).collect()}
    assert index == {(r.shard, r.offset): r.n_tokens for r in got.collect()}
    one, two = records.read_shuffled(spark, path, 1).collect(), records.read_shuffled(spark, path, 2).collect()
    assert [r.doc_id for r in one] != [r.doc_id for r in two]
    assert sorted(bytes(r.ids) for r in one) == sorted(bytes(r.ids) for r in got.collect())


def test_empty_table(spark):
    path = common.new_path(spark, "records")
    records.write_records(documents(spark, []).filter(F.lit(False)), path, PATH)
    assert records.read_records(spark, path).collect() == []


def test_damage_is_found():
    data = records.frame(5, np.array([1, 70000], "<u4").tobytes(), 4) + b"\n"
    assert [(i, np.frombuffer(x, "<u4").tolist()) for _, i, x in records.parse(data)] == [(5, [1, 70000])]
    for k in range(len(data)):
        with pytest.raises(records.BrokenRecord):
            list(records.parse(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :]))
    with pytest.raises(records.BrokenRecord):
        list(records.parse(data[:-3]))
