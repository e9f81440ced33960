import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankloom.llm import token_counts

from .conftest import documents
from .test_records import ODD

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("path", [BPE, PIECES])
def test_equals_library(spark, path):
    rng = random.Random(2)
    pairs = [*enumerate(ODD), (3, "same"), (3, "same"), (None, "no id")]
    pairs += [(100 + k, " ".join(rng.choices(["a", "of", "zebra,", "x\n", "naïve"], k=rng.randint(0, 60)))) for k in range(60)]
    if path == BPE:
        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(model.encode(x))
    want = [(i, len((x or "").encode()), count(x or ""), count(x or "") > 20) for i, x in pairs]
    df = token_counts.token_counts(documents(spark, pairs, extra=True), path, limit=20)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_small_blocks_and_empty(spark):
    pairs = [(k, "one two " * k) for k in range(30)]
    found = token_counts.occurrences(documents(spark, pairs), BPE, 8, block_docs=4)
    assert found.filter("bucket < 0").count() >= 8
    names = [x for r in found.filter("bucket >= 0").collect() for x in token_counts.unpack(r.packed)[0]]
    assert set(names) == {b"one", b" two", b" one", b" "}
    assert token_counts.token_counts(documents(spark, []), BPE).collect() == []
