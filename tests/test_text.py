import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rankloom.functions import order, text


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw", ["a  b\n c", " x y ", "", "Case Stays"])
def test_identity(spark, raw):
    want = re.sub(r"\s+", " ", raw).strip()
    assert one(spark, text.normalise(F.col("t")), t=raw) == want
    assert one(spark, text.mint_id(F.col("t"), "r_"), t=raw) == "r_" + hashlib.sha256(want.encode()).hexdigest()[:12]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), t="Café a тест x1 B2_ -- I") == ["café", "тест", "x1", "b2_"]
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_skills_repeat_as_blocks_in_family_order(spark):
    assert one(spark, text.skills(F.col("t")), t="Git with Java and python, REST; c++ and c++11") == "java python c++ java python c++ rest rest git git"
    assert one(spark, text.augment(F.col("t")), t="nothing here") == "nothing here "


@pytest.mark.parametrize(
    ("raw", "has"),
    [
        ("reach me at a.b+c@example.co.uk", "[EMAIL]"), ("call +380 44 123 4567 any time", "[PHONE]"), ("portfolio at https://jane.dev/cv", "[URL]"), ("employee id 123456789", "[NUMBER]"),
        ("5 years experience, 2019-2024, Python 3.12", "5 years"), ("5 years experience, 2019-2024, Python 3.12", "Python 3.12"),
    ],
)
def test_redaction(spark, raw, has):
    once = one(spark, text.redact(F.col("t")), t=raw)
    assert has in once and one(spark, text.redact(F.col("t")), t=once) == once
    assert all(one(spark, c, t=once) == 0 for c in text.residuals(F.col("t")).values())


def test_small_functions(spark):
    assert one(spark, text.assemble(F.col("a"), F.lit(None).cast("string"), F.col("b"), F.lit("  ")), a=" x ", b="y\n\n\n\nz") == "x\n\ny\n\nz"
    assert one(spark, text.parse_list(F.col("t")), t="['a', 'b']") == ["a", "b"] and one(spark, text.parse_list(F.col("t")), t="junk") == []
    assert [one(spark, text.experience_band(F.col("y")), y=y) for y in (0.5, 3.0, 6.0, 7.0)] == ["0-1", "2-3", "4-6", "7+"]
    assert one(spark, text.query_band(F.col("c")), c="5y") == "4-6" and one(spark, text.query_band(F.col("c")), c="9y") is None
    assert one(spark, text.truthy(F.col("t")), t="True") and not one(spark, text.truthy(F.col("t")), t="no")
    assert one(spark, text.stratum(F.array())) == "generic" and one(spark, text.stratum(F.array(F.lit("x")))) == "targeted"
    assert one(spark, text.plain(F.col("t")), t="A-b  C!") == "a b c"


def test_hash_orders(spark):
    h = hashlib.sha256(b"0|p__q").hexdigest()
    assert one(spark, order.doubly(F.col("p"), 0.3, 0), p="p__q") == (int(h[:16], 16) % 10000 < 3000)
    assert one(spark, order.group_order(F.col("p")), p="p__q") == int(h[:12], 16)
    assert one(spark, order.opaque_id(F.lit("a1"), F.col("p")), p="x") == "q_" + hashlib.sha256(b"a1|x").hexdigest()[:12]
