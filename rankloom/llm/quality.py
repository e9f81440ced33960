"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a set of hashed tokens: words in lower case, punctuation runs, and steps of a few shape shares (capitals,
immediate repeats, repeated lines, symbol endings). One weight vector is shared by all grades; ordered thresholds
turn the sum of a text's weights s into P(grade <= k) = logistic(threshold[k] - s). That gives the expected grade
and the tail probability of the top grades, which selects.

The fit takes at most ``most_labels`` labelled rows (default 12,000), the first by a hash of their id, and brings
their token sets, not their texts, to the driver: about 15 MB. Everything else covers all documents and whole texts.

Nulls: a label without doc_id or without quality is not used; a null toxic counts as 0. A null text is empty and is
scored by the thresholds alone. Without any usable label no probability is given and every document is kept.
Repeated rows and null doc_ids give one result each; ratings of one document that differ count as the lowest, and of
texts with one id the one with the smallest token set in byte order is fitted. A text of any length is one token set,
scored whole. Extra columns are not looked at by ``score`` and play no part in ``kept``. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

GRADES = 3
#: Grades from labels: 0 toxic, 1 poor, 2 good.
MOST_LABELS = 12_000
DIMENSIONS = 1 << 18
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_STEPS = (0.05, 0.1, 0.2, 0.4, 0.7)
_MEMO = 300_000


def tokens_of(text: str | None) -> set[str]:
    """The token set of a whole text."""
    if not text:
        return set()
    out = set(_TOKEN.findall(text.lower()))
    own = text.split()
    lines = [x for x in text.split("\n") if x]
    n = max(1, len(own))
    shares = {
        "capitals": sum(map(str.isupper, own)) / n,
        "repeats": sum(a == b for a, b in zip(own, own[1:], strict=False)) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "symbols": sum(not w[-1].isalnum() and w[-1] not in ".,;:?" for w in own) / n,
    }
    out.update(f"<{name} {step}>" for name, share in shares.items() for step in _STEPS if share > step)
    return out


class _Places(dict):
    def __missing__(self, token: str) -> int:
        place = zlib.crc32(token.encode("utf-8", "surrogatepass")) % DIMENSIONS
        if len(self) < _MEMO:
            self[token] = place
        return place


_places = _Places()


def features(text: str | None) -> np.ndarray:
    """Places of a text's tokens, each once, in order."""
    return np.array(sorted(set(map(_places.__getitem__, tokens_of(text)))), np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1 ... top."""
        s = float(self.weights[features(text)].sum(dtype=np.float64))
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -40, 40)))


def fit(found: list[np.ndarray], grades: np.ndarray, least_docs: int = 10, ridge: float = 1e-3, rounds: int = 400, rate: float = 0.1) -> Model:
    """Maximum likelihood with a ridge on the weights, by full-batch Adam; tokens of fewer than least_docs rows get no weight.

    The first threshold and the logarithms of the gaps are free, so the thresholds stay in order.
    """
    n, top = len(found), GRADES - 1
    column = np.concatenate(found)
    row = np.repeat(np.arange(n), [len(x) for x in found])
    often = np.bincount(column, minlength=DIMENSIONS) >= least_docs
    used = often[column]
    places, column = np.unique(column[used], return_inverse=True)
    row = row[used]
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1]
    share /= n + GRADES
    start = np.log(share / (1 - share))
    shape = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    weights = np.zeros(len(places))
    state = [(x, np.zeros_like(x), np.zeros_like(x)) for x in (weights, shape)]
    rows = np.arange(n)
    thresholds = start
    for turn in range(1, rounds + 1):
        thresholds = shape[0] + np.concatenate([[0.0], np.cumsum(np.exp(shape[1:]))])
        s = np.bincount(row, weights[column], n)
        below = np.zeros((n, GRADES + 1))
        below[:, -1] = 1
        below[:, 1:-1] = 1 / (1 + np.exp(-np.clip(thresholds - s[:, None], -40, 40)))
        slope = below * (1 - below)
        upper, lower = slope[rows, grades + 1], slope[rows, grades]
        likely = np.maximum(below[rows, grades + 1] - below[rows, grades], 1e-12)
        to_weights = np.bincount(column, ((upper - lower) / likely)[row], len(places)) / n + ridge * weights
        to_thresholds = np.array([(lower / likely)[grades == k + 1].sum() - (upper / likely)[grades == k].sum() for k in range(top)]) / n
        to_shape = np.array([to_thresholds.sum(), *(np.exp(shape[k]) * to_thresholds[k:].sum() for k in range(1, top))])
        for (x, mean, square), slope_of in zip(state, (to_weights, to_shape), strict=True):
            mean += 0.1 * (slope_of - mean)
            square += 0.001 * (slope_of**2 - square)
            x -= rate * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
    whole = np.zeros(DIMENSIONS, np.float32)
    whole[places] = weights
    return Model(whole, thresholds.copy())


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade; of several ratings of one document the lowest."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Model | None:
    """Fit on at most most_labels rated documents; None without any."""
    common.prepare(docs.sparkSession)
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)

    def extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(places=[features(t).tobytes() for t in part.pop("text")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    rated = rows.join(F.broadcast(sample), "doc_id").mapInPandas(extract, "doc_id long, grade int, places binary")  # most_labels rows at most are broadcast
    rated = rated.groupBy("doc_id", "grade").agg(F.min("places").alias("places"))  # one of repeated ids
    found = rated.toArrow().sort_by("doc_id")
    if not found.num_rows:
        return None
    return fit([np.frombuffer(x, np.int32) for x in found.column("places").to_pylist()], found.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model | None, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top (the tail probability of the top grade), kept, of every document."""
    common.prepare(docs.sparkSession)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("expected_grade"), none.alias("p_top"), F.lit(True).alias("kept"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte, whatever the data

    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            tails = np.array([sent.value.tails(t) for t in part["text"]]).reshape(-1, GRADES - 1)
            yield pd.DataFrame({"doc_id": part["doc_id"], "expected_grade": tails.sum(axis=1).round(6), "p_top": tails[:, -1].round(6), "kept": tails[:, -1] >= least_tail})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    return rows.mapInPandas(apply, "doc_id long, expected_grade double, p_top double, kept boolean")


def kept(model: Model | None, docs: DataFrame, least_tail: float = 0.5) -> Column:
    """Whether the classifier keeps a row, as a column over text."""
    common.prepare(docs.sparkSession)
    if model is None:
        return F.lit(True)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([bool(sent.value.tails(t)[-1] >= least_tail) for t in part], dtype=bool)

    return F.pandas_udf(judge, "boolean")(F.col("text"))
