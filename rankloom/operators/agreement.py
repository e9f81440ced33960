"""Classification reports and agreement between judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.operators import evaluation
from rankloom.operators.guards import GuardError, require_none

LABELS = ("Good Fit", "Potential Fit", "No Fit")


def binary(label: Column) -> Column:
    return F.when(label.isin("Good Fit", "Potential Fit"), "relevant").when(label.isNotNull(), "not relevant")


def confusion(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """truth, predicted, n for all pairs of labels, zeros kept."""
    spark = pairs.sparkSession
    require_none(pairs.filter(~F.col("truth").isin(*labels) | ~F.col("predicted").isin(*labels)).select("truth", "predicted"), "label outside the scheme")
    cells = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    return cells.join(pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n")), ["truth", "predicted"], "left").fillna(0, ["n"])


def report(cells: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support from a confusion table; undefined ratios are 0."""
    rows = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    out = rows.join(cells.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called")), "label")
    p = F.when(F.col("called") == 0, 0.0).otherwise(F.col("tp") / F.col("called"))
    r = F.when(F.col("support") == 0, 0.0).otherwise(F.col("tp") / F.col("support"))
    f = F.when(F.col("called") + F.col("support") == 0, 0.0).otherwise(2 * F.col("tp") / (F.col("called") + F.col("support")))
    return out.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), "support")


def overall(cells: DataFrame) -> DataFrame:
    """accuracy, macro_f1, n."""
    n = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    if not n.first()["n"]:
        raise GuardError("a report needs at least one pair")
    return report(cells).agg(F.round(F.avg("f1"), 6).alias("macro_f1")).crossJoin(n).select(F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), "macro_f1", "n")


def majority_floor(labelled: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """label, accuracy, macro_f1 of always answering the most common label; ties go to label order."""
    place: Column = F.lit(len(labels))
    for k, name in enumerate(labels):
        place = F.when(F.col("label") == name, k).otherwise(place)
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).withColumn("_all", F.sum("n").over(W.partitionBy(F.lit(0))))
    share = F.col("n") / F.col("_all")
    return counts.orderBy(F.desc("n"), place).limit(1).select("label", F.round(share, 6).alias("accuracy"), F.round(2 * share / (1 + share) / len(labels), 6).alias("macro_f1"))


def kappa(both: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, n, agreement, kappa of columns a and b; kappa is null where chance agreement is total."""
    by = by or []
    n = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    one, two = both.groupBy(*by, F.col("a").alias("label")).agg(F.count("*").alias("na")), both.groupBy(*by, F.col("b").alias("label")).agg(F.count("*").alias("nb"))
    chance = one.join(two, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("pe"))
    joined = n.join(chance, by, "left") if by else n.crossJoin(F.broadcast(chance))
    pe = F.coalesce("pe", F.lit(0)) / (F.col("n") * F.col("n"))
    return joined.select(*by, "n", F.round("po", 6).alias("agreement"), F.round(F.when(pe < 1, (F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


def _codes(a: Column, b: Column, labels: tuple[str, ...]) -> Column:
    place = lambda x: F.array_position(F.array(*map(F.lit, labels)), x).cast("int") - 1
    return F.when(place(a) >= 0, place(a) * len(labels) + place(b))


def kappa_interval(both: DataFrame, by: list[str], unit: str, labels: tuple[str, ...] = LABELS, draws: int = 2000, seed: int = 0) -> DataFrame:
    """by, n, agreement, kappa, ci_low, ci_high of columns a and b, resampling pairs; draws in which both sides are constant are left out."""
    k = len(labels)
    coded = both.select(*by, F.col(unit).alias("unit"), _codes(F.col("a"), F.col("b"), labels).alias("code"))
    counted = evaluation.resampled_counts(coded, by, "unit", "code", k * k, draws, seed)
    rows = [sum((F.col("c")[i * k + j] for j in range(k)), F.lit(0)) for i in range(k)]
    cols = [sum((F.col("c")[i * k + j] for i in range(k)), F.lit(0)) for j in range(k)]
    n = F.col("n")
    po, pe = sum((F.col("c")[i * (k + 1)] for i in range(k)), F.lit(0)) / n, sum((r * c for r, c in zip(rows, cols, strict=True)), F.lit(0)) / (n * n)
    constant = (F.greatest(*rows) == n) & (F.greatest(*cols) == n)
    kept = counted.filter(~constant).select(*by, F.when(pe < 1, (po - pe) / (1 - pe)).alias("k"))
    found = evaluation.interval(kept, by, "k", 5)
    return kappa(both, by).join(found, by, "left") if by else kappa(both).crossJoin(found)


def majority(votes: DataFrame, key: str) -> DataFrame:
    """key, label, n_votes: the most common label, null on a tie of the first two."""
    counts = votes.groupBy(key, "label").agg(F.count("*").alias("n"))
    spec = W.partitionBy(key).orderBy(F.desc("n"), "label")
    ranked = counts.withColumn("rn", F.row_number().over(spec)).withColumn("second", F.lead("n").over(spec)).withColumn("n_votes", F.sum("n").over(W.partitionBy(key)))
    return ranked.filter("rn = 1").select(key, F.when(F.col("second").isNull() | (F.col("second") < F.col("n")), F.col("label")).alias("label"), "n_votes")


def classwise(both: DataFrame) -> DataFrame:
    """label (of a), n, agreement."""
    return both.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"))


def fleiss(votes: DataFrame, item: str) -> DataFrame:
    """items, raters, kappa for three or more raters who all judged every item."""
    counts = votes.groupBy(item, "label").agg(F.count("*").alias("n"))
    per = counts.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("s")).withColumn("p", (F.col("s") - F.col("r")) / (F.col("r") * (F.col("r") - 1)))
    total = counts.groupBy("label").agg(F.sum("n").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))
    pe = total.agg(F.sum(F.col("share") * F.col("share")).alias("pe"))
    return per.agg(F.count("*").alias("items"), F.max("r").alias("raters"), F.avg("p").alias("po")).crossJoin(pe).select("items", "raters", F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


def fit_label_model(scored: DataFrame, labels: tuple[str, ...] = LABELS, rounds: int = 5000):
    """Balanced multinomial logistic regression of label on score; raises if it has not converged."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    number = F.lit(None).cast("double")
    for k, name in enumerate(labels):
        number = F.when(F.col("label") == name, float(k)).otherwise(number)
    counts = scored.groupBy("label").agg(F.count("*").alias("_c"))
    n = scored.count()
    weighed = scored.join(F.broadcast(counts), "label").withColumn("_weight", n / (len(labels) * F.col("_c"))).withColumn("_y", number)
    ready = VectorAssembler(inputCols=["score"], outputCol="_x").transform(weighed)
    model = LogisticRegression(family="multinomial", featuresCol="_x", labelCol="_y", weightCol="_weight", regParam=1.0 / n, standardization=False, tol=1e-9, maxIter=rounds).fit(ready)
    if model.summary.totalIterations >= rounds:
        raise GuardError("the label model has not converged")
    return model


def apply_rule(scored: DataFrame, coefficients: dict[str, tuple[float, float]]) -> DataFrame:
    """query_id, doc_id, score, predicted by stored coefficients (intercept, slope) of each label: the largest margin, ties in order."""
    margins = F.array(*(F.struct((F.lit(a) + F.lit(b) * F.col("score")).alias("m"), F.lit(-k).alias("p"), F.lit(name).alias("label")) for k, (name, (a, b)) in enumerate(coefficients.items())))
    return scored.select("query_id", "doc_id", "score", F.array_max(margins)["label"].alias("predicted"))


def predict_label(model, scored: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    out = model.transform(VectorAssembler(inputCols=["score"], outputCol="_x").transform(scored))
    name = F.lit(None).cast("string")
    for k, label in enumerate(labels):
        name = F.when(F.col("prediction") == float(k), label).otherwise(name)
    return out.select("query_id", "doc_id", "score", name.alias("predicted"))
