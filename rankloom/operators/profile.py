"""Profile aggregates of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text


def frequencies(df: DataFrame, *by: str, top: int | None = None) -> DataFrame:
    """by, n, share of all rows; the most frequent first if top is given."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = out.agg(F.sum("n").alias("_all"))  # one row
    out = out.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")
    return out if top is None else out.orderBy(F.desc("n"), *by).limit(top)


def label_counts(df: DataFrame, by: str, label: str, labels: tuple[str, ...]) -> DataFrame:
    """by, place, label, n: every label of a fixed order for every value of by, zeros kept."""
    names = df.sparkSession.createDataFrame(list(enumerate(labels)), f"place int, {label} string")
    every = df.select(by).distinct().crossJoin(F.broadcast(names))  # a handful of labels
    return every.join(df.groupBy(by, label).agg(F.count("*").alias("n")), [by, label], "left").fillna(0, ["n"])


def containing(df: DataFrame, column: str, literal: str) -> DataFrame:
    """Rows whose text has a literal, taken as it stands."""
    return df.filter(F.contains(F.col(column), F.lit(literal)))


def distinct_matches(df: DataFrame, column: str, patterns: dict[str, str]) -> DataFrame:
    """name, n: distinct matches of each pattern over all texts."""
    found = F.array(*(F.struct(F.lit(k).alias("name"), F.regexp_extract_all(F.col(column), F.lit(p), 0).alias("m")) for k, p in patterns.items()))
    each = df.select(F.explode(found).alias("f")).select("f.name", F.explode("f.m").alias("m")).groupBy("name").agg(F.count_distinct("m").alias("n"))
    names = df.sparkSession.createDataFrame([(k,) for k in patterns], "name string")
    return names.join(each, "name", "left").fillna(0, ["n"])


def length_statistics(df: DataFrame, column: str, *by: str) -> DataFrame:
    """by, n, distinct texts, min, max, mean, whole median and linear quartiles of lengths."""
    n = F.length(column)
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("mean_chars"),
        F.floor(F.median(n)).cast("long").alias("median_chars"), q.alias("_q"),
    )
    return out.select(*by, "n", "n_distinct", "min_chars", "max_chars", "mean_chars", "median_chars", *(F.col("_q")[k].alias(f"q{25 * (k + 1)}") for k in range(3)))


def token_counts(df: DataFrame, column: str, *by: str) -> DataFrame:
    """by, documents, tokens, distinct tokens."""
    words = df.select(*by, text.tokens(F.col(column)).alias("_t"))
    totals = words.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(F.size("_t")).alias("n_tokens"))
    distinct = words.select(*by, F.explode("_t").alias("t")).groupBy(*by).agg(F.count_distinct("t").alias("n_distinct"))
    return totals.join(distinct, list(by), "left").fillna(0, ["n_distinct"])


def long_text_columns(df: DataFrame, least: float = 200) -> list[str]:
    """String columns whose median length is at least that: one aggregate over all of them."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    row = df.agg(*(F.median(F.length(c)).alias(c) for c in names)).first() if names else None
    return [c for c in names if row and row[c] is not None and row[c] >= least]


def tag_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of B, I and O prefixes of tags in an array column."""
    tags = df.select(F.explode(column).alias("tag")).select(F.substring("tag", 1, 1).alias("p"))
    return tags.agg(*(F.count_if(F.col("p") == k).alias(f"n_{k.lower()}") for k in "BIO"), F.count("*").alias("n"))


def list_frequencies(df: DataFrame, cell: str, top: int) -> DataFrame:
    """The most frequent strings of a list written as text."""
    return df.select(F.explode(text.parse_list(F.col(cell))).alias("item")).groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top)


def span_problems(df: DataFrame, content: str, spans: str) -> DataFrame:
    """label, n, n_broken: spans whose text differs from the content at their offsets (end included), once both are stripped."""
    each = df.select(content, F.explode(spans).alias("s")).select(content, "s.label", F.col("s.start").alias("a"), F.col("s.end").alias("b"), F.col("s.text").alias("t"))
    found = F.substr(F.col(content), F.col("a") + 1, F.col("b") - F.col("a") + 1)
    return each.groupBy("label").agg(F.count("*").alias("n"), F.count_if(text.strip(found) != text.strip(F.col("t"))).alias("n_broken"))


def repaired_spans(df: DataFrame, content: str, spans: str, near: int = 8) -> DataFrame:
    """content, label, start, end, text, status of each span: ok where its stripped text stands at its offsets (end included), moved to where it stands within a few characters, or lost."""
    each = df.select(content, F.explode(spans).alias("s")).select(content, "s.label", F.col("s.start").alias("a"), F.col("s.end").alias("b"), text.strip(F.col("s.text")).alias("text"))
    here = text.strip(F.substr(F.col(content), F.col("a") + 1, F.col("b") - F.col("a") + 1)) == F.col("text")
    low = F.greatest(F.col("a") - near, F.lit(0))
    found = F.instr(F.substr(F.col(content), low + 1, F.length("text") + 2 * near), F.col("text"))
    status = F.when(here, "ok").when(found > 0, "moved").otherwise("lost")
    start = F.when(here, F.col("a")).when(found > 0, low + found - 1)
    end = F.when(here, F.col("b")).when(found > 0, low + found - 2 + F.length("text"))
    return each.select(content, "label", start.cast("int").alias("start"), end.cast("int").alias("end"), "text", status.alias("status"))


def bio_tags(df: DataFrame, content: str, spans: str) -> DataFrame:
    """content, tokens, tags: words between white space, tagged B-, I- or O by the first span (label, start, end included) that they overlap."""
    words = F.regexp_extract_all(F.col(content), F.lit(r"\S+"), 0)
    placed = df.select(content, spans, text.once(words).alias("tokens"))
    # A word starts where the gaps and words before it end.
    gaps = F.split(F.col(content), r"\S+")
    step = F.aggregate(
        F.sequence(F.lit(0), F.size("tokens") - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda s, i: F.struct((s["at"] + F.length(F.get(gaps, i)) + F.length(F.get("tokens", i))).alias("at"), F.concat(s["starts"], F.array(s["at"] + F.length(F.get(gaps, i)))).alias("starts")),
    )
    placed = placed.withColumn("starts", F.when(F.size("tokens") > 0, step["starts"]).otherwise(F.array().cast("array<int>")))

    def tag(word: Column, start: Column) -> Column:
        over = F.filter(F.col(spans), lambda x: (x["start"] < start + F.length(word)) & (x["end"] >= start))
        first = F.get(over, F.lit(0))
        return F.when(F.size(over) == 0, "O").when(first["start"] >= start, F.concat(F.lit("B-"), first["label"])).otherwise(F.concat(F.lit("I-"), first["label"]))

    return placed.select(content, "tokens", F.zip_with("tokens", "starts", tag).alias("tags"))


def residual_counts(df: DataFrame, column: str) -> DataFrame:
    """Matches that should not survive redaction, by class, over all texts."""
    return df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{name}") for name, c in text.residuals(F.col(column)).items()))


def html_tags(df: DataFrame, column: str) -> DataFrame:
    """tag, n: names in angle brackets, taken literally as they stand."""
    names = F.regexp_extract_all(F.col(column), F.lit("<(/?[a-zA-Z0-9]+)"), 1)
    return df.select(F.explode(names).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def label_statistics(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), F.round(F.avg(value), 5).alias("mean"), F.round(F.median(value), 5).alias("median"), F.round(F.stddev_samp(value), 5).alias("std"))


def aligned(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """key, n_one, n_two: two counts side by side, absent ones 0."""
    a, b = one.groupBy(key).agg(F.count("*").alias("n_one")), two.groupBy(key).agg(F.count("*").alias("n_two"))
    return a.join(b, key, "full").fillna(0, ["n_one", "n_two"])


def collection_digest(df: DataFrame, name: str) -> DataFrame:
    """n and digest of the sorted names, for vocabularies: the one thing that has to be in one place is what is digested."""
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(name))), 256).alias("digest"))


def collection_fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """n and a digest of all rows in any order, for collections of any size: 128 bits of each row, combined by exclusive or, and their number."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(1), *reversed(columns))
    found = df.agg(F.count("*").alias("n"), F.bit_xor(one).alias("a"), F.bit_xor(two).alias("b"), F.sum(one.cast("decimal(38,0)")).alias("s"))
    return found.select("n", F.sha2(F.concat_ws("|", "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)), F.coalesce("s", F.lit(0))), 256).alias("digest"))


def weighted_coverage(df: DataFrame, known: Column, weight: str) -> DataFrame:
    return df.agg(F.round(F.sum(F.when(known, F.col(weight)).otherwise(0)) / F.sum(weight), 6).alias("coverage"))


def build_vocabulary(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """name, n, provenance: every label and alias (name, aliases as an array) in lower case with how often it is asked for, and what is asked for beside them (item, n)."""
    names = labels.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).select(F.lower("name").alias("name")).distinct()
    asked = counts.groupBy(F.lower("item").alias("name")).agg(F.sum("n").alias("n"))
    known = names.join(asked, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.lit("label").alias("provenance"))
    return known.unionByName(asked.join(names, "name", "left_anti").select("name", "n", F.lit("asked").alias("provenance")))


def vocabulary_membership(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """item, exact, relaxed: in the vocabulary as it is, or every word of it among the vocabulary's words."""
    v = vocabulary.select(F.lower("name").alias("name")).distinct()
    parts = v.select(F.explode(F.split("name", " ")).alias("word")).distinct().withColumn("_known", F.lit(1))
    items = words.select(F.lower("item").alias("item")).distinct()
    each = items.select("item", F.explode(F.split("item", " ")).alias("word")).join(parts, "word", "left").groupBy("item").agg(F.min(F.coalesce("_known", F.lit(0))).alias("_all"))
    return each.join(v.select(F.col("name").alias("item"), F.lit(True).alias("_exact")), "item", "left").select("item", F.coalesce("_exact", F.lit(False)).alias("exact"), (F.coalesce("_exact", F.lit(False)) | (F.col("_all") == 1)).alias("relaxed"))
