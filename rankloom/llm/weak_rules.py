"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates their accuracies.

All columns and the whole estimation are DataFrame expressions. The measures of a text come from array and string
functions. Each rule votes 1 (good), -1 (bad) or 0 (abstains). Bad documents come in kinds, and a rule knows one kind
only, so each kind (repetition, loudness, noise, shape) has three rules and an estimate of its own: documents are counted by
their votes, and expectation-maximisation over those counts (27 patterns of a kind at most, in one row) estimates the
share of documents that are good in that respect and, for each rule and class, how often it is right when it votes and
how often it abstains. The posterior quality of a document is the product over kinds of its posteriors of being good,
worked out from its votes and the estimates, which are one row for each kind.

Model of a kind: given the class, its rules vote apart from each other. Three such rules identify the two classes but
for their names; the start (a share of 0.9, right in 0.95 of votes on good documents and in 0.7 on bad ones, silent in
a tenth) says which is which. A prior of the same figures weighs as much as 0.002 of the documents and one more: it
keeps the estimates of a kind that does not occur off 0 and 1 and changes no other by much. Nothing else bounds them.

A base test stays beside it: fewer than 50 words, or over half of the words in repeated 3-word windows, fails a
document whatever the vote.

Nulls: a null text has no words and fails the base test; null doc_ids and repeated rows are kept, one result each.
An empty table gives no rows. Whole texts are measured, of any length; word windows are compared as text, not hashes.
A posterior of exactly ``least`` is kept. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
STEPS, SHARE, GOOD, BAD, QUIET = 40, 0.9, 0.95, 0.7, 0.1
#: What the prior weighs, as a share of the documents, beside one document.
STRENGTH = 0.002
KINDS = {"repetition": ("repeats", "lines", "variety"), "loudness": ("shouting", "capitals", "bangs"), "noise": ("symbols", "runs", "signs"), "shape": ("length", "word_chars", "letters")}
RULES = tuple(r for rules in KINDS.values() for r in rules)
SYMBOLS = "#*$%&|<>"
_GAP, _LETTER = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more, from an array without nulls."""
    m = n - 2
    pairs = F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(n < 4, F.array().cast("array<string>")).otherwise(F.zip_with(pairs, F.slice(words, 3, m), lambda a, b: F.concat(a, F.lit(" "), b)))


def _cover(at: Column) -> Column:
    k = F.size(at)
    steps = F.zip_with(F.slice(at, 1, F.greatest(k - 1, F.lit(0))), F.slice(at, 2, F.greatest(k - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), b - a))
    return F.when(k == 0, F.lit(0)).otherwise(F.aggregate(steps, F.lit(3), lambda s, x: s + x))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_shouts, n_lines, n_runs, n_signs, n_digits, n_distinct, n_capitals, n_bangs of every document."""
    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", _GAP), lambda w: w != ""))
    # Lines with a word: an empty or blank line has nothing but separators.
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(_LETTER)))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("windows", _repeat_words(F.col("words"), F.col("n")))
    # Equal windows stand side by side once sorted; each step is a column of its own, so that it is evaluated once.
    twice = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(twice, placed))
    m = F.size("placed") - 1
    equal = F.zip_with(F.slice("placed", 1, m), F.slice("placed", 2, m), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    rows = rows.withColumn("at", F.when(F.col("placed").isNull(), F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(F.flatten(F.array_compact(equal))))))
    plain = F.length("text")
    rows = rows.withColumn("n_symbols", F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long"))
    some = F.col("n_symbols") > 0  # few texts have any, so the others are not searched again
    signs = sum((F.contains("text", F.lit(c)).cast("int") for c in SYMBOLS), F.lit(0))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _cover(F.col("at")).cast("long").alias("n_repeat_words"),
        (plain - F.length(F.replace(F.col("text"), F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(some, F.regexp_count("text", F.lit("[#*$%&|<>]{2,}"))).otherwise(0).cast("long").alias("n_runs"),
        F.when(some, signs).otherwise(0).cast("long").alias("n_signs"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.when(F.contains("text", F.lit("!!")), F.regexp_count("text", F.lit("!{2,}"))).otherwise(0).cast("long").alias("n_bangs"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """Each rule's vote over the measures; whole numbers only, so that other engines agree."""
    n = F.col("n_words")
    return {
        "length": _vote(n >= 80, n < 20),
        "word_chars": _vote((F.col("word_chars") >= 3 * n) & (F.col("word_chars") <= 9 * n) & (n > 0), (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n) | (n == 0)),
        "symbols": _vote((100 * F.col("n_symbols") <= n) & (n > 0), 5 * F.col("n_symbols") >= n),
        "lines": _vote((F.col("n_dup_lines") == 0) & (F.col("n_lines") > 2), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": _vote((10 * F.col("n_repeat_words") < n) & (n > 0), 10 * F.col("n_repeat_words") > 3 * n),
        "shouting": _vote((200 * F.col("n_shouts") <= n) & (n > 0), 5 * F.col("n_shouts") >= n),
        "variety": _vote((F.col("n_distinct") * F.col("n_distinct") >= 25 * n) & (n > 0), F.col("n_distinct") * F.col("n_distinct") < 10 * n),
        "capitals": _vote((5 * F.col("n_capitals") <= F.col("word_chars")) & (n > 0), 2 * F.col("n_capitals") > F.col("word_chars")),
        "bangs": _vote((F.col("n_shouts") == 0) & (n > 0), (F.col("n_bangs") > 0) & (20 * F.col("n_bangs") >= n)),
        "runs": _vote((F.col("n_symbols") == 0) & (n > 0), (F.col("n_runs") > 0) & (50 * F.col("n_runs") >= n)),
        "signs": _vote((F.col("n_symbols") == 0) & (n > 0), F.col("n_signs") >= 3),
        "letters": _vote((5 * F.col("n_digits") <= F.col("word_chars")) & (n > 0), 2 * F.col("n_digits") > F.col("word_chars")),
    }


def _likely(vote: Column, sign: int, accuracy: Column, quiet: Column) -> Column:
    """Likelihood of one vote if the document's class is sign."""
    return F.when(vote == 0, quiet).when(vote == sign, (1.0 - quiet) * accuracy).otherwise((1.0 - quiet) * (1.0 - accuracy))


def _posterior(pattern: Column, state: Column, rules: tuple[str, ...]) -> Column:
    good, bad = state["share"], 1.0 - state["share"]
    for r in rules:
        good = good * _likely(pattern[r], 1, state[f"good_{r}"], state[f"quiet_good_{r}"])
        bad = bad * _likely(pattern[r], -1, state[f"bad_{r}"], state[f"quiet_bad_{r}"])
    return good / (good + bad)


def _start(rules: tuple[str, ...]) -> dict[str, float]:
    out = {"share": SHARE}
    for r in rules:
        out |= {f"good_{r}": GOOD, f"bad_{r}": BAD, f"quiet_good_{r}": QUIET, f"quiet_bad_{r}": QUIET}
    return out


def estimate(patterns: DataFrame, rules: tuple[str, ...], strength: float = STRENGTH, steps: int = STEPS) -> DataFrame:
    """One row: the estimated share of good documents, each rule's accuracies and its rates of abstaining, from vote patterns with counts n."""
    counts = patterns.groupBy(*rules).agg(F.sum("n").cast("double").alias("n"))
    gathered = counts.agg(F.array_sort(F.collect_list(F.struct(*rules, "n"))).alias("patterns"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total"))  # 27 structs at most
    sums = ["good", *(f"{x}_{k}_{r}" for r in rules for k in ("good", "bad") for x in ("right", "cast"))]
    weight = F.col("total") * strength + 1.0

    def step(state: Column, _: Column) -> Column:
        weighed = F.transform(F.col("patterns"), lambda p: F.struct(p.alias("p"), _posterior(p, state, rules).alias("q")))

        def add(s: Column, x: Column) -> Column:
            p, n = x["p"], x["p"]["n"]
            out = [(s["good"] + n * x["q"]).alias("good")]
            for r in rules:
                for k, sign, q in (("good", 1, x["q"]), ("bad", -1, 1.0 - x["q"])):
                    out.append((s[f"right_{k}_{r}"] + F.when(p[r] == sign, n * q).otherwise(0.0)).alias(f"right_{k}_{r}"))
                    out.append((s[f"cast_{k}_{r}"] + F.when(p[r] == 0, 0.0).otherwise(n * q)).alias(f"cast_{k}_{r}"))
            return F.struct(*out)

        def close(s: Column) -> Column:
            members = {"good": s["good"], "bad": F.col("total") - s["good"]}
            out = [((s["good"] + weight * SHARE) / (F.col("total") + weight)).alias("share")]
            for r in rules:
                for k, before in (("good", GOOD), ("bad", BAD)):
                    right, cast = s[f"right_{k}_{r}"], s[f"cast_{k}_{r}"]
                    out.append(((right + weight * before) / (cast + weight)).alias(f"{k}_{r}"))
                    out.append(((members[k] - cast + weight * QUIET) / (members[k] + weight)).alias(f"quiet_{k}_{r}"))
            named = {c: f for c, f in zip(["share", *(f"{x}{k}_{r}" for r in rules for k in ("good", "bad") for x in ("", "quiet_"))], out, strict=True)}
            return F.struct(*(named[c] for c in _start(rules)))

        return F.aggregate(weighed, F.struct(*(F.lit(0.0).alias(x) for x in sums)), add, close)

    start = F.struct(*(F.lit(v).alias(k) for k, v in _start(rules).items()))
    return gathered.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("state")).select("state.*")


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, posterior, kept of every document."""
    measured, _ = common.materialize(measures(docs), "measures")  # fourteen numbers a document, read more than once
    voted = measured.select("*", *(v.alias(f"vote_{r}") for r, v in votes().items()))
    patterns = voted.groupBy(*(F.col(f"vote_{r}").alias(r) for r in RULES)).agg(F.count("*").alias("n"))
    posterior, votes_of = F.lit(1.0), {r: F.col(f"vote_{r}").alias(r) for r in RULES}
    for kind, rules in KINDS.items():
        state = estimate(patterns, rules).select(F.struct("*").alias(f"state_{kind}"))
        voted = voted.crossJoin(F.broadcast(state))  # one row
        posterior = posterior * _posterior(F.struct(*(votes_of[r] for r in rules)), F.col(f"state_{kind}"), rules)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("posterior", posterior)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & (F.col("posterior") >= least)).alias("kept"), F.round("posterior", 6).alias("posterior"),
    )


def _sql_kind(kind: str, rules: tuple[str, ...]) -> str:
    """e_{kind}: the estimates after all steps, over patterns p."""

    def likely(r: str, sign: int, k: str) -> str:
        return f"CASE p.{r} WHEN 0 THEN e.quiet_{k}_{r} WHEN {sign} THEN (1.0 - e.quiet_{k}_{r}) * e.{k}_{r} ELSE (1.0 - e.quiet_{k}_{r}) * (1.0 - e.{k}_{r}) END"

    start = _start(rules)
    good, bad = (" * ".join(likely(r, sign, k) for r in rules) for k, sign in (("good", 1), ("bad", -1)))
    q = f"e.share * {good} / (e.share * {good} + (1.0 - e.share) * {bad})"
    weight = f"(any_value(total) * {STRENGTH} + 1.0)"
    steps = {"share": f"(sum(n * q) + {weight} * {SHARE}) / (any_value(total) + {weight})"}
    for r in rules:
        for k, sign, own, before in (("good", 1, "n * q", GOOD), ("bad", -1, "n * (1.0 - q)", BAD)):
            steps[f"{k}_{r}"] = f"(sum(CASE WHEN {r} = {sign} THEN {own} ELSE 0.0 END) + {weight} * {before}) / (sum(CASE WHEN {r} <> 0 THEN {own} ELSE 0.0 END) + {weight})"
            steps[f"quiet_{k}_{r}"] = f"(sum(CASE WHEN {r} = 0 THEN {own} ELSE 0.0 END) + {weight} * {QUIET}) / (sum({own}) + {weight})"
    names = ", ".join(rules)
    return f"""
p_{kind} AS MATERIALIZED (SELECT {names}, CAST(sum(n) AS DOUBLE) AS n, (SELECT CAST(sum(n) AS DOUBLE) FROM p) AS total FROM p GROUP BY {names}),
r_{kind}(step, {", ".join(start)}) AS (
  SELECT 0, {", ".join(f"CAST({v} AS DOUBLE)" for v in start.values())}
  UNION ALL SELECT step + 1, {", ".join(steps[c] for c in start)} FROM (SELECT e.step, p.*, {q} AS q FROM r_{kind} e CROSS JOIN p_{kind} p WHERE e.step < {STEPS}) GROUP BY step),
q_{kind} AS MATERIALIZED (SELECT {", ".join(f"p.{r}" for r in rules)}, {q} AS q_{kind} FROM p_{kind} p CROSS JOIN r_{kind} e WHERE e.step = {STEPS})"""


def oracle_sql(least: float = 0.5) -> str:
    """The same over documents, in DuckDB SQL."""
    signs = " + ".join(f"CAST(contains(text, '{c}') AS INTEGER)" for c in SYMBOLS)
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
c AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(DISTINCT word) AS n_distinct FROM w GROUP BY r),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER (PARTITION BY r ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY r ORDER BY i) AS g FROM w),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM g WHERE g IS NOT NULL) WHERE k > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS MATERIALIZED (
  SELECT r, doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, length(text) - length(replace(text, '!', '')) AS n_shouts, coalesce(n_lines, 0) AS n_lines,
    len(regexp_extract_all(text, '[#*$%&|<>]{{2,}}')) AS n_runs, {signs} AS n_signs, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
    coalesce(n_distinct, 0) AS n_distinct, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals, len(regexp_extract_all(text, '!{{2,}}')) AS n_bangs
  FROM d LEFT JOIN c USING (r) LEFT JOIN cover USING (r) LEFT JOIN l USING (r)),
v AS MATERIALIZED (
  SELECT r, doc_id, n_words, word_chars AS wc, n_symbols, n_dup_lines, n_repeat_words,
    CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END AS length,
    CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words OR n_words = 0 THEN -1 WHEN word_chars >= 3 * n_words AND word_chars <= 9 * n_words THEN 1 ELSE 0 END AS word_chars,
    CASE WHEN 5 * n_symbols >= n_words THEN -1 WHEN 100 * n_symbols <= n_words AND n_words > 0 THEN 1 ELSE 0 END AS symbols,
    CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN -1 WHEN n_dup_lines = 0 AND n_lines > 2 THEN 1 ELSE 0 END AS lines,
    CASE WHEN 10 * n_repeat_words > 3 * n_words THEN -1 WHEN 10 * n_repeat_words < n_words AND n_words > 0 THEN 1 ELSE 0 END AS repeats,
    CASE WHEN 5 * n_shouts >= n_words THEN -1 WHEN 200 * n_shouts <= n_words AND n_words > 0 THEN 1 ELSE 0 END AS shouting,
    CASE WHEN n_runs > 0 AND 50 * n_runs >= n_words THEN -1 WHEN n_symbols = 0 AND n_words > 0 THEN 1 ELSE 0 END AS runs,
    CASE WHEN n_signs >= 3 THEN -1 WHEN n_symbols = 0 AND n_words > 0 THEN 1 ELSE 0 END AS signs,
    CASE WHEN 2 * n_digits > m.word_chars THEN -1 WHEN 5 * n_digits <= m.word_chars AND n_words > 0 THEN 1 ELSE 0 END AS letters,
    CASE WHEN n_distinct * n_distinct < 10 * n_words THEN -1 WHEN n_distinct * n_distinct >= 25 * n_words AND n_words > 0 THEN 1 ELSE 0 END AS variety,
    CASE WHEN 2 * n_capitals > m.word_chars THEN -1 WHEN 5 * n_capitals <= m.word_chars AND n_words > 0 THEN 1 ELSE 0 END AS capitals,
    CASE WHEN n_bangs > 0 AND 20 * n_bangs >= n_words THEN -1 WHEN n_shouts = 0 AND n_words > 0 THEN 1 ELSE 0 END AS bangs
  FROM m),
p AS MATERIALIZED (SELECT {", ".join(RULES)}, count(*) AS n FROM v GROUP BY ALL),{",".join(_sql_kind(k, rules) for k, rules in KINDS.items())},
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM v)
SELECT doc_id, n_words, wc AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" * ".join(f"q_{k}" for k in KINDS)} >= {least} AS kept, round({" * ".join(f"q_{k}" for k in KINDS)}, 6) AS posterior
FROM base {" ".join(f"JOIN q_{k} USING ({', '.join(rules)})" for k, rules in KINDS.items())}
"""
