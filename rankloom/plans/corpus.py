"""Identity, cleaning, profile and overlap queries with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import order, text
from rankloom.operators import guards, overlap, profile
from rankloom.plans import relations as R
from rankloom.plans.catalog import query
from rankloom.sources import readers

_SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g'))"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query("id_mint", f"SELECT doc_id, 'r_' || substr(sha256({_norm('text')}), 1, 12) AS minted FROM documents")
def id_mint(spark, d):
    return R.documents(spark, d).select("doc_id", text.mint_id(F.col("text"), "r_").alias("minted"))


@query("id_collision_check", f"SELECT count(DISTINCT {_norm('text')}) AS n_texts, count(DISTINCT substr(sha256({_norm('text')}), 1, 12)) AS n_ids, count(DISTINCT {_norm('text')}) = count(DISTINCT substr(sha256({_norm('text')}), 1, 12)) AS injective FROM documents")
def id_collision_check(spark, d):
    n = R.documents(spark, d).select(text.normalise(F.col("text")).alias("t"), text.mint_id(F.col("text"), "").alias("i"))
    return n.agg(F.count_distinct("t").alias("n_texts"), F.count_distinct("i").alias("n_ids")).withColumn("injective", F.col("n_texts") == F.col("n_ids"))


@query("token_stats", f"""WITH t AS (SELECT lang, {_tokens('text')} AS t FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, any_value(n) AS n_distinct FROM t JOIN (SELECT lang, count(DISTINCT x) AS n FROM (SELECT lang, unnest(t) AS x FROM t) GROUP BY 1) u USING (lang) GROUP BY lang""")
def token_stats(spark, d):
    return profile.token_counts(R.table(spark, d, "documents"), "text", "lang")


def _sql_skills(c: str) -> str:
    parts = []
    for p in text.SKILL_FAMILIES:
        one = f"regexp_extract_all(lower({c}), '{p}', 1)"
        parts += [one, one]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"array_to_string({out}, ' ')"


@query("skill_boost", f"""WITH x AS (SELECT doc_id, 'java and c++11, Git, REST api in sql; ' || coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, coalesce(text, '') FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, skills, length(t || ' ' || skills) AS n_chars FROM (SELECT doc_id, t, {_sql_skills('t')} AS skills FROM x)""")
def skill_boost(spark, d):
    lead = F.when(F.col("doc_id") % 2 == 0, "java and c++11, Git, REST api in sql; ").otherwise("")
    x = R.documents(spark, d).select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("t"))
    return x.select("doc_id", text.skills(F.col("t")).alias("skills"), F.length(text.augment(F.col("t"))).cast("long").alias("n_chars"))


@query("redact_residual", r"""SELECT CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+'))) AS BIGINT) AS n_email_before, CAST(0 AS BIGINT) AS n_email, CAST(0 AS BIGINT) AS n_url, CAST(0 AS BIGINT) AS n_phone_intl FROM documents""")
def redact_residual(spark, d):
    docs = R.documents(spark, d)
    before = docs.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"))), F.lit(0)).alias("n_email_before"))
    return before.crossJoin(profile.residual_counts(docs.withColumn("text", text.redact(F.col("text"))), "text"))


@query("redact_text")
def redact_text(spark, d):
    return R.documents(spark, d).select("doc_id", text.redact(F.col("text")).alias("text"))


@query("url_redaction", r"SELECT page_id, regexp_replace(coalesce(url, ''), '(?i)\b(?:https?://|www\.)\S+', '[URL]', 'g') AS url FROM pages")
def url_redaction(spark, d):
    return R.table(spark, d, "pages").select("page_id", text.redact(F.col("url")).alias("url"))


_PLAIN = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"


def _sql_shingles(name: str, source: str, ident: str, key: str, n: int = 8) -> str:
    return f"""{name} AS (SELECT DISTINCT {ident}, array_to_string(w[i : i + {n - 1}], ' ') AS shingle FROM (SELECT {key} AS {ident}, string_split({_PLAIN}, ' ') AS w FROM {source}) x, range(1, len(w) - {n - 2}) AS r(i))"""


_CONTAINMENT = f"""{_sql_shingles("ds", "documents", "doc_id", "doc_id")}, {_sql_shingles("rs", "benchmark", "ref_id", "item_id")},
dn AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1), rn AS (SELECT ref_id, count(*) AS n FROM rs GROUP BY 1), shared AS (SELECT doc_id, ref_id, count(*) AS shared FROM ds JOIN rs USING (shingle) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, ref_id) AS k FROM shared),
containment AS (SELECT d.doc_id, coalesce(b.ref_id, -1) AS ref_id, coalesce(shared, 0) AS shared, round(coalesce(greatest(shared / CAST(dn.n AS DOUBLE), shared / CAST(rn.n AS DOUBLE)), 0.0), 6) AS containment
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND k = 1 LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN rn ON rn.ref_id = b.ref_id)"""


def _refs(spark, d):
    return R.table(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), "text")


def _containment(spark, d):
    return overlap.best_containment(R.documents(spark, d), _refs(spark, d))


@query("shingle_containment", f"WITH {_CONTAINMENT} SELECT * FROM containment")
def shingle_containment(spark, d):
    return _containment(spark, d)


@query("contamination_thresholds", f"WITH {_CONTAINMENT} SELECT threshold, count(*) FILTER (WHERE containment >= threshold) AS n, round(avg(CASE WHEN containment >= threshold THEN 1.0 ELSE 0.0 END), 6) AS share FROM containment CROSS JOIN (SELECT unnest([0.9, 0.7, 0.5]::DOUBLE[]) AS threshold) GROUP BY 1")
def contamination_thresholds(spark, d):
    return overlap.contamination(_containment(spark, d))


@query("exclusion_list", f"WITH {_CONTAINMENT} SELECT * FROM containment WHERE containment >= 0.7")
def exclusion_list(spark, d):
    return overlap.exclusions(_containment(spark, d))


@query("prefix_derivative")
def prefix_derivative(spark, d):
    """Derivatives of every distinct text, compared whole; a text's reference is its smallest doc_id, which is not its own derivative."""
    docs = R.documents(spark, d)
    refs = docs.groupBy(text.normalise(F.col("text")).alias("text")).agg(F.min("doc_id").alias("ref_id"))
    return overlap.prefix_derivatives(docs, refs).filter("doc_id <> ref_id")


_PROBES = f"p AS (SELECT item_id AS ref_id, substr({_norm('text')}, 11, 60) AS p FROM benchmark), hits AS MATERIALIZED (SELECT DISTINCT ref_id, doc_id FROM p JOIN documents ON length(p) >= 60 AND contains({_norm('text')}, p))"


@query("item_derivative", f"WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents), r AS (SELECT item_id AS ref_id, {_norm('text')} AS r FROM benchmark) SELECT count(*) AS n, any_value(k) AS n_derivative, round(any_value(k) / CAST(count(*) AS DOUBLE), 6) AS share FROM n CROSS JOIN (SELECT count(DISTINCT doc_id) AS k FROM n JOIN r ON length(r) > 0 AND starts_with(t, r))")
def item_derivative(spark, d):
    docs = R.documents(spark, d)
    return overlap.derivative_share(docs, overlap.prefix_derivatives(docs, _refs(spark, d)))


@query("probe_overlap", f"WITH {_PROBES} SELECT ref_id, min(doc_id) AS doc_id FROM hits GROUP BY 1")
def probe_overlap(spark, d):
    return overlap.probes(_refs(spark, d), R.documents(spark, d), 11, 60)


@query("probe_once")
def probe_once(spark, d):
    """Each item and each document used once, items in order of id."""
    return overlap.probes_once(_refs(spark, d), R.documents(spark, d), 11, 60)


@query("leakage", f"SELECT count(*) AS n_shared FROM (SELECT {_norm('text')} AS t FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT {_norm('text')} FROM documents WHERE doc_id % 2 = 1)")
def leakage(spark, d):
    docs = R.documents(spark, d)
    return overlap.leakage(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"))


@query("label_mix", f"WITH {R.SQL_PAIRS} SELECT label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM pairs) AS DOUBLE), 6) AS share FROM pairs GROUP BY 1")
def label_mix(spark, d):
    return profile.frequencies(R.pairs(spark, d), "label")


@query("top_sources", "SELECT source, lang, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE), 6) AS share FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 10")
def top_sources(spark, d):
    return profile.frequencies(R.table(spark, d, "documents"), "source", "lang", top=10)


@query("text_length_stats", """SELECT lang, count(text) AS n, count(DISTINCT text) AS n_distinct, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS mean_chars, CAST(floor(median(length(text))) AS BIGINT) AS median_chars,
  quantile_cont(length(text)::DOUBLE, 0.25) AS q25, quantile_cont(length(text)::DOUBLE, 0.5) AS q50, quantile_cont(length(text)::DOUBLE, 0.75) AS q75 FROM documents GROUP BY 1""")
def text_length_stats(spark, d):
    return profile.length_statistics(R.table(spark, d, "documents"), "text", "lang")


@query("relevance_density", f"WITH {R.SQL_PAIRS} SELECT query_id, count(*) AS n, count(*) FILTER (WHERE label = 'Good Fit') AS good, round(avg(CASE WHEN label = 'Good Fit' THEN 1.0 ELSE 0.0 END), 6) AS density FROM pairs GROUP BY 1")
def relevance_density(spark, d):
    good = F.col("label") == "Good Fit"
    return R.pairs(spark, d).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.round(F.avg(good.cast("double")), 6).alias("density"))


@query("family_alignment", f"WITH {R.SQL_CELLS} SELECT coalesce(a.keyword, b.keyword) AS keyword, coalesce(n_one, 0) AS n_one, coalesce(n_two, 0) AS n_two FROM (SELECT keyword, count(*) AS n_one FROM cq GROUP BY 1) a FULL JOIN (SELECT keyword, count(*) AS n_two FROM cd GROUP BY 1) b ON a.keyword = b.keyword")
def family_alignment(spark, d):
    return profile.aligned(R.cell_queries(spark, d), R.cell_documents(spark, d), "keyword")


@query("tag_counter", f"WITH x AS (SELECT unnest({_tokens('text')}) AS x FROM benchmark), t AS (SELECT CASE WHEN x LIKE 't%' THEN 'B-' || x WHEN x LIKE 'i%' THEN 'I-' || x ELSE 'O' END AS tag FROM x) SELECT count(*) FILTER (WHERE tag LIKE 'B%') AS n_b, count(*) FILTER (WHERE tag LIKE 'I%') AS n_i, count(*) FILTER (WHERE tag LIKE 'O%') AS n_o, count(*) AS n FROM t")
def tag_counter(spark, d):
    words = text.tokens(F.col("text"))
    tags = F.transform(words, lambda x: F.when(x.startswith("t"), F.concat(F.lit("B-"), x)).when(x.startswith("i"), F.concat(F.lit("I-"), x)).otherwise("O"))
    return profile.tag_counts(R.table(spark, d, "benchmark").select(tags.alias("tags")), "tags")


@query("span_offsets", """WITH s AS (SELECT lang AS label, text AS c, substr(text, 6, 10) AS t, CASE WHEN doc_id % 7 = 0 THEN 6 ELSE 5 END AS a, CASE WHEN doc_id % 7 = 0 THEN 15 ELSE 14 END AS b FROM documents WHERE length(text) >= 40)
SELECT label, count(*) AS n, count(*) FILTER (WHERE regexp_replace(substr(c, a + 1, b - a + 1), '^\\s+|\\s+$', '', 'g') <> regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS n_broken FROM s GROUP BY 1""".replace("\\\\", "\\"))
def span_offsets(spark, d):
    """Spans cut from the texts themselves, every seventh shifted by one."""
    off = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    docs = R.table(spark, d, "documents").filter("length(text) >= 40")
    span = F.struct(F.col("lang").alias("label"), (off + 5).alias("start"), (off + 14).alias("end"), F.substring("text", 6, 10).alias("text"))
    return profile.span_problems(docs.select(F.col("text").alias("content"), F.array(span).alias("spans")), "content", "spans")


@query("span_repair", """WITH s AS (SELECT lang AS label, text AS c, substr(text, 6, 10) AS t, CASE WHEN doc_id % 7 = 0 THEN 6 ELSE 5 END AS a, CASE WHEN doc_id % 7 = 0 THEN 15 ELSE 14 END AS b FROM documents WHERE length(text) >= 40),
x AS (SELECT *, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS p FROM s), y AS (SELECT *, regexp_replace(substr(c, a + 1, b - a + 1), '^\\s+|\\s+$', '', 'g') = p AS here, instr(substr(c, greatest(a - 8, 0) + 1, length(p) + 16), p) AS f FROM x)
SELECT label, CASE WHEN here THEN 'ok' WHEN f > 0 THEN 'moved' ELSE 'lost' END AS status, count(*) AS n, CAST(sum(CASE WHEN here THEN a WHEN f > 0 THEN greatest(a - 8, 0) + f - 1 END) AS BIGINT) AS starts FROM y GROUP BY 1, 2""".replace("\\\\", "\\"))
def span_repair(spark, d):
    """Spans cut from the texts themselves, every seventh shifted by one, put back where their text stands."""
    off = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    docs = R.table(spark, d, "documents").filter("length(text) >= 40")
    span = F.struct(F.col("lang").alias("label"), (off + 5).alias("start"), (off + 14).alias("end"), F.substring("text", 6, 10).alias("text"))
    found = profile.repaired_spans(docs.select(F.col("text").alias("content"), F.array(span).alias("spans")), "content", "spans")
    return found.groupBy("label", "status").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query("vocabulary_build", """WITH names AS (SELECT DISTINCT lower(unnest([n_name, split_part(n_name, ' ', 1)])) AS name FROM nation), asked AS (SELECT lower(item) AS name, CAST(sum(n) AS BIGINT) AS n FROM (SELECT split_part(p_name, ' ', 1) AS item, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT n_name, n_nationkey FROM nation) GROUP BY 1)
SELECT name, coalesce(n, 0) AS n, 'label' AS provenance FROM names LEFT JOIN asked USING (name) UNION ALL SELECT name, n, 'asked' FROM asked ANTI JOIN names USING (name)""")
def vocabulary_build(spark, d):
    nation = R.table(spark, d, "nation")
    labels = nation.select(F.col("n_name").alias("name"), F.array(F.split_part(F.col("n_name"), F.lit(" "), F.lit(1))).alias("aliases"))
    asked = R.table(spark, d, "part").groupBy(F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias("item")).agg(F.count("*").alias("n"))
    return profile.build_vocabulary(labels, asked.unionByName(nation.select(F.col("n_name").alias("item"), F.col("n_nationkey").cast("long").alias("n"))))


@query("skill_freq", "WITH x AS (SELECT unnest([event_type, 'k' || user_id % 5]) AS item FROM events) SELECT item, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, item LIMIT 8")
def skill_freq(spark, d):
    cell = F.format_string("['%s', 'k%d']", "event_type", F.col("user_id") % 5)
    return profile.list_frequencies(R.table(spark, d, "events").select(cell.alias("cell")), "cell", 8)


@query("alias_coverage", """WITH v AS (SELECT DISTINCT lower(n_name) AS name FROM nation), w AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS word FROM v), i AS (SELECT DISTINCT lower(p_name) AS item FROM part UNION SELECT lower(n_name) FROM nation),
a AS (SELECT item, min(CASE WHEN w.word IS NULL THEN 0 ELSE 1 END) AS k FROM (SELECT item, unnest(string_split(item, ' ')) AS word FROM i) x LEFT JOIN w ON w.word = x.word GROUP BY 1)
SELECT item, v.name IS NOT NULL AS exact, v.name IS NOT NULL OR k = 1 AS relaxed FROM a LEFT JOIN v ON v.name = a.item""")
def alias_coverage(spark, d):
    nation = R.table(spark, d, "nation")
    items = R.table(spark, d, "part").select(F.col("p_name").alias("item")).unionByName(nation.select(F.col("n_name").alias("item")))
    return profile.vocabulary_membership(items, nation.select(F.col("n_name").alias("name")))


@query("weighted_coverage", "SELECT round(sum(CASE WHEN p_size > 25 THEN p_retailprice ELSE 0 END) / sum(p_retailprice), 6) AS coverage FROM part")
def weighted_coverage(spark, d):
    return profile.weighted_coverage(R.table(spark, d, "part"), F.col("p_size") > 25, "p_retailprice")


@query("html_tags", "WITH t AS (SELECT unnest(regexp_extract_all(html, '<(/?[a-zA-Z0-9]+)', 1)) AS tag FROM pages) SELECT tag, count(*) AS n FROM t GROUP BY 1")
def html_tags(spark, d):
    return profile.html_tags(R.table(spark, d, "pages"), "html")


@query("delimiter_counts", "SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) AS BIGINT) AS n_digits FROM documents GROUP BY 1")
def delimiter_counts(spark, d):
    return R.table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(F.split("text", "\n"))).alias("n_lines"), F.sum(F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).alias("n_digits"))


@query("label_statistics", "SELECT quality AS label, count(*) AS n, round(avg(length(text)), 5) AS mean, round(median(length(text)), 5) AS median, round(stddev_samp(length(text)), 5) AS std FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def label_statistics(spark, d):
    joined = R.table(spark, d, "labels").join(R.documents(spark, d), "doc_id").select(F.col("quality").alias("label"), F.length("text").alias("n_chars"))
    return profile.label_statistics(joined, "label", "n_chars")


@query("collection_digest", "SELECT count(*) AS n, sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM nation")
def collection_digest(spark, d):
    return profile.collection_digest(R.table(spark, d, "nation"), "n_name")


_MATCHES = {"email": "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.-]+", "phone": "[+][0-9]{1,3}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}", "number": "[0-9]{7,}"}


@query("distinct_matches", " UNION ALL ".join(f"SELECT '{k}' AS name, count(DISTINCT m) AS n FROM (SELECT unnest(regexp_extract_all(text, '{p}')) AS m FROM documents)" for k, p in _MATCHES.items()))
def distinct_matches(spark, d):
    return profile.distinct_matches(R.documents(spark, d), "text", _MATCHES)


@query("label_counts", """WITH names AS (SELECT * FROM (VALUES (0, 'Good Fit'), (1, 'Potential Fit'), (2, 'No Fit')) AS v(place, label)), x AS (SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'Good Fit' WHEN quality = 1 THEN 'Potential Fit' ELSE 'No Fit' END AS label FROM documents JOIN labels USING (doc_id))
SELECT s.source, CAST(n.place AS INTEGER) AS place, n.label, count(x.label) AS n FROM (SELECT DISTINCT source FROM x) s CROSS JOIN names n LEFT JOIN x ON x.source IS NOT DISTINCT FROM s.source AND x.label = n.label GROUP BY ALL""")
def label_counts(spark, d):
    own = R.table(spark, d, "labels").select("doc_id", R.label(F.col("quality"), F.col("toxic")).alias("label"))
    return profile.label_counts(R.table(spark, d, "documents").select("doc_id", "source").join(own, "doc_id"), "source", "label", ("Good Fit", "Potential Fit", "No Fit"))


@query("literal_filter", "SELECT doc_id FROM documents WHERE contains(text, '$')")
def literal_filter(spark, d):
    return profile.containing(R.documents(spark, d), "text", "$").select("doc_id")


@query("english_documents", f"SELECT lang, count(*) AS n FROM documents WHERE lang = 'en' AND trim(text) <> '' GROUP BY 1")
def english_documents(spark, d):
    return readers.in_language(R.table(spark, d, "documents")).groupBy("lang").agg(F.count("*").alias("n"))


@query("parsed_lists", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '|it''s|b' WHEN 1 THEN 'a, b|c' WHEN 2 THEN '' ELSE '' END AS items, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS n FROM part""")
def parsed_lists(spark, d):
    """Lists written as text: either kind of quotes, an apostrophe inside, numbers beside strings, and what is no list."""
    key = F.col("p_partkey") % 4
    cell = F.when(key == 0, F.concat(F.lit("['"), "p_name", F.lit("', \"it's\", 'b', 3]"))).when(key == 1, F.lit("['a, b', None, 'c']")).when(key == 2, F.lit("[]")).otherwise("['broken")
    found = R.table(spark, d, "part").select("p_partkey", text.parse_list(cell).alias("l"))
    return found.select("p_partkey", F.array_join("l", "|").alias("items"), F.size("l").alias("n"))


@query("text_assembly", f"""SELECT conv_id, turn, regexp_replace(concat_ws(chr(10) || chr(10), nullif(regexp_replace(coalesce(role, ''), '^{_SPACE}+|{_SPACE}+$', '', 'g'), ''), nullif(regexp_replace(CASE WHEN turn % 3 = 0 THEN '  ' ELSE chr(10) || text END, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '')), '\\n{{3,}}', chr(10) || chr(10), 'g') AS whole FROM conversations""")
def text_assembly(spark, d):
    second = F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit("\n"), "text"))
    return R.table(spark, d, "conversations").select("conv_id", "turn", text.assemble(F.col("role"), second).alias("whole"))


@query("hash_functions", """SELECT query_id, doc_id, 'q_' || substr(sha256('a1|' || query_id || '|' || doc_id), 1, 12) AS queue_id, CAST(('0x' || substr(sha256('0|' || query_id || '__' || doc_id), 1, 16))::UBIGINT % 10000 AS INTEGER) < 3000 AS doubly, CAST(('0x' || substr(sha256('0|' || query_id), 1, 12))::UBIGINT AS BIGINT) AS seat FROM (SELECT DISTINCT conv_id AS query_id, turn AS doc_id FROM conversations)""")
def hash_functions(spark, d):
    u = R.units(spark, d)
    return u.select("query_id", "doc_id", order.opaque_id(F.lit("a1"), F.col("query_id"), F.col("doc_id")).alias("queue_id"), order.doubly(F.col("pair_id"), 0.3, 0).alias("doubly"), order.group_order(F.col("query_id")).alias("seat"))


@query("experience_bands", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal / 1000 <= 1 THEN '0-1' WHEN c_acctbal / 1000 <= 3 THEN '2-3' WHEN c_acctbal / 1000 <= 6 THEN '4-6' ELSE '7+' END AS band FROM customer")
def experience_bands(spark, d):
    years = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000)
    return R.table(spark, d, "customer").select("c_custkey", text.experience_band(years).alias("band"))


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return guards.duplicate_keys(R.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("keep_first_order", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_first_order(spark, d):
    return guards.keep_first(R.table(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("relation_lookup", """SELECT s.s_suppkey, n.n_name, r.r_name, s.s_acctbal FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE s.s_acctbal > 1000 AND r.r_name <> 'ASIA'""")
def relation_lookup(spark, d):
    s, n, r = (R.table(spark, d, x) for x in ("supplier", "nation", "region"))
    joined = s.filter("s_acctbal > 1000").join(n, s["s_nationkey"] == n["n_nationkey"]).join(r.filter("r_name <> 'ASIA'"), n["n_regionkey"] == r["r_regionkey"])
    return joined.select("s_suppkey", "n_name", "r_name", "s_acctbal")


@query("set_operations", """SELECT 'except' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_operations(spark, d):
    a, b = R.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), R.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = [("except", a.subtract(b)), ("intersect", a.intersect(b)), ("union", a.unionByName(b).distinct())]
    out = None
    for name, df in named:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("order_profile", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(DISTINCT l_orderkey) AS n_orders FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def order_profile(spark, d):
    items = R.table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count_distinct("l_orderkey").alias("n_orders"),
    )
