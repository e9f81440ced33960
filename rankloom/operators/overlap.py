"""Overlap between text collections: shingle containment, prefix derivatives, probes, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom import shared
from rankloom.functions import text
from rankloom.operators.guards import keep_first


def shingle_table(docs: DataFrame, ident: str, n: int) -> DataFrame:
    """ident, shingle, size: distinct plain-word shingles of each document and how many it has."""
    words = docs.select(ident, text.once(F.split(text.plain(F.coalesce("text", F.lit(""))), " ")).alias("_w"))
    own = words.select(ident, text.shingles(F.col("_w"), n).alias("_s"))
    return own.select(ident, F.size("_s").alias("size"), F.explode("_s").alias("shingle"))


def best_containment(docs: DataFrame, refs: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, ref_id, shared, containment: the reference with most shared shingles (ties: smaller id), and the larger share.

    An inverted index. Shingles that the same references hold are one class, told apart by 128 bits of its members: a
    document's shingles are counted by class first, and a class meets its references once for each document, so that
    a passage which many of both sides hold costs one row for each, not one for each of its shingles.
    """
    r = shared.kept(shingle_table(refs, "ref_id", n), "reference_shingles")
    one, two = F.xxhash64("ref_id"), F.xxhash64(F.lit(1), "ref_id")
    held = r.groupBy("shingle").agg(F.count("*").alias("k"), F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"))
    first = held.groupBy("k", "x1", "x2").agg(F.min("shingle").alias("class"))
    classed = shared.kept(held.join(first, ["k", "x1", "x2"]).select("shingle", "class"), "shingle_classes")
    members = r.join(classed.select(F.col("class").alias("shingle")).distinct(), "shingle", "left_semi").select(F.col("shingle").alias("class"), "ref_id", F.col("size").alias("ref_size"))
    counted = shingle_table(docs, "doc_id", n).join(classed, "shingle").groupBy("doc_id", "size", "class").agg(F.count("*").alias("c"))
    common = counted.join(members, "class").groupBy("doc_id", "ref_id", "size", "ref_size").agg(F.sum("c").alias("shared"))
    best = keep_first(common, ["doc_id"], F.desc("shared"), F.col("ref_id"))
    out = docs.select("doc_id").join(best, "doc_id", "left")
    share = F.greatest(F.col("shared") / F.col("size"), F.col("shared") / F.col("ref_size"))
    return out.select("doc_id", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), F.coalesce("shared", F.lit(0)).alias("shared"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("containment"))


def contamination(found: DataFrame, thresholds: tuple[float, ...] = (0.9, 0.7, 0.5)) -> DataFrame:
    """threshold, n, share of documents at or over it."""
    each = found.select("containment", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return each.groupBy("threshold").agg(F.count_if(F.col("containment") >= F.col("threshold")).alias("n"), F.round(F.avg((F.col("containment") >= F.col("threshold")).cast("double")), 6).alias("share"))


def exclusions(found: DataFrame, least: float = 0.7) -> DataFrame:
    return found.filter(F.col("containment") >= least).orderBy(F.desc("containment"), "doc_id")


def prefix_derivatives(docs: DataFrame, refs: DataFrame, head: int = 100) -> DataFrame:
    """doc_id, ref_id where the document's normalised text starts with the reference's; blocked by the first characters."""
    d = docs.select("doc_id", text.normalise(F.col("text")).alias("_d"))
    r = refs.select("ref_id", text.normalise(F.col("text")).alias("_r")).filter("length(_r) > 0")
    d, r = d.withColumn("_h", F.substring("_d", 1, head)), r.withColumn("_h", F.substring("_r", 1, head))
    # A reference shorter than the block can only be matched by its own length.
    long = d.join(r.filter(F.length("_r") >= head), "_h").filter(F.startswith("_d", "_r"))
    short = r.filter(F.length("_r") < head).select("ref_id", "_r", F.length("_r").alias("_n"))
    lengths = short.select("_n").distinct()  # head - 1 numbers at most
    cut = d.crossJoin(F.broadcast(lengths)).select("doc_id", F.expr("substring(_d, 1, _n)").alias("_r"), "_n")
    return long.select("doc_id", "ref_id").unionByName(cut.join(short, ["_r", "_n"]).select("doc_id", "ref_id"))


def derivative_share(docs: DataFrame, found: DataFrame) -> DataFrame:
    """n, n_derivative, share: how many documents start with a reference."""
    n = docs.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count_distinct("doc_id").alias("n_derivative")))
    return n.withColumn("share", F.round(F.col("n_derivative") / F.col("n"), 6))


def probe_hits(refs: DataFrame, docs: DataFrame, start: int = 1, length: int = 60) -> DataFrame:
    """ref_id, doc_id of every document that a stretch of a reference occurs in.

    A word that the stretch holds whole is a whole word of any text that holds the stretch. Of those words the one that
    fewest documents have is the probe's anchor: documents and probes are joined on anchors, then compared. The rare
    stretches without such a word (one or two words longer than it) are sought in words of at least half its length.
    """
    probe = refs.select("ref_id", F.substring(text.normalise(F.col("text")), start, length).alias("probe")).filter(F.length("probe") >= length)
    probe = shared.kept(probe.withColumn("inner", F.filter(F.slice(F.split("probe", " "), F.lit(2), F.greatest(F.size(F.split("probe", " ")) - 2, F.lit(0))), lambda w: w != "")), "probes")
    body = docs.select("doc_id", text.normalise(F.col("text")).alias("body"))
    own = probe.select("ref_id", F.explode("inner").alias("word")).distinct()
    seen = body.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    seen = shared.kept(seen, "probe_words")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    anchors = keep_first(own.join(counts, "word"), ["ref_id"], F.col("n"), F.col("word")).select("ref_id", "word")
    pairs = anchors.join(seen, "word").select("ref_id", "doc_id").join(probe.select("ref_id", "probe"), "ref_id")
    hits = pairs.join(body, "doc_id").filter(F.contains("body", "probe")).select("ref_id", "doc_id")
    odd = probe.filter(F.size("inner") == 0)
    if odd.isEmpty():
        return hits
    least = length // 2
    long = body.filter(F.expr(f"exists(split(body, ' '), w -> length(w) >= {least - 1})"))
    return hits.unionByName(long.join(odd, F.contains("body", "probe")).select("ref_id", "doc_id"))


def probes(refs: DataFrame, docs: DataFrame, start: int = 1, length: int = 60) -> DataFrame:
    """ref_id, doc_id: each reference once, with the smallest document its stretch occurs in."""
    return keep_first(probe_hits(refs, docs, start, length), ["ref_id"], F.col("doc_id"))


def probes_once(refs: DataFrame, docs: DataFrame, start: int = 1, length: int = 60) -> DataFrame:
    """ref_id, doc_id: each reference once and each document once; references in order of id take the smallest document left.

    The greedy order needs only the pairs found, which are as few as the overlap itself; rounds settle all references
    that no smaller reference competes with, and as many rounds run as the longest chain of rivals.
    """
    left, done = shared.kept(probe_hits(refs, docs, start, length).distinct(), "probe_pairs"), None
    while not left.isEmpty():
        wish = left.groupBy("ref_id").agg(F.min("doc_id").alias("doc_id"))
        # A wish holds if no smaller reference may still come to want the document.
        claim = left.groupBy("doc_id").agg(F.min("ref_id").alias("first"))
        settled = shared.kept(wish.join(claim, "doc_id").filter("ref_id = first").select("ref_id", "doc_id"), "probes_settled")
        done = settled if done is None else done.unionByName(settled)
        left = shared.kept(left.join(settled.select("ref_id"), "ref_id", "left_anti").join(settled.select("doc_id"), "doc_id", "left_anti").select("ref_id", "doc_id"), "probe_pairs")
    return left if done is None else done


def leakage(one: DataFrame, two: DataFrame) -> DataFrame:
    """n_shared: normalised texts that both sides hold."""
    a, b = one.select(text.normalise(F.col("text")).alias("t")), two.select(text.normalise(F.col("text")).alias("t"))
    return a.intersect(b).agg(F.count("*").alias("n_shared"))
