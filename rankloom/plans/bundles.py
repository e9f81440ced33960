"""Profile bundles and build order: which registered queries make up one report or one build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.plans import annotate, catalog, corpus, extended, integrity, judging, retrieval  # noqa: F401  (they register their queries)

#: One profile for each kind of corpus.
BUNDLES = {
    "labelled_pairs": ("label_mix", "label_counts", "conflict_pairs", "relevance_density", "text_length_stats", "leakage", "delimiter_counts", "literal_filter"),
    "postings": ("top_sources", "text_length_stats", "english_documents", "label_statistics"),
    "annotated_spans": ("tag_counter", "span_offsets", "span_repair", "distinct_matches"),
    "tagged_sentences": ("tag_counter", "token_stats", "split_summary"),
    "web_pages": ("html_tags", "url_redaction", "shingle_containment", "contamination_thresholds", "exclusion_list"),
    "large_corpus": ("token_stats", "text_length_stats", "top_sources", "item_derivative"),
    "vocabulary": ("collection_digest", "alias_coverage", "weighted_coverage", "vocabulary_build"),
    "job_table": ("family_alignment", "skill_freq", "parsed_lists", "experience_bands"),
}

#: Derived tables in the order in which they depend on each other.
BUILD = ("doc_split", "pair_split", "region_partition", "shortlist_cells", "pools_nested", "campaign_replay", "campaign_holdout", "queue_build")


def bundle(spark: SparkSession, sf_dir: str, name: str) -> dict[str, DataFrame]:
    """The queries of one profile."""
    known = catalog.queries()
    return {q: known[q](spark, sf_dir) for q in BUNDLES[name]}


def build(spark: SparkSession, sf_dir: str, out: str, only: str | None = None) -> list[str]:
    """Write the derived tables below a folder, all or one."""
    done, known = [], catalog.queries()
    for name in BUILD:
        if only in (None, name):
            known[name](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
            done.append(name)
    return done
