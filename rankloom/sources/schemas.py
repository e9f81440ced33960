"""Explicit schemas of the relations that are read and written."""

PAIRS = "resume_text string, job_description_text string, label string"
SPLIT = "doc_id string, doc_type string, split string"
POOLS = "query_id string, doc_id string, relevance string, source string, pool_variant string"
SCORES = "query_id string, doc_id string, score double"
JUDGEMENTS = "pair_id string, batch string, stratum string, corpus string, query_id string, doc_id string, selection_reason string, annotator string, label string, shortlist_pick string, notes string"
PROMPTS = "pair_id string, query_id string, doc_id string, run int, draw string, prompt string, prompt_sha256 string, chars_sent int, agent_sha256 string, model string"
RETURNS = "pair_id string, run int, returned_at string, raw string"
SPANS = "content string, annotation array<struct<label: string, points: array<struct<start: int, end: int, text: string>>>>"
TAGGED = "idx int, tokens array<string>, tags_skill array<string>, tags_knowledge array<string>, source string"
