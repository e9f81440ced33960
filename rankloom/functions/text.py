"""Scalar text functions as column expressions; no Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; the engines' own \s is ASCII only.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"

#: Families of technology terms, in order, and how often each match is appended.
SKILL_FAMILIES = (
    r"\b(python|java|c\+\+|sql|javascript|typescript|go|rust|scala|perl)\b",
    r"\b(tensorflow|keras|pytorch|scikit-learn|pandas|numpy)\b",
    r"\b(aws|gcp|azure|kubernetes|docker|jenkins|gitlab|github)\b",
    r"\b(react|angular|vue|node\.?js)\b",
    r"\b(postgres|mongodb|redis|cassandra|mysql|elasticsearch)\b",
    r"\b(rest|graphql|rpc|soap)\b",
    r"\b(agile|scrum|kanban)\b",
    r"\b(git|svn|mercurial)\b",
)
SKILL_REPEAT = 2

#: What is masked, in order, and what must not survive.
MASKS = (
    ("url", r"(?iU)\b(?:https?://|www\.)\S+", "[URL]"),
    ("email", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    ("phone", r"(?U)(?<!\w)(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]\d{2,4}){1,3}(?!\w)", "[PHONE]"),
    ("digits", r"(?U)(?<!\w)\d{7,}(?!\w)", "[NUMBER]"),
)
RESIDUALS = (("email", MASKS[1][1]), ("url", MASKS[0][1]), ("phone_intl", r"(?U)(?<!\w)\+\d{7,}(?!\w)"))


def normalise(text: Column) -> Column:
    """White-space runs become one space, ends are stripped, case stays."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def mint_id(text: Column, prefix: str) -> Column:
    """prefix and twelve hex digits of the digest of the normalised text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(normalise(text), 256), 1, 12))


def plain(text: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more letters, digits or underscores; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def once(column: Column) -> Column:
    """A generator of the one value: what reads it many times gets an attribute, not a copy of the expression."""
    return F.explode(F.array(column))


def shingles(words: Column, n: int) -> Column:
    """The distinct runs of n words as 64-bit hashes; words must be an attribute, as it is read often."""
    last = F.size(words) - (n - 1)
    every = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<bigint>"))


def skills(text: Column) -> Column:
    """All skill matches of each family, the whole list SKILL_REPEAT times, space-joined; empty for no match."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract_all(low, F.lit(p), 1) for p in SKILL_FAMILIES]
    return F.array_join(F.concat(*(x for f in found for x in [f] * SKILL_REPEAT)), " ")


def augment(text: Column) -> Column:
    return F.concat(text, F.lit(" "), skills(text))


def redact(text: Column) -> Column:
    """All masks in order; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for _, pattern, mask in MASKS:
        out = F.regexp_replace(out, pattern, mask.replace("$", r"\$"))
    return out


def residuals(text: Column) -> dict[str, Column]:
    """Matches of what must not survive redaction, by class."""
    filled = F.coalesce(text, F.lit(""))
    return {name: F.regexp_count(filled, F.lit(pattern)) for name, pattern in RESIDUALS}


def assemble(*fields: Column) -> Column:
    """Stripped non-empty fields joined by a blank line; three or more line ends become two."""
    kept = [F.nullif(strip(F.coalesce(f, F.lit(""))), F.lit("")) for f in fields]
    return F.regexp_replace(F.concat_ws("\n\n", *kept), "\n{3,}", "\n\n")


_QUOTED = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+\""""
_ITEM = rf"(?:{_QUOTED}|None|True|False|[-+]?[0-9][0-9.eE+-]*+)"


def parse_list(cell: Column) -> Column:
    """Strings of a list written as text, in either kind of quotes; empty where it is no list."""
    whole = cell.rlike(rf"(?s)^\s*\[\s*(?:{_ITEM}\s*+(?:,\s*+{_ITEM}\s*+)*+,?\s*)?\]\s*$")
    items = F.transform(F.regexp_extract_all(cell, F.lit(f"(?s){_QUOTED}"), 0), lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1"))
    return F.when(whole, items).otherwise(F.array().cast("array<string>"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin("true", "1"), F.lit(False))


def experience_band(years: Column) -> Column:
    return F.when(years.isNull() | F.isnan(years.cast("double")), None).when(years <= 1, "0-1").when(years <= 3, "2-3").when(years <= 6, "4-6").otherwise("7+")


#: Experience categories of the query side, as bands.
QUERY_BANDS = {"no_exp": "0-1", "1y": "0-1", "2y": "2-3", "3y": "2-3", "5y": "4-6"}


def query_band(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in QUERY_BANDS.items():
        out = F.when(category == k, v).otherwise(out)
    return out


def stratum(keywords: Column) -> Column:
    return F.when(F.coalesce(F.size(keywords), F.lit(0)) > 0, "targeted").otherwise("generic")


def section_lines(text: Column) -> Column:
    return F.split(text, "\n")
