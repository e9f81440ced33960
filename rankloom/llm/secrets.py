"""Secret spans: three base patterns, and credential-context values that cost too many guesses to be words.

A value that follows a credential word is priced by dynamic programming: the cheapest way to segment it into common
words, dates, repeats, keyboard or alphabet walks and brute-force spans. What a guesser must try for a segment is a
number; the price is the sum of their logarithms plus one bit of order for each further segment. A value of at least
``min_log10`` is a span of kind ``guess``; of a value that base spans cover in part, the rest is.

Words and their ranks come from a short list and, behind it, the words that a public tokenizer's vocabulary file holds
in order of id (its path is a parameter): some twenty thousand. Prose after "is" or a bare "bearer" must have
characters of two classes to count as a value at all; addresses of pages and of mail never do.

Nulls: a null text is empty and has no spans; null doc_ids and repeated rows are kept, one result each. Spans are in
code points of the whole text, however long; the price is linear in a value's length. Spans that start together come
in the order of kinds. Extra columns are not looked at by ``scan`` and kept by ``redact``. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm import common, tokens

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Credential words whose value is looked at.
CONTEXT = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "credential", "authorization", "bearer", "private_key", "access_key", "login")
_CONTEXT = re.compile(
    rf"""(?:{'|'.join(CONTEXT)})(?:[_-]?(?:key|value|token|hash|code)s?|s)?["']?[\x20\t]*(?:(?:[:=]|(?P<prose>\bis\b))[\x20\t]*["']?(?:(?:bearer|basic|digest|token)[\x20\t]+)?["']?|(?<=bearer)(?P<bare>[\x20\t]+))(?P<value>[^\s"'<>,;]+)""",
    re.IGNORECASE | re.ASCII,
)
_ADDRESS = re.compile(r"[a-z][a-z0-9+.-]*://|[\w.+-]+@[\w-]+\.[\w.-]+$", re.IGNORECASE)

#: Common words of passwords, most common first: the rank is the number of guesses.
WORDS = (
    "password the admin welcome qwerty love dragon monkey master login hello sunshine princess football shadow "
    "letmein secret summer winter spring autumn user test guest root changeme default access token key pass "
    "server system company public private internal example sample demo temp backup batman superman soccer hockey "
    "baseball michael jordan george daniel thomas robert charlie london paris berlin madrid freedom computer "
    "internet google apple orange banana cookie cheese pepper flower angel butter star blue green red black white "
    "silver gold happy lucky family home house friend money january february march april may june july august "
    "september october november december monday tuesday wednesday thursday friday saturday sunday and you for with "
    "this that what from have word one two three four five six seven eight nine ten your my our new old first last"
).split()
_LONGEST = 20
#: Ends of a run that are tried as a segment of their own, beside the whole run.
_TAILS = 64


@functools.cache
def ranks(path: str | None = None) -> dict[str, int]:
    """Rank of each known word: WORDS, then the whole words of a vocabulary file in order of id."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = sorted(tokens.load(path).get_vocab().items(), key=lambda x: x[1])
    whole = (token[1:].lower() for token, _ in vocabulary if token[:1] == tokens.SHOWN_SPACE)
    known = dict.fromkeys([*WORDS, *(w for w in whole if 3 <= len(w) <= _LONGEST and w.isascii() and w.isalpha())])
    return {w: k for k, w in enumerate(known, 1)}


_PLAIN = str.maketrans("430157$@!", "aeoissTai".lower())
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in [*zip(row, row[1:], strict=False), *zip(row[1:], row, strict=False)]}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_BIT, _WALKS = math.log10(2), math.log10(len(_ROWS) * 10)


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def guess_cost(value: str, known: dict[str, int] | None = None) -> float:
    """log10 of the guesses for the cheapest segmentation of a value."""
    known = ranks() if known is None else known
    n, lower = len(value), value.lower()
    if len(lower) != n:  # a few letters change length; their case is then left alone
        lower = value
    plain = lower.translate(_PLAIN)
    best, brute = [math.inf] * (n + 1), [math.inf] * (n + 1)  # of a prefix, and of one that ends in brute-force characters
    best[0] = 0.0
    step = [math.log10(_alphabet(c)) for c in value]
    same = walk = 1
    for i in range(n):
        same = same + 1 if i and value[i] == value[i - 1] else 1
        walk = walk + 1 if i and (lower[i - 1], lower[i]) in _NEXT else 1
        more = _BIT if i else 0.0
        brute[i + 1] = step[i] + min(brute[i], best[i] + more)
        ways = [best[i + 1], brute[i + 1]]
        for run, first in ((same, step[i]), (walk, _WALKS)):
            for k in (*range(3, min(run, _TAILS) + 1), *([run] if run > _TAILS else ())):
                ways.append(best[i + 1 - k] + first + math.log10(k) + (_BIT if k <= i else 0.0))
        best[i + 1] = min(ways)
        for k in range(3, min(_LONGEST, n - i) + 1):
            for form, twist in ((lower, 0.0), (plain, _BIT)):
                if rank := known.get(form[i : i + k]):
                    price = math.log10(rank) + twist + (0.0 if value[i : i + k] == form[i : i + k] else _BIT) + _BIT
                    best[i + k] = min(best[i + k], best[i] + price + more)
        if value[i].isdigit() and (m := _DATE.match(value, i)):
            best[m.end()] = min(best[m.end()], best[i] + _date_price(m) + more)
    return best[n]


def _date_price(m: re.Match) -> float:
    digits = sum(c.isdigit() for c in m[0])
    return math.log10({4: 120, 6: 120 * 12}.get(digits, 120 * 366)) + (2 * _BIT if digits < len(m[0]) else 0.0)


def _classes(value: str) -> int:
    """How many of small letters, capitals after the first letter, digits and other characters are there."""
    return any(c.islower() for c in value) + any(c.isupper() for c in value[1:]) + any(c.isdigit() for c in value) + any(not c.isalnum() for c in value.strip("-_.()*"))


def _uncovered(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a value that no base span covers; taken is in order, its ends too."""
    out = []
    for s, e in taken[bisect.bisect_right(taken, a, key=lambda x: x[1]) :]:
        if s >= b:
            break
        if s > a:
            out.append((a, s))
        a = max(a, e)
    return [*out, (a, b)] if a < b else out


def find(text: str | None, min_log10: float = 10.0, min_chars: int = 8) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, where the value starts) of all spans, by start and then kind as listed."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), "assign", m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), "hex", m.end(), m.start()) for m in _HEX.finditer(text)]
    if any(w in low for w in CONTEXT):
        taken: list[tuple[int, int]] = []
        for s, e in sorted((s, e) for s, _, e, _ in out):  # joined, so that starts and ends rise together
            if taken and s <= taken[-1][1]:
                taken[-1] = taken[-1][0], max(e, taken[-1][1])
            else:
                taken.append((s, e))
        for m in _CONTEXT.finditer(text):
            value = m["value"].rstrip(".!?:)]}")
            if len(value) < min_chars or _ADDRESS.match(value) or (m["prose"] or m["bare"]) and _classes(value) < 2:
                continue
            a = m.start("value")
            left = _uncovered(a, a + len(value), taken)
            if left and guess_cost(value) >= min_log10:
                out += [(s, "guess", e, s) for s, e in left]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def as_string(spans: list[tuple[int, str, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, _ in spans if k in kinds)


def scan(docs: DataFrame, min_log10: float = 10.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of every document."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [find(t, min_log10) for t in part["text"]]
            out = {f"n_{kind}": [sum(s[1] == kind for s in f) for f in found] for kind in KINDS}
            out["base_sha256"] = [hashlib.sha256(as_string(f, KINDS[:3]).encode()).hexdigest() for f in found]
            out["spans"] = [as_string(f) for f in found]
            yield pd.DataFrame({"doc_id": part["doc_id"], **out})

    common.prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"))
    out = rows.mapInPandas(look, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess")


def redact_text(text: str | None, min_log10: float = 10.0, mask: str = "[SECRET]") -> str | None:
    """The text with every span's value masked; the word before it stays."""
    if not text:
        return text
    out, at = [], 0
    for a, b in sorted((v, e) for _, _, e, v in find(text, min_log10)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, min_log10: float = 10.0) -> DataFrame:
    """docs with secrets masked in text; all other columns and all rows stay."""

    def mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: redact_text(t, min_log10), na_action="ignore")

    common.prepare(docs.sparkSession)
    return docs.withColumn("text", F.pandas_udf(mask, "string")(F.col("text")))
