"""Text expressions and small text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words too frequent to search by.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its just me more most my no nor not of on only or other our out over own same she so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)
#: Markers that comments carry.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE")
#: Known beginnings of secrets.
SECRET_PATTERNS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
}
QUOTED_CANDIDATE = r"[\"'][A-Za-z0-9+/=_-]{24,}[\"']"


def tokens(text: str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def identifier_words(text: str, least: int = 3, most: int = 50) -> Column:
    """The words of identifiers: camel and snake case split, lower case, ``least`` to ``most`` characters,
    not all digits, no stop words."""
    split = F.regexp_replace(F.col(text), r"([a-z0-9])([A-Z])", "$1 $2")
    parts = F.regexp_extract_all(F.lower(split), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    return F.filter(parts, lambda w: (F.length(w) >= least) & (F.length(w) <= most) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w))


def ngrams(words: str, n: int) -> Column:
    """Runs of ``n`` words joined by spaces; empty for fewer words."""
    return F.expr(f"if(size({words}) >= {n}, transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')), cast(array() as array<string>))")


def trigrams(text: str) -> Column:
    """The set of trigrams of the lower-cased text, two spaces before and one behind it."""
    t = f"concat('  ', lower({text}), ' ')"
    return F.expr(f"array_distinct(transform(sequence(1, length({t}) - 2), i -> substring({t}, i, 3)))")


def set_similarity(a: str, b: str) -> Column:
    """Jaccard similarity of two array columns; null if both are empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, common / union)


def strip_html(text: str) -> Column:
    """Text without scripts, styles, comments and tags, common entities resolved, white space squeezed."""
    t = F.regexp_replace(F.col(text), r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalise_extracted(text: str) -> Column:
    """Extracted text with words joined over line ends, page numbers dropped and white space tidied."""
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(\p{L})-\n(\p{Ll})", "$1$2")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:[Pp]age )?\d{1,4}(?: of \d{1,4})?[ \t]*$\n?", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def shannon_entropy_bits(counts: list[int]) -> float:
    """Entropy in bits of a list of counts."""
    import math

    total = sum(counts)
    return -sum(c / total * math.log2(c / total) for c in counts if c) if total else 0.0


_VOWEL = "aeiou"


def stem(word: str) -> str:
    """A light English stemmer: plurals, -ed, -ing, -ly and final -e are taken off long enough words."""
    w = word.lower()
    if len(w) > 4 and w.endswith("sses"):
        w = w[:-2]
    elif len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "i"
    elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for suffix in ("ing", "edly", "ed", "ly"):
        if w.endswith(suffix) and len(w) - len(suffix) >= 3 and any(c in _VOWEL for c in w[: -len(suffix)]):
            w = w[: -len(suffix)]
            if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "lsz":
                w = w[:-1]
            break
    if w.endswith("y") and len(w) > 3 and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    if w.endswith("e") and len(w) > 4:
        w = w[:-1]
    return w


def damerau(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours as one step; -1 beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return -1
    last: dict[str, int] = {}
    big = len(a) + len(b)
    d = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    out = d[len(a) + 1][len(b) + 1]
    return out if out <= most else -1


def soundex_like(word: str) -> str:
    """A rough phonetic key: vowels drop, consonants fall into six classes, runs collapse."""
    groups = {c: str(n) for n, cs in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in cs}
    w = re.sub(r"[^a-z]", "", word.lower())
    if not w:
        return ""
    out, prev = w[0].upper(), groups.get(w[0], "")
    for c in w[1:]:
        g = groups.get(c, "")
        if g and g != prev:
            out += g
        if c not in "hw":
            prev = g
    return (out + "000")[:4]
