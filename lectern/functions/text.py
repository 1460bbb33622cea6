"""Scalar text, date and URL functions as native column expressions.

Words are runs of letters, digits and underscore ([\\p{L}\\p{N}_]+), which means the same in Spark and in
the SQL oracles. Index tokens split at the underscore too and have no diacritics.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]+"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}]+"
#: Words that never become query terms.
STOPWORDS = (
    "a an and are as at be by can do does for from has have how in is it may must of on or should the their there to under what when "
    "where which who whom why will with"
).split()
TITLE_CHARS = 150
EXCERPT_CHARS = 700


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(text: Column | str) -> Column:
    """White space of any kind becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(text), SPACE, " "))


def comparable(text: Column | str) -> Column:
    """The form in which quotes are compared: no soft hyphens, no hyphens between letters, no white space."""
    no_soft = F.replace(_col(text), F.lit("\u00ad"), F.lit(""))
    joined = F.regexp_replace(no_soft, rf"(?<=\p{{L}})(?:{SPACE})?-(?:{SPACE})?(?=\p{{L}})", "")
    return F.regexp_replace(F.when(F.contains(no_soft, F.lit("-")), joined).otherwise(no_soft), SPACE, "")


def dedupe_key(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", " "))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(f"({WORD})"), F.lit(1))


def _accents() -> tuple[str, str]:
    """Letters with diacritics below U+1E00..U+1EFF and Latin blocks, and what is left without them."""
    pairs = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(cp):
            pairs[chr(cp)] = bare
    return "".join(pairs), "".join(pairs.values())


_WITH, _WITHOUT = _accents()


def fold(text: Column | str) -> Column:
    """Lower case without diacritics; loose combining marks go."""
    low = F.lower(_col(text))
    bare = F.translate(F.regexp_replace(low, r"\p{M}+", ""), _WITH, _WITHOUT)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(bare)  # ASCII has none


def tokens(text: Column | str) -> Column:
    """Index tokens, in order, with repeats."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1))


def query_terms(query: Column | str, dropped: Column | None = None) -> Column:
    """Distinct terms in order: words of two characters or more, neither stopwords nor dropped ones."""
    found = F.filter(words(query), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
    found = F.array_distinct(found)
    return F.array_except(found, dropped) if dropped is not None else found


def is_prefix_term(term: Column) -> Column:
    return F.length(term) >= 4


def shape(text: Column | str) -> Column:
    """Digits become #: lines that differ in numbers only look the same."""
    return F.regexp_replace(_col(text), r"\p{Nd}+", "#")


def ref_key(ref: Column | str) -> Column:
    """Numbers and single letters of a section reference; the same for a section and its translation."""
    return F.regexp_extract_all(F.lower(_col(ref)), F.lit(r"([0-9]+|\b[a-z]\b)"), F.lit(1))


def is_title(text: Column | str) -> Column:
    t = _col(text)
    first = F.substring(t, 1, 1)
    return (F.length(t) <= TITLE_CHARS) & ~t.rlike(r"[.;:,!?)\]»”\"]$") & ~first.rlike(r"^\p{Ll}")


def excerpt(text: Column | str, limit: int = EXCERPT_CHARS) -> Column:
    t = _col(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(" …"))).otherwise(t)


TOC_LINE = r"^.{2,}?(\.{3,}|\s{2,})\s*[0-9]+\s*$"


def toc_like(text: Column | str) -> Column:
    """Five lines or more that aren't blank, over half of which end like a table of contents."""
    lines = F.filter(F.split(_col(text), "\n"), lambda x: F.trim(x) != "")
    hits = F.size(F.filter(lines, lambda x: x.rlike(TOC_LINE)))
    return (F.size(lines) >= 5) & (hits * 2 > F.size(lines))


def unfence(output: Column | str) -> Column:
    """A model's output without a code fence around all of it."""
    return F.regexp_replace(F.trim(_col(output)), r"(?s)\A```(?:json)?\s*(.*?)\s*```\z", "$1")


def partial_date_valid(value: Column | str) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD that exists; the year 0000 doesn't."""
    v = _col(value)
    day = F.substring(F.concat(v, F.lit("-01-01")), 1, 10)
    ok = v.rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2})?)?$") & ~v.startswith("0000") & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
    return F.coalesce(ok, F.lit(False))


def in_force(effective: Column | str, as_of: Column | str) -> Column:
    """Whether a partial date has come, compared at its own precision; null means always."""
    e = _col(effective)
    today = F.lit(as_of) if isinstance(as_of, str) else as_of
    return F.coalesce(e <= F.substring(today, F.lit(1), F.length(e)), F.lit(True))


def host(url: Column | str) -> Column:
    """Lower-case host without user, port or path; null if there is none."""
    found = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def on_domains(hostname: Column, domains: Column) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(domains, lambda d: (hostname == d) | hostname.endswith(F.concat(F.lit("."), d)))


def glob_regex(pattern: str) -> str:
    """A case-sensitive shell pattern as an anchored regular expression for rlike."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        k += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", k + 1)) > 0:
            inner = pattern[k:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\" + inner if inner[0] == "^" else inner) + "]"
            k = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})\\z"


def glob_pattern(glob: Column | str) -> Column:
    """glob_regex of a column: a bracket that nothing closes stands for itself."""
    g = F.regexp_replace(_col(glob), r"([\\.+^$(){}|&])", r"\\$1")
    g = F.regexp_replace(g, r"\[(?!!?[^\]]+\])", r"\\[")
    g = F.regexp_replace(g, r"(?<!\\)\[!", "[^")
    g = F.replace(F.replace(g, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit(r"(?s)\A(?:"), g, F.lit(r")\z"))


def glob_head(glob: Column | str) -> Column:
    """The literal start of a glob: what every match begins with."""
    return F.regexp_extract(_col(glob), r"^([^*?\[]*)", 1)


def java_regex(pattern: str) -> str:
    """A Python regular expression in Java's dialect: named groups, and classes that know Unicode."""
    return "(?U)" + re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern).replace(r"\Z", r"\z")


def sha(text: Column | str) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length, in double, in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)
