"""Text expressions: every regular expression and cut-off rule lives here, as Column functions that stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading forms, longest heading, blanks cut from headings.
HEADING_MAX = 48
ORDINAL = "第[0-9零一二三四五六七八九十百千万两〇]+"
CHAPTER_UNIT, VOLUME_UNIT = "[章节回篇部集节]", "[卷]"
HEADING_SEPARATOR = r"[\s　：、:]*"
HEADING_BLANKS = " \t\r\n　﻿\x0b\x0c"
CHAPTER_HEADING = rf"^{ORDINAL}{CHAPTER_UNIT}{HEADING_SEPARATOR}.*$"
ENGLISH_HEADING = r"(?i)^(chapter|chap\.)\s+\p{Nd}+.*$"
VOLUME_HEADING = rf"^{ORDINAL}{VOLUME_UNIT}{HEADING_SEPARATOR}.*$"
TITLED = rf"^({ORDINAL}(?:{CHAPTER_UNIT}|{VOLUME_UNIT})){HEADING_SEPARATOR}(.*)$"
CJK = "[一-鿿]"
#: Sentence ends: of events, and of relations, which also end at semicolons.
EVENT_SPLIT, RELATION_SPLIT = r"(?<=[。！？!?])\s*|\n+", r"(?<=[。！？!?；;])\s*|\n+"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def case_folded(t: Column) -> Column:
    """A text that has another one, letters' case aside, just where their folded forms (Python's ``casefold``) do: ß is ss, and both Greek sigmas are one.

    Capitals do it, as they are full mappings, but for seven letters: five that are capitals of their own, İ, which folds to two, and ı, which folds to itself.
    """
    plain = F.translate(F.replace(t, F.lit("\u0130"), F.lit("i\u0307")), "\u1e9e\u03f4\u2126\u212a\u212b", "\u00df\u03b8\u03c9k\u00e5")
    return F.array_join(F.transform(F.split(plain, "\u0131"), F.upper), "\u0131")


def normalize_newlines(t: Column) -> Column:
    return F.regexp_replace(t, "\r\n?", "\n")


def strip_heading(t: Column) -> Column:
    return F.btrim(t, F.lit(HEADING_BLANKS))


def strip(t: Column) -> Column:
    """Unicode white space cut from both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def collapse(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_name(t: Column) -> Column:
    return F.lower(F.regexp_replace(t, r"(?U)\s+", ""))


def is_volume(line: Column) -> Column:
    s = strip_heading(line)
    return (F.length(s) <= HEADING_MAX) & s.rlike(VOLUME_HEADING)


def is_chapter(line: Column) -> Column:
    s = strip_heading(line)
    return (F.length(s) <= HEADING_MAX) & (s.rlike(CHAPTER_HEADING) | s.rlike(ENGLISH_HEADING))


def clean_title(line: Column) -> Column:
    """What follows the ordinal, or the ordinal itself if nothing does; other headings whole."""
    s = strip_heading(line)
    rest = strip(F.regexp_extract(s, TITLED, 2))
    return F.when(s.rlike(TITLED), F.when(rest == "", F.regexp_extract(s, TITLED, 1)).otherwise(rest)).otherwise(s)


def clean_volume(line: Column) -> Column:
    s = strip_heading(line)
    return F.when(s.rlike(TITLED), strip(F.concat_ws(" ", F.regexp_extract(s, TITLED, 1), strip(F.regexp_extract(s, TITLED, 2))))).otherwise(s)


def tokens(t: Column) -> Column:
    """Distinct lower-case words, single CJK characters, and CJK bigrams (formed after all else is removed). Texts without CJK skip what only CJK has."""

    def of(low: Column) -> Column:
        words = F.regexp_extract_all(low, F.lit("[A-Za-z0-9_]+"), F.lit(0))
        chars = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
        pairs = let(chars, lambda c: F.filter(F.transform(c, lambda x, i: F.concat(x, F.get(c, i + 1))), lambda x: x.isNotNull()))
        return F.array_distinct(F.when(low.rlike(CJK), F.concat(words, chars, pairs)).otherwise(words))

    return let(F.lower(F.coalesce(t, F.lit(""))), of)


def token_pattern(tokens: Sequence[str]) -> str:
    """A regular expression that a lower-case text matches where ``tokens`` of it has one of these."""
    cjk = lambda x: len(x) <= 2 and all("一" <= c <= "鿿" for c in x)
    apart = "[^一-鿿]*"
    words = "|".join(re.escape(x) for x in tokens if not cjk(x))
    parts = [apart.join(x) for x in tokens if cjk(x)] + ([rf"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"] if words else [])
    return "|".join(parts) or "(?!)"


def candidate_tokens(tokens: Column) -> Column:
    """Without single CJK characters, unless there is nothing else."""
    return let(F.filter(tokens, lambda x: ~x.rlike(f"^{CJK}$")), lambda x: F.when(F.size(x) > 0, x).otherwise(tokens))


def lexical_score(query_tokens: Column, doc_tokens: Column, query: Column, doc: Column) -> Column:
    """Share of the query's tokens, plus hits over the root of the text's tokens, plus 0.25 if the text has the query, blanks aside."""
    hits = F.size(F.array_intersect(query_tokens, doc_tokens))
    bonus = F.when(F.contains(F.replace(doc, F.lit(" "), F.lit("")), F.replace(query, F.lit(" "), F.lit(""))), 0.25).otherwise(0.0)
    score = hits / F.size(query_tokens) + hits / F.sqrt(F.size(doc_tokens)) + bonus
    return F.when((F.size(query_tokens) == 0) | (F.size(doc_tokens) == 0), 0.0).otherwise(score)


def positions(t: Column, key: Column) -> Column:
    """0-based places of all non-overlapping occurrences of a literal."""
    def places(parts: Column) -> Column:
        ends = F.aggregate(
            F.slice(parts, 1, F.size(parts) - 1),
            F.array().cast("array<int>"),
            lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + F.length(key), F.lit(0)) + F.length(p))),
        )
        return ends

    return F.when(F.contains(t, key) & (key != ""), let(F.split(t, F.concat(F.lit(r"\Q"), key, F.lit(r"\E")), -1), places)).otherwise(F.array().cast("array<int>"))


def excerpt(t: Column, at: Column, length: Column, pad: int) -> Column:
    """The text around a place, line ends as blanks."""
    start = F.greatest(at - pad, F.lit(0))
    end = F.least(F.length(t), at + length + pad)
    return F.replace(strip(F.substring(t, start + 1, end - start)), F.lit("\n"), F.lit(" "))


def clip(t: Column, n: int) -> Column:
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n)), F.lit("..."))).otherwise(t)


def sentences(t: Column, pattern: str = EVENT_SPLIT, least: int = 8, most: int = 220) -> Column:
    return F.filter(F.transform(F.split(t, pattern), collapse), lambda s: F.length(s).between(least, most))


def relation_windows(t: Column, most: int = 120, pattern: str = RELATION_SPLIT) -> Column:
    """Sentences; longer ones cut into windows of ``most`` characters; of at least 8."""
    cut = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1)), F.lit(most)), lambda i: strip(F.substring(s, i, F.lit(most)))))
    return F.filter(F.flatten(F.transform(F.transform(F.split(t, pattern), collapse), cut)), lambda s: F.length(s) >= 8)


def bigrams(t: Column) -> Column:
    """Distinct character pairs; of one character, itself."""
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def bare(t: Column) -> Column:
    """Letters, digits and CJK only, in lower case."""
    return F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), "[^0-9A-Za-z一-鿿]+", ""))


def near_duplicate(left: Column, right: Column, threshold: float = 0.78) -> Column:
    """One holds the other (16 characters or more), or their character pairs are alike by Jaccard or containment."""
    def of(a: Column, b: Column) -> Column:
        short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
        x, y = bigrams(a), bigrams(b)
        common = F.size(F.array_intersect(x, y))
        alike = (common >= threshold * F.size(F.array_union(x, y))) | (common >= threshold * F.least(F.size(x), F.size(y)))
        return F.when((a == "") | (b == ""), False).otherwise(((F.length(short) >= 16) & F.contains(long, short)) | alike)

    return let(bare(left), lambda a: let(bare(right), lambda b: of(a, b)))


def has_any(t: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(x)) for x in terms], F.lit(False))


def first_match(t: Column, groups: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The label of the first group that has a term in the text."""
    out = F.lit(otherwise)
    for label, terms in reversed(groups):
        out = F.when(has_any(t, terms), label).otherwise(out)
    return out


def summary(t: Column, n: int = 140) -> Column:
    """White space collapsed, cut with dots."""
    return clip(collapse(t), n)


def escape_like(term: str) -> str:
    return term.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
