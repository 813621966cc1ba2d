"""Scalar expressions over page text.  All are built-in Spark functions, so they stay in the JVM.

``FLAGS`` makes matching blind to case in every script.  A null input gives null
unless the docstring says otherwise.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .patterns import FOREIGN, SPACE

FLAGS = "(?iu)"
DOTALL = "(?ius)"


def strip_html(text: Column, trim: bool = False) -> Column:
    """Visible text: bodies of script, style, noscript and template, tags and entities become blanks; white space collapses."""
    out = F.regexp_replace(text, DOTALL + r"<(script|style|noscript|template)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, FLAGS + r"&[a-z#0-9]+;", " ")
    out = F.regexp_replace(out, SPACE + "+", " ")
    return F.trim(out) if trim else out


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    """Character references to characters (Spark has no function for it); only texts with an ampersand are touched."""
    return s.map(lambda x: html.unescape(x) if x and "&" in x else x)


def strip_html_unescaped(text: Column) -> Column:
    """As :func:`strip_html` with trimming, but entities are resolved instead of dropped."""
    out = F.regexp_replace(text, DOTALL + r"<(script|style|noscript|template)\b.*?</\1>", " ")
    out = html_unescape(F.regexp_replace(out, r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(out, SPACE + "+", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def title_of(text: Column, most: int = 120) -> Column:
    """The first title element, white space collapsed, at most ``most`` characters; empty if there is none."""
    return F.substring(collapse(F.regexp_extract(text, DOTALL + r"<title[^>]*>(.*?)</title>", 1)), 1, most)


def matches(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level; one that is a plain group gives its own."""
    out, depth, inside, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    out.append(pattern[start:])
    if len(out) > 1:
        return [x for part in out for x in alternatives(part)]
    return alternatives(pattern[3:-1]) if pattern.startswith("(?:") and _closes_last(pattern) else out


def _closes_last(pattern: str) -> bool:
    """Whether the group that opens a pattern closes at its very end."""
    depth, inside, i = 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i == len(pattern) - 1
        i += 1
    return False


def by_beginning(pattern: str, deep: int = 4) -> str:
    """A pattern that matches in the same texts, with alternatives put together by their first characters.

    A long list of words is tried word by word at every place of a text; put
    together by beginnings, most of them fail on one character.  It tells only
    whether there is a match: which alternative it is may differ.
    """
    return _together(alternatives(pattern), deep)


def _together(parts: list[str], deep: int) -> str:
    groups: dict[str, list[str]] = {}
    for part in parts:
        edge = "\\b" if part.startswith("\\b") else ""
        rest = part[len(edge) :]
        plain = deep > 0 and rest[:1] and (rest[0].isalnum() or rest[0] in " -") and rest[1:2] not in ("*", "+", "?", "{")
        head = edge + rest[0] if plain else ""
        groups.setdefault(head, []).append(part[len(head) :])
    out = [x for x in groups.pop("", [])]
    for head, rest in groups.items():
        out.append(head + (rest[0] if len(rest) == 1 else "(?:" + _together(rest, deep - 1) + ")"))
    return "|".join(out)


def guarded(pattern: str, deep: int = 4, few: int = 4) -> str:
    """As :func:`by_beginning`, with a look at the next character before the alternatives of ``few`` first characters.

    The looks halve the characters, so that a place costs some looks instead of
    a try of each beginning.  They are blind to case as the pattern is; a first
    character outside ASCII is let through by all of those.
    """
    firsts: dict[str, list[str]] = {}
    for part in alternatives(pattern):
        rest = part.removeprefix("\\b")
        plain = rest[:1] and (rest[0].isalnum() or rest[0] in " -") and rest[1:2] not in ("*", "+", "?", "{")
        first = rest[0].lower() if plain else ""
        if plain and not rest[0].isascii():
            forms = rest[0] + rest[0].lower() + rest[0].upper() + rest[0].upper().lower()
            first = "" if any(c.isascii() for c in forms) else "far"
        firsts.setdefault(first, []).append(part)
    others, far = firsts.pop("", []), firsts.pop("far", [])

    def looks(keys: list[str]) -> str:
        half = len(keys) // 2
        inner = _together([x for k in keys for x in firsts[k]], deep) if len(keys) <= few else looks(keys[:half]) + "|" + looks(keys[half:])
        return f"(?=[{''.join(keys).replace('-', chr(92) + '-')}])(?:{inner})"

    out = [looks(sorted(firsts))] if firsts else []
    out += [rf"(?=(?-iu:[^\x00-\x7f]))(?:{_together(far, deep)})"] if far else []
    return "|".join([*out, _together(others, deep)] if others else out)


def has_match(text: Column, pattern: str) -> Column:
    return text.rlike(f"{FLAGS}(?:{guarded(pattern)})")


def distinct_matches(text: Column, pattern: str) -> Column:
    """Sorted distinct lower-cased matches.  The cheap test first spares the extraction for texts without any."""
    found = F.array_sort(F.array_distinct(F.transform(matches(text, pattern), F.lower)))
    return F.when(has_match(text, pattern), found).otherwise(F.array().cast("array<string>"))


def ordered_matches(text: Column, pattern: str, most: int = 400) -> Column:
    """Distinct lower-cased matches in order of appearance, of the first ``most``."""
    return F.array_distinct(F.transform(F.slice(matches(text, pattern), 1, most), F.lower))


def first_match(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """The first match, or null."""
    return F.regexp_substr(text, F.lit(flags + pattern))


def running_starts(gaps: Column, sizes: Column) -> Column:
    """Starts of parts of ``sizes``, each after its gap (arrays of one length).

    Sums run over blocks of about the square root of the number of parts, then
    over the blocks, so that a text with very many parts costs no square of them.
    """
    parts = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"))
    width = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        return F.struct((here + x["size"]).alias("at"), F.concat(acc["all"], F.array(here)).alias("all"))

    def whole(parts: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0)), width),
            lambda i: F.aggregate(F.slice(parts, i + 1, width), F.struct(F.lit(0).alias("at"), none.alias("all")), step))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("all"))
        add = lambda acc, b: F.struct(
            (acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(F.transform(b["all"], lambda x: x + acc["at"]))).alias("all"))
        return F.flatten(F.aggregate(blocks, start, add, lambda acc: acc["all"]))

    return whole(parts)


def foreign_script(text: Column) -> Column:
    """Whether Kana, CJK, Cyrillic, Thai or Hangul occurs."""
    return text.rlike(FOREIGN)


def json_objects(text: Column, schema: str) -> Column:
    """A JSON array as array of structs; null for anything else."""
    return F.from_json(F.when(F.trim(text).startswith("["), text), schema)


def json_inside(text: Column, schema: str) -> Column:
    """The first ``{...}`` block of a text, parsed; the whole text if there is none; null if it is no JSON."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    block = F.regexp_extract(trimmed, r"(?s)\{.*\}", 0)
    return F.from_json(F.when(block != "", block).otherwise(trimmed), schema)


def obfuscation_parts(text: Column) -> Column:
    """Names of the obfuscation marks found, in fixed order."""
    # The marks.
    marks = [
        ("eval-decoder", FLAGS + r"eval\(\s*(atob|unescape|decodeURIComponent|String\.fromCharCode)"),
        ("hexrun", r"(\\x[0-9a-fA-F]{2}){12,}"),
        ("docwrite-script", FLAGS + r"document\.write\([^)]{0,40}<scr"),
        ("charcode-run", r"String\.fromCharCode\([0-9]+(,[0-9]+){8,}"),
    ]
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in marks]))


def obfuscation_score(parts: Column) -> Column:
    """3 for a decoder call, 2 for each other mark."""
    return F.size(parts) * 2 + F.array_contains(parts, "eval-decoder").cast("int")


def gibberish(segment: Column) -> Column:
    """Longer than 9, under 22 % vowels, and six consonants in a row."""
    # Vowels, the share of them, and the run of consonants.
    vowels = F.regexp_count(segment, F.lit("[aeiou]"))
    return (F.length(segment) > 9) & (vowels / F.length(segment) < 0.22) & segment.rlike("[bcdfghjklmnpqrstvwxz]{6,}")


def local_day(ts: Column, hours: int = 6) -> Column:
    """Calendar day at a fixed offset from UTC, for epoch seconds or a timestamp."""
    return F.date_format(_shifted(ts, hours), "yyyy-MM-dd")


def local_hour(ts: Column, hours: int = 6) -> Column:
    return F.date_format(_shifted(ts, hours), "yyyy-MM-dd-HH")


def _shifted(ts: Column, hours: int) -> Column:
    return ts.cast("timestamp_ntz") + F.expr(f"INTERVAL {hours} HOURS")


def cap(text: Column, most: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)
