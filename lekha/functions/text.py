"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Script profiles: the class of a token's characters, and the signs that a skeleton drops.
PROFILES = {
    "devanagari": (r"[ऀ-ॿ]+", r"[ऺ-ॏ॑-॔]"),
    "ascii": (r"[a-z]+", r"[aeiou]"),
}
EDGES = r"[0-9।-ॿ‌‍]+"
SPACE = r"[\s   -     　﻿]"
#: The same blanks one by one: trimming by these needs no search.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


# Common words that a variant scan leaves out.
STOP_WORDS = (
    "के", "में", "से", "को", "पर", "और", "ही", "भी", "यह", "वह", "कि", "ना", "ने", "तो", "जो", "का", "की", "एक", "सब", "तब",
    "जब", "वो", "हो", "था", "थी", "थे", "रहे", "कर", "करे", "किया", "गया", "गये", "हुआ", "हुई", "हुए", "है", "हैं")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(text: Column) -> Column:
    """The composed form; null stays null. For distinct words and titles rather than whole texts."""
    return F.pandas_udf(_composed, StringType())(text)


def prefix_sums(xs: Column, block: int = 256) -> Column:
    """Sums of the elements before each one; blocks keep the work near linear in the length."""

    def plain(ys: Column) -> Column:
        start = F.struct(F.lit(0).cast("int").alias("s"), F.array().cast("array<int>").alias("a"))
        return F.aggregate(ys, start, lambda acc, y: F.struct((acc.s + y).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")), lambda acc: acc.a)

    n = F.ceil(F.size(xs) / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(xs, b * block + 1, F.lit(block)))
    starts = plain(F.transform(blocks, lambda ys: F.aggregate(ys, F.lit(0), lambda s, y: s + y)))
    whole = F.flatten(F.zip_with(blocks, starts, lambda ys, s: F.transform(plain(ys), lambda p: p + s)))
    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).when(F.size(xs) <= block, plain(xs)).otherwise(whole)


def pieces(text: Column, profile: str) -> Column:
    """The text cut into runs of the script and what stands between; joined they are the text."""
    run = PROFILES[profile][0]
    return F.regexp_extract_all(text, F.lit(f"{run}|{run.replace('[', '[^', 1)}"), F.lit(0))


def tokens(text: Column, profile: str = "devanagari", least: int = 2, most: int = 30, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Runs of the script's characters within the length bounds, without stop words."""
    text = F.lower(text) if profile == "ascii" else text
    return F.filter(F.regexp_extract_all(text, F.lit(PROFILES[profile][0]), F.lit(0)), lambda w: F.length(w).between(least, most) & ~w.isin(*stop))


def clean_token(word: Column) -> Column:
    """The word without marks and digits at its edges."""
    return F.regexp_replace(word, f"^{EDGES}|{EDGES}$", "")


def runs(text: Column, profile: str = "devanagari") -> Column:
    """Runs of the script's characters, as they stand."""
    return F.regexp_extract_all(F.lower(text) if profile == "ascii" else text, F.lit(PROFILES[profile][0]), F.lit(0))


def clean_tokens(text: Column, profile: str = "devanagari", least: int = 2) -> Column:
    """Runs of the script's characters, cleaned at their edges, of any length from least on; those of ASCII letters have no edges to clean."""
    found = runs(text, profile)
    return F.filter(found if profile == "ascii" else F.transform(found, clean_token), lambda w: F.length(w) >= least)


def skeleton(word: Column, profile: str = "devanagari") -> Column:
    return F.regexp_replace(word, PROFILES[profile][1], "")


def variant_bound(a: Column, b: Column) -> Column:
    """Edits within which two words of these lengths are variants."""
    return F.when(F.least(a, b) <= 4, 1).otherwise(2)


def spell_bound(length: Column) -> Column:
    """Edits within which a word of this length gets suggestions."""
    return F.when(length <= 3, 1).when(length <= 6, 2).otherwise(F.greatest(F.lit(2), F.floor(length * 0.32))).cast("int")


def line_end(line: Column, mark: str = "।", double: str = "॥") -> Column:
    """A line that ends with the mark: a comma or a point becomes it, a blank line stays."""

    def ended(bare: Column) -> Column:
        last, cut = F.substring(bare, -1, 1), lambda k: F.substring(bare, F.lit(1), F.length(bare) - k)
        return (
            F.when(bare == "", line)
            .when(last.isin(mark, double), bare)
            .when(~last.isin(",", "."), F.concat(bare, F.lit(mark)))
            .when(F.substring(bare, -2, 1) == mark, cut(1))
            .otherwise(F.concat(cut(1), F.lit(mark))))

    return bound(F.rtrim(line, F.lit(BLANKS)), ended)


def line_ends(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: line_end(x)), "\n")


# Lines that a page builder leaves behind, whole or by their beginnings.
BOILERPLATE = (
    "^Google Sites$", "^Report abuse$", "^Skip to main content$", "^Skip to navigation$", "^Embedded Files$", "^Search this site$",
    "^DOCS_timing(?![A-Za-z0-9_])", "^window\\.WIZ_", "^Page built by Google")
JUNK = "(?i)^(?:" + "|".join(x[1:] for x in BOILERPLATE) + ")"


def edgeless(text: Column) -> Column:
    """The text without blanks, newlines included, at its ends."""
    return F.trim(text, F.lit(BLANKS))


def without_lines(text: Column, pattern: str) -> Column:
    """The text less the lines that match once trimmed; three newlines and more become two, and blanks of all kinds at both ends go."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~edgeless(x).rlike(pattern)), "\n")
    return edgeless(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def slug(title: Column, default: str = "bhajan", most: int = 80) -> Column:
    """A title, composed, as a file name: no reserved characters, blanks as single hyphens, at most 80 characters."""
    x = F.regexp_replace(edgeless(nfc(title)), r'[\\/:*?"<>|]', "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, f"{SPACE}+", "-"), "-+", "-"), "^-|-$", "")
    x = F.substring(x, 1, most)
    return F.coalesce(F.when(x != "", x), F.lit(default))


def deva_digits(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "०१२३४५६७८९")


def search_form(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[‌‍]", ""), f"{SPACE}+", " ")))


def snippet(text: Column, most: int = 100) -> Column:
    x = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def excerpt(text: Column, most: int = 120) -> Column:
    """The text, blanks collapsed, its first characters and an ellipsis after them if there are more."""
    x = edgeless(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def cluster_id(forms: Column) -> Column:
    return F.substring(F.md5(F.array_join(F.array_sort(forms), "|").cast("binary")), 1, 12)


def occurrences(text: Column, find: str, ignore_case: bool = False) -> Column:
    """How often a literal occurs, without overlaps."""
    x, y = (F.lower(text), find.lower()) if ignore_case else (text, find)
    return ((F.length(x) - F.length(F.replace(x, F.lit(y), F.lit("")))) / len(y)).cast("bigint")


def anchor_id(section: Column, title: Column, index: Column) -> Column:
    """section-slug-NN; index counts from 0."""
    return F.concat_ws("-", section, slug(title), F.format_string("%02d", index + 1))


_BASENAME = r"(?i)^([0-9]+)-(.+)\.ya?ml$"


def basename_parts(name: Column) -> Column:
    """A struct of prefix and slug of NNN-slug.yaml; another name has no prefix and its own slug."""
    fits = name.rlike(_BASENAME)
    return F.struct(
        F.when(fits, F.regexp_extract(name, _BASENAME, 1)).alias("prefix"),
        F.when(fits, F.regexp_extract(name, _BASENAME, 2)).otherwise(slug(F.regexp_replace(name, r"(?i)\.ya?ml$", ""))).alias("slug"))


def slug_differs(path: Column, title: Column) -> Column:
    """Whether a title's slug is not the one in the file's name."""
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return slug(title) != basename_parts(name).slug


# Shapes of verse numbers and markers at the end of a line.
_DIGIT = "[०-९0-9]"
_MARKER = r"(?:\s*(\|\|\s*[^|]+\s*\|\|)|(\s*॥+))\s*$"
_TAIL = rf"(?:(?:\s*\|\|\s*[^|]+\s*\|\||\s*॥+{_DIGIT}+॥*|\s*।\s*{_DIGIT}+\s*।?|\s*[।॥]\s*{_DIGIT}+\s*(?:टेर|तेर)?\s*[।॥]?)\s*)+$"
_CUT_AFTER_MARK, _CUT_AT_BLANK = r"^(.+?॥)\s+.+?\.\.\.\s*$", r"\s+.+?\.\.\.\s*$"


def without_verse_numbers(line: Column) -> Column:
    """The line without verse numbers inside it and at its end, blanks collapsed.

    Lines without any of the numbers' marks, most of all lines, are only trimmed.
    """
    x = line
    for pattern in (rf"[।॥]+\s*{_DIGIT}+\s*[।॥]*", rf"!+{_DIGIT}+!+", rf"\|\|\s*{_DIGIT}+\s*\|\|", _TAIL):
        x = F.regexp_replace(x, pattern, "")
    return F.trim(F.when(line.rlike(r"[।॥!|]|\s\s"), F.regexp_replace(x, r"\s{2,}", " ")).otherwise(line))


def end_marker(line: Column) -> Column:
    """A struct of body and marker: the refrain's word, 'numbered', the double mark, what else stands between bars, or null."""
    inner = F.trim(F.replace(F.regexp_extract(line, _MARKER, 1), F.lit("||"), F.lit("")))
    marker = (
        F.when(inner.rlike("^(टेर|तेर)$"), "टेर").when(inner.rlike(f"^{_DIGIT}+$"), "numbered")
        .when(F.regexp_extract(line, _MARKER, 2) != "", "॥").when(inner != "", inner)
    )
    body = F.when(line.rlike(r"[॥|]"), F.regexp_replace(line, _MARKER, "")).otherwise(line)
    return F.struct(F.trim(body).alias("body"), marker.alias("marker"))


def without_refrain_shorthand(line: Column) -> Column:
    """The line up to a repeat that ellipses cut short: up to a double mark before it or, without one, up to the first blank."""
    x = F.trim(line)
    kept = F.coalesce(F.nullif(F.regexp_extract(x, _CUT_AFTER_MARK, 1), F.lit("")), F.regexp_replace(x, _CUT_AT_BLANK, ""))
    return F.when(x.contains("..."), F.trim(kept)).otherwise(x)
