"""Documents with nested lyrics: their fields, texts, flags, listings' rows and search items.

A document has path, title, tarz, group_name, self_authored, also_in and lyrics,
a struct of LYRICS: a plain text, or a refrain (sthayi), verses before and after,
and paragraphs of a kind (antara or commentary), or several such parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekha.functions import lyrics as y
from lekha.functions import text as t

_PART = "sthayi: string, pre_shlok: string, post_shlok: string, sthayi_connect: boolean, sthayi_connect_text: string, paragraphs: array<struct<kind: string, text: string>>"
_PART_FIELDS = ("sthayi", "pre_shlok", "post_shlok", "sthayi_connect", "sthayi_connect_text", "paragraphs")
LYRICS = f"struct<{_PART}, text: string, parts: array<struct<{_PART}>>>"
DOC = f"path string, title string, tarz string, group_name string, self_authored boolean, also_in array<string>, lyrics {LYRICS}"
_FIELDS = "array<struct<field: string, kind: string, text: string>>"


def _field(name: str | Column, text: Column, kind: Column | None = None) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("field"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"), text.alias("text"))


def _rows(docs: DataFrame, fields: Column) -> DataFrame:
    """(path, field_pos, field, kind, text) of fields with a text."""
    rows = docs.select("path", F.posexplode(F.filter(fields.cast(_FIELDS), lambda x: F.coalesce(x.text, F.lit("")) != "")).alias("field_pos", "x"))
    return rows.select("path", F.col("field_pos").cast("bigint").alias("field_pos"), "x.*")


def _numbered(paragraphs: Column, name: Callable[[Column], Column]) -> Column:
    return F.transform(F.coalesce(paragraphs, F.array().cast("array<struct<kind: string, text: string>>")), lambda p, i: _field(name(i), p.text, p.kind))


def collect_fields(docs: DataFrame, commentary: bool = True) -> DataFrame:
    """The text fields that scans look at, in order; parts are not walked. Without commentary: verses only."""
    x = F.col("lyrics")
    single = F.array(_field("title", F.col("title")), _field("tarz", F.col("tarz")), _field("lyrics", x.text), _field("lyrics.sthayi", x.sthayi), _field("lyrics.pre_shlok", x.pre_shlok), _field("lyrics.post_shlok", x.post_shlok))
    verses = _numbered(x.paragraphs, lambda i: F.concat(F.lit("lyrics.paragraphs["), i.cast("string"), F.lit("]")))
    return _rows(docs, F.concat(single, verses if commentary else F.filter(verses, lambda p: p.kind != "commentary")))


def editor_fields(docs: DataFrame) -> DataFrame:
    """The fields of an editor's form: connecting text too, all paragraphs of one name, plain text last."""
    x = F.col("lyrics")
    single = F.array(_field("title", F.col("title")), _field("tarz", F.col("tarz")), *[_field(f"lyrics.{n}", x[n]) for n in ("sthayi", "pre_shlok", "post_shlok", "sthayi_connect_text")])
    return _rows(docs, F.concat(single, _numbered(x.paragraphs, lambda i: F.lit("paragraph")), F.array(_field("legacy", x.text))))


def parts_of(lyrics: Column) -> Column:
    """The parts, or the lyrics themselves as the only one."""
    return F.when(F.size(lyrics.parts) > 0, lyrics.parts).otherwise(F.array(F.struct(*[lyrics[n].alias(n) for n in _PART_FIELDS])))


def flattened(lyrics: Column) -> Column:
    """All text of the lyrics, a piece a line or more; commentary too."""
    none = F.array().cast("array<string>")

    def of(p: Column) -> Column:
        return F.array_compact(F.concat(F.array(p.pre_shlok, p.sthayi), F.coalesce(F.transform(p.paragraphs, lambda q: q.text), none), F.array(p.post_shlok)))

    return F.coalesce(lyrics.text, F.array_join(F.filter(F.flatten(F.transform(parts_of(lyrics), of)), lambda x: x != ""), "\n"))


def lyric_lines(tarz: Column, lyrics: Column) -> Column:
    """The searchable lines: tune first, without closing marks, blanks collapsed, blank lines left out."""
    lines = F.split(F.concat_ws("\n", F.nullif(tarz, F.lit("")), F.nullif(flattened(lyrics), F.lit(""))), "\n")
    return F.filter(F.transform(lines, lambda x: y.trimmed(F.regexp_replace(F.regexp_replace(x, r"\s*॥[^॥]*॥\s*$", ""), r"\s+", " "))), lambda x: x != "")


def mapped(lyrics: Column, fn: Callable[[Column], Column]) -> Column:
    """The lyrics with a text function on plain text, refrains and verses; commentary and other fields stay."""

    def of(p: Column) -> Column:
        verses = F.transform(p.paragraphs, lambda q: q.withField("text", F.when(q.kind == "commentary", q.text).otherwise(fn(q.text))))
        return p.withField("sthayi", fn(p.sthayi)).withField("paragraphs", verses)

    return F.when(lyrics.isNotNull(), of(lyrics).withField("text", fn(lyrics.text)).withField("parts", F.transform(lyrics.parts, of)))


def flag(*levels: Column) -> Column:
    """On unless a level says false; levels may be boolean or string."""
    off = [F.coalesce(F.lower(x.cast("string")) == "false", F.lit(False)) for x in levels]
    return ~F.greatest(*off) if len(off) > 1 else ~off[0]


def connected(lyrics: Column, *levels: Column) -> Column:
    """The lyrics with the connecting flag resolved over config, section, document and lyrics, parts included; a part's own false stays.

    Where it is off the flag is null. Parts take over the lyrics' connecting text if they have none.
    """
    on = flag(*levels, lyrics.sthayi_connect)

    def part(p: Column) -> Column:
        return p.withField("sthayi_connect", F.coalesce(p.sthayi_connect, F.lit(True))).withField("sthayi_connect_text", F.coalesce(y.some(p.sthayi_connect_text), lyrics.sthayi_connect_text))

    found = lyrics.withField("sthayi_connect", F.lit(True)).withField("parts", F.transform(lyrics.parts, part))
    return F.when(lyrics.isNotNull(), F.when(on, found).otherwise(lyrics.withField("sthayi_connect", F.lit(None).cast("boolean"))))


def renderable(lyrics: Column) -> Column:
    """Whether any text of the lyrics is not blank."""
    full = lambda x: F.coalesce(y.trimmed(x) != "", F.lit(False))
    part = lambda p: full(p.sthayi) | full(p.pre_shlok) | full(p.post_shlok) | F.coalesce(F.exists(p.paragraphs, lambda q: full(q.text)), F.lit(False))
    return F.when(lyrics.isNull(), False).when(lyrics.text.isNotNull(), full(lyrics.text)).otherwise(F.exists(parts_of(lyrics), part))


def post_text(lyrics: Column) -> Column:
    """What follows the lyrics, of all parts, with blank lines between."""
    return F.array_join(F.filter(F.transform(parts_of(lyrics), lambda p: y.trimmed(p.post_shlok)), lambda x: x != ""), "\n\n")


def has_refrain(lyrics: Column) -> Column:
    """Whether a part has a refrain; a plain text has the one that structuring it finds."""
    plain = y.structured(lyrics.text).sthayi
    return F.when(lyrics.text.isNotNull(), y.trimmed(plain) != "").otherwise(F.exists(parts_of(lyrics), lambda p: F.coalesce(y.trimmed(p.sthayi) != "", F.lit(False))))


def suffix_of(part: Column) -> Column:
    """What a connected verse ends with: the explicit text's first words, or the refrain's; null where it is off."""
    return F.when(part.sthayi_connect, y.refrain_suffix(F.coalesce(y.some(part.sthayi_connect_text), part.sthayi)))


def prepared(listings: DataFrame) -> DataFrame:
    """listings (section, path, number, title, ..., lyrics, connect flags) with title, lyrics and id as a page shows them.

    connect_config and connect_section are the flags of the site and the section;
    number counts from 1 in the section.
    """
    title = F.coalesce(y.some(F.trim("title")), F.lit("Untitled"))
    return listings.withColumn("title", title).withColumn("lyrics", connected(F.col("lyrics"), F.col("connect_config"), F.col("connect_section"))).withColumn(
        "id", t.anchor_id(F.col("section"), F.col("title"), F.col("number") - 1))


def badges(listings: DataFrame, own: str) -> DataFrame:
    """listings (section, path, home_section, home_title, self_authored, is_cross_listed) with the badges they carry.

    self_badge: written by the collector, outside the section `own`. from_title: a
    cross-listed row's home, unless the badge says so already.
    """
    badge = F.coalesce(F.col("self_authored"), F.lit(False)) & (F.col("section") != own)
    hidden = badge & (F.col("home_section") == own)
    return listings.withColumn("self_badge", badge).withColumn("from_title", F.when(F.col("is_cross_listed") & ~hidden, F.col("home_title")))


def section_defaults(sections: DataFrame) -> DataFrame:
    """sections (slug, banner, sort, grouped, count_unit) with defaults: a banner by slug, title order, one unit, not grouped."""
    return sections.select(
        "slug", F.coalesce(y.some(F.col("banner")), F.concat(F.lit("assets/icons/"), F.col("slug"), F.lit(".jpg"))).alias("banner"),
        F.when(F.lower(F.trim("sort")).isin("file", "filename"), "file").otherwise("title").alias("sort"),
        F.coalesce(F.lower(F.col("grouped").cast("string")) == "true", F.lit(False)).alias("grouped"), F.coalesce(y.some(F.trim("count_unit")), F.lit("भजन")).alias("count_unit"))


def search_items(listings: DataFrame) -> DataFrame:
    """(path, section, title, id, lines, href, home_section) of listings (section, path, number, title, tarz, lyrics, home_section), one a path and section.

    Lines stay an array in the row; nothing is shuffled but the removal of repeated listings.
    """
    rows = listings.dropDuplicates(["path", "section"])
    anchor = t.anchor_id(F.col("section"), F.coalesce(y.some(F.trim("title")), F.lit("Untitled")), F.col("number") - 1)
    return rows.select("path", "section", F.coalesce("title", F.lit("")).alias("title"), anchor.alias("id"), lyric_lines(F.col("tarz"), F.col("lyrics")).alias("lines"),
                       F.concat("section", F.lit(".html#"), anchor).alias("href"), "home_section")
