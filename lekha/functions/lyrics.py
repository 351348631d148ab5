"""Structure of lyrics as column expressions: stanzas, tunes, headings, refrains, flags.

A text's lines are arrays of strings. Junk lines are those of text.BOILERPLATE.
A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lekha.functions import text as t

# Section names that head a list, tune and film markers, limits.
HEADING = r"(?i)^(अम्बे|अंबे|गणपति|विविध|शिव|राम|कृष्ण|हनुमान|होरिया|आरती|मूल\s*तत्त्व|स्वरचित).{0,24}(भजन|गान)$"
TUNE_LINE = r"(?i)^(?:तर्ज|राग)\s*[:：\-]\s*(.+)$"
TUNE_GROUP = r"(?i)\(\s*(?:तर्ज|राग)\s*[-:：]?\s*([^)]+)\)"
FILM_GROUP = r"(?i)\(\s*फिल्म\s*[-:：]?\s*([^)]+)\)"
HEADING_MOST, HOOK_LEAST, SAME_PREFIX, TAIL_LEAST, TAIL_MOST, SUFFIX_WORDS = 60, 6, 40, 12, 40, 3
CONNECT = "...."


def nothing() -> Column:
    return F.array().cast("array<string>")


def trimmed(x: Column) -> Column:
    return F.trim(x, F.lit(t.BLANKS))


def some(x: Column) -> Column:
    """The string, or null where it is blank."""
    return F.when(trimmed(x) != "", x)


def is_junk(line: Column) -> Column:
    return trimmed(line).rlike(t.JUNK)


def cleaned(text: Column) -> Column:
    """The text without junk lines; three newlines and more become two."""
    kept = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~is_junk(x)), "\n")
    return trimmed(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def blocks(text: Column) -> Column:
    """What stands between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), trimmed), lambda b: b != "")


def lines_of(block: Column) -> Column:
    """Trimmed lines that are neither blank nor junk."""
    return F.filter(F.transform(F.split(F.coalesce(block, F.lit("")), "\n"), trimmed), lambda x: (x != "") & ~x.rlike(t.JUNK))


def sanitised(block: Column) -> Column:
    """A stanza without junk lines, verse numbers and cut repeats."""
    return F.array_join(F.transform(lines_of(block), lambda x: t.without_refrain_shorthand(t.without_verse_numbers(x))), "\n")


def is_heading(line: Column) -> Column:
    """A short line that names a section, or has only ASCII letters."""
    return t.bound(trimmed(F.coalesce(line, F.lit(""))), lambda x: (x != "") & (F.length(x) <= HEADING_MOST) & (x.rlike(HEADING) | x.rlike(r"^[A-Za-z\s]+$")))


def tune(text: Column) -> Column:
    """A struct of tarz and rest: the tune that the first non-blank line names, and the text without it."""
    whole = F.coalesce(text, F.lit(""))
    lead = F.regexp_extract(whole, r"^((?:[^\S\n]*\n)*)", 1)
    line = trimmed(F.regexp_extract(whole, r"^(?:[^\S\n]*\n)*([^\n]*)", 1))
    after = F.regexp_extract(whole, r"(?s)^(?:[^\S\n]*\n)*[^\n]*(.*)$", 1)

    def groups(x: Column, pattern: str) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), trimmed), " · ")

    def parsed(x: Column) -> Column:
        tunes, films = groups(x, TUNE_GROUP), groups(x, FILM_GROUP)
        left = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, TUNE_GROUP, ""), FILM_GROUP, ""), r"\s+", " "))
        named = F.when(x.rlike(TUNE_LINE), trimmed(F.regexp_extract(x, TUNE_LINE, 1)))
        grouped = F.when((tunes != "") & (films != ""), F.concat(tunes, F.lit(" ("), films, F.lit(")"))).when(tunes != "", tunes).when(films != "", films)
        tarz = F.coalesce(named, grouped)
        keeps = named.isNull() & grouped.isNotNull() & (left != "")
        rest = F.when(tarz.isNull(), text).when(keeps, F.concat(lead, left, after)).otherwise(F.concat(lead, F.regexp_replace(after, "^\n", "")))
        return F.struct(tarz.alias("tarz"), rest.alias("rest"))

    return t.bound(line, parsed)


def norm_line(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "[॥|]", ""))


def hooks(lines: Column, title: Column) -> Column:
    """Phrases that a refrain repeats: the title, what stands before its comma, and what stands before the first line's; of six characters at least."""
    before_comma = lambda x: F.when(F.instr(x, ",") > 1, trimmed(F.substring_index(x, ",", 1)))
    name = some(trimmed(F.coalesce(title, F.lit(""))))
    first = some(trimmed(F.substring_index(F.get(lines, F.lit(0)), ",", 1)))
    return F.filter(F.array_distinct(F.array_compact(F.array(name, before_comma(name), first))), lambda x: F.length(x) >= HOOK_LEAST)


def is_refrain_only(line: Column, phrases: Column) -> Column:
    """A line that only repeats a hook, or that ellipses cut short; a blank one too."""

    def repeats(body: Column) -> Column:
        def one(b: Column, hook: Column) -> Column:
            h, short = norm_line(hook), norm_line(F.substring_index(hook, ",", 1))
            starts = (F.length(short) >= 10) & b.startswith(short) & (F.length(body) <= F.length(hook) + 10) & ~body.contains(",")
            return (h != "") & ((b == h) | (F.length(short) >= 8) & (b == short) | starts)

        return ~(body.contains(",") & (F.length(body) > 48)) & t.bound(norm_line(body), lambda b: F.exists(phrases, lambda hook: one(b, hook)))

    x = trimmed(line)
    return (x == "") | x.contains("...") | t.bound(t.end_marker(x).body, repeats)


def stanza(block: Column, phrases: Column) -> Column:
    """The block's lines that are no refrain."""
    return F.array_join(F.filter(lines_of(block), lambda x: ~is_refrain_only(x, phrases)), "\n")


def similar(a: Column, b: Column) -> Column:
    """Equal when sanitised, or one begins with the other's first characters."""
    flat = lambda x: F.regexp_replace(sanitised(x), r"\s+", " ")
    head = lambda x: F.substring(x, 1, SAME_PREFIX)
    return t.bound(flat(a), lambda x: t.bound(flat(b), lambda y: (x != "") & (y != "") & ((x == y) | x.startswith(head(y)) | y.startswith(head(x)))))


def without_opening_repeats(stanzas: Column) -> Column:
    """Stanzas that are not blank, less later ones that repeat the first."""

    def kept(xs: Column) -> Column:
        return F.filter(xs, lambda x, i: (i == 0) | ~similar(x, xs[0]))

    return t.bound(F.filter(stanzas, lambda x: x != ""), kept)


def refrain_tail(lines: Column) -> Column:
    """The first line's tail (after its last comma, or its last characters) if at least 45 % of the others share it; else null."""

    def tail(line: Column) -> Column:
        after = trimmed(F.element_at(F.split(line, "[,،]"), -1))
        after = F.when(after == "", trimmed(line)).otherwise(after)
        return F.when(F.length(after) >= TAIL_LEAST, after).otherwise(trimmed(F.substring(line, -TAIL_MOST, TAIL_MOST)))

    def shared(tails: Column) -> Column:
        first = tails[0]
        hits = F.size(F.filter(tails, lambda x, i: (i > 0) & (x.contains(first) | first.contains(x))))
        least = F.greatest(F.lit(1), F.floor((F.size(tails) - 1) * F.lit(0.45)).cast("int"))
        return F.when((F.size(tails) >= 2) & (F.length(first) >= 8) & (hits >= least), first)

    return t.bound(F.transform(lines, tail), shared)


def refrain_suffix(text: Column) -> Column:
    """The first three words without their signs, an ellipsis after them if there are more; null for a blank text."""
    flat = trimmed(F.regexp_replace(F.regexp_replace(text, r"\s*[।॥]+\s*", " "), r"\s+", " "))
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"^[,;:.!?\-–—]+|[,;:.!?\-–—]+$", ""), "[।॥]+", "")
    words = F.filter(F.transform(F.split(flat, " "), bare), lambda w: w != "")
    return t.bound(words, lambda ws: F.when(F.size(ws) > SUFFIX_WORDS, F.concat(F.array_join(F.slice(ws, 1, SUFFIX_WORDS), " "), F.lit("..."))).when(F.size(ws) > 0, F.array_join(ws, " ")))


def with_refrain(text: Column, suffix: Column) -> Column:
    """The text whose last line ends with the suffix in place of its end mark; unchanged without a suffix."""
    body = trimmed(F.coalesce(text, F.lit("")))
    unmarked = lambda x: trimmed(F.regexp_replace(x, r"[।॥]+\s*$", ""))

    def several(lines: Column) -> Column:
        last = F.concat(unmarked(F.element_at(lines, -1)), F.lit(CONNECT), suffix)
        return F.array_join(F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(last)), "\n")

    lines = F.filter(F.transform(F.split(body, "\n"), trimmed), lambda x: x != "")
    return F.when(suffix.isNull() | (suffix == ""), body).when(body.contains("\n"), t.bound(lines, several)).otherwise(F.concat(unmarked(body), F.lit(CONNECT), suffix))


def structured(text: Column, title: Column | None = None) -> Column:
    """A struct of strategy, sthayi, paragraphs, line_count, block_count that a plain text falls into.

    Several blocks are stanzas without refrain lines, the first one the sthayi (with
    the next, of at most four lines, if it has one line and that has more); a block
    of several lines has its first line as the sthayi; title helps to know refrains.
    """
    kind = "struct<strategy:string,sthayi:string,paragraphs:array<string>,line_count:int,block_count:int>"

    def made(strategy, sthayi, paragraphs, n, k) -> Column:
        return F.struct(F.lit(strategy).alias("strategy"), sthayi.alias("sthayi"), paragraphs.alias("paragraphs"), n.cast("int").alias("line_count"), k.cast("int").alias("block_count")).cast(kind)

    def of_stanzas(xs: Column, n: Column, k: Column) -> Column:
        line_n = lambda x: F.size(F.split(x, "\n"))
        joins = (F.size(xs) > 1) & ~xs[0].contains("\n") & F.get(xs, F.lit(1)).contains("\n") & (line_n(F.get(xs, F.lit(1))) <= 4)
        whole = made("stanza-blocks", F.concat_ws("\n", xs[0], xs[1]), F.slice(xs, F.lit(3), F.greatest(F.lit(0), F.size(xs) - 2)), n, k)
        return F.when(F.size(xs) == 0, made("empty-blocks", F.lit(""), nothing(), n, k)).when(joins, whole).otherwise(
            made("stanza-blocks", xs[0], F.slice(xs, F.lit(2), F.greatest(F.lit(0), F.size(xs) - 1)), n, k))

    def of_text(clean: Column) -> Column:
        def of_parts(parts: Column) -> Column:
            found, lines = parts.blocks, parts.lines
            n, k = F.size(lines), F.size(found)
            phrases = hooks(lines, F.lit("") if title is None else title)
            stanzas = t.bound(phrases, lambda p: without_opening_repeats(F.transform(found, lambda b: stanza(b, p))))
            first = t.end_marker(lines[0]).body
            rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.lit(0), n - 1)), t.without_verse_numbers)
            return (
                F.when(k >= 2, t.bound(stanzas, lambda xs: of_stanzas(xs, n, k)))
                .when(n >= 2, made("first-line-sthayi", first, rest, n, F.lit(1)))
                .when(n == 1, made("single-line", first, nothing(), n, F.lit(1)))
                .otherwise(made("empty", F.lit(""), nothing(), F.lit(0), F.lit(0))))

        return t.bound(F.struct(blocks(clean).alias("blocks"), lines_of(clean).alias("lines")), of_parts)

    return t.bound(cleaned(text), of_text)


def scored(norm: Column, title: Column) -> Column:
    """A struct of score (0 to 100), tier, reasons, flags, auto_format, review, manual for a structured text.

    Ranges, first values and points are fixed values; all of an empty text's are least.
    """
    return t.bound(norm, lambda x: _scored(x, title))


def _scored(norm: Column, title: Column) -> Column:
    sthayi, paragraphs, strategy, n_lines = norm.sthayi, norm.paragraphs, norm.strategy, norm.line_count
    k = F.size(paragraphs)
    verses = F.flatten(F.transform(paragraphs, lines_of))
    by_stanzas, by_lines = strategy == "stanza-blocks", strategy == "first-line-sthayi"
    # What each strategy begins with, and (condition, points, reason, flag).
    begin = F.when(by_stanzas, 88).when(by_lines, 72).when(strategy == "single-line", 38).otherwise(50)
    rules = [
        (by_stanzas, 0, "stanza-blocks-no-refrain-lines", None),
        (by_stanzas & (F.size(lines_of(sthayi)) <= 4) & (k >= 1), 4, "clear-sthayi-block", None),
        (by_lines, 0, "one-line-per-paragraph", None),
        (by_lines & refrain_tail(F.concat(F.array(sthayi), verses)).isNotNull(), 14, "refrain-hook-in-most-lines", None),
        (by_lines & k.between(2, 15), 8, "typical-bhajan-shape", None),
        (by_lines & (k > 20), -12, None, "many-single-line-paragraphs"),
        (by_lines & k.between(16, 20), -4, None, "long-song-many-verses"),
        (strategy == "single-line", 0, "only-one-line", "needs-manual-structure"),
        (F.exists(F.concat(F.array(sthayi), verses), is_heading), -35, None, "heading-line-in-lyrics"),
        (n_lines > 35, -10, None, "very-long-song"),
        ((trimmed(title) != "") & (sthayi != "") & (trimmed(title) == trimmed(sthayi)), -15, None, "sthayi-equals-title"),
    ]
    holds = F.struct(begin.alias("begin"), F.array(*[F.coalesce(c, F.lit(False)) for c, *_ in rules]).alias("rules"))

    def total(held: Column) -> Column:
        points, hs = held.begin, held.rules
        for i, (_, p, _, _) in enumerate(rules):
            points = points + F.when(hs[i], p).otherwise(0) if p else points
        names = lambda at: F.array_compact(F.array(*[F.when(hs[i], F.lit(r[at])) for i, r in enumerate(rules) if r[at]]))
        return F.struct(F.least(F.lit(100), F.greatest(F.lit(0), points)).alias("score"), names(2).alias("reasons"), names(3).alias("flags"))

    def tiered(x: Column) -> Column:
        empty = strategy == "empty"
        score = F.when(empty, 0).otherwise(x.score)
        return F.struct(
            score.alias("score"), F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low").alias("tier"),
            F.when(empty, F.array(F.lit("empty-lyrics"))).otherwise(x.reasons).alias("reasons"), F.when(empty, F.array(F.lit("empty"))).otherwise(x.flags).alias("flags"),
            (score >= 80).alias("auto_format"), score.between(60, 79).alias("review"), (score < 60).alias("manual"))

    return t.bound(t.bound(holds, total), tiered)
