"""Order, numbers and neighbours of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekha.plans.shared import join_groups, written


def positions(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    """rows with position 1, 2, ... in order of keys, by ranks in range parts and the parts' prefix sums.

    A hot section is spread over many parts; only one row a part meets in one task.
    """
    # written first: both sides of the join below must see the same parts
    parts = written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "parts")
    local = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*keys)))
    sizes = local.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    return local.join(F.broadcast(before), "part").withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before")


def ranked(rows: DataFrame, group: list[str], keys: list[str | Column]) -> DataFrame:
    """rows with rank 1, 2, ... in each group in order of keys, as positions: a group with all rows is ranked over many tasks."""
    placed = written(positions(rows, [*group, *keys]), "placed")
    first = placed.groupBy(*group).agg(F.min("position").alias("first"), F.count("*").alias("size"))
    joined = join_groups(placed, first, group, "size", placed.count())
    return joined.withColumn("rank", F.col("position") - F.col("first") + 1).drop("position", "first", "size")


def key_of(title: Column, collation: str | None) -> Column:
    """What titles are sorted by: their code points, or a collation (hi); null counts as empty."""
    title = F.coalesce(title, F.lit(""))
    return title if collation is None else F.collate(title, collation)


def with_title_ranks(docs: DataFrame, collation: str = "hi") -> DataFrame:
    """docs, written, with title_rank: the place of the title among all distinct ones in a collation; titles that it holds equal have one rank.

    The collation's keys are made and sorted here alone. display_order, group_order,
    listing_numbers and master_index sort by the rank where docs has one.
    """
    titles = docs.select(F.coalesce("title", F.lit("")).alias("title")).distinct()
    placed = written(positions(titles.withColumn("key", F.collate("title", collation)), ["key", "title"]), "titles")
    ranks = placed.join(placed.groupBy("key").agg(F.min("position").alias("title_rank")), "key").select(F.col("title").alias("__title"), "title_rank")
    sizes = docs.groupBy(F.coalesce("title", F.lit("")).alias("__title")).agg(F.count("*").alias("__n"))
    rows = written(docs.withColumn("__title", F.coalesce("title", F.lit(""))), "docs")
    return written(join_groups(rows, written(sizes.join(ranks, "__title"), "ranks"), ["__title"], "__n", rows.count()).drop("__title", "__n"), "ranked")


def title_key(docs: DataFrame, title: Column, collation: str | None = None) -> Column:
    """What rows are sorted by for their titles: the rank in docs, if it has one, else key_of; where title is null, as if it were empty."""
    return F.when(title.isNotNull(), F.col("title_rank")).otherwise(0) if "title_rank" in docs.columns else key_of(title, collation)


def display_order(docs: DataFrame, sections: DataFrame, collation: str | None = None, keep_groups: bool = False) -> DataFrame:
    """(section, doc_id, number): a section's documents by title, or by doc_id where its sort is 'file'.

    docs has doc_id, section, title; sections has section_pos, section, sort. A
    null title counts as empty; ties go to the smaller doc_id. A grouped section
    keeps the order of files where keep_groups. collation: as in key_of.
    """
    by_file = (F.col("sort") == "file") | (F.coalesce("grouped", F.lit(False)) if keep_groups else F.lit(False))
    rows = docs.join(sections, "section").select(
        "section", "section_pos", "doc_id", title_key(docs, F.when(~by_file, F.col("title")), collation).alias("key"))
    placed = positions(rows, ["section_pos", "key", "doc_id"])
    first = placed.groupBy("section").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "section").select("section", "doc_id", (F.col("position") - F.col("first") + 1).alias("number"))


def neighbours(numbered: DataFrame) -> DataFrame:
    """numbered (section, doc_id, number) with prev_id and next_id, by joins on the number beside."""
    beside = numbered.select("section", F.col("doc_id").alias("other"), F.col("number").alias("n"))
    before = beside.select("section", F.col("other").alias("prev_id"), (F.col("n") + 1).alias("number"))
    after = beside.select("section", F.col("other").alias("next_id"), (F.col("n") - 1).alias("number"))
    return numbered.join(before, ["section", "number"], "left").join(after, ["section", "number"], "left").select("section", "doc_id", "number", "prev_id", "next_id")


def master_index(docs: DataFrame, sections: DataFrame, collation: str | None = None) -> DataFrame:
    """(doc_id, number) over the documents of sections that count, by title, then doc_id."""
    counted = sections.where(~F.coalesce("excluded", F.lit(False))).select("section")
    rows = docs.join(counted, "section", "left_semi").select("doc_id", title_key(docs, F.col("title"), collation).alias("key"))
    return positions(rows, ["key", "doc_id"]).select("doc_id", F.col("position").alias("number"))


def unique_documents(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(n): documents of the sections that count."""
    counted = sections.where(~F.coalesce("excluded", F.lit(False))).select("section")
    return docs.join(counted, "section", "left_semi").agg(F.count("*").alias("n"))


def groups(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, group_name): distinct groups of the grouped sections."""
    grouped = sections.where("grouped").select("section")
    return docs.join(grouped, "section", "left_semi").where("group_name is not null").select("section", "group_name").distinct()


def verse_numbers(turns: DataFrame, spoken: str = "जबानी") -> DataFrame:
    """(conv_id, turn, number) of verses (user) that are neither blank nor spoken, running in each document.

    A spoken verse begins with the word for it and a dash or colon; one that only
    begins with the word counts.
    """
    counts = (F.col("role") == "user") & (F.trim("text") != "") & ~F.trim("text").rlike(rf"^{spoken}\s*[-–—:：]")
    flag = F.when(F.coalesce(counts, F.lit(False)), 1).otherwise(0)
    run = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("flag", flag).withColumn("number", F.sum("flag").over(run)).where("flag = 1").select("conv_id", "turn", "number")


def listing_numbers(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(section, doc_id, anchor, label): the place in display order, and the number shown.

    Where a section uses groups (it is grouped, or a document has one), labels run
    over the groups in the order in which they are first seen, by title within, and
    documents without a group have none; elsewhere the label is the anchor's number.
    """
    anchors = display_order(docs, sections, keep_groups=True).withColumnRenamed("number", "anchor")
    used = docs.join(sections, "section").groupBy("section").agg((F.max(F.coalesce("grouped", F.lit(False))) | F.coalesce(F.max(F.col("group_name").isNotNull()), F.lit(False))).alias("uses"))
    rows = docs.join(sections.select("section", "section_pos", "sort"), "section").where("group_name is not null")
    first = rows.groupBy("section", "group_name").agg(F.min("doc_id").alias("seen"))
    keyed = rows.join(first, ["section", "group_name"]).select("section", "section_pos", "doc_id", "seen", title_key(docs, F.when(F.col("sort") != "file", F.col("title"))).alias("key"))
    placed = positions(keyed, ["section_pos", "seen", "key", "doc_id"])
    start = placed.groupBy("section").agg(F.min("position").alias("start"))
    labels = placed.join(start, "section").select("section", "doc_id", (F.col("position") - F.col("start") + 1).alias("in_groups"))
    out = anchors.join(used, "section").join(labels, ["section", "doc_id"], "left")
    return out.select("section", "doc_id", "anchor", F.when(F.col("uses"), F.col("in_groups")).otherwise(F.col("anchor")).alias("label"))


def verse_group_numbers(turns: DataFrame, spoken: str = "जबानी") -> DataFrame:
    """(conv_id, turn, pos, number) of the groups of lines (between blank ones) of verses, numbered on in each document.

    Commentary, blank and spoken items are left out; a group that ends in a refrain
    line (cut by ellipses) has no number and counts for none.
    """
    split = F.filter(F.transform(F.split("text", r"\n[^\S\n]*\n\s*"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    verse = (F.col("role") == "user") & ~F.trim("text").rlike(rf"^{spoken}\s*[-–—:：]")
    rows = turns.where(F.coalesce(verse, F.lit(False))).select("conv_id", "turn", F.posexplode(split).alias("pos", "group"))
    last = F.trim(F.element_at(F.split("group", r"\n"), -1))
    refrain = ~last.contains("....") & (last.rlike(r"\.\.\.\s*॥?\s*$") | (last.endswith("..") & (F.length(last) < 48)))
    flag = F.when(refrain, 0).otherwise(1)
    run = Window.partitionBy("conv_id").orderBy("turn", "pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("flag", flag).withColumn("number", F.sum("flag").over(run)).select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), F.when(F.col("flag") == 1, F.col("number")).alias("number"))
