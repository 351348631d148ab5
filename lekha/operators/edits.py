"""Batches of edits, and names for new and renamed documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekha.functions import text as t
from lekha.operators.graph import connected_components
from lekha.operators.listings import ranked
from lekha.plans.shared import written


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, status, sha, text) of docs (path, sha, text) after edits (path, version, op, sha, text).

    Of a path's edits the last by version counts (then the greater sha, then text).
    op is create, update or delete. status: same, created, updated, deleted (text
    null), or conflict, where the document stays: a create of what exists, an edit
    of what does not, or one made on another sha. path is unique in docs; rows with
    a null path are dropped.
    """
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), F.desc("sha"), F.desc("text")))
    last = edits.where("path is not null").withColumn("r", rank).where("r = 1").select("path", "op", F.col("sha").alias("base"), F.col("text").alias("new"))
    both = docs.where("path is not null").select("path", F.lit(True).alias("there"), "sha", "text").join(last, "path", "full_outer")
    there, fits = F.coalesce(F.col("there"), F.lit(False)), F.coalesce(F.col("sha") == F.col("base"), F.lit(False))
    status = (
        F.when(F.col("op").isNull(), "same").when((F.col("op") == "create") & ~there, "created").when((F.col("op") == "update") & there & fits, "updated")
        .when((F.col("op") == "delete") & there & fits, "deleted").otherwise("conflict"))
    text = F.when(F.col("status").isin("created", "updated"), F.col("new")).when(F.col("status") != "deleted", F.col("text"))
    return both.withColumn("status", status).withColumn("text", text).select(
        "path", "status", F.when(F.col("status").isin("created", "updated"), F.md5(F.encode("text", "UTF-8"))).when(F.col("status") != "deleted", F.col("sha")).alias("sha"), "text")


_OUTCOME = "edit string, path string, op string, to string, status string, reason string, sha string, origin string"


def _folded(batches):
    """Edits applied one after another, group by group; documents of a group come before its edits.

    What stands at the group's paths is (sha, the document that the text is of, the
    edit that it is of), and is all that is kept; it comes out after each group in
    rows without a status, each edit's outcome in a row with one.
    """
    group, here = None, {}
    for batch in batches:
        out = []
        for of, path, op, to, base, sha, edit in zip(*(batch.column(c).to_pylist() for c in ("group", "path", "op", "to", "base", "sha", "edit")), strict=True):
            if of != group:
                out += [(e, p, None, None, None, None, s, o) for p, (s, o, e) in here.items()]
                group, here = of, {}
            if op is None:
                here[path] = (sha, path, None)
                continue
            there, aside = here.get(path), op == "rename" and to != path
            if op not in ("create", "update", "delete", "rename") or op == "rename" and to is None:
                reason = "unknown"
            elif op == "create":
                reason = "exists" if there else None
            elif not there:
                reason = "missing"
            elif base is not None and base != there[0]:
                reason = "stale"
            else:
                reason = "exists" if aside and to in here else None
            if reason is None:
                new = there if op == "rename" and sha is None else (sha, None, edit)
                if op == "delete" or aside:
                    del here[path]
                if op != "delete":
                    here[to if aside else path] = new
            status = "conflict" if reason else {"create": "created", "update": "updated", "delete": "deleted", "rename": "renamed"}[op]
            out.append((edit, path, op, to, status, reason, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)] if out else [pa.array([], pa.string())] * 8, names=[c.split()[0] for c in _OUTCOME.split(", ")])
    if here:
        rows = [(e, p, None, None, None, None, s, o) for p, (s, o, e) in here.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=[c.split()[0] for c in _OUTCOME.split(", ")])


def apply_batch(docs: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What becomes of edits (path, version, op, sha, to, text) to docs (path, sha, text): the outcomes, and the documents after them.

    Edits apply in order of version (ties: by path, op, to, sha, text), each to what
    the ones before left. op is create, update, delete, or rename, which moves a
    document to the path `to` and gives it the text, if there is one. All but create
    are made on a sha, that of the text they mean to change; a null sha means
    whatever is there. Two names are swapped by a move to a third.

    outcomes: (version, path, op, to, status, reason), a row an edit; status is
    created, updated, deleted, renamed or conflict, and then reason says why nothing
    was done: exists (a create or rename onto a document), missing (no document
    there), stale (made on another sha) or unknown (another op, or a rename without
    `to`). documents: (path, sha, text, origin) as they stand at the end; sha is the
    md5 of a new text, origin the path in docs of one whose text is kept. A new text
    that is null is empty. Rows with a null path are dropped; paths of docs are unique.

    Paths that moves join are one group of a graph; groups are folded apart from each
    other, in the order of their edits. Texts take no part in the fold: a group's
    task streams digests and keeps what stands at its paths.
    """
    moves = edits.where("op = 'rename' and to is not null and path <> to").select("path", "to").distinct()
    groups = written(connected_components(moves, "path", "to").select(F.col("node").alias("path"), F.col("component").alias("group")), "groups")
    key = F.md5(F.to_json(F.struct("version", "path", "op", "to", F.col("base"), "text")).cast("binary"))
    made = edits.where("path is not null").select("version", "path", "op", "to", F.col("sha").alias("base"), "text")
    made = written(made.withColumn("edit", key).withColumn("text", F.when((F.col("op") != "rename") | F.col("text").isNotNull(), F.coalesce("text", F.lit("")))), "edits")
    steps = made.select("version", "path", F.coalesce("op", F.lit("")).alias("op"), "to", "base", F.md5(F.col("text").cast("binary")).alias("sha"), "edit")
    named = steps.select("path").union(steps.where("to is not null").select("to")).distinct()
    held = docs.where("path is not null").join(named, "path", "left_semi").select("path", "sha")
    rows = held.unionByName(steps, allowMissingColumns=True).join(groups, "path", "left").withColumn("group", F.coalesce("group", "path"))
    order = ["group", F.col("op").isNotNull(), "version", "path", "op", "to", "base", "edit"]
    folded = written(rows.select("group", "path", "op", "to", "base", "sha", "edit", "version").repartition("group").sortWithinPartitions(*order).mapInArrow(_folded, _OUTCOME), "folded")
    versions = made.groupBy("edit").agg(F.first("version").alias("version"), F.first("text").alias("text"))  # equal keys have equal versions and texts
    outcomes = folded.where("status is not null").join(versions, "edit").select("version", "path", F.nullif("op", F.lit("")).alias("op"), "to", "status", "reason")
    at_end = folded.where("status is null").select("path", "sha", "origin", "edit")
    moved = at_end.where("origin is not null").join(docs.select(F.col("path").alias("origin"), "text"), "origin").select("path", "sha", "text", "origin")
    new = at_end.where("edit is not null").join(versions, "edit").select("path", "sha", "text", "origin")
    same = docs.where("path is not null").join(named, "path", "left_anti").select("path", "sha", "text", F.col("path").alias("origin"))
    return outcomes, same.unionByName(moved).unionByName(new)


def _numbered(number: Column) -> Column:
    return F.when(number < 1000, F.format_string("%03d", number)).otherwise(number.cast("string"))


def _free(named: DataFrame, existing: DataFrame) -> DataFrame:
    """named (folder, doc_id, base, ...) with name: base.yaml, or base-2.yaml, base-3.yaml, ...: in order of doc_id, the numbers that are not taken.

    The numbers taken of a base and those to come are placed in one order: before a
    taken number stand the free ones below it, and a document's rank among those to
    come, with the taken ones placed before it, is its number. So a base that all
    documents share is numbered over many tasks.
    """
    whole = F.regexp_extract("name", r"^(.*)\.yaml$", 1)
    cut, k = (F.regexp_extract("name", r"^(.*?)-([0-9]+)\.yaml$", i) for i in (1, 2))
    one = existing.select("folder", whole.alias("base"), F.lit(1).cast("bigint").alias("k")).where("base <> ''")
    more = existing.select("folder", cut.alias("base"), k.alias("k")).where("k <> '' and length(k) <= 18 and not k like '0%'").withColumn("k", F.col("k").cast("bigint")).where("k >= 2")
    taken = one.unionByName(more).distinct().join(named.select("folder", "base").distinct(), ["folder", "base"], "left_semi")
    taken = ranked(taken, ["folder", "base"], ["k"]).select("folder", "base", (F.col("k") - F.col("rank")).alias("free"), F.lit(0).alias("kind"), F.lit(None).cast(named.schema["doc_id"].dataType).alias("doc_id"))
    wanted = ranked(named.select("folder", "base", "doc_id"), ["folder", "base"], ["doc_id"]).select("folder", "base", (F.col("rank") - 1).alias("free"), F.lit(1).alias("kind"), "doc_id")
    placed = ranked(taken.unionByName(wanted), ["folder", "base"], ["free", "kind", "doc_id"]).where("kind = 1")
    k = F.col("rank")  # those to come before it, those taken before it, and itself
    rows = named.join(placed.select("folder", "base", "doc_id", "rank"), ["folder", "base", "doc_id"])
    return rows.withColumn("name", F.concat("base", F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit(".yaml"))).drop("base", "rank")


def allocate_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(folder, doc_id, name) for new (folder, doc_id, title), in order of doc_id: the next number in the folder and the title's slug.

    existing (folder, name) are names that are taken; a name that is taken gets -2,
    -3, ... doc_id is unique in new. A folder with all documents is numbered over
    many tasks.
    """
    sizes = existing.groupBy("folder").agg(F.count("*").alias("k"))
    rows = ranked(new.where("folder is not null").select("folder", "doc_id", t.slug(F.col("title")).alias("slug")), ["folder"], ["doc_id"]).join(sizes, "folder", "left")
    base = F.concat(_numbered(F.coalesce("k", F.lit(0)) + F.col("rank")), F.lit("-"), "slug")
    return _free(rows.select("folder", "doc_id", base.alias("base")), existing).select("folder", "doc_id", "name")


def rename(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """(folder, doc_id, name, new_name) of docs (folder, doc_id, name, title) whose title's slug is not the one in the name; the number stays.

    Renames to one name are told apart in order of doc_id, which is unique.
    """
    rows = docs.where("folder is not null").select("folder", "doc_id", "name", t.slug(F.col("title")).alias("slug"), t.basename_parts(F.col("name")).alias("parts"))
    rows = written(rows.where("slug <> parts.slug"), "renames")
    base = F.concat(F.coalesce("parts.prefix", F.lit("001")), F.lit("-"), F.col("slug"))
    return _free(rows.select("folder", "doc_id", F.col("name").alias("old"), base.alias("base")), existing).select("folder", "doc_id", F.col("old").alias("name"), F.col("name").alias("new_name"))
