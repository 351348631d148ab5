"""A store of documents in Parquet files, with commits that copy only what they change.

Data files are never changed. A version is a manifest, one row a data file, written
after the files; a commit that fails before that leaves no trace for readers, and
files that no manifest names are never read. One writer commits at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lekha.plans.shared import remove, written


def _files(df: DataFrame) -> list[str]:
    """The data files that df reads, by their place in the store."""
    return sorted("data/" + f.rsplit("/data/", 1)[1] for f in df.inputFiles())


def _write(rows: DataFrame, path: str, version: int, kept: list[str], by: list[str]) -> None:
    """Write rows into new data files, by ranges of some columns, and then the manifest of kept and new files."""
    spark, place = rows.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(place)
    new = _files(spark.read.schema(rows.schema).parquet(place))
    manifest = spark.createDataFrame([(f, rows.schema.json()) for f in [*kept, *new]], "file string, columns string")
    # an unfinished manifest of this version has no rows and may be written anew
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifests/version={version}")


def create(docs: DataFrame, path: str, by: tuple[str, ...] = ("section", "doc_id")) -> int:
    """Make a store of docs, in files by ranges of the columns `by`; gives version 1."""
    _write(docs, path, 1, [], list(by))
    return 1


def versions(spark: SparkSession, path: str) -> list[int]:
    rows = spark.read.schema("file string, columns string, version int").json(f"{path}/manifests").select("version").distinct()
    return sorted(r.version for r in rows.collect())  # as many as commits


def files(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The data files of a version, the last by default."""
    version = version or versions(spark, path)[-1]
    return sorted(r.file for r in spark.read.schema("file string").json(f"{path}/manifests/version={version}").collect())


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The documents of a version, the last by default."""
    version = version or versions(spark, path)[-1]
    rows = spark.read.schema("file string, columns string").json(f"{path}/manifests/version={version}").collect()  # one a data file
    return _read(spark, path, [r.file for r in rows], rows[0].columns)


def _read(spark: SparkSession, path: str, names: list[str], columns: str | StructType) -> DataFrame:
    schema = StructType.fromJson(json.loads(columns)) if isinstance(columns, str) else columns
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def commit(spark: SparkSession, path: str, changes: DataFrame, removed: DataFrame | None = None, by: tuple[str, ...] = ("section", "doc_id")) -> int:
    """Put changes (the store's columns) and the removal of documents (doc_id) into a new version; gives its number.

    Rows of changes replace the documents with their doc_id or are new; those that
    equal what is there are left out, and of several with one doc_id the greatest
    counts. A document that is also removed goes. Only files that hold a changed or
    removed document are written anew, with the rest of their rows; all others stay
    as they are. Without changes the last version stays. Rows without a doc_id are
    left out of changes, and stay in the store.
    """
    last = versions(spark, path)[-1]
    now, names = read(spark, path, last), files(spark, path, last)
    columns = now.columns
    one = changes.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(*columns)).alias("new"))
    old = now.select("doc_id", F.struct(*columns).alias("old"))
    changed = one.join(old, "doc_id", "left").where(~F.col("new").eqNullSafe(F.col("old")))
    if removed is not None:
        changed = changed.join(removed.select("doc_id"), "doc_id", "left_anti")
    changed = written(changed.select("new.*"), "changes")
    ids = changed.select("doc_id")
    ids = written(ids if removed is None else ids.union(removed.select("doc_id")).distinct(), "ids")
    if ids.isEmpty():
        return last
    held = now.select("doc_id", F.col("_metadata.file_path").alias("file")).join(ids, "doc_id", "left_semi").select("file").distinct()
    touched = {"data/" + r.file.rsplit("/data/", 1)[1] for r in held.collect()}  # data files, not documents
    if not touched and changed.isEmpty():
        return last
    rest = _read(spark, path, sorted(touched), now.schema).join(ids, "doc_id", "left_anti")
    _write(rest.select(columns).unionByName(changed.select(columns)), path, last + 1, [n for n in names if n not in touched], list(by))
    return last + 1


def vacuum(spark: SparkSession, path: str, keep: int | None = None) -> tuple[int, int]:
    """Drop all versions but the last `keep` (None: none is dropped), and data files that no version names, those of failed commits too; gives the numbers of both.

    It counts as a writer: no commit may run beside it, and readers of a dropped
    version fail. Manifests go first, so a vacuum that is broken off leaves the kept
    versions whole and is finished by the next one. The driver holds names of data
    files, no documents.
    """
    if keep is not None and keep < 1:
        raise ValueError("the last version stays")
    there = versions(spark, path)
    old = there[:-keep] if keep else []
    for v in old:
        remove(spark, f"{path}/manifests/version={v}")
    named = spark.read.schema("file string").json(f"{path}/manifests").select("file").distinct()
    # names only: the content is not read
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/data")
    held = held.select(F.regexp_extract("path", r"/(data/[^/]+/[^/]+)$", 1).alias("file"))
    loose = [r.file for r in held.join(named, "file", "left_anti").collect()]
    used = {r.file.split("/")[1] for r in named.collect()}
    for f in loose:
        if f.split("/")[1] in used:
            remove(spark, f"{path}/{f}")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    for folder in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):  # as many as commits
        if folder.getPath().getName() not in used:
            remove(spark, folder.getPath().toString())
    return len(old), len(loose)
