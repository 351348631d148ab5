"""Tables that several jobs of one query share, and the folder they live in."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Groups that hold this part of all rows, or more, are joined apart.
SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent and all runs on one machine (tests) a new
    temporary folder is made and kept as the session's own.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lekha.shared.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="spark-lekha-")
        spark.conf.set("lekha.shared.dir", conf)
    return conf.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lekha/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> bool:
    """Remove all that this application wrote into the shared folder; says whether there was anything.

    Results not yet saved may still read these tables, so it is for the end of a job.
    Other applications' tables stay; so does what this one saved elsewhere.
    """
    return remove(spark, _own_dir(spark))


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder of any file system that Spark reads; says whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    It cuts the lineage as checkpoint() does, compressed, and survives the loss
    of any executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows (written) with the columns of groups, one row a key, or nulls where there is none: a left join without a hot task.

    size is a column of groups: how many of the `total` rows have the key. Groups
    with a SHARE-th of all rows or more, which are SHARE at most, are broadcast;
    the rest is joined by a shuffle, in which no key is hot.
    """
    hot = F.col(size) * SHARE >= total
    first = rows.join(F.broadcast(groups.where(hot).withColumn("__hot", F.lit(True))), key, "left")
    rest = first.where("__hot is null").select(rows.columns).join(groups.where(~hot), key, "left")
    return first.where("__hot").drop("__hot").unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
