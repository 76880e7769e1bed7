"""What the operators of this folder share: tables in the cluster's shared folder, and reading inputs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed value: white space as the contracts of this folder define it.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set, else, on one machine, one of our own, and on a cluster one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            own = tempfile.mkdtemp(prefix="linequarry-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            at = f"file://{own}"
        else:
            at = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_linequarry"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Where the tables of written() that still are there lie.
made: list[str] = []

#: A fixed value: Spark's setting by which an execution deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, readable after executors are lost. The shuffles that made it go with the write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    made.append(path)
    return out


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if at in made:
        made.remove(at)


def forget(df: DataFrame) -> None:
    """Deletes a table made by written() that no result still reads."""
    delete(df.sparkSession, df._written_at)


def written_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s rows as a table, and all other tables that it made on the way deleted."""
    before = set(made)
    out = written(make(), label)
    for at in [x for x in made if x not in before and x != out._written_at]:
        delete(out.sparkSession, at)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
