from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.term_index import TermIndex


#: Changes with what the index stores, so that one left by other code is not read.
INDEX_FORMAT = 2


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local master without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/lodestone"


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def term_index(spark: SparkSession, sf_dir: str) -> TermIndex:
    """The stored term index of the documents in sf_dir, built the first time it is asked for and again once their files change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    state = (INDEX_FORMAT, str(fs.makeQualified(at)), fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime())
    path = f"{shared_dir(spark)}/terms-{hashlib.sha1(repr(state).encode()).hexdigest()[:16]}"
    if TermIndex.exists(spark, path):
        return TermIndex(spark, path)
    return TermIndex.build(load(spark, sf_dir, "documents"), path)


def split_columns(select: str) -> list[str]:
    """The expressions of a select list."""
    out, depth = [""], 0
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out
