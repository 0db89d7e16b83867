"""What the training-data operators share: tables written in the cluster's shared folder, and components of a link table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local master gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(found)
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and returns the written table: lineage ends there, a lost executor loses nothing of it.

    The write's shuffle files go as soon as it ends, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["_settled_at"] = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that `settle` wrote and nothing reads any more."""
    for table in tables:
        path = vars(table).pop("_settled_at", None) if table is not None else None
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Spread:
    """Joins on a key of which one value may hold a third of all rows.

    `sizes` has a row for each key that many rows may share: (key, held). Keys with more rows than the larger of LEAST and a
    10,000th of the sum, so fewer than 10,000 of them, get a number of salts by their rows; only they are broadcast. Rows
    are dealt by key and a hash of `by`, and the few rows of the other side are repeated for each salt of their key.
    """

    LEAST = 256

    def __init__(self, sizes: DataFrame, by: str):
        total = sizes.agg(F.sum("held")).first()[0] or 0
        bound = max(self.LEAST, total // 10_000)
        self.by = by
        hot = sizes.where(F.col("held") > bound).select("key", F.ceil(F.col("held") / bound).cast("int").alias("salts"))
        # and one key that is not hot: so that without hot keys the plan, and what its operators count, stays the same
        none = sizes.where(F.col("held") <= bound).select("key", F.lit(1).alias("salts")).limit(1)
        self.hot = settle(hot.unionByName(none), "hot-keys")

    def join(self, rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        """rows joined on key with table, whose keys are distinct."""
        salts = F.coalesce("salts", F.lit(1))
        rows = rows.join(F.broadcast(self.hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64(self.by), salts).cast("int")).drop("salts")
        table = table.join(F.broadcast(self.hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        return rows.join(table, ["key", "salt"], how).drop("salt")


def text_of(col: str = "text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def numbered(df: DataFrame, group: list[str], order: list, rows: int, out: str, per_cell: int = 4096) -> DataFrame:
    """Adds `out`, gapless from 0 within each group, without bringing a group's rows into one task.

    Rows are dealt to cells by a hash of `order`; a cell's first number is the count of its group's rows in the cells before
    it, a row's place in its cell comes from a window over that cell. `rows` is the table's row count and sets only the
    number of cells (one for about `per_cell` rows), of which there are 65,536 at most.
    """
    from pyspark.sql import Window as W

    cells = min(65_536, max(1, rows // per_cell))
    cell = f"__cell_{out}"
    df = df.withColumn(cell, F.pmod(F.xxhash64(F.lit(out), *order), F.lit(cells)))
    before = (
        df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__first", F.sum("__n").over(W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)))
        .select(*group, cell, F.coalesce("__first", F.lit(0)).alias("__first"))
    )
    within = F.row_number().over(W.partitionBy(*group, cell).orderBy(*order)) - 1
    return df.withColumn("__at", within).join(before, [*group, cell]).withColumn(out, (F.col("__first") + F.col("__at")).cast("long")).drop(cell, "__at", "__first")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of `edges` (a, b) reaches; ids without a link to another id have no row.

    Alternating large-star and small-star rounds: each keeps the components and pulls every id towards its component's
    smallest. A round's table is written; the rounds end when the written table no longer changes.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    mark = None
    for _ in range(most_rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        spent, e = e, settle(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), name)
        release(spent)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
