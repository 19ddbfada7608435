"""Session helpers shared by all operators: table access, lineage cuts, bounded driver reads."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="lexiforge-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir() or wanted


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: used where a result feeds several jobs."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_unsized(df: DataFrame) -> DataFrame:
    """``cut``, and forget what size the planner reckoned for ``df``.

    A checkpoint keeps the reckoned size, and a join's is the product of its sides'. In a loop of joins the number of its digits is multiplied
    each round, until the driver is full of digits. Partitioning and order are kept.
    """
    done = cut(df)
    plan, session = done._jdf.queryExecution().logical(), df.sparkSession
    jvm = session._jvm
    none = getattr(jvm.scala, "None$").__getattr__("MODULE$")
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, bare), session)


def forget(spark: SparkSession) -> None:
    """Drop the shuffle files and checkpoints that no DataFrame refers to any more.

    Spark drops them when the driver happens to collect its garbage, which a driver with little to do does once in half an hour.
    """
    gc.collect()  # proxies of the JVM's objects that stand in cycles
    spark._jvm.System.gc()


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a reference table whose size is bounded by contract; more rows are an error, never cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is meant to be a small reference table")
    return rows


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_lexiforge_shipped", False):
        return
    import shutil

    import lexiforge

    root = os.path.dirname(os.path.abspath(lexiforge.__file__))
    folder = tempfile.mkdtemp(prefix="lexiforge-code-")  # on the driver only; Spark copies the archive to the executors
    archive = shutil.make_archive(f"{folder}/lexiforge", "zip", os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(archive)
    sc._lexiforge_shipped = True


HOT_ROWS, HOT_KEYS = 100_000, 1_000


def join_unique(left: DataFrame, right: DataFrame, key: str, hot_rows: int = HOT_ROWS, hint: str | None = None) -> DataFrame:
    """Left join with a table that has one row a key, where a key, or null, may hold a large part of the left rows.

    Keys with more than ``hot_rows`` rows and a thousandth of all rows, at most ``HOT_KEYS`` of them, are joined by broadcast; rows with a null key
    aren't joined at all; the rest is joined as ``hint`` says or left to the planner. No row is dropped, and no task gets all rows of a hot key.
    """
    from pyspark.sql import functions as F

    spark = left.sparkSession
    floor = max(hot_rows, left.count() // HOT_KEYS)
    counts = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > floor)
    hot = [r[0] for r in counts.select(key).collect()]
    rest = [c for c in right.columns if c != key]
    none = left.filter(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in rest])
    told = left.filter(F.col(key).isNotNull())
    columns = [*left.columns, *rest]
    hinted = right.hint(hint) if hint else right
    if not hot:
        return told.join(hinted, key, "left").select(columns).unionByName(none)
    few = F.broadcast(spark.createDataFrame([(h,) for h in hot], left.select(key).schema))
    warm = told.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, "left")
    cold = told.join(few, key, "left_anti").join(hinted, key, "left")
    return warm.select(columns).unionByName(cold.select(columns)).unionByName(none)
