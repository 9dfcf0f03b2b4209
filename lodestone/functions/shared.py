"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

#: The folder made for an application that names none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session on a single machine (a local master, as in tests) names none, a local
    one is made; on a cluster, whose executors wouldn't see it, that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        named = _own[app]
    # With its scheme, so that tasks, which don't know Spark's default store, find it too.
    path = spark._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: What each session has put in the shared folder.
_made: dict[str, list[str]] = defaultdict(list)


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/lodestone-{tag}-{uuid.uuid4().hex}"
    _made[spark._jsparkSession.sessionUUID()].append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what this session has put in the shared folder, and returns how many paths that was.

    For use once results are written: DataFrames that operators returned may read these files.
    Other sessions' files stay.
    """
    gone = 0
    for name in _made.pop(spark._jsparkSession.sessionUUID(), []):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: what was computed survives the loss of an executor, and costly
    Python stages don't run twice.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Inputs below so many bytes are dealt evenly by ``spread``.
SMALL = 32 << 20


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt over as many tasks as there are shuffle partitions, by the columns ``by`` if any.

    For costly work on small rows: however large the table, its row groups are few, and after an
    aggregate Spark makes few tasks of what is few bytes. A shuffle of the rows costs little beside it.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *by)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly over the cores where they are small, else as they are.

    A small file is often one row group, which Spark gives to one task however many cores are
    free; costly work per row then runs on one. Only inputs below ``SMALL`` bytes, by Spark's
    estimate, are shuffled for that; larger ones have as many row groups as they need. The rows
    are the same either way.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL else rows
