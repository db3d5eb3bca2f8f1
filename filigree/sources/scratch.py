"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder that a session without ``spark.checkpoint.dir`` uses, by its application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names.

    Only where that is unset and the master is local, as in tests, a folder of this machine is taken.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="filigree-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/filigree-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: it cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Bytes, as planned or shuffled, up to which a join broadcasts unasked. Ids and counts take ten times as much in memory.
BROADCAST_BYTES = 1 << 20


def bounded_broadcasts(spark: SparkSession) -> None:
    """Sets what joins broadcast unasked, where it is unset: written tables look small by their files, and the driver holds all of them."""
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, str(BROADCAST_BYTES))


def discard(df: DataFrame) -> None:
    """Removes a table that ``saved`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
