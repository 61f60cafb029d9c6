"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset (tests, local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if already.isDefined():
        return already.get()
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixframe-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/helixframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def discard(spark: SparkSession) -> int:
    """Delete the tables that ``materialize`` wrote in this application, once their results have been stored; returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


#: Rows of a batch that goes to Python, unless the session sets its own number: records here are whole texts.
BATCH_ROWS = 2000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="helixframe-code-"), "helixframe.zip")
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if spark.conf.get(key) == "10000":
            spark.conf.set(key, str(BATCH_ROWS))
    return spark
