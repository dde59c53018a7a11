"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and the master is local (tests), a new folder."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewell-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _sweep() -> None:
    """Deletes what is left of this process' folders, when it ends."""
    for path, (jvm, conf) in list(_made.items()):
        try:
            _delete(jvm, conf, path)
        except Exception:  # noqa: BLE001  the session is gone, or the folder
            pass


_made: dict[str, tuple] = {}
atexit.register(_sweep)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's process ends."""
    path = f"{shared_dir(spark)}/tracewell-{uuid.uuid4().hex}"
    _made[path] = spark._jvm, spark._jsc.hadoopConfiguration()
    return path


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. The folder goes
    with dropped(), or when the driver's process ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/tracewell-" in f:
            _delete(df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), f)
            for path in [p for p in _made if f.endswith(p.rsplit("/", 1)[1])]:
                del _made[path]


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless they find it on their path (PYTHONPATH, or the working directory)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in map(os.path.abspath, filter(None, known)) or getattr(context, "_tracewell_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tracewell"), "zip", root, "tracewell")
    context.addPyFile(archive)  # the driver serves it to executors
    context._tracewell_shipped = True
