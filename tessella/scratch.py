"""Tables between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where none is named a local session gets one of its own.

    On a cluster without it this fails, as executors can't read the driver's folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _sweep() -> None:
    """Delete the tables of this process, whose plans end with it, as their own sessions reach them."""
    for path, spark in _made.items() if SparkContext._gateway else ():
        try:
            _delete(spark, path)
        except (Py4JError, OSError) as e:  # the JVM may be gone
            print(f"{path} is left behind: {e}", file=sys.stderr)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    if not _made:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage without tying the rows to one executor: any task of a
    later stage can be run again after an executor is lost.  Rows of one value of
    ``by`` are files of their own, so a condition on it reads no others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing will read again."""
    for df in tables:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            known = [p for p in _made if f"{parent.split(':', 1)[-1].lstrip('/')}/".startswith(f"{p.split(':', 1)[-1].lstrip('/')}/")]
            for path in known:
                _delete(_made.pop(path), path)
