"""Session settings, table access and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings for a session of our own; a cluster's session is used as it comes.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "12g",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("spanloom")
    for k, v in (LOCAL_CONF | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where it is unset and the master is plain local mode, a temporary folder is set for the session; on a cluster
    an unset folder is an error, since a machine-local folder would lose data with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = Path(tempfile.mkdtemp(prefix="spanloom-")).as_uri()
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back: cuts the lineage and survives lost executors.

    The application's folder is removed when the driver ends; `dropped` removes a table before that.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/spanloom-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone
        pass


def dropped(df: DataFrame) -> None:
    """Remove a table made by `written` that no later plan reads."""
    path = getattr(df, "_spanloom_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
