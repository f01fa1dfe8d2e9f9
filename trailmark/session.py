"""Session defaults and checkpoint helpers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "trailmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; `conf` overrides them.

    `master` stays unset on a cluster so that spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER,
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once per application, so that the UDFs can import it.

    Not needed where it is installed on the executors or passed with --py-files.
    """
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "trailmark.zip")
        with zipfile.ZipFile(archive, "w") as bundle:
            for folder, _, files in os.walk(here):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        bundle.write(path, os.path.join("trailmark", os.path.relpath(path, here)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in spark.checkpoint.dir. Only a local master, as in tests, may leave that unset:
    a local folder is then created, once per application. On a cluster other machines would not see it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    jvm_dir = sc._jsc.sc().getCheckpointDir()
    if configured:
        if not jvm_dir.isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and read it back without its lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that `materialize` wrote in this process, oldest first.
_written: list[str] = []


def written_mark() -> int:
    """For `delete_written`: how many folders `materialize` has written so far."""
    return len(_written)


def delete_written(spark: SparkSession, mark: int) -> None:
    """Deletes the folders that `materialize` wrote since `mark`. Only once nothing reads them any more."""
    for text in _written[mark:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _written[mark:]


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing holds any more; else they stay until the driver
    happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and return a scan of it.

    For results that several later steps read: they are computed once, pruned by column when read,
    and outlive the executors that made them.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)
