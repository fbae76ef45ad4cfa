"""Session helpers: building a session, and cutting lineage where all executors can read it again."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "legistra", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEGISTRA_DRIVER_MEMORY", "12g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    It is what spark.checkpoint.dir names. Where that is unset, it is a temporary folder of this machine if the
    master is local, as in tests; on a cluster that is an error, as no other folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), f"legistra-checkpoints-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the library to the executors' Python workers, once per application, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    place = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/lib/{uuid.uuid4().hex}/{root.name}.zip")
    out = place.getFileSystem(context.hadoopConfiguration()).create(place)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(place.toString())
    _SHIPPED.add(app)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A new place for a table of this application under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder, and read back."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what this application keeps under the shared folder; results that were not written are lost with it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}")
    place.getFileSystem(spark.sparkContext._jsc.sc().hadoopConfiguration()).delete(place, True)
