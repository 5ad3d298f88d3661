"""Session settings, the shared scratch folder, and sending this package to the executors."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects; on a cluster these come from its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("itemweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster names it, or the checkpoint directory set in the session.

    A local session without either gets a temporary folder; on a cluster that raises, because no other machine would see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="itemweave-"))
    return context.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Cut the lineage: write `df` as a Parquet table into the shared folder and read it back.

    The table outlives lost executors, and its columns are stored compressed, unlike a checkpoint's rows. Tables are deleted
    when the driver ends, or by clear_scratch() as soon as no result that reads them is needed any more. With `free`, the files
    of its shuffles are deleted as soon as it is written, instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/itemweave-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE, None)
    if free:
        spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of written(), or selections of one, that nothing reads any more."""
    for table in tables:
        for path in {unquote(file.rpartition("/")[0]) for file in table.inputFiles()}:
            system, name = _path(table.sparkSession, path)
            system.delete(name, True)


def _path(spark: SparkSession, path: str):
    """(file system, path) on the JVM side."""
    context = spark.sparkContext
    name = context._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(context._jsc.hadoopConfiguration()), name


def clear_scratch() -> None:
    """Delete the tables that written() made so far; sessions that ended are skipped."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            system, name = _path(spark, path)
            system.delete(name, True)
        except Exception:  # noqa: BLE001  the session is gone, and its temporary folder is no concern of a cluster
            continue


atexit.register(clear_scratch)


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, so that functions pickled by reference load there; once for each context."""
    context = spark.sparkContext
    if _SHIPPED.get("to") != context.applicationId:
        root, data = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        target = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/itemweave.zip"
        system, name = _path(spark, target)
        out = system.create(name, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        context.addPyFile(target)
        _SHIPPED["to"] = context.applicationId
    return spark
