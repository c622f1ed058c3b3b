"""Session settings, lineage cuts and the size check that guards every broadcast."""

from __future__ import annotations

import atexit
import gc
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyarrow.dataset import dataset
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is sent to all executors only if its data is known to be smaller than this.
BROADCAST_BYTES = 32 << 20


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stratoloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made and set if the session runs on one machine
    (tests); on a cluster no other machine would see it, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = jvm_dir.get() if jvm_dir.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stratoloom-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Cuts:
    """Lineage cuts: tables written to the shared folder and read back.

    A written table survives the loss of executors, carries its size into the
    planner (so that only small ones are broadcast) and is dropped as soon as a
    loop no longer needs it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        # what no loop drops is deleted when the session's machine ends
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.base)
        files = place.getFileSystem(conf)
        files.mkdirs(place)
        files.deleteOnExit(place)

    def cut(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write the rows and read them back."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._cut_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete the files of a cut that nothing reads any more."""
        path = getattr(df, "_cut_path", None)
        if path:
            jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def sweep(self) -> None:
        """Have the shuffle files of what was written deleted now, not when the driver happens to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def rows_of(path: str, columns: list[str]) -> Iterator[tuple]:
    """The rows of a cut, or of one folder of it, read by a Python worker where they lie; binaries come as buffers."""
    files, place = FileSystem.from_uri(path)
    for b in dataset(place, filesystem=files, format="parquet").to_batches(columns=columns, batch_size=4, batch_readahead=1, fragment_readahead=1, use_threads=False):
        yield from zip(*([x.as_buffer() for x in c] for c in b.columns))


def measured_bytes(df: DataFrame) -> int:
    """An upper estimate of the rows' size, from their text form (one pass over ``df``)."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))).alias("b")).first()
    return int(row.b or 0) + 16 * int(row.n)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it was measured below the limit, else as it is.

    Without the hint the join falls back to a shuffle, which AQE splits where a key is hot.
    """
    return F.broadcast(df) if measured_bytes(df) <= limit else df


def few_or_raise(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must stay small; raises rather than filling the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once per session.

    The archive lies in the shared folder, not on one machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_stratoloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("stratoloom") / p.relative_to(root))
    jvm, conf = spark._jvm, sc._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/stratoloom-{uuid.uuid4().hex}.zip")
    out = place.getFileSystem(conf).create(place, True)
    out.write(bytearray(archive.getvalue()))
    out.close()
    sc.addPyFile(place.toString())
    sc._stratoloom_shipped = True


def map_frames(df: DataFrame, func: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """``mapInPandas`` with the package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInPandas(func, schema)
