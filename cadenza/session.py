"""Session helpers: shipping the package to executors and naming the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark context.

    Workers then need no installed copy: the driver serves a small zip of the sources.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cadenza_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="cadenza-")) / "cadenza.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, f"cadenza/{file.relative_to(root)}")
        sc.addPyFile(str(archive.resolve()))
    sc._cadenza_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local
    session gets a temporary folder; a cluster session is refused, since a folder
    of one machine would lose data there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cadenza-checkpoints-"))
    return str(sc.getCheckpointDir()).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder, which cuts the lineage of iterative plans."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it.

    Cuts the lineage: a lost executor costs no more than the stage that it ran.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cadenza-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame that ``stored`` made and that is used up."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if "/cadenza-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are used up: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
