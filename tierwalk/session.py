"""Makes this package importable in Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_AT: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers of this application, once."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    home = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tierwalk-code-")) / "tierwalk_code.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, os.path.join(home.name, p.relative_to(home)))
    context.addPyFile(str(at))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_before.get() if set_before.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster, intermediate tables need a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tierwalk-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    _AT[out] = at
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables that `materialise` wrote for these frames. Nothing that is still to be computed may read them."""
    for df in frames:
        at = _AT.pop(df, None)
        if at:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
