"""What a Spark session needs to run this package's tasks."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    # Spark serves the file to the executors; the folder is the driver's alone.
    path = os.path.join(tempfile.mkdtemp(prefix="mnemodex-"), "mnemodex.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, top))
        if os.path.exists(beside := os.path.join(top, "corpus_pipeline.py")):
            archive.write(beside, "corpus_pipeline.py")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the folder that ``spark.checkpoint.dir`` names and go on from the written rows; a session on one machine that names none gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="mnemodex-checkpoint-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
