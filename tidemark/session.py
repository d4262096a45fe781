"""Session helpers that every entry point shares."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers, and sets what the operators rely on.

    The package goes to the executors through Spark's own file distribution, once per application.
    A checkpoint folder is set only where the session has none: the one that spark.checkpoint.dir
    names, else, on a local master alone, a temporary one.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_tidemark_shipped", False):
        root, memory = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(memory, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
        Path(path).write_bytes(memory.getvalue())
        sc.addPyFile(path)
        sc._tidemark_shipped = True
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query made within it go when the query ends; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
