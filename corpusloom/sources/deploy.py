"""Getting this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context.

    Python workers then import it wherever they run, without a shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loom"), "corpusloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(_PACKAGE):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(path)
    sc._corpusloom_shipped = True
