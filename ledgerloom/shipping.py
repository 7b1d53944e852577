"""Sends this package to the executors, whose Python may not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each application; frames built after it can use the package in their Python workers."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", None):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(), "ledgerloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
    context.addPyFile(name)
    context._ledgerloom_shipped = name


#: Rows of a batch of whole texts; Python holds a batch with all its units or chunks at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Makes Arrow batches smaller unless the session has its own setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
