"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DONE: set[str] = set()


#: Bytes of a batch of rows between the JVM and Python, where the session leaves Spark's default.
BATCH, _DEFAULT = 8 << 20, "67108864b"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to all executors, once an application, and bound the batches
    that pass to Python by bytes."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _DEFAULT) == _DEFAULT:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    context = spark.sparkContext
    if context.applicationId in _DONE:
        return
    _DONE.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyring-"), "tallyring.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tallyring", os.path.relpath(full, here)))
    context.addPyFile(path)
