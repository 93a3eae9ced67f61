"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from evidentia.scratch import fresh_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application, by way of the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "evidentia") + ".zip")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    stream.write(packed.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(path.toString())
    _SHIPPED.add(app)
