"""Make this package importable on executors, for operators whose tasks run Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

import duovox

_sent: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Send the package's sources as a zip, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        _sent.add(app)
        root = os.path.dirname(os.path.abspath(duovox.__file__))
        folder = tempfile.mkdtemp(prefix="duovox-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "duovox_paired.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(at, n)
                        z.write(full, os.path.join("duovox", os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(path)
    return spark
