"""Getting the package to Python workers that would not find it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once for each application, unless they find it by their path.

    Workers look in PYTHONPATH and in the folder the driver was started in.  On a cluster whose
    machines hold the package elsewhere, give it with ``--py-files``.
    """
    context = spark.sparkContext
    path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT in path or Path.cwd() == ROOT or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="memloom-"), "memloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted((ROOT / "memloom").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    context.addPyFile(target)
