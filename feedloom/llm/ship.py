"""Give tasks the package where they cannot import it by themselves."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import feedloom

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once, unless the workers' path has it (set by PYTHONPATH or the
    working folder, which they inherit). A cluster job that is submitted with ``--py-files`` needs no more."""
    sc = spark.sparkContext
    package = Path(feedloom.__file__).resolve().parent
    given = [Path(p or ".").resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."]]
    if package.parent in given or sc.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="feedloom-package-")) / "feedloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name) / f.relative_to(package))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shipping(fn):
    """A query or stage whose tasks use this package."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *args):
        ship(spark)
        return fn(spark, *args)

    return run
