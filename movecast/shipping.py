"""Gives the package to the Python workers of a session, as ``--py-files`` would."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_held: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Add the zipped package to ``spark``, once per application; where it runs from a zip already it was shipped.

    The zip lies in a folder of the driver until the driver ends: Spark's file server hands it to the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _held or not _ROOT.is_dir():
        return
    folder = tempfile.TemporaryDirectory(prefix=f"{_ROOT.name}-")
    sources = sorted(_ROOT.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in sources)).hexdigest()[:12]
    path = Path(folder.name) / f"{_ROOT.name}-{digest}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sources:
            archive.write(source, source.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    _held[sc.applicationId] = folder
