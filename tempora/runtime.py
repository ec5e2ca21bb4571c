"""Making this package importable on the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH already has it there."""
    root = Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if root in paths or sc.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tempora-code-"), "tempora_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "tempora").rglob("*.py")):
            out.write(path, path.relative_to(root))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or a private one where all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _folders:
            folder = tempfile.mkdtemp(prefix="tempora-scratch-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _folders[app] = f"file://{folder}"
        found = _folders[app]
    return f"{found.rstrip('/')}/tempora-{name}-{uuid.uuid4().hex}"
