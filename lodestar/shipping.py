"""Makes this package importable on executors that don't have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the session's executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="lodestar-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)
