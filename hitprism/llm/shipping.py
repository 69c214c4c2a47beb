"""Hands this package to the executors' Python workers."""

import tempfile
import zipfile
from pathlib import Path

import hitprism

_shipped = set()


def ship(spark):
    """Once per application: Spark sends the package's source to each executor,
    so that tasks can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(hitprism.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="hitprism-")) / "hitprism.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
