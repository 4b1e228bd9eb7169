"""The package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession


@cache
def packed() -> str:
    """The package as a zip file; the name is all that Python workers need to import from it."""
    root, out = Path(__file__).resolve().parents[2], Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "strandworks.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "strandworks").rglob("*.py")):
            z.write(p, p.relative_to(root))
    return str(out)


@cache
def _sent(application: str) -> set[str]:
    return set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each application; needed where they do not have it installed."""
    sent = _sent(spark.sparkContext.applicationId)
    if not sent:
        spark.sparkContext.addPyFile(packed())
        sent.add("strandworks")
