"""Makes this package importable in executors that do not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_ROWS, ARROW_BYTES = 1000, 8_000_000
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Zip the package once per application and let Spark's file server deliver it. Sets the session's Arrow batches to
    ARROW_ROWS rows and ARROW_BYTES bytes if they are larger: a batch of long texts lies in memory on both sides."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
            spark.conf.set(key, str(most))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="chunkyard-ship-")) / "chunkyard.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("chunkyard") / p.relative_to(here))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
