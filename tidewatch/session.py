"""Session factory, and the package's own code for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch at most: texts are long, and a batch stands in memory on both sides.
ARROW_ROWS = 1024


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: UTC, adaptive plans, Arrow."""
    builder = SparkSession.builder.master(master).appName("tidewatch")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give Python workers this package: one archive, sent by the driver's own file server.

    Also bounds the rows of an Arrow batch, where the session allows more.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(), "tidewatch_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
