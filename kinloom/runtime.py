"""Makes this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the session's executors, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="kinloom-code-")) / "kinloom_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def settle(spark: SparkSession) -> SparkSession:
    """Let executors collect their garbage, which gives heap that an earlier stage has grown back to the machine; Python workers of the next one need it. A few tasks of one row."""
    n = 4 * max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()
    return spark
