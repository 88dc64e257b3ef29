"""A session with the settings the engine expects, and its code on every Python worker."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def get_session(master: str = "local[*]", name: str = "driftlens", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, with ``__`` for a dot."""
    builder = SparkSession.builder.master(master).appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's source to the executors, once per application, so that Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="driftlens-src-")) / "driftlens_src.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, str(f.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
