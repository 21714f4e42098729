"""Session builder with the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(app: str = "corpuscle", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, submit-time settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch between the JVM and a Python worker, at most; Spark's own limit of bytes holds as well.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application; they need not share a folder with the driver. The
    bundle stays on the driver until the driver ends, as executors fetch it when they start."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    bundle = Path(folder) / "corpuscle.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(bundle))


def prepare(spark: SparkSession) -> None:
    """For applications, such as the registered queries: ships the package, and lowers the session's rows per Arrow batch to
    BATCH_ROWS, as either side of a Python worker holds whole batches and texts can be long. Operators change no setting themselves."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
