"""A session with the settings the library is tested with; any other session works too."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "matrixlake", cores: int | str = "*", partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the submitted configuration wins."""
    b = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ:
        b = b.master(f"local[{cores}]").config("spark.driver.memory", memory)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}),
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or local where that is unset and Spark runs in this process alone."""
    import atexit
    import shutil
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "matrixlake-scratch")
    if "://" in root and not root.startswith("file://"):
        raise RuntimeError(f"stored corpora need a mounted folder, not {root}")
    path = os.path.join("/" + root.removeprefix("file:").lstrip("/"), f"corpora-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
