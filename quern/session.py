"""Sessions for the command line, benches and tests. The queries themselves take any session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, name: str = "quern", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine with adaptive plans and a zone of UTC."""
    n = cpus or os.cpu_count() or 4
    b = SparkSession.builder.master(f"local[{n}]").appName(name).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for k, v in {"spark.sql.shuffle.partitions": str(n), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.driver.host": "127.0.0.1"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df):
    """``df`` written to the checkpoint folder and read from there.

    The folder is that of ``spark.checkpoint.dir``, shared by all executors. Where neither it nor a folder set before exists, a session on
    one machine, as in tests, gets a temporary one; on a cluster that is an error, as executors don't share such a folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return df.checkpoint(eager=True)
