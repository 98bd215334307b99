"""Session construction and lineage checkpoints."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def _default_heap() -> str:
    """60% of physical memory, at most 16g (local mode: the driver is the executor)."""
    try:
        phys = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(phys * 0.6 / 2**30)))}g"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "codeloom") -> SparkSession:
    """A session with AQE on and the UI off; for tests, benches and scripts.

    On a cluster the session comes from the launcher and only the SQL
    settings below matter; ``master`` is then left unset.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("CODELOOM_DRIVER_MEMORY", _default_heap())))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; make a scratch one only if unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; we never
    override it.  Local runs (tests) get a fresh scratch folder; on a cluster
    without the setting this is an error, as executors share no local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not d and not (sc.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="codeloom-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used after Python stages (parsing, model calls) so downstream fan-out
    does not re-run them, and so a lost executor does not recompute them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``codeloom`` importable in every Python worker (once per application).

    Arrow/pandas stages pickle functions of this package by reference, so the
    workers must import it; this is what ``--py-files`` does at submit time.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import codeloom
    pkg = os.path.dirname(os.path.abspath(codeloom.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="codeloom-pkg-"), "codeloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)
