"""Session construction and shared-storage paths.

On a cluster the session comes configured: ``spark.checkpoint.dir`` names a
folder every executor can reach.  Operators that write intermediate tables
(written tables, streaming sinks, stream checkpoints) put them below that folder;
only with a local master and no such setting do we choose one ourselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Session settings every job in this package relies on.
#  - UTC so that epoch <-> text formatting is the same on every host.
#  - AQE re-plans joins from runtime sizes (broadcast only when the measured
#    side is below the threshold, otherwise sort-merge), coalesces small
#    shuffle partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows that go to Python travel in batches of bounded size, however long their texts are.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Commit only the changelog of each batch; snapshots are written in the background.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "shelfwise",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return a session with ``BASE_CONF`` applied.

    ``master`` is only set when given (tests, bench); on a cluster the
    launcher decides.  The web UI stays off: no server is started.
    """
    b = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    if master:
        b = b.master(master)
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of ``BASE_CONF`` to an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.coalescePartitions.enabled",
              "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.execution.arrow.maxBytesPerBatch",
              "spark.sql.streaming.stateStore.providerClass",
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"):
        spark.conf.set(k, BASE_CONF[k])
    ensure_checkpoint_dir(spark)
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by every Python worker (executors, and the
    driver-side runner of stateful stream processors) with ``addPyFile``, as
    ``--py-files`` would.  Done once per SparkContext."""
    # Functions and stateful-processor classes of this package are pickled by
    # value, so even Python runners that never see --py-files (the driver-side
    # runner of transformWithStateInPandas) need not import it.
    import sys as _sys

    from pyspark import cloudpickle

    pkg_mod = _sys.modules[__name__.split(".")[0]]
    try:
        cloudpickle.register_pickle_by_value(pkg_mod)
    except ValueError:
        pass  # already registered
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="shelfwise-pyfiles-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = os.path.join(folder, "shelfwise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster the session must name one (``spark.checkpoint.dir``): a folder of one machine would
    lose rows without a word, so there is none to fall back on.  A local master gets a temporary
    folder, which goes with the session.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = _local_folder(sc.master)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def _local_folder(master: str) -> str:
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set: with master {master!r} it has to name a folder that "
                           "the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` below the shared checkpoint folder and read it back.

    The plan runs once, nothing is cached on an executor's own disk, and a lost executor costs
    only a read of the written files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below this application's folder in the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfwise/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder.  DataFrames that still read it
    (results of operators that cut lineage, stream sinks) are not usable afterwards."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


__all__ = ["get_session", "apply_conf", "ensure_checkpoint_dir", "scratch_path", "clear_scratch", "ship_package",
           "checkpoint_table", "BASE_CONF"]
