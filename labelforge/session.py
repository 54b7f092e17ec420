"""Session helpers.

Library code never builds its own session; it takes the caller's. These
helpers exist for tests, the bench and the entry point, and for reading the
shared checkpoint folder a cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the engine expects; AQE re-plans joins and coalesces / splits
# skewed shuffle partitions at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 128 << 20) -> dict[str, str]:
    """Settings to pass at submit time for an input of ``input_bytes`` on a
    cluster with ``total_cores`` task slots.

    Shuffle partitions are sized so one partition holds about
    ``target_partition_bytes`` of the largest input (a 100 TB scan gives
    ~800k partitions at 128 MB), and never fewer than three waves of tasks;
    AQE then coalesces small partitions toward the advisory size and splits
    skewed ones (a partition is skewed at 5x the median and above 256 MB)."""
    partitions = max(3 * total_cores, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "labelforge", memory: str | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``labelforge`` importable on every executor's Python workers
    (the ``--py-files`` mechanism): zip the package once per application and
    add it with ``SparkContext.addPyFile``, which serves it to the executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="labelforge-pyfiles-"), "labelforge.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder of this session, if one is configured."""
    configured = spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    return _configured_dir(spark)


def _configured_dir(spark: SparkSession) -> str | None:
    try:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - not a runtime SQL conf on this version
        wanted = None
    return wanted or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset and
    the master is local (tests) a fresh folder under the system temp dir."""
    sc = spark.sparkContext
    configured = sc.getCheckpointDir()
    if configured:
        return configured
    wanted = _configured_dir(spark)
    if not wanted:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        wanted = tempfile.mkdtemp(prefix="labelforge-ckpt-")
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir() or wanted


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path inside the shared checkpoint folder, for written tables
    that cut lineage (never a machine-local folder on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder, so a lost
    executor does not force recomputation of non-deterministic ids and a
    twice-used frame is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
