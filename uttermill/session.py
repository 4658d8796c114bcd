"""Session helpers: local sessions for tests/bench, the shared scratch
folder, and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "uttermill") -> SparkSession:
    """A local session for tests and the benchmark (never used by the
    library itself, which always takes the caller's session)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``uttermill`` importable in executor Python workers (pandas UDFs
    and ``mapInPandas`` refer to its modules): the package is zipped once per
    application and registered with ``addPyFile``, like ``--py-files``."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="uttermill-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> str:
    """Ship the package to the executors and return the checkpoint folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator of the cluster and
    is only read here. Only when it is unset (local tests) a folder is
    created and registered.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="uttermill-ckpt-")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def broadcast_if_small(df: DataFrame, max_rows: int = config.BROADCAST_MAX_ROWS,
                       max_bytes: int = config.BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it is within both bounds, found by one
    aggregate (rows, and bytes of their JSON form). Beyond them the plain
    DataFrame is returned and Spark plans a shuffle join (AQE splits skewed
    keys)."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= max_rows and (total or 0) <= max_bytes else df


def collect_if_small(df: DataFrame, max_rows: int = config.BROADCAST_MAX_ROWS,
                     max_bytes: int = config.BROADCAST_MAX_BYTES) -> list | None:
    """The rows of ``df`` if it is within both bounds (one aggregate finds
    them), for a broadcast variable that Python tasks read; else None."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return df.collect() if n <= max_rows and (total or 0) <= max_bytes else None


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition before a CPU-heavy, byte-light stage (edit
    distances, similarity). Byte-based partition coalescing would otherwise
    pack such a stage into few tasks; the round robin also evens out hot
    intents. Target: max(2 x default parallelism, shuffle partitions)."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism,
            int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    return df.repartition(n)


def materialize(df: DataFrame) -> DataFrame:
    """Write a small, reused intermediate result once to the shared
    checkpoint folder (reliable checkpoint: survives lost executors and cuts
    the lineage, so later size checks and joins read it instead of
    recomputing its plan)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
