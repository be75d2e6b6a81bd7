"""Session helpers: a local session for tests / bench, and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tokenmill") -> SparkSession:
    """Session for tests and the local bench. Cluster jobs get their session from the cluster."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Documents are large rows: keep Arrow batches small.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a folder every executor can reach; it is
    read from the session. Only where it is unset (local tests) is a folder of
    our own created and registered; a cluster without the setting is an error, as
    every executor would write to a disk of its own.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getCheckpointDir()
    if conf_dir:
        return conf_dir
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tokenmill-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``df.checkpoint()`` has a reliable (shared) target."""
    target = spark.sparkContext.getCheckpointDir()
    if target:
        return target
    conf_dir = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder for written tables."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows that Spark hands to a Python worker at once; its default of 10,000 documents may be gigabytes.
BATCH_ROWS = 512


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches in any session, unless it has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tokenmill`` importable in Python workers (executors) via ``addPyFile``.

    The package is zipped from the driver's copy once per application; Spark
    distributes the archive to every executor, on a cluster as locally.
    """
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import hashlib
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    files = []
    for base, _dirs, names in os.walk(pkg_dir):
        if "__pycache__" in base:
            continue
        for n in sorted(names):
            if n.endswith(".py"):
                files.append(os.path.join(base, n))
    digest = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            digest.update(f.encode() + fh.read())
    archive = os.path.join(tempfile.gettempdir(), f"tokenmill-{digest.hexdigest()[:12]}.zip")
    if not os.path.exists(archive):
        tmp = archive + f".{uuid.uuid4().hex[:6]}"
        with zipfile.ZipFile(tmp, "w") as zf:
            for f in files:
                zf.write(f, os.path.relpath(f, root))
        os.replace(tmp, archive)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
