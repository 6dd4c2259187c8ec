"""Session helpers: one place that decides configuration and the checkpoint folder."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job of this package relies on. They are defaults only: a value the
# cluster already sets wins, so a 1000-executor deployment keeps its own sizing.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go once nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Operators ask for broadcasts of one-row-per-partition tables only; all others go by measured size.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_session(master: str | None = None, app_name: str = "haulage",
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build or fetch the session, then make sure a checkpoint folder is known."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking it from the cluster setting.

    ``spark.checkpoint.dir`` names a shared folder on a cluster and is used as is.
    Only a local-mode session without that setting (tests, laptops) gets a fresh
    temporary folder; a cluster without it is an error, because a machine-local
    folder would not survive the loss of that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (a remote Spark Connect session has no local context)
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="haulage-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def _package_zip() -> tuple[bytes, str]:
    """This package's Python files as a zip (deterministic), and a short content hash."""
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    arc = os.path.join("haulage", os.path.relpath(full, root))
                    info = zipfile.ZipInfo(arc, date_time=(1980, 1, 1, 0, 0, 0))
                    with open(full, "rb") as fh:
                        zf.writestr(info, fh.read())
    data = buf.getvalue()
    return data, hashlib.sha256(data).hexdigest()[:16]


def ship_package(spark: SparkSession) -> None:
    """Make ``haulage`` importable in Python workers (data sources, stateful streams).

    The package is zipped into the shared checkpoint folder and added with
    ``addPyFile``, once per SparkContext; Spark ships it to every executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: code is shipped with the server's artifacts)
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    from pyarrow import fs as pafs
    data, digest = _package_zip()
    folder = ensure_checkpoint_dir(spark).rstrip("/") + "/haulage-code"
    path = f"{folder}/haulage-{digest}.zip"
    local = path[len("file:"):] if path.startswith("file:") else path
    if local.startswith("/"):
        filesystem, inner = pafs.LocalFileSystem(), local
    else:
        filesystem, inner = pafs.FileSystem.from_uri(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    if filesystem.get_file_info(inner).type == pafs.FileType.NotFound:
        with filesystem.open_output_stream(inner) as out:
            out.write(data)
    sc.addPyFile(path)
    _SHIPPED.add(app)
