"""Where a job may keep checkpoints and tables that other executors must see."""

import tempfile
import uuid
import warnings

from pyspark.sql import SparkSession

# Folders made by this process, by session: (application id, base) -> folder.
_folders: dict[tuple[str, str], str] = {}
# Executors that were seen to share a base: (application id, base) -> their addresses.
_tried: dict[tuple[str, str], set[str]] = {}
# The base that a session on a cluster uses, by application id.
_found: dict[str, str] = {}
_LOCAL_SCHEMES = ("file:", "/")
_FILES_PER_CORE = 4

# Where a cluster may have a folder that its executors share; the first that they do serves.
_PLACES = [
    lambda spark: _found.get(spark.sparkContext.applicationId),
    lambda spark: spark.conf.get("spark.checkpoint.dir", None),
    lambda spark: spark.sparkContext.getCheckpointDir(),
    lambda spark: spark.conf.get("spark.sql.warehouse.dir"),
    lambda spark: f"file://{tempfile.gettempdir()}",
]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir``.

    Where that setting is absent, a local-mode session gets a temporary folder. On a cluster
    a path that may be one machine's is tried first. If files that executors write there are
    missing afterwards, or nothing is set, the context's checkpoint folder, the warehouse or
    the temporary folder serves, if executors share one; else the job is refused. All folders
    of a session go when its JVM ends.
    """
    base = _base(spark)
    key = (spark.sparkContext.applicationId, base)
    if key not in _folders:
        _folders[key] = f"{base.rstrip('/')}/logmill-{uuid.uuid4().hex}"
        _make_for_session(spark, _folders[key])
    return f"{_folders[key]}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by ``shared_folder`` once nothing reads it any more."""
    if not any(folder.startswith(f"{made}/") for made in _folders.values()):
        raise ValueError(f"not a folder of this session: {folder}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    # local-cluster has executors of its own, each with its own working and temporary folder
    local = spark.sparkContext.master.split("[")[0] == "local"
    if base and (local or not base.startswith(_LOCAL_SCHEMES) or _is_mounted(spark)):
        return base
    if local:
        return f"file://{tempfile.gettempdir()}"
    failure = None
    for place in _PLACES:
        try:
            if there := place(spark):
                _found[spark.sparkContext.applicationId] = found = _try(spark, there)
                if failure and base:
                    warnings.warn(f"executors do not share {base} ({failure}); temporary tables go below {found}")
                return found
        except Exception as error:  # whatever keeps a place from being written or read
            failure = failure or error
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share") from failure
    raise ValueError(
        f"spark.checkpoint.dir is {base}, a path of one machine; name a store that "
        "all executors share, or set spark.logmill.sharedMount=true if it is a mount"
    ) from failure


def _try(spark: SparkSession, base: str) -> str:
    """The base with its scheme, if executors share it; raises if not.

    Every core writes some small files, and all must be there for the driver and for
    whatever executor reads them. Tried anew when executors have joined.
    """
    context = spark.sparkContext
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(path).toString()
    executors = set(context._jsc.sc().getExecutorMemoryStatus().keys().mkString(",").split(","))
    known = _tried.get((context.applicationId, whole), set())
    if executors <= known:
        return whole
    trial = f"{whole.rstrip('/')}/logmill-trial-{uuid.uuid4().hex}"
    files = _FILES_PER_CORE * context.defaultParallelism
    try:
        spark.range(0, files, 1, files).write.parquet(trial)
        seen = spark.read.schema("id bigint").parquet(trial).count()
    finally:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(trial), True)
    if seen != files:
        raise FileNotFoundError(f"{files - seen} of {files} files that executors wrote to {base} are missing")
    _tried[context.applicationId, whole] = executors | known
    return whole


def _is_mounted(spark: SparkSession) -> bool:
    return spark.conf.get("spark.logmill.sharedMount", "false") == "true"


def _make_for_session(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
