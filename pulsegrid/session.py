"""Session settings, sized tables and the shared working folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "pulsegrid", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that jobs run from any folder."""
    import pulsegrid

    application = spark.conf.get("spark.app.id", "")
    if application in _shipped:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(pulsegrid.__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="pulsegrid-code-"), "pulsegrid_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top in ("pulsegrid", "workload"):
            for folder, _, names in os.walk(os.path.join(home, top)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, home))
    spark.addArtifacts(archive, pyfile=True)
    _shipped.add(application)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session, which has no other machines, may fall back to a
    folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pulsegrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/pulsegrid/{label}-{uuid.uuid4().hex}"


#: Bytes of the rows that Python gets at once.  By Spark's default they may be 64 MB in each task, which the JVM and Python both hold,
#: and of which the JVM keeps buffers.
ARROW_BYTES, AT_ONCE = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """From now on Python gets about ``AT_ONCE`` bytes at once in this session, if the session does not say otherwise.  No result depends on it."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(AT_ONCE))


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, with ``bound_batches``.

    Cuts the lineage in a way that survives executor loss, and tells the
    planner the table's true size.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    bound_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = getattr(spark, "_jvm", None)
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if jvm is not None and "/pulsegrid/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sources(df: DataFrame) -> list[int]:
    """Planner sizes of every source the plan reads, once per read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]


def _multiplies(df: DataFrame) -> bool:
    """Whether the plan makes rows of its own, so that the bytes it reads say nothing about its size."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.search(r"\b(Generate|Expand|Range) ", plan) is not None


def planned_bytes(df: DataFrame) -> int:
    """Bytes the plan reads."""
    return sum(_sources(df))


def broadcast_limit(spark: SparkSession) -> int:
    raw = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(raw)


def sized(df: DataFrame, label: str = "params") -> DataFrame:
    """A small-side table whose size the planner can trust.

    Left lazy when the whole input is smaller than a broadcast anyway and the plan
    makes no further rows.  Otherwise written once, so the join that follows is a
    broadcast if the true size allows it and a skew-aware shuffle join if not.
    """
    if planned_bytes(df) <= broadcast_limit(df.sparkSession) and not _multiplies(df):
        return df
    return written(df, label)


#: A table that several branches of a job need is computed once if it reads more
#: than this many bytes, or reads its sources more than this many times.
SHARE_ABOVE_BYTES = 64 << 20
SHARE_ABOVE_READS = 3


def shared(df: DataFrame, label: str = "shared") -> DataFrame:
    """A table that several branches of one job read; written once if it is expensive."""
    reads = _sources(df)
    cheap = sum(reads) <= SHARE_ABOVE_BYTES and len(reads) <= SHARE_ABOVE_READS and not _multiplies(df)
    return df if cheap else written(df, label)
