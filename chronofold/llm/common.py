"""Helpers shared by the training-data operators: shared storage, lineage cuts, table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch sent to Python: texts have no length limit, so bytes count besides rows.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

_own_folder: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may do without: it gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="chronofold-")
    return _own_folder[app]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote; nothing that is still to be computed may read it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds. Spark reads these settings when a query runs, after the operator has returned,
    so they are lowered for the session where they are higher, and never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).lower()
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int):
    """``crc32`` of an id's text modulo ``folds``: the split that the label contracts use."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(folds)


def unit_hash(*columns, seed: int = 0):
    """A repeatable uniform number in (0, 1) made from the given columns."""
    bits = F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 12)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
