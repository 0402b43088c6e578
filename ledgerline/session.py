"""Session settings the library is written for, and results written down between steps."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where the split costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What is written down compresses well; its size in memory decides whether it is broadcast.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Filters reach sources of one's own (sources/pieces.py).
    "spark.sql.python.filterPushdown.enabled": "true",
}

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def build_session(app: str = "ledgerline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else one in the warehouse; all executors share either."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_written"


def new_path(spark: SparkSession) -> str:
    """A fresh folder name in the shared folder; the open :func:`scratch`, if any, removes it."""
    path = f"{_shared_folder(spark).rstrip('/')}/ledgerline-{uuid.uuid4().hex}"
    held = _written.get()
    if held is not None:
        held.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owns what is written down while it is open, and removes it when it closes.

    Frames are lazy, so whoever opens it consumes the results (writes or collects them) inside. Without
    one, files stay until the shared folder is cleaned.
    """
    held: list[str] = []
    token = _written.set(held)
    try:
        yield
    finally:
        _written.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in held:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def write_down(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder once, to ``path`` there if given, and read back.

    What reads the result starts from files: nothing is computed again after the loss of an
    executor, and Spark knows the size when it chooses a join.
    """
    untyped = {f.name for f in df.schema.fields if isinstance(f.dataType, NullType)}
    stored = df.select(*[F.col(c) if c not in untyped else F.lit(None).cast("string").alias(c) for c in df.columns])
    path = path or new_path(df.sparkSession)
    stored.write.parquet(path)
    read = df.sparkSession.read.schema(stored.schema).parquet(path)
    return read.withColumns({c: F.lit(None) for c in untyped}) if untyped else read
