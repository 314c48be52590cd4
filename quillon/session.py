"""Session helpers: local sessions, table reads, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side may be broadcast after it has been counted.
BROADCAST_ROWS = 200_000
#: Bytes up to which it may be.
BROADCAST_BYTES = 16 << 20


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: spark.checkpoint.dir; on one machine, else a temporary one of this session.

    On a cluster a session without it is refused: a folder of one machine would lose what other executors write.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The files are removed when the driver's JVM exits, or earlier by released().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for paths in _OPEN:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_OPEN: list[list[str]] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all that cut() wrote within it; what is still needed must have been read or written elsewhere."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.pop()
        for p in paths:
            _remove(spark, p)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has partitions, for costly work on few bytes.

    Without it the optimizer merges small partitions by their bytes and one task would do all the work. Rows go by a hash of
    the keys that no other operator partitions by, so the exchange is never taken for one that is there already.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(F.lit(n), *keys)) if keys else df.repartition(n)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for clusters that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = f"{tempfile.mkdtemp(prefix='quillon-')}/quillon_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)
    context._quillon_shipped = True


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when a count proves at most ``rows`` rows of at most ``most_bytes`` in all, else leave the choice to
    the optimizer. Texts and binaries count as long as they are, arrays by their elements, other columns eight bytes each.

    ``df`` should be cheap to count, e.g. the result of cut().
    """

    def length(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(field.dataType, T.ArrayType):
            return F.coalesce(F.size(c), F.lit(0)) * 16 + 8
        return F.lit(8)

    size = reduce(lambda a, b: a + b, (length(f) for f in df.schema.fields), F.lit(16))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= most_bytes else df
