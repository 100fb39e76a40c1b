"""What the training-data operators share: shared storage, row keys, splits."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: At most so many keys are treated as hot: each holds more than this part of all rows.
HOT_PARTS = 1000
SALTS = 64

_run: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only on one machine, as in tests, a session that names none gets a local
    temporary folder for the rest of its time.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.sparkContext.setCheckpointDir(got)
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in this run's folder, which goes when the driver ends."""
    base = shared_dir(spark)
    if base not in _run:
        _run[base] = f"{base}/run-{uuid.uuid4().hex}"
        atexit.register(_clean, spark, _run[base])
    return f"{_run[base]}/{what}-{uuid.uuid4().hex}"


def _clean(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # None once the session is stopped
        with contextlib.suppress(Py4JError, OSError):
            remove(spark, path)


def materialize(df: DataFrame, what: str, **options) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, survives lost executors."""
    return written(df, what, **options)[0]


def written(df: DataFrame, what: str, **options) -> tuple[DataFrame, str]:
    """``materialize``, and the path, for tables that another soon replaces."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def whole(df: DataFrame, name: str = "row") -> Column:
    """All columns as one, so that no name made beside it can clash; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def text_of(df: DataFrame) -> Column:
    return (F.col("text") if "text" in df.columns else F.lit(None)).cast("string")


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> list[int]:
    """Hashes of the keys with more than 1 / ``HOT_PARTS`` of all rows: at most ``HOT_PARTS``."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(n) * HOT_PARTS > total).select(F.xxhash64(*keys)).collect()]


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], hot: list[int], by: list[str], how: str = "left") -> DataFrame:
    """``many`` joined to ``one`` (each key once); rows of a hot key are dealt over ``SALTS`` by the columns ``by``."""
    if not hot:
        return many.join(one, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    left = many.withColumn("salt_", F.when(is_hot, F.pmod(F.xxhash64(*by, F.lit(3)), F.lit(SALTS)).cast("int")).otherwise(0))
    right = one.withColumn("salt_", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "salt_"], how).drop("salt_")


def most_frequent(counts: DataFrame, n: str, most: int) -> int:
    """The least count such that at most ``most`` rows have it or more.

    Found from counts by 32 steps an octave, a table of a bounded size, so no
    task sorts the rows.
    """
    step = F.floor(F.log2(n) * 32).cast("int")
    by = sorted(((r[0], r[1], r[2]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)), F.min(n)).collect()), reverse=True)
    total, least = 0, 1 << 62
    for _, rows, low in by:
        total += rows
        if total > most:
            break
        least = low
    return least


def release() -> None:
    """Give freed memory back to the system: a worker process stays for the tasks of other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def bucket(modulus: int, name: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Exactly the wanted columns, cast; a missing one is null, any extra is left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in wanted.items()])
