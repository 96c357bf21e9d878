"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java patterns of a word and of what stands between words (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, though `body` uses it many times."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text (of an empty text where it is null), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def short_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """df, after fewer rows and bytes go to Python at once: texts may be long, and a batch is in memory several times.

    Both are settings of the session, as a plan reads them when it runs; they are only lowered."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < _bytes(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def _bytes(value: str) -> int:
    """A setting's number; some come with the unit b."""
    return int(value.removesuffix("b").removesuffix("B"))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the memory that it freed goes back to the system: a worker stays alive while later stages use none."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole


def ids_as_text(df: DataFrame) -> DataFrame:
    """df with doc_id as text: pandas would turn whole numbers beside a null into floats, and lose their last digits."""
    return df.withColumn("doc_id", F.col("doc_id").cast("string"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            found = jvm.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="tramline-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Written to the shared folder and read again: cuts lineage and outlives executors.

    The write's own shuffle files go when it ends, as nothing reads them again."""
    spark = df.sparkSession
    path, key = f"{shared_dir(spark)}/tramline-{label}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df in no more partitions than `rows` short rows need; tables of many rows keep their partitions.

    Without it, each step over a small table would run and write hundreds of near empty tasks and files."""
    return df.coalesce(max(1, -(-rows // each)))


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- vectorised hashing of words inside Arrow batches -------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _POWERS[str(base)] = have if len(have) <= 1 << 22 else have[: 1 << 22]
    return have[:n]


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of one text, in order, and their lengths in bytes.

    The bytes are summed with powers of an odd number, so each word's hash is a difference of two
    running sums, shifted to the word's own start: a few array operations, whatever the number of words.
    """
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    inside = np.concatenate(([False], ~space, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(b)), out=total[1:])
    size = end - start
    value = (total[end] - total[start]) * _powers(_INV, len(b))[start]
    return mix64(value ^ (size.astype(np.uint64) * _M2)), size


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it is shorter."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def lower_ascii(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()
