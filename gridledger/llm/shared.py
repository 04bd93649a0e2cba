"""What the operators of this subpackage share: saved tables and text in numpy form."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that numpy handles at once; keeps a task's memory constant however long the texts are.
CHUNK_BYTES = 1 << 19
#: Bytes of rows that cross to Python at once; Spark's own bound is 10,000 rows, however long they are.
BATCH_BYTES = 1 << 21

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master may do without: elsewhere executors share no folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it again: lineage ends, and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """The rows with a number, saved together: a second scan may be split in another way and number them anew."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def mapped(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) for rows with texts, in batches of about BATCH_BYTES, or of one row if that is longer.

    Each core of an executor holds a batch outside the heap and again in Python. Plans read the bound when they run, so
    it stays set in the session; one that the session has already is left as it is."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def forget(df: DataFrame) -> None:
    """Remove the files of saved tables that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of tables that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def weights(n: int, seed: int = 0) -> np.ndarray:
    """n odd pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _MIX[2]) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random word for each byte inside a word, the same for a letter and its capital; white space counts nothing.
_BYTE = weights(256, 29)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd 64-bit word, and their inverses."""
    base = int(_MIX[2])
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (np.uint64(base), np.uint64(inverse)))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of runs of whole texts of about `most` bytes. Null texts are empty.

    A text longer than `most` makes a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, in order, and the text each is in.

    A word is a difference of running sums of its bytes' words times rising powers, moved to the first power."""
    n = len(raw)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not n:
        return none
    inside = ~_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offs[:-1][offs[:-1] < n]
    begins[edges] = inside[edges]
    edges = offs[1:][offs[1:] > 0] - 1
    ends[edges] = inside[edges]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(starts):
        return none
    up, down = _powers(max(CHUNK_BYTES, 1 << (n - 1).bit_length()))
    with np.errstate(over="ignore"):
        sums = _BYTE[raw]
        sums *= up[:n]
        np.cumsum(sums, out=sums)
        h = sums[stops - 1]
        h[1:] -= sums[starts[1:] - 1]
        h[0] -= sums[starts[0] - 1] if starts[0] else np.uint64(0)
        h = mix(h * down[starts] + (stops - starts).astype(np.uint64) * _MIX[2])
    return h, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
