"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a session whose executors are the driver itself gets a
    folder of its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and it survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a stored table that no later step reads."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column) -> F.Column:
    """The text as the operators see it: null is the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of texts."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


#: Words that one worker process remembers at a time; a bound on memory, not on the input.
MEMO = 400_000


def word_code(word: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass")) | 1


class WordCodes(dict):
    """word -> 64-bit code (xxh3), remembered while the memo is below its bound. `clean` maps the word first;
    a word that it turns into nothing gets the code 0."""

    def __init__(self, clean=None):
        super().__init__()
        self.clean = clean

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        kept = self.clean(word) if self.clean else word
        code = word_code(kept) if kept else 0
        self[word] = code
        return code

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


ODD = np.uint64(0x9E3779B97F4A7C15)


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """The code of each run of n codes, by its start; empty where there are fewer than n."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = codes[:m].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out *= ODD
            out ^= out >> np.uint64(32)
            out += codes[i : i + m]
        return mixed(out)
