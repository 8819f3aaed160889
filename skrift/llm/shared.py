"""What several operators need: shared storage, words and hashes."""

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import byte_batches, scratch, written  # noqa: F401

#: White space of the contracts: blank and the controls 9 to 13. bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a worker's cache holds.
CACHED = 100_000


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (see tables.shared_dir)."""
    return scratch(spark, name)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """df with a long of its own for every row, which is the same in each plan that reads it.

    A Parquet table that is read as it is has its rows' file and place in it for
    a key: files are numbered in a written table of two longs a file, which is
    all that is broadcast. Other formats do not know a row's place, and plans
    other than a scan may give rows in another order: these are written once.
    """
    whole = df._jdf.queryExecution().analyzed()
    scan = whole.nodeName() == "LogicalRelation" and "_metadata" not in df.columns and "HadoopFsRelation" in whole.relation().getClass().getName()
    if not scan or whole.relation().fileFormat().toString() != "Parquet":
        return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed")
    file = F.col("_metadata.file_path")
    own = df.select("*", F.xxhash64(file).alias("__file"), F.col("_metadata.row_index").alias("__at"))
    files = df.select(file.alias("path")).distinct()
    nth = F.row_number().over(Window.orderBy("path")).cast("long")
    first = written(files.select(F.xxhash64("path").alias("__file"), F.call_function("shiftleft", nth, F.lit(40)).alias("__first")), "files")
    if first.count() != first.select("__file").distinct().count():  # two paths of one hash
        return written(df.withColumn(name, F.monotonically_increasing_id()), "keyed")
    return own.join(F.broadcast(first), "__file").select(*df.columns, (F.col("__first") + F.col("__at")).alias(name))


def dropped(df: DataFrame) -> None:
    """Deletes the files of a written table that no later plan reads."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def split_by(df: DataFrame, key: str, wanted: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be among those of the written table `wanted`, and rows whose key is not, without a shuffle.

    A bit for each key's hash, in at most `most` longs: this is what is
    broadcast, whatever the number of keys. Eight keys a long let 12 % of other
    rows pass; beyond 8 * most keys the filter lets more pass, and never loses a row.
    """
    longs = 1 << max(6, min(most.bit_length() - 1, (wanted.count() // 8).bit_length()))
    h = F.xxhash64(F.col(key), F.lit(3))
    place, bit = h.bitwiseAND(longs - 1).alias("__place"), F.shiftrightunsigned(h, 58).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = F.broadcast(wanted.select(place, mask.alias("b")).groupBy("__place").agg(F.bit_or("b").alias("__bits")))
    both = df.withColumn("__place", place)
    held = F.col("__bits").bitwiseAND(mask) != 0
    may = both.join(bits, "__place").where(held).drop("__place", "__bits")
    rest = both.join(bits, "__place", "left").where(~F.coalesce(held, F.lit(False))).drop("__place", "__bits")
    return may.select(df.columns), rest.select(df.columns)


def pruned(df: DataFrame, key: str, wanted: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Rows of df whose key may be wanted, so that a join shuffles few others."""
    return split_by(df, key, wanted, most)[0]


def n_words(text):
    """Count of the contracts' words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# -- hashes -------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((_GOLD * (salt + 1)) & 0xFFFFFFFFFFFFFFFF))


class WordHashes(dict):
    """Word to 64-bit hash; forgets everything when it holds `most` words, so memory is bounded."""

    def __init__(self, most: int = CACHED):
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; the whole as one when there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)
