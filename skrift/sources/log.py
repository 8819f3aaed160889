"""An append log of rows with an order: each append is a commit that allots sequence numbers.

A commit is a file of the folder `commits`, whose name is its number; it says
where the rows are, which sequence numbers they have and what the append was
called. Commit files are never replaced: of two writers that make the same one,
one fails and tries the next number. An append whose name was committed adds
nothing, so it may be tried again. Compaction is a commit too: it names the
files that now hold the last row of every key, and readers start from it.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEQUENCE = "seq"
COMMIT = "number long, name string, path string, first long, n long, compacts boolean"


def _path(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str) -> list[dict]:
    """All commits from the last compaction on, in order; names of earlier ones go with the compaction."""
    path, fs = _path(spark, f"{folder}/commits")
    if not fs.exists(path):
        return []
    rows = spark.read.schema(COMMIT + ", names array<string>").json(f"{folder}/commits/*.json").orderBy("number").collect()
    found = [r.asDict() for r in rows]
    start = max((i for i, r in enumerate(found) if r["compacts"]), default=0)
    return found[start:]


def _committed(spark: SparkSession, folder: str, commit: dict) -> bool:
    """Makes a commit's file under its number, whole at once; false where another writer was first."""
    path, fs = _path(spark, f"{folder}/commits/{commit['number']:012d}.json")
    new, _ = _path(spark, f"{folder}/commits/.new-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(json.dumps(commit).encode())
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(kind, 1)
    none[0] = kind.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(new), fs.makeQualified(path), none)
    except Exception as taken:  # noqa: BLE001 - Py4J wraps what the store raises
        fs.delete(new, False)
        if "exist" in str(taken).lower():
            return False
        raise
    return True


def append(rows: DataFrame, folder: str, name: str, order: list[str] = ()) -> int:
    """Adds rows in the order of `order` (else as they come); returns how many. Nothing is added under a name that was committed."""
    spark = rows.sparkSession
    if any(name in (c["names"] or [c["name"]]) for c in commits(spark, folder)):
        return 0
    path = f"{folder}/rows-{uuid.uuid4().hex}"
    (rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    n = spark.read.parquet(path).count()
    while True:
        done = commits(spark, folder)
        if any(name in (c["names"] or [c["name"]]) for c in done):
            return 0
        last = done[-1] if done else {"number": -1, "first": 0, "n": 0}
        if _committed(spark, folder, {"number": last["number"] + 1, "name": name, "path": path, "first": last["first"] + last["n"], "n": n, "compacts": False}):
            return n


def read(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    """All rows since the last compaction, with their sequence number `seq`. A log without commits has the rows of `schema` and none of them."""
    out = None
    for c in commits(spark, folder):
        own = spark.read.parquet(c["path"])
        if not c["compacts"]:
            # a row's number is its place in its part, after the parts before
            sizes = own.groupBy("__part").agg(F.count("*").alias("__n"))
            before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            nth = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
            own = own.withColumn("__nth", nth).join(F.broadcast(sizes.withColumn("__before", before)), "__part")
            own = own.withColumn(SEQUENCE, F.lit(c["first"] - 1) + F.col("__before") + F.col("__nth")).drop("__part", "__at", "__nth", "__n", "__before")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        if schema is None:
            raise FileNotFoundError(f"no log in {folder}")
        out = spark.createDataFrame([], schema).withColumn(SEQUENCE, F.lit(0).cast("long"))
    return out


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key by its number; combined before the shuffle."""
    rest = [c for c in log.columns if c not in (*keys, SEQUENCE)]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), SEQUENCE).alias("__r"), F.max(SEQUENCE).alias(SEQUENCE)).select(*keys, SEQUENCE, "__r.*")


def compact(spark: SparkSession, folder: str, keys: list[str]) -> bool:
    """Keeps the last row of each key; false where another commit came between, which may be tried again. Older rows' files stay for readers."""
    done = commits(spark, folder)
    if not done or done[-1]["compacts"]:
        return False
    path, last = f"{folder}/rows-{uuid.uuid4().hex}", done[-1]
    latest(read(spark, folder), keys).write.parquet(path)
    names = [n for c in done for n in (c["names"] or [c["name"]])]
    return _committed(spark, folder, {"number": last["number"] + 1, "name": f"compaction {last['number'] + 1}", "names": names, "path": path, "first": last["first"] + last["n"], "n": 0, "compacts": True})
