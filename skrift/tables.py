"""Spreading over cores, batches of texts, ranks of large groups, and tables in the shared folder."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session may have a temporary one, which goes with it."""
    found = spark.conf.get(SHARED, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"{SHARED} must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="skrift-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set(SHARED, found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str = "index") -> str:
    """A new path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/skrift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all tables that this application has written; for its end, as unread results may need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/skrift-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: several plans read it, and it survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is too small to be split among them, by the planner's estimate of its size: nothing runs for it. Rows that are read from as many files as there are cores lie spread already."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(plan.stats().sizeInBytes()) >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return df if plan.nodeName() == "LogicalRelation" and len(df.inputFiles()) >= cores else df.repartition(cores)


def byte_batches(spark: SparkSession, most: str = "4m") -> None:
    """Bounds the Arrow batches of texts by bytes, unless the session does: by rows alone, a split goes to Python as one."""
    if not spark.conf.get(BATCH_BYTES, None):
        spark.conf.set(BATCH_BYTES, most)


def range_ranked(df: DataFrame, by: str | list[str], *order, name: str = "rank") -> DataFrame:
    """df with the row's number within `by`, for groups that are too large for one task.

    Rows are range-sorted by group and order and written with their place in the
    range, so no second shuffle numbers them; ranges' sizes, few, say where each starts.
    """
    keys = [by] if isinstance(by, str) else list(by)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = written(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged").withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) + 1 - F.col("__first")).drop("__n", "__first")
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + [F.col("__part") == F.col("__of")]
    sizes = sizes.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__part").alias("__of"), "__before")
    out = ranged.join(F.broadcast(sizes), same)  # a row a range and group
    return out.withColumn(name, (F.col("__at") + F.col("__before")).cast("int")).select(*df.columns, name)
