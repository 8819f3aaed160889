"""Streams of passages and of result rows, an extension of the batch operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import evaluate as E
from ..sources.index import append, keyed, missing
from ..sources.layers import RESULTS, SCHEMAS


def layer_stream(spark: SparkSession, name: str, path: str) -> DataFrame:
    """New JSON-lines files of a layer, as they come."""
    return spark.readStream.schema(SCHEMAS[name]).json(path)


def embed_new(passages: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Encodes the content keys of a stream of passages (context, text) that folder lacks, and adds them there.

    A batch that is run again writes its own folder anew, so no key is added twice.
    """

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
        earlier = [p for p in (f.getPath().toString() for f in found) if not p.endswith(f"/batch={n}")]
        known = spark.read.parquet(*earlier) if earlier else None
        encode(missing(keyed(batch), known)).select("emb", "vector").write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return passages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(passages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Adds a stream of passages (pid, party, layer, context, text) to the index of a folder, a delta segment a batch.

    Segments are named by checkpoint and batch, so a batch that is run again after a failure adds nothing.
    """

    def add(batch: DataFrame, n: int) -> None:
        append(batch, folder, name=f"{checkpoint}-{n}")

    return passages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def result_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Result rows without errors; a repeated row (config, id, time) within the watermark counts once."""
    own = spark.readStream.schema(RESULTS).json(path).where("error IS NULL")
    own = own.withColumn("at", F.to_timestamp("time")).withWatermark("at", late)
    return own.dropDuplicatesWithinWatermark(["config", "id", "time"])


def latest_results(log: DataFrame) -> DataFrame:
    """The last row of each config and question of a written log."""
    return E.latest(log, ["config", "id"], "time")
