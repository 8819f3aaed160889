"""A corpus from raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
has kept; all but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skrift.llm import decontam, dedup, mixing, pii, toxicity
from skrift.llm.shared import WORD, keyed, written

#: Rows are taken out by a key of their own: ids may be null or repeated.
ROW = "__row"


def less_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the rejection limit; each row is judged by its text, whatever its id."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.severity(docs, model, name="__severity").where(F.col("__severity") < toxicity.REJECT).select(docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, of the smallest id; rows that repeat an id and a wordless text are one row."""
    rows = keyed(docs, ROW)
    gone = dedup.near_duplicates(rows, row_col=ROW).where("NOT kept").select(ROW)
    wordless = rows.where(F.col("doc_id").isNotNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    firsts = wordless.groupBy("doc_id", "text").agg(F.min(ROW).alias(ROW))
    # written, so that its size is known: texts are shuffled only for a large one
    gone = written(gone.unionByName(wordless.select(ROW).join(firsts.select(ROW), ROW, "left_anti")), "gone")
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item; a row is taken out for its own text, so rows of null or repeated ids stay or go one by one."""
    rows = keyed(docs, ROW)
    found = decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=ROW)
    leaks = written(found.select(ROW).distinct(), "leaks")
    return rows.join(leaks, ROW, "left_anti").select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; n_chars follows the text, null texts stay null."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each row; repeated rows and rows without an id are queue entries of their own, ties go by id, then size."""
    return mixing.mix(docs)


STAGES = [("toxicity", less_toxic), ("near-dedup", deduplicated), ("decontamination", decontaminated), ("pii", redacted), ("mixing", mixed)]

#: No SQL expresses trained or hashed stages; tests hold each stage against what small rows must give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = written(docs, "stage")
    return docs
