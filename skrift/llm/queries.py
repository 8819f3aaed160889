"""The queries of the training-data operators, and the SQL that checks them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, dedup, license, mixing, negatives, packing, phrases, pii, secrets, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.severity(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", (F.col("severity") >= toxicity.REJECT).alias("rejected"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], given.schema)
    return chat.digests(chat.formatted(chat.linear(given.unionAll(extra)), unique=True))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.capture_index(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), with_ids=False)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("id") % 50 == 0)


def queries() -> dict:
    own = (op1_toxicity, op2_chat, op3_licenses, op4_mixing, op5_pii, op6_decontamination, op7_warc, op8_near_dedup, op9_secrets, op10_neighbours, op11_phrases, op12_packing, op13_negatives)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict:
    return {"op2_chat": chat.ORACLE, "op4_mixing": mixing.ORACLE, "op6_decontamination": decontam.ORACLE, "op7_warc": warc.ORACLE, "op8_near_dedup": dedup.ORACLE, "op9_secrets": secrets.ORACLE, "op11_phrases": phrases.ORACLE, "op13_negatives": negatives.ORACLE}
