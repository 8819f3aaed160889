"""The four layers' JSON lines, their context lines, and their union to one passage table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions.split import split_pieces

# The layers' schemas.
SCHEMAS = {
    "said": "chunk_id string, layer string, parti string, parti_namn string, sakfraga string, heading string, labels array<string>, text string, text_for_embedding string, url string, hamtad string, lastmod string, sources array<string>, in_index boolean, content_hash string",
    "motion": "text string, heading string, sektion_text string, match_score double, yrkande_nr int, parti string, rm string, beteckning string, doc_title string, forste_undertecknare string, undertecknare string, layer string, chunk_id string",
    "program": "chunk_id string, layer string, parti string, doc_type string, year int, heading string, page int, text string, source_file string",
    "proposition": "rm string, beteckning string, doc_title string, parti string, datum string, file string, heading string, text string, chunk_id string",
}
QUESTIONS = "id string, typ string, fraga string, sok struct<parti:array<string>,layer:string,k:int,per_parti:int>, relevant struct<layer:string,parti:array<string>,beteckning:array<string>,rm:array<string>,sakfraga_regex:string,text_regex:string>, forvantade_partier array<string>, forvantade_lager array<string>, tillskrivning_regex string, forvantat_saknas boolean, forvantat_avboj boolean, sprak string, foljer string, kommentar string"
RESULTS = "config string, id string, typ string, fraga string, foljer string, answer string, model string, latency_s double, api_calls int, n_hits int, n_gaps int, searches string, hits array<struct<n:int,layer:string,parti:string,kontext:string,similarity:double>>, sources array<string>, time string, error string"


def exists(spark: SparkSession, path: str) -> bool:
    """Is there any file of this path, which may have wildcards, in whatever store?"""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm))


def layer(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A layer's JSON lines by its schema; a path without files is an empty layer."""
    return spark.read.schema(SCHEMAS[name]).json(path) if exists(spark, path) else spark.createDataFrame([], SCHEMAS[name])


def questions(spark: SparkSession, path: str, with_rule: bool = False) -> DataFrame:
    own = spark.read.option("multiLine", True).schema(QUESTIONS).json(path)
    return own.where("relevant IS NOT NULL") if with_rule else own


def subtypes(spark: SparkSession, path: str) -> DataFrame:
    """(key, subtype) of a JSON object; a missing file is an empty map."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, subtype string")
    own = spark.read.text(path, wholetext=True)
    return own.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "subtype"))


def grades(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def party_name(party: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in K.PARTIES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, party), party)


def said_context(party: Column, topic: Column, heading: Column, labels: Column) -> Column:
    party, topic = (F.coalesce(c, F.lit("")) for c in (party, topic))
    head = F.coalesce(F.nullif(heading, F.lit("")), topic)
    line = F.trim(F.concat(party_name(party), F.lit(" ("), party, F.lit(") om "), topic, F.lit(": "), head))
    extra = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.lower(x) != F.lower(head))
    return F.when(F.size(extra) > 0, F.concat(line, F.lit(" ("), F.array_join(extra, "; "), F.lit(")"))).otherwise(line)


def motion_context(party: Column, number: Column, session: Column, heading: Column) -> Column:
    line = F.concat(party_name(party), F.lit(" ("), party, F.lit("), motion "), F.coalesce(number, F.lit("")), F.lit(" "), F.coalesce(session, F.lit("")))
    return F.trim(F.concat(line, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(", om "), heading)).otherwise("")))


def program_context(party: Column, kind: Column, year: Column, heading: Column) -> Column:
    shared = party.contains(";")
    name = F.when(shared, F.lit("Tidöpartierna")).otherwise(party_name(party))
    line = F.concat(name, F.lit(" ("), F.when(shared, F.replace(party, F.lit(";"), F.lit(", "))).otherwise(party), F.lit("), "), F.coalesce(kind, F.lit("partiprogram")))
    line = F.concat(line, F.when(F.coalesce(year, F.lit(0)) != 0, F.concat(F.lit(" (antaget "), year.cast("string"), F.lit(")"))).otherwise(""))
    return F.concat(line, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" — "), heading)).otherwise(""))


def proposition_context(session: Column, number: Column, title: Column, heading: Column) -> Column:
    line = F.concat(F.lit("Regeringen (M, KD, L), proposition "), F.coalesce(session, F.lit("")), F.lit(":"), F.coalesce(number, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))
    return F.trim(F.concat(line, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" — "), heading)).otherwise("")))


def passages(said: DataFrame, motion: DataFrame, program: DataFrame, proposition: DataFrame, subtype: DataFrame) -> DataFrame:
    """One row a piece: id, parent, layer, parti, kontext, text, emb and what each layer has besides."""
    c = F.col
    motion = motion.join(subtype, F.concat("rm", F.lit(":"), "beteckning") == c("key"), "left").withColumn("subtyp", F.coalesce("subtype", F.lit(""))).drop("key", "subtype")
    parts = [
        said.withColumn("layer", F.lit("said")).withColumn("kontext", said_context(c("parti"), c("sakfraga"), c("heading"), c("labels"))).drop("text_for_embedding", "heading"),
        motion.withColumn("layer", F.lit("motion")).withColumn("kontext", motion_context(c("parti"), c("beteckning"), c("rm"), c("heading"))).withColumn("extra_bm25", c("sektion_text")),
        program.withColumn("layer", F.lit("program")).withColumn("kontext", program_context(c("parti"), c("doc_type"), c("year"), c("heading"))),
        proposition.withColumn("layer", F.lit("proposition")).withColumn("kontext", proposition_context(c("rm"), c("beteckning"), c("doc_title"), c("heading"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.withColumnRenamed("chunk_id", "parent").select("*", F.posexplode(split_pieces("text")).alias("i", "piece")).drop("text").withColumnRenamed("piece", "text")
    body = F.when(c("layer") == "motion", T.proposal_core(c("text"))).otherwise(c("text"))
    return out.withColumn("id", F.concat("parent", F.lit("#"), c("i").cast("string"))).withColumn("emb", T.content_key(T.embedded(c("kontext"), body))).drop("i")


def write_layer(records: DataFrame, path: str) -> None:
    """JSON lines by party; only the parties that records hold are overwritten."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parti").json(path)
