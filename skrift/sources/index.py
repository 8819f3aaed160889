"""The search index: segments of tables in a folder, and a manifest that names the current ones.

A build writes one segment of all passages. An append writes a delta segment:
its passages, their postings, and the ids of earlier passages that it replaces
or removes (`gone`). A passage holds unless a later segment has its id among
those; counts and lengths of all that hold are in the manifest, document
frequencies are merged as postings are read. Compaction makes one segment of
what holds.

Each step writes its tables beside the old ones and replaces the manifest last,
so an interrupted one leaves the old index in use. An append has a name; one
that the manifest has already adds nothing, so a repeated batch is safe. Steps
that replace segments retire them; `vacuum` deletes those that were retired
`keep` steps ago or more, as readers may still use later ones. There is one
writer at a time.

Vectors are kept by content key; only keys that no earlier step of the same
model has are encoded. Lexical tables can be rebuilt alone.
"""

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..operators import search as S
from ..tables import spread


def _fs(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """The current manifest; None where no build has ended."""
    path, fs = _fs(spark, f"{folder}/manifest.json")
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()[0]) if fs.exists(path) else None


def _swap(spark: SparkSession, folder: str, found: dict) -> None:
    jvm = spark._jvm
    new, fs = _fs(spark, f"{folder}/.manifest-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(json.dumps(found, ensure_ascii=False).encode())
    out.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kind, 1)
    over[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(_fs(spark, f"{folder}/manifest.json")[0]), over)


def keyed(passages: DataFrame) -> DataFrame:
    """Passages with the content key `emb` of what is embedded."""
    return passages.withColumn("emb", T.content_key(T.embedded(F.col("context"), F.col("text"))))


def missing(passages: DataFrame, known: DataFrame | None) -> DataFrame:
    """(emb, text): one row a content key that `known` (emb, ...) lacks."""
    wanted = passages.select("emb", T.embedded(F.col("context"), F.col("text")).alias("text"))
    if known is not None:
        wanted = wanted.join(known.select("emb"), "emb", "left_anti")
    return wanted.groupBy("emb").agg(F.min("text").alias("text"))


def _segment(passages: DataFrame, path: str) -> tuple[DataFrame, int, int]:
    """Writes a segment's passages, lengths and postings; returns the passages, their number and their words."""
    spark = passages.sparkSession
    keyed(spread(passages)).write.parquet(f"{path}/passages")
    own = spark.read.parquet(f"{path}/passages")
    S.token_lists(own).write.parquet(f"{path}/tokens")
    lists = spark.read.parquet(f"{path}/tokens")
    S.postings(lists).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
    total = lists.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return own, total[0], total[1]


def _encoded(own: DataFrame, path: str, old: dict, encode, model: str) -> list[str]:
    """Paths of vectors, with those of the segment's new content keys."""
    if encode is None:
        return old.get("vectors", [])
    earlier = old.get("vectors", []) if old.get("model") == model else []
    known = own.sparkSession.read.parquet(*earlier) if earlier else None
    encode(missing(own, known)).select("emb", "vector").write.parquet(f"{path}/vectors")
    return [*earlier, f"{path}/vectors"]


def _manifest(segments: list[dict], n: int, words: int, vectors: list[str], model: str | None, retired: list[list[str]], names: list[str]) -> dict:
    return {"segments": segments, "n": n, "words": words, "avgdl": words / n if n else 0.0, "vectors": vectors, "model": model, "retired": retired, "names": names, "max_chars": K.MAX_CHARS, "overlap": K.OVERLAP}


def build(passages: DataFrame, folder: str, encode: Callable[[DataFrame], DataFrame] | None, model: str = "stub") -> dict:
    """Builds the index of passages (pid, party, layer, context, text) anew and makes it current.

    `encode` turns (emb, text) into (emb, vector); without it only the lexical
    tables are built, and the manifest goes on naming the vectors it named.
    """
    spark, old = passages.sparkSession, manifest(passages.sparkSession, folder) or {}
    path = f"{folder}/v-{uuid.uuid4().hex}"
    own, n, words = _segment(passages, path)
    retired = [*old.get("retired", []), [s["path"] for s in old.get("segments", [])]]
    found = _manifest([{"path": path, "gone": False}], n, words, _encoded(own, path, old, encode, model), model if encode else old.get("model"), retired, [])
    _swap(spark, folder, found)
    return found


def _union(spark: SparkSession, segments: list[dict], name: str) -> DataFrame:
    """A table of all segments, with the segment's number as `seg`."""
    parts = [spark.read.parquet(f"{s['path']}/{name}").withColumn("seg", F.lit(n)) for n, s in enumerate(segments) if name != "gone" or s["gone"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def holding(rows: DataFrame, segments: list[dict]) -> DataFrame:
    """Rows (pid, seg, ...) that no later segment has replaced or removed."""
    if not any(s["gone"] for s in segments):
        return rows.drop("seg")
    last = _union(rows.sparkSession, segments, "gone").groupBy("pid").agg(F.max("seg").alias("last"))
    return rows.join(last, "pid", "left").where(F.col("last").isNull() | (F.col("seg") >= F.col("last"))).drop("seg", "last")


def append(passages: DataFrame, folder: str, removed: DataFrame | None = None, name: str | None = None, encode: Callable[[DataFrame], DataFrame] | None = None, model: str = "stub") -> dict:
    """Adds passages to an index, in place of earlier ones of their ids, and takes out those of `removed` (pid).

    Of several rows of one id the largest by its columns counts. An append of a
    name that is in the manifest is done already and changes nothing.
    """
    spark, old = passages.sparkSession, manifest(passages.sparkSession, folder)
    if old is None:
        raise FileNotFoundError(f"no index in {folder}")
    if name is not None and name in old["names"]:
        return old
    path = f"{folder}/d-{uuid.uuid4().hex}"
    rest = [c for c in passages.columns if c != "pid"]
    once = passages.groupBy("pid").agg(F.max(F.struct(*rest)).alias("r")).select("pid", "r.*")
    own, n, words = _segment(once, path)
    ids = own.select("pid") if removed is None else own.select("pid").unionByName(removed.select("pid").distinct()).distinct()
    held = holding(_union(spark, old["segments"], "tokens").select("pid", "dl", "seg"), old["segments"]).join(ids, "pid")
    held.select("pid", "dl").write.parquet(f"{path}/gone")
    out = spark.read.parquet(f"{path}/gone").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    segments = [*old["segments"], {"path": path, "gone": out[0] > 0}]
    names = old["names"] if name is None else [*old["names"], name]
    found = _manifest(segments, old["n"] + n - out[0], old["words"] + words - out[1], _encoded(own, path, old, encode, model), model if encode else old["model"], old["retired"], names)
    _swap(spark, folder, found)
    return found


def compact(spark: SparkSession, folder: str) -> dict:
    """Makes one segment of what holds; words are not stemmed again."""
    old = manifest(spark, folder)
    if old is None:
        raise FileNotFoundError(f"no index in {folder}")
    if len(old["segments"]) == 1:
        return old
    path = f"{folder}/v-{uuid.uuid4().hex}"
    for name in ("passages", "tokens", "postings"):
        own = holding(_union(spark, old["segments"], name), old["segments"])
        (own.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else own).write.parquet(f"{path}/{name}")
    retired = [*old["retired"], [s["path"] for s in old["segments"]]]
    found = _manifest([{"path": path, "gone": False}], old["n"], old["words"], old["vectors"], old["model"], retired, old["names"])
    _swap(spark, folder, found)
    return found


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Deletes tables of all but the last `keep` retired steps, unless vectors in them are in use; returns their paths."""
    old = manifest(spark, folder)
    if old is None:
        raise FileNotFoundError(f"no index in {folder}")
    ended = old["retired"][: len(old["retired"]) - keep] if keep else old["retired"]
    gone = []
    for path in [p for step in ended for p in step]:
        for name in ("passages", "tokens", "postings", "gone", *(["vectors"] if f"{path}/vectors" not in old["vectors"] else [])):
            own, fs = _fs(spark, f"{path}/{name}")
            if fs.exists(own):
                fs.delete(own, True)
        gone.append(path)
    _swap(spark, folder, old | {"retired": old["retired"][len(ended) :]})
    return gone


class Index:
    """The current version of an index; refuses tables that do not fit their manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        found = manifest(spark, folder)
        if found is None:
            raise FileNotFoundError(f"no index in {folder}")
        self.manifest = found
        self.segments = found["segments"]
        self.passages = holding(_union(spark, self.segments, "passages"), self.segments)
        self.postings = _union(spark, self.segments, "postings")
        self.stats = spark.createDataFrame([(found["n"], found["avgdl"])], "n long, avgdl double")
        self.vectors = None
        if (n := self.passages.count()) != found["n"]:
            raise ValueError(f"the manifest counts {found['n']} passages, the table has {n}")
        if found["vectors"]:
            own = spark.read.parquet(*found["vectors"]).dropDuplicates(["emb"])
            self.vectors = self.passages.select("pid", "emb").join(own, "emb").select("pid", "vector")

    def bm25(self, questions: DataFrame, limit: int | None, drop_party_words: bool = False) -> DataFrame:
        """(qid, pid, score, rank); of the postings, only the questions' terms meet what later segments took out."""
        return S.bm25_scored(self.postings, self.stats, questions, limit, drop_party_words, lambda found: holding(found, self.segments))

    def ranking(self, questions: DataFrame, method: str = "hybrid", party_filter: bool = True, candidates: int = K.CANDIDATES) -> DataFrame:
        """The fused ranking of questions (qid, question[, qvector]) before any filter."""
        pool = None if party_filter else candidates
        if method != "bm25" and self.vectors is None:
            raise ValueError("this index has no vectors")
        lexical = self.bm25(questions, pool, party_filter) if method in ("hybrid", "bm25") else None
        dense = S.dense(self.vectors, questions.select("qid", "qvector"), pool) if method in ("hybrid", "vector") else None
        return S.fuse(lexical, dense)

    def search(self, questions: DataFrame, k: int = 8, method: str = "hybrid", layer: str | None = None, party: list[str] | None = None, per_party: int | None = None, candidates: int = K.CANDIDATES) -> DataFrame:
        """Fused hits of questions; filters follow the ranking, a party filter widens the pool, a cap holds for each party."""
        hits = S.filtered(self.ranking(questions, method, bool(party), candidates), self.passages, layer, party)
        return S.top(hits, k) if per_party is None else S.capped_shared(hits, per_party, k)


#: Indexes by folder, with the version that they were opened at.
_OPEN: dict[str, tuple[str, Index]] = {}


def opened(spark: SparkSession, folder: str) -> Index:
    """The index of a folder, opened anew only when a build has replaced its tables."""
    now = json.dumps(manifest(spark, folder), sort_keys=True)
    if _OPEN.get(folder, ("",))[0] != now:
        _OPEN[folder] = (now, Index(spark, folder))
    return _OPEN[folder][1]


def encoder(load: Callable[[], Callable[[list[str]], list]], prefix: str = "", batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """Turns (emb, text) into (emb, vector) by a model that each worker loads once; vectors get unit length.

    load() gives a function from texts to vectors; a question's encoder has the prefix "query: ".
    """

    def run(frames):
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = np.asarray(model([prefix + t for t in part["text"]]), float)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                yield pd.DataFrame({"emb": part["emb"], "vector": list(rows / np.where(norm > 0, norm, 1))})

    return lambda texts: texts.select("emb", "text").mapInPandas(run, "emb string, vector array<double>")
