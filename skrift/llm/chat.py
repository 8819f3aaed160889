"""Chat formatting of reply trees.

Messages (conversation, message, parent, role, text, score) form trees.
Iterative self-joins by pointer doubling give each message its depth, root and
score from the root, in as many rounds as the depth has binary digits; leaves
are root-to-leaf paths, ranked by score within their conversation. The chosen
paths' messages are enumerated by self-joins that double the covered depth, and
each path is formatted as one conversation.

Template: `<s>[ROLE] role [/ROLE] text </s>` and a line feed per turn. Within
roles and texts, a control string gets a backslash before it, and before the
backslashes that already precede one, so reading back removes exactly one.
Template marks stand after a blank or line feed, never after a backslash. Loss
spans cover the texts of assistant turns.

Defined results: null texts and roles are empty; a missing parent makes a root;
messages on a cycle are on no path. Of messages that repeat an id within a
conversation, the one with the smallest parent (null first), role, text and score
counts. A message without an id is one that nothing replies to; ids are read as
strings, and a leaf without one has a made-up name. A conversation without a
message gives no row. In linear(), a conversation is one path ordered by turn (nulls first), and
ties by role, then text. Columns other than the named ones are not read.
"""

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .spans import running

#: Fixed control strings of the template, and common ones of others.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ANY = "|".join(re.escape(c) for c in CONTROLS)
_JAVA = "|".join(r"\Q" + c + r"\E" for c in CONTROLS)
UNESCAPE = re.compile(rf"\\(\\*(?:{_ANY}))")
TURN = re.compile(r"<s>\[ROLE\] (.*?) \[/ROLE\] (.*?) </s>\n", re.S)
LOSS_ROLE = "assistant"


def escaped(text):
    """The texts of a column with control strings escaped."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<!\\)(\\*(?:{_JAVA}))", r"\\$1")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the offsets are those of the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def doubled(messages: DataFrame) -> DataFrame:
    """messages (conv, id, parent, score, ...) with root, depth and total (score of the path from the root)."""
    known = messages.select(F.col("conv").alias("pc"), F.col("id").alias("pid"))
    own = messages.join(known, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("parent") == F.col("pid")), "left")
    # up: the ancestor reached so far, null beyond the root; top: the topmost message seen
    state = own.select("conv", "id", F.col("pid").alias("up"), F.coalesce("pid", "id").alias("top"), F.when(F.col("pid").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total"))
    state = written(state, "tree")
    done, live, last = state.where("up IS NULL"), state.where("up IS NOT NULL"), -1
    # only messages that have not reached their root go on; those on a cycle never do
    while (left := live.count()) and left != last:
        a = live.unionByName(done).select(*[F.col(c).alias(f"a_{c}") for c in live.columns])
        step = live.join(a, F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("up") == F.col("a_id")))
        step = step.select("conv", "id", F.col("a_up").alias("up"), F.col("a_top").alias("top"), (F.col("depth") + F.col("a_depth")).alias("depth"), (F.col("total") + F.col("a_total")).alias("total"))
        step = written(step, "tree")
        done, live, last = done.unionByName(step.where("up IS NULL")), step.where("up IS NOT NULL"), left
    return done.drop("up").withColumnRenamed("top", "root")


def best_paths(messages: DataFrame, most: int | None = None) -> DataFrame:
    """(conv, leaf, rank, id, place): the messages of each chosen root-to-leaf path, root first.

    Paths are ranked by mean score, then length, then leaf; `most` keeps that many a conversation.
    """
    tree = doubled(messages)
    inner = messages.where("parent IS NOT NULL").select(F.col("conv").alias("ic"), F.col("parent").alias("iid")).distinct()
    leaves = tree.join(inner, F.col("conv").eqNullSafe(F.col("ic")) & (F.col("id") == F.col("iid")), "left_anti")
    by = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / (F.col("depth") + 1)), F.desc("depth"), "id")
    leaves = leaves.withColumn("rank", F.row_number().over(by))
    if most is not None:
        leaves = leaves.where(F.col("rank") <= most)
    parents = messages.select("conv", "id", "parent")
    paths = leaves.select("conv", F.col("id").alias("leaf"), "rank", "id", F.col("depth").alias("place"))
    # jump tables: the ancestor 2^i above; each round doubles how much of a path is there
    jump = written(parents.select(F.col("conv").alias("jc"), F.col("id").alias("jid"), F.col("parent").alias("to")), "jump")
    reach, deepest = 1, leaves.agg(F.max("depth")).first()[0] or 0
    paths = written(paths, "paths")
    while reach <= deepest:
        more = paths.join(jump, F.col("conv").eqNullSafe(F.col("jc")) & (F.col("id") == F.col("jid"))).where(F.col("to").isNotNull() & (F.col("place") >= reach))
        more = more.select("conv", "leaf", "rank", F.col("to").alias("id"), (F.col("place") - reach).alias("place"))
        paths = written(paths.unionAll(more), "paths")
        onward = jump.select(F.col("jc").alias("kc"), F.col("jid").alias("kid"), F.col("to").alias("kto"))
        jump = written(jump.join(onward, F.col("jc").eqNullSafe(F.col("kc")) & (F.col("to") == F.col("kid"))).select("jc", "jid", F.col("kto").alias("to")), "jump")
        reach *= 2
    return paths


def formatted(messages: DataFrame, most: int | None = None, unique: bool = False) -> DataFrame:
    """(conv, leaf, rank, formatted, loss): one row per chosen path; loss holds [start, end) of each span.

    unique: no id is repeated within a conversation, so none has to be looked for.
    """
    if not unique:
        # what has no id is written once under one of its own, which no reply names
        own = F.when(F.col("id").isNull(), F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("id").cast("string"))
        messages = written(messages.select("conv", own.alias("id"), F.col("parent").cast("string").alias("parent"), "role", "text", "score"), "named")
        one = messages.groupBy("conv", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        messages = written(one.select("conv", "id", "m.*"), "messages")
    paths = best_paths(messages.select("conv", "id", "parent", "score"), most)
    piece = F.concat(F.lit("<s>[ROLE] "), escaped(F.col("role")), F.lit(" [/ROLE] "), escaped(F.col("text")), F.lit(" </s>\n"))
    head = F.length(F.concat(F.lit("<s>[ROLE] "), escaped(F.col("role")), F.lit(" [/ROLE] ")))
    pieces = messages.select(F.col("conv").alias("mc"), F.col("id").alias("mid"), piece.alias("piece"), head.alias("head"), F.length(escaped(F.col("text"))).alias("chars"), (F.col("role") == LOSS_ROLE).alias("loss"))
    joined = paths.join(pieces, F.col("conv").eqNullSafe(F.col("mc")) & (F.col("id") == F.col("mid")))
    turn = F.struct("place", "piece", "head", "chars", "loss")
    whole = joined.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    ends = running(F.transform("turns", lambda t: F.length(t["piece"])))
    start = lambda t, e: e - F.length(t["piece"]) + t["head"]
    spans = F.zip_with("turns", ends, lambda t, e: F.struct(t["loss"].alias("loss"), start(t, e).alias("start"), (start(t, e) + t["chars"]).alias("end")))
    loss = F.transform(F.filter(spans, lambda x: F.coalesce(x["loss"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return whole.select("conv", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def linear(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations that have no branches: each replies to the one before it."""
    by = Window.partitionBy("conv").orderBy("turn", "role", "text")
    own = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    own = own.withColumn("n", F.row_number().over(by))
    parent = F.when(F.col("n") > 1, (F.col("n") - 1).cast("string"))
    return own.select("conv", F.col("n").cast("string").alias("id"), parent.alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(paths: DataFrame) -> DataFrame:
    """Figures of formatted conversations, read back from the formatted text and its loss mask."""

    def read(frames):
        for frame in frames:
            out = []
            for conv, text, loss in zip(frame.conv, frame.formatted, frame.loss):
                turns = read_back(text)
                spans = [unescape(text[x["start"] : x["end"]]) for x in loss]
                whole = "".join(f"{r}\n{t}\n" for r, t, _, _ in turns)
                learnt = "".join(spans)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return paths.mapInPandas(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _oracle() -> str:
    controls = "|".join(re.escape(c).replace("'", "''") for c in CONTROLS)
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(role, '(\\*({controls}))', '\\\1', 'g')) + length(regexp_replace(text, '(\\*({controls}))', '\\\1', 'g')) + 25 AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


ORACLE = _oracle()
