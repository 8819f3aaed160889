"""WARC archives: revisit records, and an external merge of their indexes.

Writing: Spark's text sink with two CRLFs as line separator writes exactly the
records of a WARC/1.1 file, on any store that Spark can write. Payloads that
occur more than once and have at least `least` bytes are stored once, in the
record with the largest id; the others revisit it.

Reading: every archive file is parsed by its Content-Length headers and gives a
capture run, sorted locally by URL key and timestamp. Runs are written, then
range-partitioned by (URL key, timestamp, id) to ranges of about RANGE lines,
and a loser tree merges the k slices of each range: globally ordered capture
histories, without one task that sees everything.

Records are written by size class, and an archive holds so many of its class
that it has at most about FILE_BYTES (one record, if that is larger), as a task
reads an archive as one value. The largest class holds what one value can.

Defined results: a null payload is empty; a null URL has the key ""; null ids
are the smallest, and repeated ids with equal payloads are all responses if
that id is the largest. Other columns are not read; an empty table gives no
rows.
"""

import hashlib
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The capture time of id 0; others follow by a second each, where the table has no time.
EPOCH = 1704067200
LEAST, PER_FILE = 1000, 20_000
#: Bytes of an archive; lines of a merged range; upper ends of the size classes of payloads.
FILE_BYTES, RANGE = 64 << 20, 200_000
CLASSES = (4 << 10, 64 << 10, 1 << 20, 16 << 20)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time: Column | None = None, least: int = LEAST) -> DataFrame:
    """(bytes, value): a WARC record without its closing CRLFs, and its payload's size."""
    time = time if time is not None else F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col(id_col), F.lit(0)))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    raw = F.col("payload").cast("binary")
    own = own.withColumn("bytes", F.octet_length("payload")).withColumn("digest", F.sha1(raw))
    keyed = own.select("id", "bytes", "digest").where(F.col("bytes") >= least)
    # written, so that its size is known: a small one is broadcast, and payloads are shuffled only for a large one
    first = keyed.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    first = written(first, "repeated")
    own = own.join(first, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    revisit = F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:capture:"), F.coalesce(F.col("id").cast("string"), F.lit("")),
        F.lit(f">{CRLF}WARC-Date: "), F.col("date"),
        F.lit(f"{CRLF}WARC-Target-URI: "), F.translate("url", "\r\n", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{CRLF}X-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: <urn:capture:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(body).cast("string"),
        F.lit(CRLF * 2),
    )
    return own.select("bytes", F.concat(header, body).alias("value"))


def write_archives(pages: DataFrame, path: str, per_file: int = PER_FILE, payload_col: str = "html", **columns) -> None:
    size = F.octet_length(F.coalesce(F.col(payload_col), F.lit("")))
    nth = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        nth = F.when(size <= most, i).otherwise(nth)
    own = records(pages, payload_col=payload_col, **columns)
    ends = (-1, *CLASSES, None)
    for i in sorted(r[0] for r in pages.select(nth.alias("c")).distinct().collect()):
        low, high = ends[i], ends[i + 1]
        part = own.where((F.col("bytes") > low) & (F.lit(True) if high is None else F.col("bytes") <= high))
        most = 1 if high is None else max(1, min(per_file, FILE_BYTES // high))
        part.select("value").write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then path and query."""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


HEADER = re.compile(rb"([^:\r\n]+): ([^\r\n]*)")
FIELDS = ("run", "url_key", "timestamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "length")
SCHEMA = "run string, url_key string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def parse(content: bytes):
    """The records of an archive: headers, block, offset, length."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        head = {k.decode(): v.decode("utf-8") for k, v in HEADER.findall(content, at, end)}
        start = end + 4
        stop = start + int(head["Content-Length"])
        if content[at : at + 8] != b"WARC/1.1" or content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        yield head, memoryview(content)[start:stop], at, stop + 4 - at
        at = stop + 4


def _id(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:capture:") : -1]
    return int(digits) if digits else None


def capture(run: str, head: dict, block, offset: int, length: int) -> tuple:
    """An index line. A response's payload is measured; a revisit has its figures from the header."""
    kind = head["WARC-Type"]
    if kind == "response":
        payload = block[bytes(block[:200]).index(b"\r\n\r\n") + 4 :]
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != head["WARC-Payload-Digest"][5:].lower():
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    else:
        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:].lower()
    return (run, url_key(head["WARC-Target-URI"]), head["WARC-Date"], _id(head["WARC-Record-ID"]), size, digest, kind, _id(head.get("WARC-Refers-To")), offset, length)


def order(line: tuple):
    """URL key (by UTF-8 bytes, as Spark compares), timestamp, id."""
    return line[1].encode(), line[2], line[3] is not None, line[3] or 0


def _batch(lines: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), TYPES)] if lines else [pa.array([], t) for t in TYPES], names=list(FIELDS))


def _runs(batches):
    """A sorted run of index lines for each archive file."""
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            run = name.rsplit("/", 1)[-1]
            lines = sorted((capture(run, *r) for r in parse(content.as_py())), key=order)
            for at in range(0, len(lines), 10_000):
                yield _batch(lines[at : at + 10_000])


def loser_tree_merge(runs: list[list], key=order):
    """Merges sorted lists. Inner nodes hold the loser of their match; the winner replays one path a step."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    end = (1,)

    def head(r):
        return (0, key(runs[r][at[r]]), r) if at[r] < len(runs[r]) else end

    heads = [head(r) for r in range(k)]
    losers = [-1] * k

    def play(node):
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
        return winner

    winner = play(1) if k > 1 else 0
    while heads[winner] != end:
        yield runs[winner][at[winner]]
        at[winner] += 1
        heads[winner] = head(winner)
        node = (winner + k) // 2
        while node:
            if heads[losers[node]] < heads[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2


def _merged(batches):
    """Merges the slices of a key range; a run that arrives in several pieces out of order is sorted first."""
    runs: dict[str, list] = {}
    for batch in batches:
        for line in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(line[0], []).append(line)
    lists = [own if all(order(a) <= order(b) for a, b in zip(own, own[1:])) else sorted(own, key=order) for own in runs.values()]
    out = []
    for line in loser_tree_merge(lists):
        out.append(line)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index lines, a sorted run for each archive below the path; none where nothing was written."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs, SCHEMA)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Partitions in order, each in order: read in partition order, the global capture history. runs: a written table, as it is read for its ranges first."""
    ranges = max(1, -(-runs.count() // RANGE), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return runs.repartitionByRange(ranges, F.col("url_key"), F.col("timestamp"), F.col("page_id")).mapInArrow(_merged, SCHEMA)


def capture_index(pages: DataFrame, **columns) -> DataFrame:
    """Writes archives into the shared folder and reads them back as one merged index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    if pages.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    write_archives(pages, path, **columns)
    return merge_runs(written(read_runs(spark, path), "runs"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to FROM f
"""
