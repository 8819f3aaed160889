"""The grading sheet and the report of an evaluation."""

import csv
import io
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer as A
from ..operators import evaluate as E

# The sheet's columns.
GRADES = ("supported", "attribution", "relevance", "neutral")
FIELDS = ("config", "id", "typ", "fraga", "answer", "sources", *GRADES, "notes")


def grading_rows(latest: DataFrame, graded: DataFrame | None = None) -> DataFrame:
    """The sheet's rows: answers without errors, with the source lines they cite; grades come over only to the very answer that was graded."""
    own = latest.where("error IS NULL").select("config", "id", "typ", "fraga", "answer", F.array_join(A.cited_sources(F.coalesce("sources", F.array().cast("array<string>")), F.col("answer")), "\n").alias("sources"))
    kept = (*GRADES, "notes")
    if graded is None:
        return own.select("*", *[F.lit(None).cast("string").alias(c) for c in kept])
    old = graded.select("config", "id", "answer", *kept).dropDuplicates(["config", "id", "answer"])
    return own.join(old, ["config", "id", "answer"], "left").select(*FIELDS)


def write_grading(rows: DataFrame, path: str, configs: list[str], ids: list[str]) -> int:
    """Writes the sheet as one CSV file with a byte order mark, row by row; returns the number of rows."""
    place = lambda names, c: F.coalesce(F.array_position(F.lit(names), F.col(c)), F.lit(0))
    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        sheet = csv.writer(out)
        sheet.writerow(FIELDS)
        for row in rows.select(*FIELDS).orderBy(place(configs, "config"), place(ids, "id"), "config", "id").toLocalIterator():
            sheet.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def means(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and count of each column at three grains in one pass: config, config and type, config and question."""
    aggs = [a for c in columns for a in (F.avg(c).alias(c), F.count(c).alias(f"n_{c}"))]
    own = metrics.groupingSets([["config"], ["config", "typ"], ["config", "typ", "id"]], "config", "typ", "id")
    return own.agg(F.grouping_id().alias("grain"), *aggs)


def markdown(table: DataFrame, digits: int = 3) -> str:
    """A report table; for aggregates, which have few rows."""
    out = io.StringIO()
    out.write("| " + " | ".join(table.columns) + " |\n|" + "-|" * len(table.columns) + "\n")
    for row in table.toLocalIterator():
        cells = ("–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|") for v in row)
        out.write("| " + " | ".join(cells) + " |\n")
    return out.getvalue()


# Rows of the overview: title, metric, and whether it is a share.
OVERVIEW = (
    ("Answered", "answered", True), ("API calls per question (mean)", "api_calls", False), ("Citations pointing to a retrieved passage", "citation_validity", True),
    ("Substantive sentences with a citation", "citation_coverage", True), ("Expected parties mentioned (comparative questions)", "party_mentioned", True),
    ("Expected parties backed by a cited passage (comparative)", "party_cited", True), ("Expected source type cited", "layer_cited", True),
    ("Attribution wording present (government / Tidö)", "attribution_found", True), ("Missing material acknowledged", "gap_acknowledged", True),
    ("Voting advice declined (refusal phrase)", "refused", True), ("Answer in the question's language", "language_ok", True),
)
COMPARATIVE = ("party_mentioned", "party_cited")
FIGURE = ("citation_coverage", "party_cited", "layer_cited", "gap_acknowledged", "refused", "language_ok")


def overview(metrics: DataFrame) -> DataFrame:
    """(config, typ, qid, grain, metric, value, n): means over the answers that a metric applies to, at three grains in one pass.

    Citation coverage is pooled over sentences; parties count for questions
    that expect several (`comparative`). metrics: answer_metrics with typ and comparative.
    """
    names = [m for _, m, _ in OVERVIEW if m != "citation_coverage"]
    applies = lambda m: F.when(F.col("comparative"), F.col(m)) if m in COMPARATIVE else F.col(m)
    own = metrics.select("config", "typ", "qid", "cited_claims", "claims", *[applies(m).cast("double").alias(m) for m in names])
    sums = [a for m in names for a in (F.avg(m).alias(m), F.count(m).alias(f"n_{m}"))]
    coverage = (F.sum("cited_claims") / F.sum("claims")).alias("citation_coverage")
    means = own.groupingSets([["config"], ["config", "typ"], ["config", "typ", "qid"]], "config", "typ", "qid")
    means = means.agg(F.grouping_id().alias("grain"), *sums, coverage, F.coalesce(F.sum("claims"), F.lit(0)).alias("n_citation_coverage"))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.col(f"n_{m}").cast("long").alias("n")) for _, m, _ in OVERVIEW]))
    return means.select("config", "typ", "qid", "grain", rows.alias("r")).select("config", "typ", "qid", "grain", "r.*").where("n > 0")


def cell(value: float, n: int, share: bool) -> str:
    return "—" if value is None else f"{value:.0%} ({n})" if share else f"{value:.1f} ({n})"


def report(metrics: DataFrame, latency: DataFrame, configs: list[str]) -> str:
    """The report's text: overview, by type and by question. It has a row for each metric, type and question, so it is read to the driver."""
    means = overview(metrics).collect()
    title = {m: (t, share) for t, m, share in OVERVIEW}
    at = {(r.config, r.grain, r.typ, r.qid, r.metric): cell(r.value, r.n, title[r.metric][1]) for r in means}
    times = {r["config"]: r for r in latency.collect()}
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    head = lambda cells: [line(cells), "|" + "---|" * len(cells)]
    out = ["# Answer evaluation", "", "## Overview", "", "Each cell is the mean over the questions the metric applies to, with that number in brackets.", "", *head(["Metric", *configs])]
    for name, key in (("Median latency (s)", "p50"), ("90th percentile latency (s)", "p90")):
        out.append(line([name, *(f"{times[c][key]:.1f}" if c in times else "—" for c in configs)]))
    for t, m, _ in OVERVIEW:
        cells = [at.get((c, 3, None, None, m), "—") for c in configs]
        out += [line([t, *cells])] if set(cells) != {"—"} else []
    out += ["", "## Per question type", ""]
    shown = [m for _, m, _ in OVERVIEW[3:]]
    for c in configs:
        out += [f"### {c}", "", *head(["Type", *shown])]
        out += [line([t, *(at.get((c, 1, t, None, m), "—") for m in shown)]) for t in sorted({r.typ for r in means if r.config == c and r.grain == 1})] + [""]
    out += ["## Per question", ""]
    flags = metrics.select("config", "typ", "qid", E.problem_flags(metrics).alias("flags")).orderBy("config", "qid").collect()
    for c in configs:
        out += [f"### {c}", "", *head(["Id", "Type", "Cited sentences", "Flags (automatic)"])]
        out += [line([r.qid, r.typ, at.get((c, 0, r.typ, r.qid, "citation_coverage"), "—"), r.flags or "ok"]) for r in flags if r.config == c] + [""]
    return "\n".join(out)


def share_figure(metrics: DataFrame, configs: list[str], width: int = 640) -> str:
    """Bars of the configs' shares as an SVG drawing."""
    at = {(r.metric, r.config): r.value for r in overview(metrics).where("grain = 3").collect()}
    title = {m: t for t, m, _ in OVERVIEW}
    grey = lambda i: f"hsl(210,45%,{35 + 50 * i // max(1, len(configs))}%)"
    parts, y = [], 20
    for m in FIGURE:
        parts.append(f'<text x="4" y="{y}" font-size="11">{escape(title[m])}</text>')
        for i, c in enumerate(configs):
            if (v := at.get((m, c))) is not None:
                parts.append(f'<rect x="4" y="{y + 4}" width="{max(1, v * (width - 150)):.0f}" height="9" fill="{grey(i)}"/><text x="{v * (width - 150) + 10:.0f}" y="{y + 12}" font-size="9">{escape(c)} {v:.0%}</text>')
                y += 12
        y += 18
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{y}">{"".join(parts)}</svg>'


def latency_figure(rows: DataFrame, configs: list[str], width: int = 640) -> str:
    """A dot where answers' seconds (config, latency_s) lie, and a line at each config's median, as an SVG drawing.

    Answers that fall on one point are one dot, so what comes to the driver is bounded by the width.
    """
    found = rows.where("latency_s IS NOT NULL")
    most = found.agg(F.max("latency_s")).first()[0] or 1.0
    x = lambda v: 90 + v / most * (width - 110)
    own = found.groupBy("config", F.round(F.col("latency_s") / most * (width - 110)).alias("at")).agg(F.min("latency_s").alias("latency_s")).collect()
    medians = {r["config"]: r["p50"] for r in E.latency(rows, "config", "latency_s").collect()}
    parts = []
    for i, c in enumerate(configs):
        y = 30 + 40 * i
        parts.append(f'<text x="4" y="{y + 4}" font-size="11">{escape(c)}</text>')
        parts += [f'<circle cx="{x(r.latency_s):.1f}" cy="{y}" r="3" fill="hsl(210,45%,50%)" fill-opacity="0.6"/>' for r in own if r.config == c]
        if c in medians:
            parts.append(f'<line x1="{x(medians[c]):.1f}" x2="{x(medians[c]):.1f}" y1="{y - 12}" y2="{y + 12}" stroke="black" stroke-width="2"/><text x="{x(medians[c]) + 4:.0f}" y="{y - 8}" font-size="9">median {medians[c]:.1f} s</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 40 * len(configs)}">{"".join(parts)}</svg>'


def hits_view(hits: list[dict]) -> str:
    """Hits as lines for a console: number, similarity, context and the text's beginning."""
    lines = (f"[{n}] {m['similarity']:.3f} {m['context']}\n    {' '.join(m['text'].split())[:200]}" if m.get("similarity") is not None else f"[{n}] {m['context']}\n    {' '.join(m['text'].split())[:200]}" for n, m in enumerate(hits, 1))
    return "\n".join(lines)


def answer_view(answer: str | None, info: dict, sources: list[str]) -> str:
    """An answer, what was done for it, and its sources, for a console."""
    head = " | ".join(f"{k} {v}" for k, v in info.items() if k not in ("searches",))
    return "\n".join([f"[{head}]", "", answer or "", "", "Sources:", *(f"  {s}" for s in sources)])
