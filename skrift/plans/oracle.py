"""SQL that checks the queries, for DuckDB over the same tables."""

from .. import constants as K
from ..operators import sections as X
from ..sources import programs as P


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + "]"


def tok(text: str, drop=()) -> str:
    stops = _list((*K.STOPWORDS, *drop))
    stem = f"^(.{{{K.MIN_STEM},}}?)(?:{'|'.join(K.SUFFIXES)})$"
    return f"list_transform(list_filter(list_transform(regexp_extract_all({text}, '{K.WORD}'), lambda x: lower(x)), lambda x: NOT list_contains({stops}, x)), lambda x: regexp_replace(x, '{stem}', '\\1'))"


CORPUS = "c AS (SELECT doc_id AS pid, lang AS layer, source AS party, source || ' (' || lang || ')' AS context, text FROM documents)"
LISTS = f"{CORPUS}, l AS (SELECT pid, tokens, len(tokens) AS dl FROM (SELECT pid, {tok("context || ' ' || text || ' '")} AS tokens FROM c))"
STATS = "st AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM l)"
POST = "po AS (SELECT term, pid, dl, count(*) AS tf FROM (SELECT pid, dl, unnest(tokens) AS term FROM l) GROUP BY ALL)"
DF = "df AS (SELECT term, count(*) AS df FROM po GROUP BY term)"


def bm25(drop=(), limit: str = "rank <= 10", name: str = "b", source: str = "benchmark") -> str:
    return f"""{LISTS}, {STATS}, {POST}, {DF},
q0 AS (SELECT item_id AS qid, {tok("text", drop)} AS t FROM {source}),
qt AS (SELECT qid, term, count(*) AS qtf, min(pos) AS qpos FROM (SELECT qid, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM q0) GROUP BY ALL),
bs AS (SELECT qid, pid, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, min(qpos) AS qpos
       FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY qid, pid),
{name} AS (SELECT * FROM (SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, qpos, pid) AS INT) AS rank FROM bs) WHERE {limit})"""


VEC = "d AS (SELECT vec_id AS pid, embedding AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)), qv AS (SELECT item_id AS qid, embedding AS q FROM benchmark JOIN embeddings ON item_id = vec_id)"
DOT = "list_dot_product(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[]))"


def dense(limit: str = "rank <= 10") -> str:
    return f"{VEC}, ds AS (SELECT qid, pid, {DOT} AS score FROM d, qv), ve AS (SELECT * FROM (SELECT qid, pid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, pid) AS INT) AS rank FROM ds) WHERE {limit})"


def hybrid(weight: float = K.WEIGHT_BM25, pool: str = f"rank <= {K.CANDIDATES}", drop=()) -> str:
    return f"""{bm25(drop, pool, source="(SELECT * FROM benchmark WHERE item_id IN (SELECT vec_id FROM embeddings))")}, {dense(pool)},
u AS (SELECT qid, pid, {weight} / (60 + rank) AS part, rank AS lr, CAST(NULL AS INT) AS vr, CAST(NULL AS DOUBLE) AS sim FROM b UNION ALL SELECT qid, pid, 1.0::DOUBLE / (60 + rank), NULL, rank, score FROM ve),
h0 AS (SELECT qid, pid, sum(part) AS score, max(lr) AS lr, max(vr) AS vr, max(sim) AS similarity FROM u GROUP BY qid, pid),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, lr NULLS LAST, vr NULLS LAST, pid) AS INT) AS rank FROM h0)"""


TOP = "CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT)"
POLITICAL = """pol AS (SELECT *, party || ' (' || layer || ')' AS kontext, layer = 'motion' AND CASE pid % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE pid % 2 = 0 END AS single,
  CASE WHEN pid % 2 = 0 THEN 'A B' ELSE 'A B, C D' END AS signers, CASE WHEN pid % 7 = 0 THEN 'ftp://' ELSE 'https://' END || 'p.se/' || pid % 50 AS url FROM (
  SELECT doc_id AS pid, text, CASE lang WHEN 'fr' THEN 'motion' WHEN 'de' THEN 'program' WHEN 'es' THEN 'proposition' ELSE 'said' END AS layer,
  CASE WHEN lang = 'es' THEN 'M;KD;L' ELSE ['S', 'M', 'SD', 'C', 'V', 'KD', 'MP', 'L'][CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 8 + 1] END AS party FROM documents))"""
SLOTS = "sl AS (SELECT * FROM (VALUES (0,'S','program',1),(1,'S','motion',2),(2,'S','said',1),(3,'M','program',1),(4,'M','motion',2),(5,'M','proposition',2),(6,'M','said',1),(7,'KD','program',1),(8,'KD','motion',2),(9,'KD','proposition',2),(10,'KD','said',1)) t(slot, s_party, s_layer, n))"
FILLED = f"""{hybrid(pool='true', drop=K.PARTY_WORDS)}, {POLITICAL}, {SLOTS},
ca AS (SELECT * FROM (SELECT h.*, pol.layer, single, slot, s_party, s_layer, n, row_number() OVER (PARTITION BY qid, slot ORDER BY rank) AS pos FROM h JOIN pol USING (pid) JOIN sl ON list_contains(string_split(pol.party, ';'), s_party) AND pol.layer = s_layer) WHERE pos <= n + 20),
re AS (SELECT * FROM (SELECT *, max(similarity) OVER (PARTITION BY qid, layer) AS best FROM ca) WHERE similarity IS NULL OR similarity >= greatest(-0.2, best - 0.3)),
f0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, slot ORDER BY pos) AS k FROM re WHERE NOT single AND slot <> 9) WHERE k <= n),
f9 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, slot ORDER BY pos) AS k FROM re WHERE slot = 9 AND NOT EXISTS (SELECT 1 FROM f0 WHERE f0.qid = re.qid AND f0.pid = re.pid)) WHERE k <= n),
fi AS (SELECT * FROM f0 UNION ALL SELECT * FROM f9)"""
SHOWN = f"""{bm25(limit='rank <= 6').replace(CORPUS, f"{POLITICAL}, c AS (SELECT pid, layer, party, kontext AS context, text FROM pol)")}, {dense('rank <= 6')},
two AS (SELECT qid, pid, 0 AS call, rank FROM b UNION ALL SELECT qid, pid, 1, rank FROM ve),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, pid ORDER BY call, rank) AS k FROM two) WHERE k = 1),
sh AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY call, rank) AS INT) AS n, CAST(call AS INT) AS call, pid, pol.* EXCLUDE (pid) FROM one JOIN pol USING (pid))"""
STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def sentences(text: str) -> str:
    """A list of the sentences of a text."""
    lines = f"list_transform(string_split_regex({text}, '\\r\\n|\\r|\\n'), lambda x: {STRIPPED.format('x')})"
    lines = f"list_filter({lines}, lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT ends_with(x, ':') AND NOT (starts_with(x, '**') AND ends_with(x, '**')))"
    clean = f"regexp_replace(regexp_replace(x, '{K.LIST_MARKER}', ''), '{K.TRAILING_CITATIONS}', '\\2\\1', 'g')"
    parts = f"flatten(list_transform({lines}, lambda x: string_split(regexp_replace({clean}, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31))))"
    return f"list_filter({parts}, lambda x: x <> '')"


def names(text: str, code: str) -> str:
    """Does a text name a party?"""
    return f"regexp_matches(' ' || {text} || ' ', '{K.PARTY_NAMES_IN_ANSWERS[code]}|[^\\p{{L}}\\p{{N}}_-]{code}[^\\p{{L}}\\p{{N}}_-]')"


def language(text: str) -> str:
    count = lambda words: f"len(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: list_contains({_list(words)}, x)))"
    return f"CASE WHEN {count(K.ENGLISH)} > {count(K.SWEDISH)} THEN 'en' ELSE 'sv' END"


def match_words(text: str) -> str:
    """The distinct stems that proposals and sections are matched by."""
    stem = f"^(.{{{K.MIN_STEM},}}?)(?:{'|'.join(K.SUFFIXES)})$"
    words = f"list_filter(list_transform(regexp_extract_all({text}, '{K.MATCH_WORD}'), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains({_list(K.MATCH_STOPWORDS)}, x))"
    return f"list_distinct(list_transform({words}, lambda x: regexp_replace(x, '{stem}', '\\1')))"


#: Folds over lists of a state: pieces that are done, and the text that is held.
PIECES = rf"""
p0 AS (SELECT doc_id AS pid, {STRIPPED.format('text')} AS t FROM documents),
p1 AS (SELECT pid, t, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') AS paras FROM p0 WHERE length(t) > 1200),
p2 AS (SELECT pid, nr, para FROM (SELECT pid, unnest(paras) AS para, unnest(range(len(paras))) AS nr FROM p1)),
p3 AS (SELECT pid, nr, para, list_transform(string_split(regexp_replace(para, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: {{'done': []::VARCHAR[], 'held': x}}) AS s FROM p2),
p4 AS (SELECT pid, nr, CASE WHEN length(para) <= 1200 THEN [para] ELSE f.done || CASE WHEN f.held <> '' THEN [f.held] ELSE [] END END AS parts FROM (
  SELECT pid, nr, para, list_reduce([{{'done': []::VARCHAR[], 'held': ''}}] || s, lambda a, x: CASE
    WHEN length(x.held) > 1200 THEN {{'done': a.done || CASE WHEN a.held <> '' THEN [a.held] ELSE [] END || list_transform(range(CAST(ceil((length(x.held) - 1200) / 1050.0) AS BIGINT)), lambda i: substr(x.held, i * 1050 + 1, 1200)),
                                     'held': trim(substr(x.held, CAST(ceil((length(x.held) - 1200) / 1050.0) AS BIGINT) * 1050 + 1))}}
    WHEN a.held <> '' AND length(a.held) + length(x.held) + 1 > 1200 THEN {{'done': a.done || [a.held], 'held': x.held}}
    ELSE {{'done': a.done, 'held': trim(a.held || ' ' || x.held)}} END) AS f FROM p3)),
p5 AS (SELECT pid, flatten(list(parts ORDER BY nr)) AS parts FROM p4 GROUP BY pid),
p6 AS (SELECT pid, f.done || [f.held] AS pieces FROM (
  SELECT pid, list_reduce([{{'done': []::VARCHAR[], 'held': ''}}] || list_transform(parts, lambda x: {{'done': []::VARCHAR[], 'held': x}}), lambda a, x: CASE
    WHEN a.held = '' THEN {{'done': a.done, 'held': x.held}}
    WHEN length(a.held) + length(x.held) + 2 > 1200 THEN {{'done': a.done || [a.held], 'held': x.held}}
    ELSE {{'done': a.done, 'held': a.held || chr(10) || chr(10) || x.held}} END) AS f FROM p5)),
p7 AS (SELECT pid, i, pieces[i] AS own, right(pieces[i - 1], 150) AS tail FROM (SELECT pid, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM p6)),
p8 AS (SELECT pid, i - 1 AS i, CASE WHEN i > 1 AND contains(tail, ' ') THEN {STRIPPED.format("substr(tail, strpos(tail, ' ') + 1) || ' ' || own")} ELSE own END AS piece FROM p7
  UNION ALL SELECT pid, 0, t FROM p0 WHERE t <> '' AND length(t) <= 1200)"""
METRICS = rf"""
m0 AS (SELECT conv_id || '-' || turn AS qid, CASE WHEN conv_id % 5 = 0 THEN 'no_rag' ELSE 'rag_tools' END AS config, turn % 4 AS nth, conv_id,
  text || CASE turn % 4 WHEN 1 THEN ' Moderaterna vill sänka skatten för alla [1] och [7].' WHEN 3 THEN ' Det saknas material [2].' ELSE '' END AS answer FROM conversations WHERE role = 'assistant'),
m AS (SELECT qid, config, nth, NOT starts_with(answer, '[no answer') AS answered, CASE WHEN config <> 'no_rag' THEN CASE nth WHEN 1 THEN 0.5 WHEN 3 THEN 1.0 END END AS citation_validity,
  CASE WHEN conv_id % 2 = 1 THEN (CAST({names('answer', 'M')} AS INT) + CAST({names('answer', 'V')} AS INT)) / 2.0 END AS party_mentioned,
  CASE WHEN conv_id % 2 = 1 THEN CASE WHEN nth IN (1, 3) THEN 0.5 ELSE 0.0 END END AS party_cited, CASE WHEN conv_id % 2 = 1 THEN nth = 3 END AS layer_cited,
  CASE WHEN conv_id % 3 = 0 THEN regexp_matches(answer, '(?i)REGERINGEN|moderaterna') END AS attribution_found,
  CASE WHEN conv_id % 4 = 0 THEN regexp_matches(answer, '(?i){K.GAP}') END AS gap_acknowledged, CASE WHEN conv_id % 4 = 1 THEN regexp_matches(answer, '(?i){K.REFUSAL}') END AS refused,
  {language('answer')} = 'sv' AS language_ok, CASE WHEN conv_id % 2 = 1 THEN CASE nth WHEN 1 THEN 'V' WHEN 3 THEN 'M' ELSE 'M,V' END END AS missing FROM m0)"""
JUDGED = f"""{bm25()}, j AS (SELECT b.*, party, context, coalesce(quality = 1 AND toxic = 0, false) AND layer = 'en' AS flag FROM b JOIN c USING (pid) LEFT JOIN labels ON pid = labels.doc_id),
pm AS (SELECT qid, avg(CAST(flag AS INT)) AS p, coalesce(max(CASE WHEN flag THEN 1.0 / rank END), 0) AS m, count(*) FILTER (NOT flag) AS false_hits, arg_min(context, rank) AS top_context FROM j GROUP BY qid)"""
NUMBERED = f"{bm25()}, nu AS (SELECT qid, rank AS n, pid, layer, context, party AS source, text FROM b JOIN c USING (pid))"
URLS = "p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)"
SHOW = "qid, pid, round(score, 6) AS score"


def unescaped(text: str) -> str:
    """The character references that the pages have; of doubled ones, one."""
    for name, mark in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{mark}', 'g')"
    return text


def cleaned(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, chr(173), '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


#: Blocks of text: marks for edges of blocks, for a heading, and for parts that are not the page's own.
BLOCKS = rf"""
h0 AS (SELECT page_id, {cleaned(unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
  regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '(?s)<title>.*?</title>|</?(?:p|div|article|br|body|head)(?: [^>]*)?>', chr(30), 'g') AS t FROM pages),
h1 AS (SELECT page_id, title, regexp_replace(regexp_replace(replace(replace(t, '<h1>', chr(30) || chr(28)), '</h1>', chr(30)), '(?s)<nav>.*?</nav>|<footer>.*?</footer>', chr(30) || chr(29) || chr(30), 'g'), '<[^>]*>', '', 'g') AS t FROM h0),
h2 AS (SELECT page_id, title, p, starts_with(p, chr(28)) AS heads, p = chr(29) AS skipped, i FROM (SELECT page_id, title, unnest(string_split(t, chr(30))) AS p, generate_subscripts(string_split(t, chr(30)), 1) AS i FROM h1)),
h3 AS (SELECT *, CASE WHEN skipped THEN 0 ELSE len(string_split(text, ' ')) END AS words FROM (SELECT * EXCLUDE (p), {cleaned(unescaped("replace(p, chr(28), '')"))} AS text FROM h2) WHERE text <> ''),
h4 AS (SELECT *, NOT skipped AND coalesce(lag(words) OVER o, 0) + 2 * words + coalesce(lead(words) OVER o, 0) >= 40 AS dense FROM h3 WINDOW o AS (PARTITION BY page_id ORDER BY i)),
bl AS (SELECT *, dense OR (heads AND NOT skipped AND coalesce(lead(dense) OVER (PARTITION BY page_id ORDER BY i), false)) AS main FROM h4),
mt AS (SELECT page_id, title, coalesce(string_agg(text, chr(10) ORDER BY i) FILTER (main), '') AS text FROM bl GROUP BY page_id, title)"""
MOTIONS = rf"""
m0 AS (SELECT page_id, list_transform(regexp_extract_all(html, '<p>([^<]+)</p>', 1), lambda x: {unescaped('x')}) AS body, list_transform(regexp_extract_all(html, '<p>([^<]+)</p>', 1), lambda x: {unescaped("string_split(x, '. ')[1]")}) AS ask FROM pages),
m1 AS (SELECT page_id, i, {cleaned('b')} AS body, {cleaned('a')} AS ask FROM (SELECT page_id, unnest(body) AS b, unnest(ask) AS a, generate_subscripts(ask, 1) AS i FROM m0)),
mq AS (SELECT page_id, ask AS text, {match_words('ask')} AS y, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nr FROM m1 WHERE ask <> ''),
ms AS (SELECT page_id, i, body, {match_words('body')} AS s FROM m1),
mm AS (SELECT mq.page_id, nr, text, i, body, CASE WHEN len(y) > 0 THEN len(list_intersect(y, s)) / CAST(len(y) AS DOUBLE) ELSE 0 END AS score FROM mq JOIN ms USING (page_id)),
mb AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY page_id, nr ORDER BY score DESC, i) = 1)"""
BILLS = rf"""
b0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') AS own FROM documents),
b1 AS (SELECT doc_id, list_filter(own, lambda x: NOT regexp_full_match(x, '{X.NOISE[1:-1]}')) AS lines FROM b0 WHERE len(own) > 0),
b2 AS (SELECT doc_id, list_reduce([{{'done': []::VARCHAR[], 'held': NULL::VARCHAR}}] || list_transform(lines, lambda x: {{'done': []::VARCHAR[], 'held': x}}), lambda a, x: CASE
    WHEN a.held IS NULL THEN {{'done': a.done, 'held': x.held}}
    WHEN NOT regexp_matches(a.held, '[.!?:]$') AND (length(a.held) >= 90 OR regexp_matches(x.held, '^\p{{Ll}}') OR regexp_matches(a.held, '[,–-]$')) THEN {{'done': a.done, 'held': a.held || ' ' || x.held}}
    ELSE {{'done': a.done || [a.held], 'held': x.held}} END) AS f FROM b1),
b3 AS (SELECT doc_id, array_to_string(list_transform(CASE WHEN f.held IS NULL THEN [] ELSE f.done || [f.held] END, lambda p: regexp_replace(p, '([\p{{L}}\p{{N}}_])- ([a-zåäö])', '\1\2', 'g')), chr(10) || chr(10)) AS text FROM b2)"""

PROGRAMS = rf"""
g0 AS (SELECT doc_id, text, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') AS p FROM documents)),
g1 AS (SELECT doc_id, i // 12 + 1 AS page, i % 12 // 4 AS block, i % 4 AS line, k, {STRIPPED.format("CASE k WHEN 0 THEN left(x, 40) WHEN 1 THEN (i % 9 + 1) || '.1 ' || left(x, 30) WHEN 2 THEN 'M' WHEN 3 THEN '12' WHEN 4 THEN left(x, 100) ELSE x END")} AS text FROM (SELECT *, (doc_id + i * 7) % 11 AS k FROM g0)
  UNION ALL SELECT doc_id, 1000000, 0, 0, 10, {STRIPPED.format("'Slut ' || regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')")} FROM documents WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]')),
g2 AS (SELECT *, CASE WHEN k = 3 OR regexp_matches(text, '{P.NOISE.replace("(?iu)", "(?i)")}') THEN 'skip' WHEN k = 2 THEN 'dropcap' WHEN NOT regexp_matches(text, '{P.LETTERS}') THEN 'skip' WHEN k IN (0, 4) OR regexp_matches(text, '{P.NUMBERED}') THEN 'heading' ELSE 'body' END AS style FROM g1),
g3 AS (SELECT * FROM g2 WHERE style <> 'skip' WINDOW page AS (PARTITION BY doc_id, page) QUALIFY NOT (bool_or(regexp_matches(text, '{P.CONTENTS.replace("(?iu)", "(?i)")}')) OVER page OR (count(*) FILTER (style = 'heading') OVER page >= {P.CONTENTS_HEADINGS} AND coalesce(sum(length(text)) FILTER (style = 'body') OVER page, 0) < {P.CONTENTS_CHARS}))),
g4 AS (SELECT *, CAST(style IS DISTINCT FROM lag(style) OVER o AS INT) AS turn FROM g3 WHERE style <> 'dropcap' WINDOW o AS (PARTITION BY doc_id, page, block ORDER BY line)),
g5 AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id, page, block ORDER BY line) AS run FROM g4),
g6 AS (SELECT doc_id, page, block, run, style, list(text ORDER BY line) AS lines, array_to_string(list(text ORDER BY line), ' ') AS whole, min(line) AS line, count(*) OVER (PARTITION BY doc_id, page, block) AS runs FROM g5 GROUP BY doc_id, page, block, run, style),
g7 AS (SELECT *, style = 'heading' AND length(whole) BETWEEN 2 AND {P.LONGEST_HEADING} AND regexp_matches(whole, '^[\p{{Lu}}\p{{Nd}}]') AND regexp_matches(whole, '{P.LETTERS}') AND (NOT ends_with(whole, '.') OR regexp_matches(whole, '{P.NUMBERED}')) AS head FROM g6),
g8 AS (SELECT *, sum(CAST(head OR coalesce(before, false) AS INT)) OVER (PARTITION BY doc_id, page, block ORDER BY run) AS seq FROM (SELECT *, lag(head) OVER (PARTITION BY doc_id, page, block ORDER BY run) AS before FROM g7 WHERE NOT (runs = 1 AND style = 'heading' AND NOT head))),
g9 AS (SELECT doc_id, page, block, seq, head, CASE WHEN head THEN any_value(whole) ELSE list_reduce([''] || flatten(list(lines ORDER BY run)), lambda a, x: CASE WHEN a = '' THEN x WHEN ends_with(a, '-') AND regexp_matches(x, '^\p{{Ll}}') AND NOT regexp_matches(x, '^(och|eller) ') THEN a[:-2] || x ELSE a || ' ' || x END) END AS text FROM g8 GROUP BY doc_id, page, block, seq, head),
ga AS (SELECT doc_id, page, block, seq, CASE WHEN head THEN 'heading' ELSE 'paragraph' END AS kind, text FROM g9 UNION ALL SELECT doc_id, page, block, -1, 'dropcap', 'M' FROM g3 WHERE style = 'dropcap' GROUP BY doc_id, page, block),
gb AS (SELECT *, coalesce(count(*) FILTER (kind = 'paragraph') OVER (PARTITION BY doc_id ORDER BY page, block, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM ga),
gc AS (SELECT *, bool_or(kind = 'dropcap') OVER (PARTITION BY doc_id, n) AS capped FROM gb),
gd AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY page, block, seq) AS last FROM gc WHERE kind <> 'dropcap'),
ge AS (SELECT *, sum(CAST(kind = 'heading' AND coalesce(last = 'paragraph', false) AS INT)) OVER (PARTITION BY doc_id ORDER BY page, block, seq) AS section FROM gd),
gf AS (SELECT doc_id, section, coalesce(max(page) FILTER (kind = 'heading'), 1) AS page, coalesce(list(text ORDER BY page, block, seq) FILTER (kind = 'heading'), []) AS heads, list(CASE WHEN capped THEN 'M' ELSE '' END || text ORDER BY page, block, seq) FILTER (kind = 'paragraph') AS parts FROM ge GROUP BY doc_id, section),
gg AS (SELECT doc_id, section, page, list_reduce([''] || heads, lambda a, x: CASE WHEN regexp_matches(x, '{P.NUMBERED}') OR length(a) + length(x) + CAST(a <> '' AS INT) > {P.LONGEST_JOINED} THEN x WHEN a = '' THEN x ELSE a || ' ' || x END) AS heading, array_to_string(parts, chr(10) || chr(10)) AS text FROM gf WHERE parts IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "latest_logged": "WITH s AS (SELECT user_id, event_type, event_id, value, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS seq FROM events) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY seq DESC) = 1",
        "passage_rows": f"""WITH {PIECES}, k AS (SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN 'said' WHEN 'fr' THEN 'motion' WHEN 'de' THEN 'program' ELSE 'proposition' END AS layer, CASE lang WHEN 'en' THEN source || ' (' || source || ') om ämne: ämne' WHEN 'fr' THEN source || ' (' || source || '), motion ' || doc_id || ' 2024/25, om h' WHEN 'de' THEN source || ' (' || source || '), partiprogram (antaget 2020) — h' ELSE 'Regeringen (M, KD, L), proposition 2024/25:1 t — h' END AS kontext, CASE WHEN lang = 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'Enskild motion' ELSE '' END END AS subtyp FROM documents)
SELECT doc_id || '#' || i AS id, layer, source AS parti, CAST(doc_id AS VARCHAR) AS parent, subtyp, sha1(kontext) AS kontext, sha1(piece) AS text, left(sha1('passage: ' || kontext || chr(10) || piece), 16) AS emb FROM p8 JOIN k ON pid = doc_id""",
        "sitemap_urls": "WITH m AS (SELECT page_id, 'p' || page_id % 5 AS party, page_id // 5 % 7 AS k, trim(url) AS url, CASE WHEN page_id % 3 = 0 THEN '2024-05-0' || (page_id % 9 + 1) END AS lastmod FROM pages) SELECT party, url, lastmod FROM m WHERE k <> 6 QUALIFY row_number() OVER (PARTITION BY party, url ORDER BY k DESC, page_id DESC) = 1",
        "parties_in": "WITH t AS (SELECT doc_id, ' ' || lower(text || ' (' || " + _list([*K.ALIASES, "Socialdemokraterna S", "xmoderaterna", "kd-l", "MP_"]) + f"[doc_id % {len(K.ALIASES) + 4} + 1] || ', ' || CASE WHEN doc_id % 3 = 0 THEN 'Sossarna?' ELSE '' END) || ' ' AS t FROM documents), h AS (SELECT doc_id, code, min(n) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {n} AS n, '{K.ALIASES[a]}' AS code FROM t WHERE regexp_matches(t, '[^\\p{{L}}\\p{{N}}_]{a}[^\\p{{L}}\\p{{N}}_]')" for n, a in enumerate(sorted(K.ALIASES, key=len, reverse=True))) + ") GROUP BY doc_id, code) SELECT doc_id, coalesce((SELECT string_agg(code, ',' ORDER BY n) FROM h WHERE h.doc_id = t.doc_id), '') AS parties FROM t",
        "program_sections": f"WITH {PROGRAMS} SELECT doc_id || '.pdf' AS file, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INT) AS nth, heading, CAST(page AS INT) AS page, length(text) AS chars, sha1(text) AS sha1 FROM gg",
        "html_main_text": f"WITH {BLOCKS} SELECT page_id, title, text FROM mt",
        "html_blocks": f"WITH {BLOCKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) AS INT) AS nth, sha1(text) AS sha1, CAST(words AS INT) AS words, 0 AS linked, main FROM bl WHERE NOT skipped",
        "html_anchors": f"WITH a0 AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+') AS host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1)) AS label FROM pages), a1 AS (SELECT host || regexp_replace({unescaped('href')}, '#.*', '') AS url, {cleaned(unescaped('label'))} AS label FROM a0) SELECT url, array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (label <> ''), [])), '|') AS labels FROM a1 GROUP BY url",
        "said_records": f"WITH {BLOCKS}, s0 AS (SELECT page_id, text, CASE WHEN page_id % 5 = 0 OR title = '' THEN 'En sida ' || page_id ELSE title END AS heading FROM mt WHERE length(text) >= {K.MIN_TEXT_CHARS}) SELECT 'V:said:en-sida-' || page_id AS chunk_id, 'V' AS parti, 'en-sida-' || page_id AS sakfraga, heading, sha1(text) AS text, sha1(heading || chr(10) || CASE WHEN page_id % 4 = 0 THEN '(Ämne; B)' || chr(10) ELSE '' END || text) AS text_for_embedding, page_id % 2 = 0 AS in_index, concat_ws(',', CASE WHEN page_id % 3 <> 0 THEN 'sitemap' END, CASE WHEN page_id % 2 = 0 THEN 'index' END) AS sources, left(sha256(text), 16) AS content_hash FROM s0",
        "motion_records": f"WITH {MOTIONS} SELECT '2024/25:' || page_id || ':yrkande:' || nr AS chunk_id, sha1(text) AS text, CASE WHEN score >= {K.MIN_MATCH} THEN 'Del ' || (i - 1) ELSE '' END AS heading, sha1(CASE WHEN score >= {K.MIN_MATCH} THEN body ELSE '' END) AS sektion_text, round(score, 6) AS match_score, CAST(nr AS INT) AS yrkande_nr, ['S', 'C', 'MP', ''][page_id % 4 + 1] AS parti, 'Område ' || page_id AS doc_title, 'av A B m.fl. (' || ['S', 'båda C', 'alla MP', '?'][page_id % 4 + 1] || ')' AS forste_undertecknare, 'A B;C D' AS undertecknare FROM mb",
        "proposition_records": f"WITH {BILLS} SELECT 'prop:2023/24:' || (doc_id + 200) || ':0' AS chunk_id, doc_id || '.html' AS file, 'Lag ' || doc_id AS doc_title, '5 oktober 2023' AS datum, 'Propositionens huvudsakliga innehåll' AS heading, length(text) AS chars, sha1(text) AS sha1 FROM b3",
        "tokenize_stem": f"SELECT pid, len(t) AS n_tokens, sha1(array_to_string(t, ' ')) AS sha1 FROM (SELECT doc_id AS pid, {tok('text')} AS t FROM documents)",
        "term_freq": f"WITH {LISTS}, {POST} SELECT pid, term, tf FROM po",
        "doc_freq_idf": f"WITH {LISTS}, {STATS}, {POST}, {DF} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st",
        "corpus_stats": f"WITH {LISTS}, {STATS} SELECT n, round(avgdl, 6) AS avgdl FROM st",
        "bm25_topk": f"WITH {bm25()} SELECT {SHOW}, rank FROM b",
        "index_bm25": f"WITH {bm25()} SELECT {SHOW}, rank FROM b",
        "index_deltas": f"WITH {bm25()} SELECT {SHOW}, rank FROM b",
        "report_grains": "SELECT event_type AS config, user_id % 3 AS typ, user_id AS id, CAST(grouping(event_type, user_id % 3, user_id) AS BIGINT) AS grain, round(avg(value), 6) AS value, count(value) AS n_value FROM events GROUP BY GROUPING SETS ((event_type), (event_type, user_id % 3), (event_type, user_id % 3, user_id))",
        "grading_sheet": """
WITH o AS (SELECT *, conv_id || '-' || turn AS id, 'rag' AS config, text || ' [1].' AS answer FROM conversations WHERE role = 'assistant'),
g AS (SELECT DISTINCT id, CASE WHEN turn = 1 THEN answer ELSE 'old' END AS answer FROM o WHERE turn % 4 = 1)
SELECT config, o.id, '[1, 4] a' AS sources, CASE WHEN g.id IS NOT NULL THEN '1' END AS supported, CASE WHEN g.id IS NOT NULL THEN '1' END AS neutral, CASE WHEN g.id IS NOT NULL THEN 'n' END AS notes
FROM o LEFT JOIN g ON o.id = g.id AND o.answer = g.answer WHERE NOT (conv_id % 5 = 0)""",
        "bm25_drop_party_words": f"WITH {bm25(K.PARTY_WORDS)} SELECT {SHOW}, rank FROM b",
        "vector_topk": f"WITH {dense()} SELECT {SHOW}, rank FROM ve",
        "vector_topk_per_label": f"WITH {dense('true')} SELECT qid, label, pid, round(score, 6) AS score, rank FROM (SELECT ve.qid, e.label, ve.pid, ve.score, CAST(row_number() OVER (PARTITION BY ve.qid, e.label ORDER BY round(ve.score, 9) DESC, ve.pid) AS INT) AS rank FROM ve JOIN embeddings e ON ve.pid = e.vec_id) WHERE rank <= 3",
        "rrf_hybrid": f"WITH {hybrid()} SELECT {SHOW}, rank FROM h WHERE rank <= 10",
        "rrf_weights": f"WITH {hybrid(1.0)} SELECT {SHOW}, rank FROM h WHERE rank <= 10",
        "hybrid_layer_filter": f"WITH {hybrid()} SELECT * FROM (SELECT {SHOW}, {TOP} AS rank FROM h JOIN c USING (pid) WHERE layer = 'en') WHERE rank <= 8",
        "hybrid_party_filter": f"WITH {hybrid(pool='true', drop=K.PARTY_WORDS)} SELECT * FROM (SELECT {SHOW}, {TOP} AS rank FROM h JOIN c USING (pid) WHERE party IN ('src0', 'src3')) WHERE rank <= 8",
        "per_party_cap": f"WITH {hybrid()}, o AS (SELECT h.*, party, row_number() OVER (PARTITION BY qid, party ORDER BY rank) AS k FROM h JOIN c USING (pid)) SELECT * FROM (SELECT {SHOW}, {TOP} AS rank, party FROM o WHERE k <= 1) WHERE rank <= 8",
        "slot_retrieval": f"WITH {FILLED} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(similarity, score), 9) DESC, slot, pos) AS INT) AS n, slot, pid, round(similarity, 6) AS similarity FROM fi",
        "slot_gaps": f"WITH {FILLED} SELECT qid, s_party, s_layer FROM (SELECT DISTINCT qid FROM qv) q, sl WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.qid = q.qid AND fi.slot = sl.slot) AND NOT (s_layer = 'motion' AND s_party IN ('M', 'KD', 'L'))",
        "relevance_cutoff": f"WITH {CORPUS}, {dense('rank <= 300')} SELECT qid, layer, pid, round(score, 6) AS similarity FROM (SELECT *, max(score) OVER (PARTITION BY qid, layer) AS best FROM ve JOIN c USING (pid)) WHERE score >= greatest(0.1, best - 0.15)",
        "quota_table": "WITH q AS (SELECT * FROM (VALUES ('one_party','program',3),('one_party','motion',8),('one_party','proposition',3),('one_party','said',3),('several_parties','program',1),('several_parties','motion',2),('several_parties','proposition',2),('several_parties','said',1)) t(mode, layer, w)), s AS (SELECT unnest(['program,motion,proposition,said', 'motion', 'program,said']) AS layers), x AS (SELECT * FROM q, s WHERE list_contains(string_split(layers, ','), layer)) SELECT item_id AS qid, mode, layers, layer, n FROM (SELECT mode, layers, layer, CAST(ceil(w * (SELECT sum(w) FROM q b WHERE b.mode = x.mode) / sum(w) OVER (PARTITION BY mode, layers)) AS INT) AS n FROM x) y JOIN benchmark ON mode = ['one_party', 'several_parties'][item_id % 2 + 1] AND layers = ['program,motion,proposition,said', 'motion', 'program,said'][item_id % 3 + 1]",
        "context_budget": rf"WITH {NUMBERED}, pc AS (SELECT qid, n, chr(10) || '[' || n || '] ' || upper(layer) || ' — ' || context || chr(10) || 'källa: ' || source || chr(10) || text || chr(10) AS piece FROM nu) SELECT qid, n, chars, s AS sha1 FROM (SELECT qid, n, length(piece) AS chars, sha1(piece) AS s, sum(length(piece)) OVER (PARTITION BY qid ORDER BY n) AS run FROM pc) WHERE run <= 20000",
        "source_list": f"WITH {NUMBERED} SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY f) AS INT) AS line_no, '[' || ns || '] ' || source AS line FROM (SELECT qid, source, min(n) AS f, string_agg(n, ', ' ORDER BY n) AS ns FROM nu WHERE n IN (1, 3, 5, 6, 7, 8, 12) GROUP BY qid, source)",
        "cited_numbers": "SELECT item_id, array_to_string([item_id, item_id + 3] || CASE WHEN item_id > 0 AND item_id < 50 THEN range(item_id, item_id * 2 + 1) ELSE [item_id, item_id * 2] END, ',') AS numbers FROM benchmark",
        "history_last_turns": r"SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN regexp_replace(text, '\s*\[\d+(?:\s*[,–-]\s*\d+)*\]', '', 'g') ELSE text END AS text FROM (SELECT * REPLACE (text || CASE WHEN turn % 2 = 1 THEN '  [1]' || chr(10) || '[2, 3–5].' ELSE '' END AS text), row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3",
        "content_key": f"WITH {CORPUS} SELECT pid, left(sha1('passage: ' || context || chr(10) || text), 16) AS emb, left(sha256(text), 16) AS content_hash FROM c",
        "embedding_cache_missing": f"WITH {CORPUS}, k AS (SELECT pid, 'passage: ' || context || chr(10) || text AS t FROM c), e AS (SELECT pid, left(sha1(t), 16) AS emb, t FROM k) SELECT emb, sha1(min(t)) AS sha1 FROM e WHERE emb NOT IN (SELECT emb FROM e WHERE pid % 3 = 0) GROUP BY emb",
        "passage_union": "SELECT CASE lang WHEN 'en' THEN 'said' WHEN 'fr' THEN 'motion' WHEN 'de' THEN 'program' ELSE 'proposition' END AS layer, source AS parti, CASE lang WHEN 'en' THEN source || ' (' || source || ') om ämne: ämne' WHEN 'fr' THEN source || ' (' || source || '), motion ' || doc_id || ' 2024/25, om h' WHEN 'de' THEN source || ' (' || source || '), partiprogram (antaget 2020) — h' ELSE 'Regeringen (M, KD, L), proposition 2024/25:1 t — h' END AS kontext, CASE WHEN lang = 'fr' THEN CASE WHEN doc_id % 2 = 0 THEN 'Enskild motion' ELSE '' END END AS subtyp, count(DISTINCT doc_id) AS parents FROM documents WHERE trim(text) <> '' GROUP BY ALL",
        "context_lines": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Tidöpartierna (M, KD)' ELSE 'Socialdemokraterna (S)' END || ', partiprogram' || CASE WHEN doc_id % 3 <> 0 THEN ' (antaget ' || doc_id % 3 || ')' ELSE '' END || ' — ' || lang AS line FROM documents",
        "split_paragraphs": r"SELECT doc_id AS pid, len(list_filter(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda x: trim(x) <> '')) AS n FROM documents",
        "sentence_split": f"SELECT doc_id AS pid, len(s) AS n, sha1(array_to_string(s, '|')) AS sha1 FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
        "language_vote": rf"SELECT doc_id AS pid, CASE WHEN len(list_filter(w, lambda x: list_contains({_list(K.ENGLISH)}, x))) > len(list_filter(w, lambda x: list_contains({_list(K.SWEDISH)}, x))) THEN 'en' ELSE 'sv' END AS language FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents)",
        "voting_advice_flag": f"SELECT item_id AS qid, regexp_matches(text || CASE WHEN item_id % 3 = 0 THEN ' Vilket parti SKA jag välja?' ELSE '' END, '(?i){K.VOTING_ADVICE}') AS advice FROM benchmark",
        "precision_mrr": f"WITH {JUDGED} SELECT qid, round(p, 6) AS precision, round(CAST(m AS DOUBLE), 6) AS reciprocal_rank FROM pm",
        "precision_rules": f"""WITH {bm25()}, j AS (SELECT b.*, party, layer, CAST(pid % 10 AS VARCHAR) AS number, CAST(pid % 3 AS VARCHAR) AS session, string_split(text, ' ')[1] AS topic, context || ' ' || text AS body, qid % 8 AS kind FROM b JOIN c USING (pid)),
f AS (SELECT *, kind <> 6 AND (kind NOT IN (0, 7) OR layer = 'en') AND (kind NOT IN (1, 7) OR party IN ('src0', 'src3', 'src7')) AND (kind NOT IN (2, 7) OR number IN ('1', '2', '5', '7', '9')) AND (kind NOT IN (3, 7) OR session IN ('1', '2'))
  AND (kind NOT IN (4, 7) OR regexp_matches(topic, '(?i)^(THE|d.|[a-f])')) AND (kind NOT IN (5, 7) OR regexp_matches(body, '(?i)SRC.* (der|THE|la) ')) AS flag FROM j)
SELECT qid, round(avg(CAST(flag AS INT)), 6) AS precision, round(CAST(coalesce(max(CASE WHEN flag THEN 1.0 / rank END), 0) AS DOUBLE), 6) AS reciprocal_rank, count(*) FILTER (NOT flag) AS false_hits FROM f GROUP BY qid""",
        "retrieval_runs": f"""WITH r AS (SELECT * FROM (WITH {bm25(limit='rank <= ' + str(K.CANDIDATES))} SELECT * FROM b WHERE qid % 4 <> 1) UNION ALL SELECT * FROM (WITH {bm25(K.PARTY_WORDS, 'true')} SELECT * FROM b WHERE qid % 4 = 1)),
o AS (SELECT r.qid, r.pid, 1.0 / (60 + rank) AS score, rank, lang AS layer, source AS party FROM r JOIN documents ON pid = doc_id WHERE (qid % 3 <> 0 OR lang = 'en') AND (qid % 4 <> 1 OR source IN ('src0', 'src3'))),
p AS (SELECT * FROM o QUALIFY qid % 5 <> 2 OR row_number() OVER (PARTITION BY qid, party ORDER BY rank) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM p)
SELECT qid, pid, round(CAST(score AS DOUBLE), 6) AS score, CAST(nth AS INT) AS rank, layer, party FROM n WHERE nth <= 3 + qid % 5""",
        "topic_urls": "SELECT page_id, 'p' || page_id % 7 AS party, url FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]*' || page_id % 7 || '[0-9]*([?#]|$)')",
        "party_coverage": f"WITH {JUDGED}, o AS (SELECT qid, coalesce(list(DISTINCT party) FILTER (flag), []) AS own FROM j GROUP BY qid) SELECT qid, round(len(list_intersect(own, ['src0', 'src1', 'src2'])) / 3.0::DOUBLE, 6) AS covered, array_to_string(list_sort(list_filter(['src0', 'src1', 'src2'], lambda x: NOT list_contains(own, x))), ',') AS missing, array_to_string(list_sort(list_filter(own, lambda x: NOT list_contains(['src0', 'src1', 'src2'], x))), ',') AS unexpected FROM o",
        "false_hits": f"WITH {JUDGED} SELECT qid, false_hits, top_context FROM pm",
        "metrics_by_type": f"WITH {JUDGED} SELECT coalesce('t' || qid % 3, 'all') AS type, round(avg(p), 6) AS precision, round(avg(CAST(m AS DOUBLE)), 6) AS mrr, count(*) AS n FROM pm GROUP BY ROLLUP ('t' || qid % 3)",
        "latency_p50_p90": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, median(value) AS p50 FROM events GROUP BY 1), a AS (SELECT *, CAST(greatest(1, least(n - 1, 9 * (n + 1) // 10)) AS BIGINT) AS k FROM s) SELECT event_type, n, round(p50, 6) AS p50, round((v[k] * (10 - (9 * (n + 1) - 10 * k)) + v[k + 1] * (9 * (n + 1) - 10 * k)) / 10, 6) AS p90 FROM a",
        "pooled_citation_coverage": "SELECT event_type, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS cited, count(*) AS claims, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM events GROUP BY 1",
        "latest_result": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
        "url_discovery_join": f"WITH {URLS}, l AS (SELECT url, CAST(max(page_id) AS VARCHAR) AS lastmod FROM p WHERE page_id % 3 <> 0 GROUP BY url), r AS (SELECT url, CAST(min(page_id) AS VARCHAR) AS labels FROM p WHERE page_id % 2 = 0 GROUP BY url) SELECT coalesce(l.url, r.url) AS url, lastmod, labels, concat_ws(',', CASE WHEN l.url IS NOT NULL THEN 'sitemap' END, CASE WHEN r.url IS NOT NULL THEN 'index' END) AS sources FROM l FULL JOIN r ON l.url = r.url",
        "slug_collisions": r"""
WITH u AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages), s AS (SELECT url, string_split(regexp_replace(url, '/+$', ''), '/') AS parts FROM u),
t AS (SELECT *, CASE WHEN parts[-1] = '' THEN 'index' ELSE parts[-1] END AS slug, coalesce(parts[-2], '') AS parent FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY url) AS k FROM t), w AS (SELECT url, CASE WHEN k > 1 THEN parent || '__' || slug ELSE slug END AS slug FROM v),
x AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY url) AS k FROM w) SELECT url, CASE WHEN k > 1 THEN slug || '__' || k ELSE slug END AS slug FROM x""",
        "html_strip": r"SELECT page_id, sha1(trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'))) AS sha1 FROM pages",
        "section_ranges": "WITH s AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS t FROM documents), x AS (SELECT doc, unnest(range(0, len(t))) AS pos, unnest(t) AS line FROM s), y AS (SELECT doc, CAST(pos AS INT) AS pos, CAST(length(line) % 3 AS INT) AS depth FROM x) SELECT a.doc, a.pos, a.depth, lead(a.pos) OVER (PARTITION BY a.doc ORDER BY a.pos) AS next_any, (SELECT min(b.pos) FROM y b WHERE b.doc = a.doc AND b.pos > a.pos AND b.depth <= a.depth) AS next_level FROM y a",
        "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_heading FROM events",
        "body_style_mode": r"SELECT file, font, size FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY chars DESC, font DESC, size DESC) AS k FROM (SELECT source AS file, lang AS font, round(CAST(doc_id % 4 + 8.04 AS DOUBLE), 1) AS size, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g'))) AS chars FROM documents GROUP BY 1, 2, 3)) WHERE k = 1",
        "worklist": "SELECT config, item_id AS id FROM benchmark, (VALUES ('rag_tools'), ('no_rag')) t(config) WHERE config = 'no_rag' OR item_id NOT IN (SELECT user_id FROM events WHERE user_id % 2 = 0)",
        "grade_carry_over": "SELECT conv_id || '-' || turn AS id, CASE WHEN conv_id % 4 = 0 OR (conv_id % 2 = 0 AND text = 'old') THEN '2' END AS supported, CASE WHEN conv_id % 4 = 0 OR (conv_id % 2 = 0 AND text = 'old') THEN 'n' END AS notes FROM conversations",
        "followup_parent": """
SELECT u.conv_id || '-' || u.turn AS id, CASE WHEN u.turn > 1 THEN 'rag' END AS config, CASE WHEN u.turn > 1 THEN u.conv_id || '-' || (u.turn - 1) END AS follows, CASE WHEN u.turn > 1 THEN sha1(a.text) END AS parent_sha1
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn + 1 = u.turn AND a.role = 'assistant' WHERE u.role = 'user' AND (u.turn <= 1 OR a.conv_id IS NOT NULL)""",
        "split_text_full": f"WITH {PIECES} SELECT pid, CAST(i AS BIGINT) AS i, length(piece) AS chars, sha1(piece) AS sha1 FROM p8",
        "substantive_sentences": f"SELECT doc_id AS pid, len(s) AS n, len(list_filter(s, lambda x: len(regexp_extract_all(regexp_replace(x, '{K.CITATION}', '', 'g'), '\\S+')) >= 6 AND NOT regexp_matches(x, '(?i){K.GAP}') AND NOT regexp_matches(x, '(?i){K.REFUSAL}'))) AS substantive FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
        "stub_embedding": f"""WITH t AS (SELECT item_id AS qid, unnest({tok('text')}) AS t FROM benchmark), x AS (SELECT qid, substr(md5(t), 7, 1) AS h, substr(md5(t), 8, 1) AS l FROM t),
c AS (SELECT qid, CAST((strpos('0123456789abcdef', h) - 1) * 16 + strpos('0123456789abcdef', l) - 1 AS BIGINT) AS bin, count(*) AS n FROM x GROUP BY 1, 2)
SELECT qid, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY qid)), 9) AS value FROM c""",
        "best_section_match": f"""WITH y AS (SELECT doc_id, {match_words('text')} AS y, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, y, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM y), w AS (SELECT *, {match_words('line')} AS s FROM l),
p AS (SELECT doc_id, line, pos, len(list_intersect(y, s)) / CAST(nullif(len(y), 0) AS DOUBLE) AS score FROM w WHERE len(s) > 0),
b AS (SELECT doc_id, score, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS k FROM p) WHERE k = 1)
SELECT doc_id AS doc, round(coalesce(score, 0), 6) AS match_score, CASE WHEN coalesce(score, 0) >= 0.5 THEN length(line) ELSE 0 END AS chars FROM y LEFT JOIN b USING (doc_id)""",
        "per_party_cap_shared": f"""WITH RECURSIVE {hybrid()}, z AS (SELECT doc_id AS pid, source || CASE WHEN doc_id % 10 = 0 THEN ';src' || (CAST(regexp_extract(source, '(\\d+)', 1) AS INT) + 1) % 20 ELSE '' END AS party FROM documents),
k0 AS (SELECT qid, pid, party, rank, row_number() OVER (PARTITION BY qid, party ORDER BY rank) AS nth FROM h JOIN z USING (pid)),
k1 AS (SELECT qid, pid, party, string_split(party, ';') AS own, row_number() OVER (PARTITION BY qid ORDER BY rank) AS i FROM k0 WHERE nth = 1),
g(qid, i, taken, picks) AS (SELECT DISTINCT qid, CAST(0 AS BIGINT), []::VARCHAR[], []::BIGINT[] FROM k1 UNION ALL
  SELECT g.qid, k1.i, CASE WHEN len(list_filter(own, lambda p: NOT list_contains(taken, p))) > 0 AND len(picks) < 8 THEN taken || own ELSE taken END,
         CASE WHEN len(list_filter(own, lambda p: NOT list_contains(taken, p))) > 0 AND len(picks) < 8 THEN picks || [pid] ELSE picks END FROM g JOIN k1 ON g.qid = k1.qid AND k1.i = g.i + 1),
f AS (SELECT qid, arg_max(picks, i) AS picks FROM g GROUP BY qid), o AS (SELECT qid, unnest(picks) AS pid, CAST(unnest(range(1, len(picks) + 1)) AS INT) AS rank FROM f)
SELECT qid, pid, party, rank FROM o JOIN z USING (pid)""",
        "individual_motions": f"WITH {POLITICAL} SELECT pid, single FROM pol WHERE layer = 'motion'",
        "slot_table": """SELECT item_id AS qid, s.* FROM (WITH p AS (SELECT * FROM (VALUES (0,'S'),(1,'M'),(2,'SD'),(3,'C'),(4,'V'),(5,'KD'),(6,'MP'),(7,'L')) t(i, s_party)), l AS (SELECT * FROM (VALUES (0,'program',1),(1,'motion',2),(2,'proposition',2),(3,'said',1)) t(j, s_layer, n))
SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INT) AS slot, s_party, s_layer, n, 'all' AS asked FROM p, l WHERE s_layer <> 'proposition' OR s_party IN ('M', 'KD', 'L')
UNION ALL VALUES (0, 'KD', 'motion', 13, 'KD'), (1, 'KD', 'said', 5, 'KD')) s JOIN benchmark ON s.asked = CASE WHEN item_id % 2 = 0 THEN 'all' ELSE 'KD' END""",
        "tool_round": f"WITH {SHOWN} SELECT qid, n, call, pid FROM sh",
        "prompt_context": f"""WITH {SHOWN}, pc AS (SELECT qid, n, chr(10) || '[' || n || '] ' || upper(layer) || ' — ' || kontext || chr(10) || 'källa: ' || CASE layer WHEN 'motion' THEN 'motion ' || pid || ' 2024/25' || CASE WHEN single THEN ' (enskild motion, ' || signers || ')' ELSE '' END
  WHEN 'proposition' THEN 'prop. 2024/25:' || pid || ', 1 maj 2024' WHEN 'program' THEN 'partiprogram, s. ' || pid % 40 ELSE url END || chr(10) || text
  || CASE WHEN layer = 'motion' AND pid % 5 = 0 AND text <> '' THEN chr(10) || 'Motivering: ' || CASE WHEN length(text) > 600 THEN regexp_replace(left(text, 600), ' [^ ]*$', '') || ' …' ELSE text END ELSE '' END || chr(10) AS piece FROM sh),
cx AS (SELECT qid, chr(10) || 'HÄMTADE TEXTER' || chr(10) || string_agg(piece, chr(10) ORDER BY n) AS context FROM pc GROUP BY qid),
pr AS (SELECT item_id AS qid, 'KONTEXT' || chr(10) || coalesce(context, chr(10) || 'HÄMTADE TEXTER') || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || '{K.GAPS_TITLE}' || chr(10) || '- Socialdemokraterna (S): partiprogrammet' || chr(10) || '- Socialdemokraterna (S): motioner' ELSE '' END
  || chr(10) || chr(10) || 'SLUT PÅ KONTEXT' || CASE WHEN regexp_matches(text, '(?i){K.VOTING_ADVICE}') THEN '{K.VOTING_ADVICE_NOTE}' ELSE '' END || chr(10) || chr(10) || 'FRÅGA: ' || text AS t
  FROM benchmark LEFT JOIN cx ON item_id = cx.qid WHERE context IS NOT NULL OR item_id % 2 = 0) SELECT qid, length(t) AS chars, sha1(t) AS sha1 FROM pr""",
        "listed_sources": f"""WITH {SHOWN} SELECT qid, n, CASE layer WHEN 'motion' THEN 'motion 2024/25:' || pid || ' (' || party || ') – t' || pid WHEN 'proposition' THEN 'prop. 2024/25:' || pid || ' (regeringen: M, KD, L) – t' || pid
  WHEN 'program' THEN 'partiprogram (' || party || ') ' || (2000 + pid % 2 * 20) || ', p. ' || pid % 40 || ' – h' ELSE url || CASE WHEN pid % 2 = 0 THEN ' (last edited 2024-05-06)' ELSE '' END END AS line FROM sh""",
        "link_buttons": f"WITH {SHOWN} SELECT qid, min(n) AS n, url FROM sh WHERE n IN (1, 2, 3, 4, 6, 7) AND starts_with(url, 'https://') GROUP BY qid, url",
        "passage_counts": f"WITH {POLITICAL}, s AS (SELECT layer, party, CASE WHEN layer = 'motion' THEN CASE pid % 3 WHEN 0 THEN 'Enskild motion' WHEN 1 THEN 'Kommittémotion' ELSE '' END END AS subtype FROM pol) SELECT layer, party, subtype, CAST(grouping(layer, party, subtype) AS BIGINT) AS grain, count(*) AS n FROM s GROUP BY GROUPING SETS ((layer), (layer, party), (layer, subtype))",
        "filter_hits": f"SELECT count(*) FILTER (a) AS advice, count(*) FILTER (a AND f) AS flagged_advice, count(*) FILTER (NOT a) AS others, count(*) FILTER (NOT a AND f) AS flagged_others FROM (SELECT item_id % 2 = 0 AS a, regexp_matches(text || CASE WHEN item_id % 3 = 0 THEN ' Vilket parti SKA jag välja?' ELSE '' END, '(?i){K.VOTING_ADVICE}') AS f FROM benchmark)",
        "text_length_places": "SELECT parti, n, l[n // 2 + 1] AS median, l[n * 9 // 10 + 1] AS p90, l[-1] AS largest FROM (SELECT lang AS parti, count(*) AS n, list_sort(list(length(text))) AS l FROM documents GROUP BY lang)",
        "party_mentions": "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {names('t', p)} THEN '{p}' END" for p in K.PARTIES) + ") AS parties FROM (SELECT doc_id, text || ' ' || ['Moderaterna', 'the Greens', 'SD', 'sd', 'xMP', 'moderat', 'Centre Party', 'Liberalerna'][doc_id % 8 + 1] || ', V.' AS t FROM documents)",
        "citation_strip": f"SELECT doc_id, sha1(regexp_replace(regexp_replace(text || '  [3]' || chr(10) || '[4, 5] x (' || ['SAID', 'MOTION', 'x'][doc_id % 3 + 1] || ').', '{K.CITATION}', '', 'g'), '{K.LAYER_LABEL}', '', 'g')) AS sha1 FROM documents",
        "joined_line_text": r"""
WITH w AS (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x, j: CASE (j - 1) % 3 WHEN 0 THEN x || '-' WHEN 1 THEN ['och ', 'eller ', 'x'][CAST((j - 1) % 9 // 3 + 1 AS INT)] || x ELSE x END), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, sha1(list_reduce([''] || w, lambda a, x: CASE WHEN a = '' THEN x WHEN ends_with(a, '-') AND regexp_matches(x, '^\p{Ll}') AND NOT regexp_matches(x, '^(?:och|eller) ') THEN left(a, length(a) - 1) || x ELSE trim(a || ' ' || x) END)) AS sha1 FROM w""",
        "answer_metrics": f"WITH {METRICS} SELECT qid, config, answered, CAST(citation_validity AS DOUBLE) AS citation_validity, CAST(party_mentioned AS DOUBLE) AS party_mentioned, CAST(party_cited AS DOUBLE) AS party_cited, layer_cited, attribution_found, gap_acknowledged, refused, language_ok FROM m",
        "problem_flags": f"""WITH {METRICS} SELECT qid, concat_ws('; ', CASE WHEN NOT answered THEN 'no answer' END, CASE WHEN nth = 1 AND config <> 'no_rag' THEN 'invalid citation 7' END, 'no source for ' || missing, CASE WHEN NOT layer_cited THEN 'expected source type not cited' END,
  CASE WHEN NOT attribution_found THEN 'attribution wording missing' END, CASE WHEN NOT gap_acknowledged THEN 'gap not acknowledged' END, CASE WHEN NOT refused THEN 'no refusal phrase' END, CASE WHEN NOT language_ok THEN 'wrong language' END) AS problems FROM m""",
    }
