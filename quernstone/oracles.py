"""The queries of the catalogue in DuckDB's SQL, written apart from the Spark plans."""

from __future__ import annotations

from . import bases
from .functions import patterns as P
from .operators import generate

WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ANSWERS, QUESTIONS, REPLIES, MARKDOWN, PREDICTIONS, GOLD = map(bases.duck, (bases.ANSWERS, bases.QUESTIONS, bases.REPLIES, bases.MARKDOWN, bases.PREDICTIONS, bases.GOLD))


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def plain_tok(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '([\p{{L}}\p{{N}}]+)', 1)"


def tok(x: str) -> str:
    """Words and digits; of Chinese runs, their pairs."""
    spaced = f"regexp_replace({x}, '([㐀-鿿]+)', ' \\1 ', 'g')"
    pairs = "CASE WHEN regexp_matches(w, '^[㐀-鿿]') AND length(w) > 1 THEN list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) ELSE [w] END"
    return f"CASE WHEN regexp_matches({x}, '[㐀-鿿]') THEN flatten(list_transform({plain_tok(spaced)}, lambda w: {pairs})) ELSE {plain_tok(x)} END"


def nums(x: str, pattern: str = P.NUMBER_SIGNED) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, 0)"


def stopped(x: str) -> str:
    return f"list_filter(list_distinct({tok(x)}), lambda w: NOT list_contains([{', '.join(map(q, P.STOP_WORDS))}], w))"


def jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def normal(x: str) -> str:
    return f"translate({strip(f'lower({x})')}, {q(P.PUNCTUATION)}, '')"


def f1(common: str, a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 AND {b} = 0 THEN 1.0::DOUBLE WHEN {a} = 0 OR {b} = 0 OR {common} = 0 THEN 0.0::DOUBLE ELSE 2 * ({common}::DOUBLE / {a}) * ({common}::DOUBLE / {b}) / (({common}::DOUBLE / {a}) + ({common}::DOUBLE / {b})) END"


def bag(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_intersect({a}, {b}), lambda w: least(len(list_filter({a}, lambda v: v = w)), len(list_filter({b}, lambda v: v = w))))), 0)"


def bm25(p: str, source: str, asked: str, k: int) -> str:
    """CTEs p_idf and p_hits over ``source`` (id, text) and ``asked`` (query_id, question)."""
    return f"""
{p}_tok AS (SELECT id, {tok('text')} AS t FROM {source}),
{p}_corpus AS (SELECT count(*) AS n, avg(len(t))::DOUBLE AS avgdl FROM {p}_tok),
{p}_post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM {p}_tok) GROUP BY id, dl, term),
{p}_raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {p}_post, {p}_corpus GROUP BY term, n),
{p}_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {p}_raw) ELSE raw END AS idf FROM {p}_raw),
{p}_asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok('question')}) AS term FROM {asked}) GROUP BY query_id, term),
{p}_scores AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM {p}_post JOIN {p}_asked USING (term) JOIN {p}_idf USING (term), {p}_corpus GROUP BY query_id, id),
{p}_hits AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}_scores) WHERE rank <= {k} AND score > 0)"""


def tfidf(p: str, source: str, asked: str, k: int) -> str:
    words = lambda x: f"list_filter({tok(x)}, lambda w: length(w) >= 2)"
    return f"""
{p}_post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({words('text')}) AS term FROM {source} WHERE {strip('text')} <> '') GROUP BY id, term),
{p}_n AS (SELECT count(*) AS n FROM {source} WHERE {strip('text')} <> ''),
{p}_terms AS (SELECT term, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS total FROM {p}_post GROUP BY term ORDER BY total DESC, term LIMIT 5000), {p}_n),
{p}_raw AS (SELECT id, term, tf * idf AS w FROM {p}_post JOIN {p}_terms USING (term)),
{p}_weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {p}_raw),
{p}_qraw AS (SELECT query_id, term, count(*) * any_value(idf) AS w FROM (SELECT query_id, unnest({words('question')}) AS term FROM {asked}) JOIN {p}_terms USING (term) GROUP BY query_id, term),
{p}_q AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS w FROM {p}_qraw),
{p}_scores AS (SELECT query_id, id, round(sum(weight * w), 9) AS score FROM {p}_weights JOIN {p}_q USING (term) GROUP BY query_id, id),
{p}_hits AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}_scores) WHERE rank <= {k} AND score > 0)"""


DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
ASKED = "asked AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
SCALED = "(SELECT query_id, id, rank, round(score / max(score) OVER (PARTITION BY query_id), 9) AS score FROM %s)"
DENSE = """
dense_hits AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT i.item_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
  FROM benchmark i JOIN embeddings e ON e.vec_id = i.item_id, embeddings v)) WHERE rank <= 10)"""

SKIP = " OR ".join(f"starts_with(x, {q(p)})" for p in P.BOILERPLATE_PREFIXES) + f" OR regexp_matches(x, {q(P.COMPANY_LINE)})"
CLAUSE = "regexp_extract(x, '^[^。；，]*')"
SUMMARY = rf"""coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '' AND NOT regexp_matches(x, '^#{{1,4}}\s+') AND length(x) >= 10
  AND NOT regexp_matches(x, '^[\d\s|｜\-+]+$') AND NOT ({SKIP}) AND NOT regexp_matches(x, '\.{{6,}}\s*$') AND length({CLAUSE}) > 5)[1], '')"""
SUMMARY = f"substr(regexp_extract({SUMMARY}, '^[^。；，]*'), 1, 200)"

PAGES = rf"""
md AS {MARKDOWN},
cut AS (SELECT filename, text AS whole, string_split(regexp_replace(replace(replace(text, chr(10) || '---' || chr(10), ''), chr(12), ''), '<!--\s*Page\s+(\d+)\s*-->', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM md),
parts AS (SELECT filename, parts, unnest(range(1, len(parts) + 1, 2)) AS i FROM cut),
pages AS (SELECT filename, CASE WHEN i = 1 THEN 1 ELSE parts[i - 1]::BIGINT END AS page, {strip('parts[i]')} AS text,
  list_filter(list_transform(regexp_extract_all(parts[i], {q(P.TABLE_BLOCK)}, 1), lambda t: {strip('t')}), lambda t: t <> '') AS tables
  FROM parts WHERE {strip('parts[i]')} <> '')"""

#: A text counts once for each of its terms, so no postings are needed.
TERM_STATS = f"""
WITH df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({tok('text')})) AS term FROM documents) GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, (SELECT count(*) AS n FROM documents))
SELECT term, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM raw"""

CANDIDATES = """
runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([㐀-鿿]+)', 1)) AS run FROM pages) GROUP BY run),
placed AS (SELECT run, n, unnest(range(1, length(run) + 1)) AS i FROM runs),
sized AS (SELECT run, n, i, unnest(range(1, least(4, length(run) - i + 1) + 1)) AS s FROM placed),
g AS (SELECT substr(run, i, s) AS word, CASE WHEN i > 1 THEN substr(run, i - 1, 1) ELSE '' END AS l, substr(run, i + s, 1) AS r, sum(n)::DOUBLE AS n FROM sized GROUP BY ALL),
c AS (SELECT word, sum(n) AS n FROM g GROUP BY word HAVING sum(n) >= 5 OR length(word) = 1),
total AS (SELECT sum(n) AS total FROM c WHERE length(word) = 1),
halves AS (SELECT word, n, unnest(range(1, length(word))) AS k FROM c WHERE length(word) > 1),
apart AS (SELECT halves.word, min(ln(halves.n * total / (a.n * b.n))) AS cohesion FROM halves JOIN c a ON a.word = substr(halves.word, 1, k) JOIN c b ON b.word = substr(halves.word, k + 1), total GROUP BY halves.word),
hl AS (SELECT word, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT word, l, sum(n) AS n FROM g GROUP BY word, l) GROUP BY word),
hr AS (SELECT word, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT word, r, sum(n) AS n FROM g GROUP BY word, r) GROUP BY word)
SELECT word, n::BIGINT AS n, round(cohesion, 6) AS cohesion, CASE WHEN length(word) > 1 THEN round(least(hl.h, hr.h), 6) END AS freedom FROM c LEFT JOIN apart USING (word) JOIN hl USING (word) JOIN hr USING (word)"""

SENTS = rf"""{PAGES},
sents AS (SELECT filename, page, i - 1 AS idx, s[i] AS sentence FROM (SELECT filename, page, s, unnest(range(1, len(s) + 1)) AS i FROM (
  SELECT filename, page, list_filter(list_transform(string_split(regexp_replace(text, '([。！？；])\s*', '\1' || chr(10), 'g'), chr(10)), lambda s: {strip('s')}), lambda s: length(s) > 2) AS s FROM pages))),
pairs AS (SELECT filename, page, idx, sentence, list_distinct({tok('sentence')}) AS a, list_distinct({tok('lead(sentence) OVER w')}) AS b, lead(sentence) OVER w IS NOT NULL AS has FROM sents WINDOW w AS (PARTITION BY filename, page ORDER BY idx)),
sims AS (SELECT filename, page, idx, sentence, CASE WHEN has THEN {jac('a', 'b')} END AS similarity FROM pairs)"""

BREAKS = f"""{SENTS},
limits AS (SELECT filename, page, greatest(round(avg(similarity) - CASE WHEN count(similarity) = 1 THEN 0.1 ELSE stddev_pop(similarity) END, 12), 0.15) AS lim FROM sims GROUP BY filename, page),
marks AS (SELECT filename, page, idx, sentence, similarity, coalesce(lag(round(similarity, 12) < lim) OVER (PARTITION BY filename, page ORDER BY idx), false) OR regexp_matches(sentence, {q(P.MARKDOWN_HEAD)}) AS is_break FROM sims JOIN limits USING (filename, page))"""

TITLE_TEXT = rf"""CASE WHEN regexp_matches(x, '^#{{1,4}}\s+') THEN {strip("regexp_extract(x, '^#{1,4}\\s+([^\\n]+)', 1)")}
  WHEN length(x) < 4 OR length(x) > 100 OR ({SKIP}) OR NOT regexp_matches(x, '[一-鿿]') OR regexp_matches(x, '[。！？]') OR regexp_matches(x, {q(P.RUNNING_TEXT)}) OR regexp_matches(x, {q(P.CLAUSE_JOIN)}) OR regexp_matches(x, {q(P.DATA_LINE)}) THEN NULL
  WHEN regexp_matches(x, '\.{{6,}}\s*$') OR (instr(x, '：') - 1 >= 2 AND instr(x, '：') - 1 <= length(x) * 0.5) OR (length(x) <= 40 AND NOT regexp_matches(x, '\d')) THEN {strip("regexp_replace(x, '\\s*\\.{3,}\\s*$', '')")} END"""
TITLES = rf"""{PAGES},
lines AS (SELECT filename, page, i - 1 AS line, {strip('l[i]')} AS x FROM (SELECT filename, page, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pages)),
titles AS (SELECT filename, page, line, title FROM (SELECT filename, page, line, {TITLE_TEXT} AS title FROM lines WHERE x <> '') WHERE length(title) > 2)"""

TABLE_CHUNKS = "SELECT filename || '_p' || page || '_table' || (i - 1) AS chunk_id, 'table' AS type, tables[i] AS content FROM (SELECT filename, page, tables, unnest(range(1, len(tables) + 1)) AS i FROM pages)"


def typed(x: str) -> str:
    return ", ".join("(" + " + ".join(f"regexp_matches({x}, {q(p)})::BIGINT" for p in ps) + f") AS {name}" for name, ps in P.QUESTION_PATTERNS.items())


KINDS = list(P.QUESTION_PATTERNS)
PICK = f"CASE WHEN greatest({', '.join(KINDS)}) = 0 THEN '{P.DEFAULT_TYPE}' " + " ".join(f"WHEN {k} = greatest({', '.join(KINDS)}) THEN '{k}'" for k in KINDS) + " END"
CITES = f"list_filter(list_zip(regexp_extract_all(answer, {q(P.CITATION)}, 1), regexp_extract_all(answer, {q(P.CITATION)}, 2)), lambda c: {strip('c[1]')} <> '')"
# Repeats drop out by first place of each (name, page).
CITE_ROWS = f"""
c AS (SELECT qid, {CITES} AS cs FROM a),
e AS (SELECT qid, i, {strip('cs[i][1]')} AS filename, cs[i][2]::BIGINT AS page FROM (SELECT qid, cs, unnest(range(1, len(cs) + 1)) AS i FROM c)),
cites AS (SELECT qid, filename, page, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS idx FROM (SELECT qid, filename, page, min(i) AS i FROM e GROUP BY qid, filename, page))"""


def tidy(x: str) -> str:
    for unit in P.UNITS:
        x = rf"regexp_replace({x}, '(\d+(?:\.\d+)?)\s*{unit}', '\1{unit}', 'g')"
    return x


BARE = strip("coalesce(answer, '')")
IS_EMPTY = f"({BARE} = '' OR {BARE} IN ({', '.join(map(q, P.EMPTY_PHRASES))}))"
SETTLED = f"CASE WHEN {IS_EMPTY} THEN {q(P.EMPTY_MESSAGE)} ELSE answer END"


def cut(x: str) -> str:
    head = f"substr({x}, 1, 500)"
    stop = f"length(regexp_extract({head}, '(?s)^(.*[。.])', 1))"
    return f"CASE WHEN length({x}) < 10 THEN {x} WHEN length({x}) > 500 THEN CASE WHEN {stop} - 1 > 400 THEN substr({head}, 1, {stop}) ELSE {head} || '...' END ELSE {x} END"


LOST = f"list_sort(list_distinct(list_filter({nums('answer')}, lambda v: NOT list_contains({nums('context')}, v))))"
CHECK = f"""
m AS (SELECT qid, answer, context, list_distinct({nums('answer', P.NUMBER_PLAIN)}) AS an, list_distinct({nums('context', P.NUMBER_PLAIN)}) AS cn, {stopped('answer')} AS aw, {stopped('context')} AS cw FROM a),
r AS (SELECT *, len(an) AS n, len(list_intersect(an, cn)) AS hit, len(aw) AS w, len(list_intersect(aw, cw)) AS shr FROM m),
v AS (SELECT *, CASE WHEN answer = '' OR context = '' OR regexp_matches(answer, {q(P.NO_INFORMATION)}) THEN 'Neutral' WHEN n > 0 AND hit::DOUBLE / n >= 0.8 THEN 'Support' WHEN n >= 3 AND (n - hit)::DOUBLE / n >= 0.75 THEN 'Contradict'
  WHEN w > 0 AND len(cw) > 0 AND shr::DOUBLE / w >= 0.5 THEN 'Support' WHEN w > 0 AND len(cw) > 0 AND shr::DOUBLE / w <= 0.15 THEN 'Contradict' ELSE 'Neutral' END AS verdict FROM r)"""
ADVICE = ", ".join(f"CASE verdict {' '.join(f'WHEN {q(k)} THEN {q(f[i])}' for k, f in P.FEEDBACK.items())} END AS {n}" for i, n in enumerate(("action", "reason", "suggestion")))

JUDGED = f"""
p AS {PREDICTIONS}, g0 AS {GOLD},
g AS (SELECT {strip('question')} AS question, arg_max(answer, ord) AS gold FROM g0 WHERE {strip('question')} <> '' GROUP BY 1),
judged AS (SELECT p.id, {strip('p.question')} AS question, p.filename, p.question_type, p.answer AS pred, g.gold FROM p JOIN g ON {strip('p.question')} = g.question)"""
# The longest common subsequence a character at a time: a row of lengths per pair is a running maximum of the last one.
SCORED = f"""WITH RECURSIVE {JUDGED},
n AS (SELECT *, {normal('pred')} AS x, {normal('gold')} AS y FROM judged),
chars AS (SELECT id, unnest(range(1, length(y) + 1)) AS j, y FROM n),
ys AS (SELECT id, j, y[j:j] AS c FROM chars),
lcs(id, i, j, v) AS (
  SELECT id, 0::BIGINT, j, 0::BIGINT FROM ys
  UNION ALL
  SELECT id, i, j, max(step) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT l.id, l.i + 1 AS i, l.j, greatest(l.v, CASE WHEN y.c = n.x[l.i + 1:l.i + 1] THEN coalesce(lag(l.v) OVER (PARTITION BY l.id ORDER BY l.j), 0) + 1 ELSE 0 END) AS step
    FROM lcs l JOIN n ON n.id = l.id JOIN ys y ON y.id = l.id AND y.j = l.j WHERE l.i < length(n.x))
),
common AS (SELECT l.id, max(l.v) AS v FROM lcs l JOIN n ON n.id = l.id WHERE l.i = length(n.x) GROUP BY l.id),
lists AS (SELECT n.*, coalesce(c.v, 0) AS lcs, list_filter(string_split(x, ''), lambda z: z <> '') AS xc, list_filter(string_split(y, ''), lambda z: z <> '') AS yc, {tok('x')} AS xw, {tok('y')} AS yw, list_distinct({nums('pred')}) AS xn, list_distinct({nums('gold')}) AS yn FROM n LEFT JOIN common c ON c.id = n.id),
scored AS (SELECT id, (x = y)::INT::DOUBLE AS exact_match, {f1(bag('xc', 'yc'), 'len(xc)', 'len(yc)')} AS char_f1, {f1(bag('xw', 'yw'), 'len(xw)', 'len(yw)')} AS word_f1, {f1('lcs', 'length(x)', 'length(y)')} AS rouge_l, {f1('len(list_intersect(xn, yn))', 'len(xn)', 'len(yn)')} AS number_f1 FROM lists)"""

FUSED = f"""WITH {DOCS}, {ASKED}, {DENSE}, {bm25('b', 'docs', 'asked', 10)}, {tfidf('k', 'docs', 'asked', 5)},
sums AS (SELECT id, s AS text FROM (SELECT doc_id AS id, {SUMMARY} AS s FROM documents) WHERE s <> ''), {bm25('s', 'sums', 'asked', 5)},
heads AS (SELECT doc_id || '_' || line AS id, doc_id, title AS text FROM (SELECT doc_id, line, {TITLE_TEXT} AS title FROM (
  SELECT doc_id, i - 1 AS line, {strip('l[i]')} AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE x <> '') WHERE length(title) > 2), {bm25('t', 'heads', 'asked', 5)},
ranked AS (
  SELECT query_id, id, rank, 0 AS channel, 'dense' AS source, '_text' AS tail FROM dense_hits UNION ALL SELECT query_id, id, rank, 1, 'bm25', '_text' FROM b_hits
  UNION ALL SELECT query_id, h.doc_id, rank, 2, 'title', '_title' FROM t_hits JOIN heads h USING (id)
  UNION ALL SELECT query_id, id, rank, 3, 'keyword', '_keyword' FROM k_hits UNION ALL SELECT query_id, id, rank, 4, 'summary', '_summary' FROM s_hits),
named AS (SELECT r.*, d.source || '_p' || d.doc_id || r.tail AS chunk_id, d.doc_id || r.tail AS key, d.text AS content, d.source AS filename, d.doc_id AS page FROM ranked r JOIN documents d ON d.doc_id = r.id),
grouped AS (SELECT query_id, chunk_id, any_value(key) AS key, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(channel * 1000 + rank) AS first, array_to_string(list(DISTINCT source ORDER BY source), '|') AS unordered, list(DISTINCT channel ORDER BY channel) AS seen, any_value(content) AS content, any_value(filename) AS filename, any_value(page) AS page FROM named GROUP BY query_id, chunk_id),
fused AS (SELECT query_id, chunk_id, score, array_to_string(list_transform(seen, lambda c: ['dense', 'bm25', 'title', 'keyword', 'summary'][c + 1]), '|') AS sources, content, filename, page, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, key) AS rank FROM grouped)"""

def hits_of(k: int) -> str:
    return f"""WITH RECURSIVE {DOCS}, {ASKED}, {bm25('b', 'docs', 'asked', k)},
hits AS (SELECT h.query_id, h.id, h.rank, h.score, d.text AS content, CASE WHEN d.doc_id % 2 = 0 THEN 'table' ELSE 'text' END AS type, a.question, [{', '.join(map(q, KINDS))}][h.query_id % 4 + 1] AS question_type, list_distinct({tok('d.text')}) AS words, list_distinct({tok('a.question')}) AS asks
  FROM b_hits h JOIN documents d ON d.doc_id = h.id JOIN asked a USING (query_id))"""


HITS = hits_of(10)
LEXICAL = "CASE WHEN len(asks) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(asks, words))::DOUBLE / len(asks), 9) END"


def mmr(source: str, rel: str, k: int) -> str:
    """CTE mmr (query_id, id, rank): k rounds over ``source``; small candidate lists keep their order."""
    j = jac("a.words", "b.words")
    rounds = ""
    for i in range(1, k + 1):
        before = " UNION ALL ".join(f"SELECT query_id, id FROM pick{n}" for n in range(1, i))
        worst = f"coalesce((SELECT max(sim) FROM sims s JOIN ({before}) t ON t.query_id = s.query_id AND t.id = s.y WHERE s.query_id = c.query_id AND s.x = c.id), 0)" if before else "0"
        rest = f"WHERE NOT EXISTS (SELECT 1 FROM ({before}) t WHERE t.query_id = c.query_id AND t.id = c.id)" if before else ""
        rounds += f", pick{i} AS (SELECT query_id, id FROM (SELECT c.query_id, c.id, row_number() OVER (PARTITION BY c.query_id ORDER BY round(0.7 * c.{rel} - (1 - 0.7) * {worst}, 12) DESC, c.rank) AS o FROM many c {rest}) WHERE o = 1)"
    picks = " UNION ALL ".join(f"SELECT query_id, id, {i} AS rank FROM pick{i}" for i in range(1, k + 1))
    return f"""many AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM {source}) WHERE total > {k}),
few AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM {source}) WHERE total <= {k}),
sims AS (SELECT a.query_id, a.id AS x, b.id AS y, {j} AS sim FROM many a JOIN many b ON a.query_id = b.query_id AND a.id <> b.id){rounds},
mmr AS (SELECT query_id, id, rank FROM few UNION ALL {picks})"""


def by_type(source: str) -> str:
    first = f"CASE question_type WHEN 'fact_extraction' THEN type = 'table' WHEN 'chart_understanding' THEN regexp_matches(content, {q(P.CHART_REFERENCE)}) ELSE false END"
    return f"SELECT query_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY ({first})::INT DESC, rank) AS rank, id AS doc_id FROM {source}"


#: The whole chain over gold answers as pages: five channels, fusion, staged reranking, context, prompt, answer, check. The stand-in model repeats the prompt's last line, which is the question.
CHAIN = f"""WITH RECURSIVE g0 AS {GOLD}, shown AS (SELECT '客户' || ord AS filename, 1 AS page, answer AS text FROM g0),
asked AS {bases.duck(bases.SEGMENT_QUESTIONS)},
chunks AS (SELECT filename || '_p1_text' AS id, {strip('text')} AS text, filename, page FROM shown WHERE length({strip('text')}) > 10),
lines AS (SELECT filename, {strip('l[i]')} AS x FROM (SELECT filename, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM shown)),
heads AS (SELECT filename || '_p1_title' AS id, title AS text, filename FROM (SELECT filename, {TITLE_TEXT} AS title FROM lines WHERE x <> '') WHERE length(title) > 2),
sums AS (SELECT filename || '_p1_summary' AS id, s AS text, filename FROM (SELECT filename, {SUMMARY} AS s FROM shown) WHERE s <> ''),
keys AS (SELECT filename || '_p1_keyword' AS id, text, filename FROM shown),
{bm25('b', 'chunks', 'asked', 10)}, {bm25('t', 'heads', 'asked', 5)}, {bm25('s', 'sums', 'asked', 5)}, {tfidf('k', 'keys', 'asked', 5)},
told AS (SELECT 'q' || query_id AS name, unnest({tok('question')}) AS w FROM asked UNION ALL SELECT 'd' || id, unnest({tok('text')}) FROM chunks),
hashed AS (SELECT name, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim, sum(CASE WHEN ('0x' || substr(md5(w), 9, 2))::BIGINT % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM told GROUP BY 1, 2),
unit AS (SELECT name, dim, v / sqrt(sum(v * v) OVER (PARTITION BY name)) AS v FROM hashed WHERE v <> 0),
near AS (SELECT a.name AS qname, b.name AS dname, sum(a.v * b.v) AS s FROM unit a JOIN unit b USING (dim) WHERE a.name LIKE 'q%' AND b.name LIKE 'd%' GROUP BY 1, 2),
dense AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.query_id, c.id, round(coalesce(n.s, 0.0), 9) AS score FROM asked a CROSS JOIN chunks c LEFT JOIN near n ON n.qname = 'q' || a.query_id AND n.dname = 'd' || c.id)) WHERE rank <= 10),
body AS (SELECT id, text AS content, filename, 'text' AS type FROM chunks UNION ALL SELECT id, any_value(text), any_value(filename), NULL FROM heads GROUP BY id
  UNION ALL SELECT s.id, p.text, p.filename, NULL FROM sums s JOIN shown p USING (filename) UNION ALL SELECT id, text, filename, NULL FROM keys),
ranked AS (SELECT query_id, id, rank, 0 AS channel FROM dense UNION ALL SELECT query_id, id, rank, 1 FROM b_hits UNION ALL SELECT query_id, id, rank, 2 FROM t_hits UNION ALL SELECT query_id, id, rank, 3 FROM k_hits UNION ALL SELECT query_id, id, rank, 4 FROM s_hits),
grouped AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(channel * 1000 + rank) AS first FROM ranked GROUP BY query_id, id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM grouped),
kinds AS (SELECT query_id, {PICK} AS kind FROM (SELECT query_id, {typed('question')} FROM asked)),
hits AS (SELECT f.query_id, f.id, f.rank, b.content, b.filename, b.type, k.kind AS question_type, list_distinct({tok('b.content')}) AS words, list_distinct({tok('a.question')}) AS asks FROM fused f JOIN body b USING (id) JOIN asked a USING (query_id) JOIN kinds k USING (query_id)),
one AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY {LEXICAL} DESC, rank) AS rank), {LEXICAL} AS rerank_score FROM hits WHERE rank <= 50),
two AS (SELECT * FROM one WHERE rank <= 20), {mmr('two', 'rerank_score', 3)},
last AS (SELECT h.query_id, h.content, h.filename, row_number() OVER (PARTITION BY h.query_id ORDER BY (CASE question_type WHEN 'fact_extraction' THEN type = 'table' WHEN 'chart_understanding' THEN regexp_matches(content, {q(P.CHART_REFERENCE)}) ELSE false END)::INT DESC NULLS LAST, m.rank) AS rank FROM mmr m JOIN hits h ON h.query_id = m.query_id AND h.id = m.id),
shown_to AS (SELECT query_id, arg_min(filename, rank) AS filename, string_agg('[来源: ' || filename || ' 第1页]' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM last WHERE rank <= 3 GROUP BY query_id),
a AS (SELECT q.query_id AS qid, left('问题：' || q.question, 200) AS answer, coalesce(s.context, '') AS context FROM asked q LEFT JOIN shown_to s USING (query_id)), {CHECK}
SELECT v.qid AS query_id, coalesce(s.filename, '') AS filename, CASE WHEN s.filename IS NULL THEN 0 ELSE 1 END::BIGINT AS page, k.kind AS question_type, md5(v.answer) AS answer_md5, false AS has_citations, verdict, CASE verdict WHEN 'Support' THEN 'keep' WHEN 'Contradict' THEN 'expand_retrieval' ELSE 'review' END AS action
FROM v JOIN kinds k ON k.query_id = v.qid LEFT JOIN shown_to s ON s.query_id = v.qid"""

TASKS = "tasks AS (SELECT user_id::VARCHAR AS filename, event_id AS page, event_type FROM events)"
GOLD_PAGES = f"""WITH {DOCS}, {ASKED}, {bm25('b', 'docs', 'asked', 10)},
shown AS (SELECT h.query_id, d.source AS filename, d.doc_id AS page, h.rank FROM b_hits h JOIN documents d ON d.doc_id = h.id),
told AS (SELECT a.query_id, min(d.doc_id) AS page FROM asked a JOIN documents d ON contains(d.text, a.question) GROUP BY a.query_id),
firsts AS (SELECT a.query_id, CASE WHEN t.page IS NULL THEN 0 ELSE coalesce((SELECT min(rank) FROM shown s WHERE s.query_id = a.query_id AND s.page = t.page), 0) END AS rank
  FROM asked a LEFT JOIN told t USING (query_id) WHERE t.page IS NOT NULL OR a.query_id % 2 <> 0)"""

TEMPLATE = "CASE kind " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in generate.TEMPLATES.items()) + " END"
LINES = f"list_filter(list_transform(string_split(coalesce(reply, ''), chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
# First places keep the order that a plain distinct would lose.
ORDERED = "list_filter(l, lambda x, i: list_position(l, x) = i)"


def semantic(size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE {BREAKS}, open_ AS (SELECT * FROM pages WHERE length(text) >= 10),
m AS (SELECT marks.* FROM marks JOIN open_ USING (filename, page)),
fold(filename, page, idx, grp, text, ends) AS (
  SELECT filename, page, idx, 0::BIGINT, sentence, (is_break AND length(sentence) >= 50) OR (length(sentence) >= {size} AND (coalesce(similarity < 0.25, false) OR length(sentence) >= {1.5 * size})) FROM m WHERE idx = 0
  UNION ALL
  SELECT filename, page, idx, grp, t, (is_break AND length(t) >= 50) OR (length(t) >= {size} AND (coalesce(similarity < 0.25, false) OR length(t) >= {1.5 * size})) FROM (
    SELECT m.filename, m.page, m.idx, m.is_break, m.similarity, CASE WHEN f.ends THEN f.grp + 1 ELSE f.grp END AS grp, CASE WHEN f.ends THEN m.sentence ELSE f.text || m.sentence END AS t FROM fold f JOIN m ON m.filename = f.filename AND m.page = f.page AND m.idx = f.idx + 1)),
groups AS (SELECT filename, page, grp, arg_max(text, idx) AS text FROM fold GROUP BY filename, page, grp),
tails AS (SELECT *, coalesce(CASE WHEN length(lag(text) OVER w) > {overlap} THEN right(lag(text) OVER w, {overlap}) ELSE '' END, '') AS tail FROM groups WINDOW w AS (PARTITION BY filename, page ORDER BY grp)),
chunks AS (SELECT filename, page, grp, {strip("CASE WHEN starts_with(text, tail) THEN text ELSE tail || text END")} AS content FROM tails),
every AS (SELECT filename || '_p' || page || '_chunk' || (row_number() OVER (PARTITION BY filename, page ORDER BY grp) - 1) AS chunk_id, 'text' AS type, content FROM chunks WHERE length(content) > 10
  UNION ALL SELECT chunk_id, type, content FROM ({TABLE_CHUNKS.replace('FROM pages)', "FROM pages p WHERE length(text) < 10 OR EXISTS (SELECT 1 FROM sents s WHERE s.filename = p.filename AND s.page = p.page))")}))
SELECT chunk_id, type, length(content)::BIGINT AS length, md5(content) AS md5 FROM every"""


SQL = {
    "token_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {tok('text')} AS t FROM documents)",
    "page_tokens": f"WITH {PAGES} SELECT filename || '_p' || page AS id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT filename, page, {tok('text')} AS t FROM pages)",
    "page_topk": f"WITH {PAGES}, rows_ AS (SELECT filename || '_p' || page AS id, text FROM pages), asked AS {bases.TITLE_QUESTIONS_DUCK}, {bm25('b', 'rows_', 'asked', 10)} SELECT query_id, rank, id, round(score, 6) AS score FROM b_hits",
    "bm25_term_stats": TERM_STATS,
    "bm25_topk": f"WITH {DOCS}, {ASKED}, {bm25('b', 'docs', 'asked', 10)} SELECT query_id AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM b_hits",
    "bm25_block_topk": f"WITH {DOCS}, {ASKED}, {bm25('b', 'docs', 'asked', 10)} SELECT query_id AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM b_hits",
    "bm25_segments_topk": f"WITH docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {ASKED}, {bm25('b', 'docs', 'asked', 10)} SELECT query_id AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM b_hits",
    "vector_index_topk": """SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT e.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings e, embeddings v WHERE e.vec_id % 20 = 0)) WHERE rank <= 10""",
    "word_candidates": f"WITH {PAGES}, {CANDIDATES}",
    "dense_topk": f"WITH {DENSE} SELECT query_id, rank, id AS vec_id, round(score, 6) AS score FROM dense_hits",
    "tfidf_topk": f"WITH {DOCS}, {ASKED}, {tfidf('k', 'docs', 'asked', 5)} SELECT query_id AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM k_hits",
    "title_rows": f"WITH {TITLES} SELECT filename, page, line, title FROM titles",
    "title_topk": f"WITH {TITLES}, rows_ AS (SELECT filename || '_p' || page || '_' || line AS id, title AS text FROM titles), asked AS {bases.TITLE_QUESTIONS_DUCK}, {bm25('t', 'rows_', 'asked', 5)} SELECT query_id, rank, id, round(score, 6) AS score FROM {SCALED % 't_hits'}",
    "summary_rows": f"SELECT doc_id, {SUMMARY} AS summary FROM documents",
    "summary_topk": f"WITH {ASKED}, sums AS (SELECT id, s AS text FROM (SELECT doc_id AS id, {SUMMARY} AS s FROM documents) WHERE s <> ''), {bm25('s', 'sums', 'asked', 5)} SELECT query_id AS item_id, rank, id AS doc_id, round(score, 6) AS score FROM {SCALED % 's_hits'}",
    "rrf_fusion": f"{FUSED} SELECT query_id AS item_id, rank, chunk_id, round(score, 9) AS score, sources FROM fused",
    "context_text": f"""{FUSED}, top AS (SELECT *, '[来源: ' || filename || ' 第' || page || '页]' || chr(10) || content AS block FROM fused WHERE rank <= 3),
t AS (SELECT query_id, arg_min(filename, rank) AS f, arg_min(page, rank) AS p, string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c, count(*) AS n FROM top GROUP BY query_id)
SELECT a.query_id AS item_id, coalesce(f, '') AS top_filename, coalesce(p, 0)::BIGINT AS top_page, md5(coalesce(c, '')) AS context_md5, length(coalesce(c, ''))::BIGINT AS context_len, coalesce(n, 0)::BIGINT AS n_hits FROM asked a LEFT JOIN t USING (query_id)""",
    "rerank_lexical": f"{HITS} SELECT query_id AS item_id, row_number() OVER (PARTITION BY query_id ORDER BY {LEXICAL} DESC, rank) AS rank, id AS doc_id FROM hits",
    "mmr_rerank": f"{HITS}, scaled AS (SELECT * REPLACE (round(score / 100, 9) AS score) FROM hits), {mmr('scaled', 'score', 3)} SELECT query_id AS item_id, rank, id AS doc_id FROM mmr",
    "type_filter": f"{HITS} {by_type('hits')}",
    "multi_stage_rerank": f"""{hits_of(60)}, one AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY {LEXICAL} DESC, rank) AS rank), {LEXICAL} AS rerank_score FROM hits WHERE rank <= 50),
two AS (SELECT * FROM one WHERE rank <= 20), {mmr('two', 'rerank_score', 5)}, three AS (SELECT h.* EXCLUDE (rank), m.rank FROM mmr m JOIN hits h USING (query_id, id)) SELECT * FROM ({by_type('three')}) WHERE rank <= 5""",
    "page_split": f"WITH {PAGES} SELECT filename, page, md5(text) AS text_md5, len(tables)::BIGINT AS n_tables FROM pages",
    "extract_tables": f"WITH md AS {MARKDOWN}, t AS (SELECT filename, list_filter(list_transform(regexp_extract_all(text, {q(P.TABLE_BLOCK)}, 1), lambda t: {strip('t')}), lambda t: t <> '') AS l FROM md) SELECT filename, i - 1 AS idx, l[i] AS tbl FROM (SELECT filename, l, unnest(range(1, len(l) + 1)) AS i FROM t)",
    "page_chunks": f"""WITH RECURSIVE {PAGES}, bare(filename, page, tables, i, text) AS (SELECT filename, page, tables, 0, text FROM pages UNION ALL SELECT filename, page, tables, i + 1, replace(text, tables[i + 1], '') FROM bare WHERE i < len(tables)),
texts AS (SELECT filename || '_p' || page || '_text' AS chunk_id, 'text' AS type, {strip('text')} AS content FROM bare WHERE i = len(tables)), every AS (SELECT * FROM texts WHERE length(content) > 10 UNION ALL {TABLE_CHUNKS})
SELECT chunk_id, type, length(content)::BIGINT AS length, md5(content) AS md5 FROM every""",
    "sentences": f"WITH {SENTS} SELECT filename, page, idx, sentence FROM sents",
    "sentence_similarity": f"WITH {SENTS} SELECT filename, page, idx, round(similarity, 6) AS similarity FROM sims WHERE similarity IS NOT NULL",
    "breakpoints": f"WITH {BREAKS} SELECT filename, page, idx, is_break FROM marks",
    "semantic_chunks": semantic(500, 100),
    "semantic_chunks_small": semantic(120, 30),
    "semantic_chunks_streamed": semantic(500, 100),
    "enrich_merge_typed": """WITH last AS (SELECT user_id::VARCHAR AS filename, event_id % 50 AS page, max(event_id) AS n, arg_max(event_type, event_id) AS kind, arg_max(json_extract(props, '$.k')::BIGINT, event_id) AS k FROM events GROUP BY 1, 2),
p AS (SELECT DISTINCT user_id::VARCHAR AS filename, event_id % 97 AS page FROM events)
SELECT p.filename, p.page, CASE WHEN n % 7 <> 0 THEN 'p' || n ELSE '' END AS page_summary, coalesce(n % 7 <> 0 AND n % 3 < 2, false) AS has_charts,
  CASE WHEN n % 7 = 0 THEN '' WHEN n % 3 = 0 THEN kind || '0|' || kind || '1' WHEN n % 3 = 1 THEN kind || '0' ELSE '' END AS titles,
  CASE WHEN n % 7 = 0 THEN 0 WHEN n % 3 = 0 THEN 2 * k WHEN n % 3 = 1 THEN k ELSE 0 END::BIGINT AS sources FROM p LEFT JOIN last USING (filename, page)""",
    "chart_items": """WITH r AS (SELECT user_id::VARCHAR AS filename, event_id AS page, event_type, json_extract(props, '$.k') AS k FROM events WHERE event_id % 5 IN (0, 1, 4)),
two AS (SELECT *, unnest([0, 1]) AS pos FROM r)
SELECT filename, page, pos::BIGINT AS pos, CASE WHEN pos = 0 THEN event_type WHEN page % 3 = 0 THEN '7' END AS title, CASE WHEN pos = 0 THEN page::DOUBLE WHEN page % 3 = 1 THEN 1.5::DOUBLE END AS "values", CASE WHEN pos = 0 THEN k::BIGINT ELSE -1 END AS source_k FROM two""",
    "classify_question": f"SELECT qid, {PICK} AS question_type FROM (SELECT qid, {typed('question')} FROM {QUESTIONS})",
    "classify_scores": f"SELECT qid, {typed('question')} FROM {QUESTIONS}",
    "rewrite_dedup": f"SELECT qid, array_to_string({ORDERED}, '|') AS variants FROM (SELECT qid, list_concat([question], {LINES}) AS l FROM {REPLIES})",
    "decompose_lines": f"SELECT qid, CASE WHEN len(l) = 0 THEN question ELSE array_to_string(l, '|') END AS parts FROM (SELECT qid, question, {LINES} AS l FROM {REPLIES})",
    "prompt_text": f"""WITH k AS (SELECT qid, question, {PICK} AS kind FROM (SELECT qid, question, {typed('question')} FROM {QUESTIONS})), t AS (SELECT k.qid, question, context, {TEMPLATE} || chr(10) || {q(generate.CITATION_NOTE)} AS tpl FROM k JOIN {ANSWERS} a ON a.qid = k.qid)
SELECT qid, md5(replace(string_split(tpl, '{{context}}')[1] || context || string_split(tpl, '{{context}}')[2], '{{question}}', question)) AS prompt_md5 FROM t""",
    "citations": f"WITH a AS {ANSWERS}, {CITE_ROWS} SELECT qid, idx, filename, page FROM cites",
    "has_citations": f"SELECT qid, regexp_matches(answer, {q(P.CITATION_ANY)}) AS has_citations FROM {ANSWERS}",
    "format_citation": f"SELECT qid, '[来源: 报告 A 第' || qid || '页]' AS citation FROM {QUESTIONS}",
    "clean_answer": f"SELECT qid, {strip(f'regexp_replace(answer, {q(P.CITATION_ANY)}, {q('')}, {q('g')})')} AS answer FROM {ANSWERS}",
    "numbers_eval": f"SELECT qid, array_to_string({nums('answer')}, '|') AS numbers FROM {ANSWERS}",
    "numbers_selfcheck": f"SELECT qid, array_to_string({nums('answer', P.NUMBER_PLAIN)}, '|') AS numbers FROM {ANSWERS}",
    "unsupported_numbers": f"SELECT qid, array_to_string({LOST}, '|') AS numbers FROM {ANSWERS}",
    "normalize_format": f"SELECT qid, {tidy('answer')} AS answer FROM {ANSWERS}",
    "handle_empty": f"SELECT qid, {SETTLED} AS answer FROM {ANSWERS}",
    "control_length": f"SELECT qid, {cut('answer')} AS answer FROM {ANSWERS}",
    "postprocess": f"""SELECT qid, CASE WHEN e THEN {q(P.EMPTY_MESSAGE)} ELSE {cut('t')} END AS answer, CASE WHEN e THEN '' ELSE array_to_string(lost, '|') END AS unsupported_numbers, NOT e AND length({cut('t')}) < length(t) AS was_truncated, e AS was_empty
FROM (SELECT qid, {IS_EMPTY} AS e, {tidy('answer')} AS t, {LOST} AS lost FROM {ANSWERS})""",
    "check_support": f"WITH a AS {ANSWERS}, {CHECK} SELECT qid, verdict FROM v",
    "self_check": f"""WITH a AS {ANSWERS}, {CHECK} SELECT qid, verdict, round(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE hit::DOUBLE / n END, 4) AS num_support_ratio, round(CASE WHEN w = 0 THEN 0.0::DOUBLE ELSE shr::DOUBLE / w END, 4) AS keyword_overlap_ratio,
array_to_string(list_sort(an), '|') AS answer_numbers, array_to_string(list_sort(cn), '|') AS context_numbers FROM v""",
    "feedback": f"WITH a AS {ANSWERS}, {CHECK} SELECT qid, {ADVICE} FROM v",
    "consistency_vote": f"""WITH s AS (SELECT conv_id, turn AS idx, {stopped('text')} AS words FROM conversations WHERE role = 'assistant'),
t AS (SELECT a.conv_id, a.idx, round(coalesce(sum({jac('a.words', 'b.words')}), 0), 9) AS score FROM s a LEFT JOIN s b ON a.conv_id = b.conv_id AND a.idx <> b.idx GROUP BY a.conv_id, a.idx),
best AS (SELECT conv_id, max(score) AS top FROM t GROUP BY conv_id)
SELECT t.conv_id, min(CASE WHEN score = top THEN idx END) AS best_idx, count(*) FILTER (score >= round(top * 0.8, 9))::BIGINT AS votes FROM t JOIN best USING (conv_id) GROUP BY t.conv_id""",
    "normalize_text": f"SELECT id, {normal('answer')} AS answer FROM {PREDICTIONS}",
    **{m: f"{SCORED} SELECT id, round({m}, 6) AS {m} FROM scored" for m in ("char_f1", "word_f1", "rouge_l", "number_f1")},
    "evaluate_answers": f"{SCORED} SELECT count(*)::BIGINT AS count, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("exact_match", "char_f1", "word_f1", "rouge_l", "number_f1")) + " FROM scored",
    "report_extremes": f"{SCORED} SELECT (SELECT id FROM scored ORDER BY rouge_l DESC, id LIMIT 1) AS best, round(max(rouge_l), 6) AS best_rouge_l, (SELECT id FROM scored ORDER BY rouge_l, id LIMIT 1) AS worst, round(min(rouge_l), 6) AS worst_rouge_l FROM scored",
    "retrieval_details": f"{GOLD_PAGES} SELECT query_id AS item_id, rank::BIGINT AS rank FROM firsts",
    "retrieval_metrics": f"{GOLD_PAGES} SELECT k::BIGINT AS k, count(*)::BIGINT AS count, round(avg((rank > 0 AND rank <= k)::INT::DOUBLE), 9) AS recall, round(avg((rank > 0 AND rank <= k)::INT::DOUBLE), 9) AS hit_rate, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 9) AS mrr FROM firsts, (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k",
    **{name: f"WITH {JUDGED} SELECT coalesce({by}, 'unknown') AS \"group\", count(*)::BIGINT AS total, sum(({strip('pred')} <> {strip('gold')})::INT)::BIGINT AS errors, round(avg(({strip('pred')} <> {strip('gold')})::INT::DOUBLE), 9) AS error_rate FROM judged GROUP BY 1" for name, by in (("errors_by_type", "question_type"), ("errors_by_document", "filename"))},
    "bad_cases": f"WITH {JUDGED} SELECT id, question, pred, gold FROM judged WHERE {strip('pred')} <> {strip('gold')}",
    "enrich_pending": f"WITH {TASKS} SELECT filename, page FROM tasks t WHERE page >= 100 AND NOT EXISTS (SELECT 1 FROM tasks d WHERE d.event_type = 'purchase' AND d.filename = t.filename AND d.page = t.page)",
    "enrich_cap": f"WITH {TASKS} SELECT filename, page FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY page) AS n FROM tasks) WHERE n <= 3",
    "enrich_progress": f"WITH {TASKS} SELECT filename, count(*)::BIGINT AS total, count(*) FILTER (event_type = 'purchase')::BIGINT AS done, greatest(0, count(*) FILTER (event_type <> 'purchase'))::BIGINT AS remaining FROM tasks GROUP BY filename",
    "enrich_merge": f"WITH {TASKS}, r AS (SELECT filename, page % 50 AS page, arg_max(event_type, page) AS description FROM tasks GROUP BY 1, 2) SELECT p.filename, p.page, coalesce(r.description, '') AS description FROM (SELECT DISTINCT filename, page % 97 AS page FROM tasks) p LEFT JOIN r USING (filename, page)",
    "enrich_merge_charts": f"""WITH {TASKS}, r AS (SELECT user_id::VARCHAR AS filename, event_id % 50 AS page, arg_max({{'s': CASE WHEN event_id % 3 > 0 THEN event_type END, 'e': event_id, 't': event_type}}, event_id) AS l FROM events GROUP BY 1, 2)
SELECT p.filename, p.page, coalesce(l.s, '') AS page_summary, coalesce(l.e % 2 = 0, false) AS has_charts, coalesce(l.e % 5 > 0, false) AS has_tables, CASE WHEN l.e % 4 > 0 THEN l.t || '|c' ELSE '' END AS charts, '' AS tables FROM (SELECT DISTINCT filename, page % 97 AS page FROM tasks) p LEFT JOIN r USING (filename, page)""",
    "enrich_max_pages": f"WITH {TASKS} SELECT filename, page, filename || '_page_' || page AS page_summary FROM tasks t WHERE page >= 100 AND NOT EXISTS (SELECT 1 FROM tasks d WHERE d.event_type = 'purchase' AND d.filename = t.filename AND d.page = t.page) ORDER BY filename, page LIMIT 500",
    "tasks_from_images": "SELECT 'u_page_' || user_id AS filename, event_id AS page, '/img/u_page_' || user_id || '_page_' || event_id || '.png' AS path FROM events WHERE event_id % 7 <> 0",
    "parse_json_reply": "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k')::BIGINT ELSE -1 END AS k FROM events",
    "upsert_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "answer_chain": CHAIN,
    "pipeline_stub": f"""WITH a AS {ANSWERS}, {CITE_ROWS}, {CHECK}, k AS (SELECT qid, {PICK} AS kind FROM (SELECT qid, {typed('question')} FROM {QUESTIONS})), n AS (SELECT qid, count(*) AS n FROM cites GROUP BY qid)
SELECT v.qid, k.kind AS question_type, coalesce(n.n, 0) > 0 AS has_citations, coalesce(n.n, 0)::BIGINT AS n_citations, verdict, CASE verdict WHEN 'Support' THEN 'keep' WHEN 'Contradict' THEN 'expand_retrieval' ELSE 'review' END AS action FROM v JOIN k USING (qid) LEFT JOIN n USING (qid)""",
}
