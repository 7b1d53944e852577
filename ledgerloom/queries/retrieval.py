"""Retrieval on documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.plans import retrieval as R
from ledgerloom.queries.book import Book

BOOK = Book()
TERMS = ["license", "the", "tion", "it"]
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


def bm25_sql(source: str, key: str, terms: list[str]) -> str:
    """Common tables from `source` (key, text) to k: key and score of each hit."""
    fit = {t: f"starts_with(w, '{t}')" if len(t) >= 3 else f"w = '{t}'" for t in terms}
    tf = ", ".join(f"len(list_filter(w0, lambda w: {fit[t]})) AS t{i}" for i, t in enumerate(terms))
    idf = [f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END" for i in range(len(terms))]
    return f"""w AS (SELECT {key}, {WORDS} AS w0 FROM {source}), c AS (SELECT {key}, len(w0) AS len, {tf} FROM w),
a AS (SELECT count(*) AS n, avg(len) AS av, {', '.join(f'count(*) FILTER (t{i} > 0) AS df{i}' for i in range(len(terms)))} FROM c),
k AS (SELECT {key}, {' + '.join(f'({idf[i]}) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * len / av))' for i in range(len(terms)))} AS score FROM c, a WHERE {' OR '.join(f't{i} > 0' for i in range(len(terms)))})"""


BM25 = bm25_sql("documents", "doc_id", TERMS)
SEM = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 7),
s AS (SELECT vec_id, list_inner_product(e, qe) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(qe, qe))) AS score FROM v, q ORDER BY score DESC, vec_id LIMIT 40),
h AS (SELECT vec_id, score FROM s WHERE score >= greatest(0.78, (SELECT max(score) FROM s) - 0.05))"""


def vector(b) -> list[float]:
    row = b.table("embeddings").filter("vec_id = 7").select("embedding").first()
    return [float(x) for x in row.embedding]


@BOOK.add("normalized_tokens", r"""
SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda w: w <> '')) AS w FROM documents) GROUP BY w""")
def normalized_tokens(b):
    return b.table("documents").select(F.explode(T.tokens(T.normalize(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


KIND = r"CASE WHEN NOT regexp_matches(x, '\p{L}') THEN 'num' WHEN regexp_full_match(regexp_replace(x, '[^\p{L}]', '', 'g'), '[A-Za-z]+') THEN 'en' ELSE 'bad' END"
EN = ", ".join(f"'{w}'" for w in sorted(T.EN_STOP))


def quality_sql(source: str, keys: str) -> str:
    """Common tables from `source` (keys and text) to q, with score, bad, words and plausible."""
    return rf"""t AS (SELECT {keys}, text, list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS w, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS raw FROM {source}),
k AS (SELECT *, list_transform(w, lambda x: {KIND}) AS k, len(list_filter(raw, lambda x: {KIND} = 'bad')) AS loose, list_filter(w, lambda x: {KIND} = 'en') AS en FROM t),
c AS (SELECT *, len(w)::DOUBLE AS a, len(list_filter(k, lambda x: x = 'num'))::DOUBLE AS num, len(list_filter(k, lambda x: x = 'bad'))::DOUBLE AS b, len(en)::DOUBLE AS e,
  len(list_filter(en, lambda x: length(x) <= 3 AND NOT (upper(x) = x AND length(x) >= 2) AND lower(x) NOT IN ({EN})))::DOUBLE AS junk, len(list_filter(en, lambda x: lower(x) IN ({EN})))::DOUBLE AS stop,
  len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{{L}}') AND length(x) >= 7 AND NOT regexp_full_match(x, '[0-9]+')))::DOUBLE AS long,
  length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::DOUBLE AS letters, len(regexp_extract_all(text, '[©®•@$§\\=+^|~<>{{}}\[\]¦¬°±*#%&_`]'))::DOUBLE AS sym FROM k),
g AS (SELECT *, a - num AS n, least(1, (b + loose) / (2 * greatest(1, a - num))) AS broken, num / greatest(1, a) AS share,
  (1 - least(1, greatest(0, junk / greatest(1, e) - 0.08) * 2.5)) * (0.55 + 0.45 * least(1, stop / greatest(1, e) / 0.08)) AS good FROM c),
q AS (SELECT {keys}, text, round(CASE WHEN n > 0 THEN (1 - broken) * CASE WHEN share > 0.4 AND a >= 10 THEN 1 - (share - 0.4) ELSE 1 END * CASE WHEN e >= 6 THEN 1 - e / greatest(1, n) * (1 - good) ELSE 1 END
  * CASE WHEN letters >= 30 THEN 1 - least(0.6, greatest(0, sym / greatest(1, letters) - 0.02) * 4) ELSE 1 END ELSE 0 END, 3) AS score, round(CASE WHEN n > 0 THEN broken ELSE 0 END, 3) AS bad, CAST(n AS INT) AS words,
  CASE WHEN a > 0 THEN greatest(0, 1 - 1.3 * b / greatest(1, a) - 1.2 * (junk + long) / greatest(1, a) - least(0.5, 3 * sym / greatest(1, letters))) ELSE 0 END AS plausible FROM g)"""


@BOOK.add("text_quality_stats", f"""
WITH {quality_sql("documents", "doc_id, lang")} SELECT lang, count(*) AS docs, count(*) FILTER (score >= 0.7) AS readable, CAST(sum(words) AS BIGINT) AS words, round(CAST(sum(CAST(score AS DECIMAL(9, 3))) AS DOUBLE), 3) AS score FROM q GROUP BY lang""")
def text_quality_stats(b):
    """Quality of the texts of each language; sums are of three decimals, so that their order doesn't matter."""
    rows = T.with_quality(b.table("documents").select("doc_id", "lang", "text"), "text", "q").select("lang", "q.score", "q.words")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("score") >= 0.7).alias("readable"), F.sum("words").cast("long").alias("words"), F.sum(F.col("score").cast("decimal(9,3)")).cast("double").alias("score"))


@BOOK.add("text_quality", f"WITH {quality_sql('documents', 'doc_id')} SELECT doc_id, score, bad, words FROM q")
def text_quality(b):
    """The fixture has texts in Latin letters alone; tests have Persian ones."""
    return T.with_quality(b.table("documents").select("doc_id", "text"), "text", "q").select("doc_id", "q.score", "q.bad", "q.words")


BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
PAGES = f"""g0 AS (SELECT doc_id, list_reduce([{{'o': []::VARCHAR[], 'h': ''}}] || list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {{'o': []::VARCHAR[], 'h': x}}), lambda s, x:
  CASE WHEN s.h <> '' AND length(s.h) + length(x.h) > {T.PAGE} THEN {{'o': list_append(s.o, s.h), 'h': x.h || chr(10)}} ELSE {{'o': s.o, 'h': s.h || x.h || chr(10)}} END) AS p FROM documents),
g1 AS (SELECT doc_id, CASE WHEN trim(p.h, {BLANKS}) <> '' OR len(p.o) = 0 THEN list_append(p.o, CASE WHEN trim(p.h, {BLANKS}) <> '' THEN p.h ELSE '' END) ELSE p.o END AS l FROM g0),
g AS (SELECT doc_id, unnest(range(len(l))) AS page, unnest(l) AS text FROM g1)"""


def chunk_sql(source: str, keys: str) -> str:
    """Common tables from `source` (keys, text) to h: keys, seq and text of each chunk. A fold makes paragraphs of lines, another one
    chunks of their pieces; k says what a piece is: w a whole paragraph, p a part, h a hard cut."""
    short = f"trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANKS})"
    line = f"list_transform(list_append(string_split({short}, chr(10)), ''), lambda x: trim(x, {BLANKS}))"
    joined = "CASE WHEN x.h = '' THEN s.h WHEN s.h = '' THEN x.h ELSE s.h || ' ' || x.h END"
    full = f"({joined}) <> '' AND (x.h = '' OR (right(x.h, 1) IN ('.', '؟', '?', ':', '!') AND length({joined}) > 200))"
    hard, size, step = f"greatest(0, length(x) - {T.OVERLAP + 1}) // {T.SIZE - T.OVERLAP}", T.SIZE, T.SIZE - T.OVERLAP
    piece = f"list_transform(range({hard}), lambda i: {{'o': []::VARCHAR[], 'n': '', 'k': 'h', 'p': substring(x, i * {step} + 1, {size})}}) || [{{'o': []::VARCHAR[], 'n': '', 'k': 'p', 'p': substring(x, {hard} * {step} + 1)}}]"
    cuts = f"list_filter(string_split(regexp_replace(x, '([.!?؟؛:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: y <> '')"
    over = f"(s.n <> '' AND (x.k = 'h' OR length(s.n) + length(x.p) + 1 > {size}))"
    tail = f"right(s.n, {T.OVERLAP})"
    left = f"CASE WHEN NOT {over} THEN s.n WHEN x.k = 'h' OR strpos({tail}, ' ') = 0 THEN '' ELSE substring({tail}, strpos({tail}, ' ') + 1) END"
    out = f"CASE WHEN {over} THEN list_append(s.o, s.n) ELSE s.o END"
    fold = f"""CASE WHEN x.k = 'h' THEN {{'o': list_append({out}, x.p), 'n': '', 'k': '', 'p': ''}}
  ELSE {{'o': {out}, 'n': ({left}) || CASE WHEN ({left}) <> '' AND x.k = 'w' THEN chr(10) ELSE ' ' END || x.p, 'k': '', 'p': ''}} END"""
    return f"""h0 AS (SELECT {keys}, {line} AS lines FROM {source} WHERE text IS NOT NULL),
h1 AS (SELECT {keys}, list_reduce([{{'o': []::VARCHAR[], 'h': ''}}] || list_transform(lines, lambda x: {{'o': []::VARCHAR[], 'h': x}}), lambda s, x: CASE WHEN {full} THEN {{'o': list_append(s.o, {joined}), 'h': ''}} ELSE {{'o': s.o, 'h': {joined}}} END).o AS p FROM h0),
h2 AS (SELECT {keys}, flatten(list_transform(p, lambda z: CASE WHEN length(z) <= {size} THEN [{{'o': []::VARCHAR[], 'n': '', 'k': 'w', 'p': z}}] ELSE flatten(list_transform({cuts.replace('(x,', '(z,')}, lambda x: {piece})) END)) AS c FROM h1),
h3 AS (SELECT {keys}, list_reduce([{{'o': []::VARCHAR[], 'n': '', 'k': '', 'p': ''}}] || c, lambda s, x: {fold}) AS f FROM h2),
h4 AS (SELECT {keys}, list_filter(list_transform(list_append(f.o, f.n), lambda x: trim(x, {BLANKS})), lambda x: length(array_to_string(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+'), ' ')) >= 3) AS l FROM h3),
h AS (SELECT {keys}, unnest(range(len(l))) AS seq, unnest(l) AS text FROM h4)"""


@BOOK.add("chunks", f"WITH {chunk_sql('documents', 'doc_id')} SELECT doc_id, CAST(seq AS INT) AS seq, CAST(length(text) AS INT) AS n_chars, md5(text) AS md5 FROM h")
def chunks(b):
    """The fixture has no signs that the normal form for display composes; tests have."""
    return b.table("documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("seq", "chunk")).select("doc_id", "seq", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("md5"))


@BOOK.add("virtual_pages", f"WITH {PAGES} SELECT doc_id, CAST(page AS INT) AS page, CAST(length(text) AS INT) AS n_chars FROM g")
def virtual_pages(b):
    return b.table("documents").select("doc_id", F.posexplode(T.virtual_pages(F.col("text"))).alias("page", "body")).select("doc_id", "page", F.length("body").alias("n_chars"))


@BOOK.add("keyword_search_bm25", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM k ORDER BY k.score DESC, doc_id LIMIT 40")
def keyword_search_bm25(b):
    return R.top(R.bm25(b.table("documents"), TERMS), 40, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@BOOK.add("semantic_topk", f"WITH {SEM} SELECT vec_id, round(score, 6) AS score FROM h")
def semantic_topk(b):
    return R.semantic(b.table("embeddings"), vector(b), 40).select("vec_id", F.round("score", 6).alias("score"))


@BOOK.add("hybrid_rrf", f"""
WITH {BM25}, {SEM}, k40 AS (SELECT doc_id AS id, score FROM k ORDER BY score DESC, doc_id LIMIT 40),
u AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) AS part FROM k40 UNION ALL SELECT vec_id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id) - 1) FROM h)
SELECT id AS doc_id, round(sum(part), 6) AS score FROM u GROUP BY id""")
def hybrid_rrf(b):
    """Vectors are those of the documents of their numbers."""
    words = R.top(R.bm25(b.table("documents"), TERMS), 40, "doc_id")
    near = R.semantic(b.table("embeddings").withColumnRenamed("vec_id", "doc_id"), vector(b), 40, "doc_id")
    return R.fuse(words, near, "doc_id", 80).select("doc_id", F.round("score", 6).alias("score"))


SENT = r"""s AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?؟؛])\s+', '\1' || chr(10), 'g'), '\n'), lambda x: trim(x, ' ')), lambda x: length(x) > 10) AS l FROM documents))"""
HITS = " + ".join(f"CAST(contains(lower(sentence), '{t}') AS INT)" for t in ("license", "version", "under"))


@BOOK.add("best_sentences", f"""
WITH {SENT}, h AS (SELECT doc_id, CAST(pos AS INT) AS pos, sentence, {HITS} AS hits FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) AS r FROM h WHERE hits > 0)
SELECT doc_id, pos, sentence, hits FROM r WHERE r <= 2""")
def best_sentences(b):
    return R.best_sentences(b.table("documents"), ["license", "version", "under"])


@BOOK.add("extractive_answer", rf"""
WITH {SENT}, n AS (SELECT doc_id, sentence, array_to_string(list_filter(regexp_split_to_array(lower(sentence), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') AS norm FROM s),
g AS (SELECT *, {HITS} - CASE WHEN length(sentence) < 40 THEN 0.5 ELSE 0.0 END AS score FROM n WHERE length(norm) >= 15),
o AS (SELECT norm, min(doc_id) AS doc_id, arg_min(sentence, (doc_id, sentence)) AS sentence, max(score) AS score FROM g WHERE score > 0 GROUP BY norm)
SELECT doc_id, sentence, CAST(score AS DOUBLE) AS score FROM o WHERE score >= greatest(1.0, (SELECT max(score) FROM o) / 2) ORDER BY o.score DESC, norm LIMIT 4""")
def extractive_answer(b):
    return R.answer(b.table("documents"), ["license", "version", "under"])


def units_sql(source: str) -> str:
    """Common tables from `source` (doc_id, text) to u: doc_id, pos and text of each unit. A fold over the lines, with what is held."""
    begins = f"regexp_matches(x.h, '{T.LIST_ITEM}|{T.LINE_HEAD}')"
    held = f"(s.h <> '' AND (x.h = '' OR {begins}))"
    before = f"CASE WHEN {held} THEN list_append(s.u, s.h) ELSE s.u END"
    left = f"CASE WHEN {held} THEN '' ELSE s.h END"
    now = f"trim(({left}) || ' ' || x.h)"
    ends = f"(x.h <> '' AND (suffix(x.h, '.') OR suffix(x.h, '؟') OR suffix(x.h, '!') OR suffix(x.h, ':') OR suffix(x.h, '؛') OR (({left}) = '' AND len(regexp_split_to_array(x.h, '\\s+')) < 6)))"
    step = f"{{'u': CASE WHEN {ends} THEN list_append({before}, {now}) ELSE {before} END, 'h': CASE WHEN {ends} THEN '' ELSE {now} END}}"
    part = lambda x: f"regexp_replace({x}, '([.؟!؛])\\s+(\\D)', '\\1' || chr(1) || '\\2', 'g')"
    return f"""l0 AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS filled FROM {source}),
l1 AS (SELECT doc_id, CASE WHEN len(filled) >= 8 AND len(list_filter(filled, lambda x: len(regexp_split_to_array(x, '\\s+')) <= 3)) > 0.4 * len(filled) THEN [trim(regexp_replace(text, '\\s+', ' ', 'g'))] ELSE list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) END AS lines FROM l0),
l2 AS (SELECT doc_id, list_reduce([{{'u': []::VARCHAR[], 'h': ''}}] || list_transform(list_append(lines, ''), lambda x: {{'u': []::VARCHAR[], 'h': x}}), lambda s, x: {step}).u AS p FROM l1),
l3 AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(p, lambda x: string_split({part(part('x'))}, chr(1)))), lambda x: trim(x)), lambda x: x <> '') AS v FROM l2),
u AS (SELECT doc_id, unnest(range(len(v))) AS pos, unnest(v) AS text FROM l3)"""


@BOOK.add("text_units", f"WITH {units_sql('documents')} SELECT doc_id, pos::INTEGER AS pos, md5(text) AS md5 FROM u")
def text_units(b):
    return b.table("documents").select("doc_id", F.posexplode(T.units(F.col("text"))).alias("pos", "unit")).select("doc_id", "pos", F.md5("unit").alias("md5"))


STOPS = ", ".join(f"'{w}'" for w in sorted(T.FA_STOP | T.EN_STOP))
CUE_COUNT = " + ".join(f"contains(plain, '{c}')::INT" for c in R.CUES)


@BOOK.add("summary_topn", f"""
WITH {units_sql('documents')}, s0 AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(text, '{T.LIST_ITEM}', ''), '{T.GREETING}', ''), ' -–:،,') AS text FROM u),
s1 AS (SELECT *, regexp_split_to_array(trim(text), '\\s+') AS words FROM s0), s2 AS (SELECT doc_id, pos, text FROM s1 WHERE len(words) BETWEEN 6 AND 80 AND NOT regexp_matches(text, '{T.LINE_HEAD}') AND len(list_filter(words, lambda w: NOT regexp_matches(w, '\\p{{L}}'))) <= 0.3 * len(words)),
{quality_sql('s2', 'doc_id, pos')}, s3 AS (SELECT doc_id, pos, text, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS plain FROM q WHERE plausible >= 0.6 AND score >= 0.7),
s4 AS (SELECT *, least(3, {CUE_COUNT}) AS cues, list_distinct(list_filter(string_split(plain, ' '), lambda w: length(w) > 2 AND w NOT IN ({STOPS}) AND NOT regexp_full_match(w, '[0-9]+'))) AS terms,
  row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS m FROM s3),
d AS (SELECT doc_id, w, count(*) AS df FROM (SELECT doc_id, unnest(terms) AS w FROM s4) GROUP BY ALL), f AS (SELECT x.doc_id, x.pos, sum(df) AS f FROM (SELECT doc_id, pos, unnest(terms) AS w FROM s4) x JOIN d USING (doc_id, w) GROUP BY ALL),
s5 AS (SELECT s4.*, round(coalesce(f, 0) / pow(greatest(1, len(terms)), 0.6) * (1 + 0.35 * cues) * (1.25 - 0.4 * k / m), 9) AS weight FROM s4 LEFT JOIN f USING (doc_id, pos)),
s6 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pos DESC) AS r FROM s5)
SELECT doc_id, pos::INTEGER AS pos, md5(CASE WHEN length(text) <= {R.CUT} THEN text ELSE regexp_replace(substring(text, 1, {R.CUT}), '\\s\\S*$', '') || '…' END) AS md5 FROM s6 WHERE r <= 4""")
def summary_topn(b):
    return R.summary(b.table("documents")).select("doc_id", "pos", F.md5("sentence").alias("md5"))


@BOOK.add("passage_recall", """
SELECT item_id, count(*) AS docs FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def passage_recall(b):
    found = R.passages(b.table("benchmark"), b.table("documents").select("doc_id", "text"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("docs"))


def hits_sql(terms: list[str], limit: int = 6, near: str = "SELECT NULL AS chunk_id, NULL AS score WHERE false") -> str:
    """Common tables to hits: the best chunk of each of the best pages for the terms, fused with the hits `near`."""
    chunked = chunk_sql("g", "doc_id, page").replace("h AS (SELECT doc_id, page,", "h AS (SELECT concat_ws('-', doc_id, page + 1, unnest(range(len(l)))) AS chunk_id, doc_id, page,")
    return f"""{PAGES}, {chunked}, {bm25_sql('h', 'chunk_id', terms)}, pool AS (SELECT chunk_id, score FROM k ORDER BY k.score DESC, chunk_id LIMIT {max(5 * limit, 40)}), near AS ({near}),
ranks AS (SELECT chunk_id, 0 AS s, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 AS r FROM pool UNION ALL SELECT chunk_id, 1, row_number() OVER (ORDER BY score DESC, chunk_id) - 1 FROM near),
fused AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM ranks GROUP BY chunk_id ORDER BY 2 DESC, min((s, r)) LIMIT {3 * limit}),
paged AS (SELECT chunk_id, doc_id, page + 1 AS page, text, score, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, chunk_id) AS r FROM fused JOIN h USING (chunk_id)),
hits AS (SELECT chunk_id, doc_id, CAST(page AS INT) AS page, text, round(score, 5) AS score FROM paged WHERE r = 1 ORDER BY paged.score DESC, chunk_id LIMIT {limit})"""


@BOOK.add("chunk_search", f"WITH {hits_sql(TERMS)} SELECT chunk_id, doc_id, page, score FROM hits")
def chunk_search(b):
    """Chunks of all documents, searched by words; the page's best sentences are those of its best hit."""
    return R.search(R.index_chunks(b.table("documents")), TERMS).select("chunk_id", "doc_id", "page", "score")


QUESTION = "Which version of the license is meant, and under what terms?"
ASKED = T.query_terms(QUESTION)
FIRST = "concat_ws('-', vec_id, 1, 0)"
NEAR = f"SELECT {FIRST} AS chunk_id, score FROM h0v WHERE score >= greatest(0.78, (SELECT max(score) FROM h0v) - 0.05)"
SEMANTIC = f"""h0v AS (SELECT * FROM (SELECT vec_id, {FIRST} AS cid, list_inner_product(e, qe) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(qe, qe))) AS score
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 7)) ORDER BY score DESC, cid LIMIT 40)"""
SPLIT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?؟؛])\s+', '\1' || chr(10), 'g'), '\n'), lambda x: trim(x, ' ')), lambda x: length(x) > 10)"
MET = " + ".join(f"CAST(contains(lower(sentence), '{t}') AS INT)" for t in ASKED)


@BOOK.add("question_answer", rf"""
WITH {SEMANTIC}, {hits_sql(ASKED, near=NEAR)}, e AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, chunk_id) AS INT) AS source, doc_id, page, text FROM hits),
s AS (SELECT source, doc_id, page, unnest({SPLIT}) AS sentence FROM e),
n AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(sentence), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), ' ') AS norm FROM s),
t AS (SELECT *, {MET} - CASE WHEN length(sentence) < 40 THEN 0.5 ELSE 0.0 END AS points FROM n WHERE length(norm) >= 15),
o AS (SELECT norm, min((source, doc_id, page, sentence)) AS f, max(points) AS points FROM t WHERE points > 0 GROUP BY norm),
b AS (SELECT f, norm, points FROM o WHERE points >= greatest(1.0, (SELECT max(points) FROM o) / 2) ORDER BY points DESC, norm LIMIT 4)
SELECT f[1] AS source, f[2] AS doc_id, f[3] AS page, f[4] AS sentence, CAST(points AS DOUBLE) AS score FROM b""")
def question_answer(b):
    """A question, answered from the hits by words and vectors in all chunks. A vector stands for the first chunk of the document of its number."""
    first = b.table("embeddings").select(F.concat_ws("-", "vec_id", F.lit(1), F.lit(0)).alias("chunk_id"), "embedding")
    return R.ask(R.index_chunks(b.table("documents")), QUESTION, R.semantic(first, vector(b), 40, "chunk_id"))


MARKS = " OR ".join(f"starts_with(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '{t}')" for t in TERMS)
ESCAPED = "replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@BOOK.add("highlighted", f"""
SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all(text, '\\s+|\\S+'), lambda x: CASE WHEN {MARKS} THEN '<mark>' || {ESCAPED} || '</mark>' ELSE {ESCAPED} END), '')) AS md5 FROM documents""")
def highlighted(b):
    return b.table("documents").select("doc_id", F.md5(T.highlight(F.col("text"), TERMS)).alias("md5"))
