"""The library's tables derived from the driver's: documents by source make workspaces, conversations make messages, events make logs.
Each Spark derivation stands beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich
from ..operators.chunking import chunk_segments
from ..sources.scratch import spread

#: White space, as RE2 writes it.
SQL_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return sql_strip(f"regexp_replace({x}, '{SQL_SPACE}+', ' ', 'g')")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; documents are dealt out to all cores, since all that is done to texts costs more than moving them."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "source AS workspace_id", "concat('doc_', doc_id, '.txt') AS filename", "text", "cast(octet_length(text) AS bigint) AS size",
        "CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'embedded' END AS status",
        "CASE WHEN doc_id % 3 = 0 THEN concat('Summary of ', doc_id) END AS summary",
        "CASE WHEN doc_id % 3 = 0 THEN 'done' WHEN doc_id % 97 = 1 THEN 'pending' END AS summary_status",
        "timestampadd(MINUTE, doc_id, TIMESTAMP'2024-01-01 00:00:00') AS created_at",
    )


DOCUMENTS = """docs AS (SELECT doc_id AS id, source AS workspace_id, 'doc_' || doc_id || '.txt' AS filename, text, strlen(text) AS size,
  CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'embedded' END AS status,
  CASE WHEN doc_id % 3 = 0 THEN 'Summary of ' || doc_id END AS summary,
  CASE WHEN doc_id % 3 = 0 THEN 'done' WHEN doc_id % 97 = 1 THEN 'pending' END AS summary_status,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at FROM documents)"""


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those whose name ends in 2 have the signature of their documents stored."""
    rows = documents(spark, sf_dir).groupBy(F.col("workspace_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    rows = rows.selectExpr("id", "concat('Workspace ', id) AS name", "CASE WHEN right(id, 1) IN ('1', '2') THEN concat('About ', id) END AS summary", "created_at")
    stored = enrich.signatures(documents(spark, sf_dir)).select(F.col("workspace_id").alias("id"), F.when(F.right("workspace_id", F.lit(1)) == "2", F.col("signature")).alias("signature"))
    return rows.join(stored, "id")


WORKSPACES = """ws AS (SELECT workspace_id AS id, 'Workspace ' || workspace_id AS name,
  CASE WHEN right(workspace_id, 1) IN ('1', '2') THEN 'About ' || workspace_id END AS summary, min(created_at) AS created_at FROM docs GROUP BY workspace_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role <> 'system'").selectExpr(
        "concat(conv_id, ':', lpad(cast(turn AS string), 5, '0')) AS id", "concat('src', conv_id % 20) AS workspace_id", "role", "text AS content",
        "timestampadd(MINUTE, turn, TIMESTAMP'2024-01-01 00:00:00') AS created_at",
    )


MESSAGES = """msgs AS (SELECT conv_id || ':' || lpad(turn::VARCHAR, 5, '0') AS id, 'src' || (conv_id % 20) AS workspace_id, role, text AS content,
  TIMESTAMP '2024-01-01' + to_minutes(turn) AS created_at FROM conversations WHERE role <> 'system')"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "documents").count()
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id", f"event_id % {max(1, n)} AS document_id", "concat('src', user_id % 20) AS workspace_id",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level", "event_type AS stage", "props AS message", "ts AS created_at",
    )


LOGS = """logs AS (SELECT event_id AS id, event_id % (SELECT count(*) FROM documents) AS document_id, 'src' || (user_id % 20) AS workspace_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS level, event_type AS stage, props AS message, ts AS created_at FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(
        "doc_id AS document_id", "CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status",
        "CASE WHEN doc_id % 14 = 0 THEN 0 ELSE 5 END AS progress", "CASE WHEN doc_id % 14 NOT IN (0, 7) THEN 'stopped' END AS error",
        "timestampadd(MINUTE, doc_id, TIMESTAMP'2024-01-01 00:00:00') AS updated_at",
    )


JOBS = """jobs AS (SELECT doc_id AS document_id, CASE doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN doc_id % 14 = 0 THEN 0 ELSE 5 END AS progress, CASE WHEN doc_id % 14 NOT IN (0, 7) THEN 'stopped' END AS error,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS updated_at FROM documents)"""


def document_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").where("doc_id % 4 > 0").selectExpr("doc_id AS document_id", "explode(sequence(0, cast(doc_id % 4 AS int) - 1)) AS position")
    return rows.selectExpr("document_id", "position", "concat('Question ', document_id, '.', position) AS question")


DOCUMENT_QUESTIONS = """dq AS (SELECT document_id, position, 'Question ' || document_id || '.' || position AS question
  FROM (SELECT doc_id AS document_id, unnest(range(0, doc_id % 4))::INT AS position FROM documents WHERE doc_id % 4 > 0))"""


# chunks: each document a segment, cut up

NORMAL = f"""normal AS (SELECT doc_id, source, {sql_strip("list_aggregate(list_transform(string_split(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160), ' '), '([{L}])-' || '{S}*' || chr(10) || '{S}*([{L}])', '{BACK}', 'g'), '[➨➔→]', ' ', 'g'), chr(10)), lambda line: " + sql_collapse("line") + "), 'string_agg', chr(10))").replace("{L}", r"\p{L}\p{N}_").replace("{S}", SQL_SPACE).replace("{BACK}", r"\1\2")} AS t FROM documents)"""

#: The cuts of each normalised text: start and end by code point, one row a window.
CUTS = """cuts AS (
  SELECT doc_id, 0 AS n, 0 AS start, 0 AS stop, false AS done, t FROM normal WHERE t <> ''
  UNION ALL
  SELECT doc_id, n + 1, nstart, nstop, nstop >= length(t), t FROM (
    SELECT *, CASE WHEN cut > nstart + 700 THEN cut ELSE e END AS nstop FROM (
      SELECT *, CASE WHEN e >= length(t) THEN -1 WHEN nl > nstart + 700 THEN nl ELSE sp END AS cut FROM (
        SELECT *, CASE WHEN strpos(reverse(w), chr(10)) = 0 THEN -1 ELSE e - strpos(reverse(w), chr(10)) END AS nl, CASE WHEN strpos(reverse(w), ' ') = 0 THEN -1 ELSE e - strpos(reverse(w), ' ') END AS sp FROM (
          SELECT *, substring(t, nstart + 1, e - nstart) AS w FROM (
            SELECT *, least(nstart + 1400, length(t)) AS e FROM (
              SELECT doc_id, n, t, CASE WHEN n = 0 THEN 0 WHEN strpos(substring(t, s + 1, least(s + 210, length(t)) - s), ' ') > 0 THEN s + strpos(substring(t, s + 1, least(s + 210, length(t)) - s), ' ') ELSE s END AS nstart
              FROM (SELECT *, greatest(stop - 210, start + 1) AS s FROM cuts WHERE NOT done)))))))),
raw AS (SELECT doc_id, n, """ + sql_strip("substring(t, start + 1, stop - start)") + """ AS p FROM cuts WHERE n > 0),
numbered AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS c, lead(p) OVER (PARTITION BY doc_id ORDER BY n) AS after FROM raw WHERE p <> ''),
pieces AS (SELECT doc_id, i::INT AS i, CASE WHEN c > 1 AND i = c - 2 AND length(after) < 420 THEN p || chr(10) || chr(10) || after ELSE p END AS piece FROM numbered WHERE NOT (c > 1 AND i = c - 1 AND length(p) < 420))"""


def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one segment. Segments are dealt out by document before their text is worked on, so they aren't spread first."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "1 AS page_number", "0 AS order", "'text' AS content_type", "text", "left(text, 200) AS page_context", "array(source, lang) AS breadcrumbs", "cast(array() AS array<struct<x0:double,y0:double,x1:double,y1:double>>) AS bbox", "'' AS image_path", "'' AS image_kind")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents (O41 to O45), without vectors."""
    return chunk_segments(text_segments(spark, sf_dir)).select(F.element_at("breadcrumbs", 1).alias("workspace_id"), "doc_id", "chunk_index", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("embed_text").alias("text"), "content_type", "page_number", "page_context", "breadcrumbs", F.nullif("image_path", F.lit("")).alias("image_path"))


def with_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows (doc_id, chunk_index and others) with a document's vector at its first chunk; vectors that questions have are left out.
    Where there are many vectors rows are dealt out by document, so wide ones are better written before."""
    own = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    vectors = read(spark, sf_dir, "embeddings").join(own, "vec_id", "left_anti").select(F.col("vec_id").alias("_vec"), "embedding")
    first = (F.col("doc_id") == F.col("_vec")) & (F.col("chunk_index") == 0)
    return rows.join(vectors, first, "left").select(*rows.columns, "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pieces with vectors."""
    return with_vectors(spark, sf_dir, pieces(spark, sf_dir))


CHUNKS = f"""{NORMAL},
{CUTS},
chunks AS (SELECT source AS workspace_id, doc_id, i AS chunk_index, piece AS text, lang, left(documents.text, 200) AS page_context, CASE WHEN i = 0 THEN embedding END AS embedding
  FROM pieces JOIN documents USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id AND vec_id NOT IN (SELECT item_id FROM benchmark))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage asked of every workspace (a few, from one row that lists them); every tenth is a word that no text has."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    names = read(spark, sf_dir, "documents").agg(F.sort_array(F.collect_set("source")).alias("_names"))
    rows = read(spark, sf_dir, "benchmark").selectExpr("item_id", "CASE WHEN item_id % 10 = 0 THEN concat('zzqxv', item_id) ELSE text END AS question").join(vectors, "item_id", "left")
    return rows.join(F.broadcast(names)).select("item_id", "question", "embedding", F.posexplode("_names").alias("_w", "workspace_id")).select((F.col("item_id") * 1000 + F.col("_w")).alias("q_id"), "workspace_id", "question", "embedding")


QUESTIONS = """places AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS w FROM (SELECT DISTINCT source FROM documents)),
questions AS (SELECT item_id * 1000 + w AS q_id, source AS workspace_id, CASE WHEN item_id % 10 = 0 THEN 'zzqxv' || item_id ELSE text END AS question, embedding
  FROM benchmark CROSS JOIN places LEFT JOIN embeddings ON vec_id = item_id)"""

#: Tokens of a text as a list.
TOKENS = r"""flatten(list_transform(regexp_extract_all(lower(translate({0}, 'İI', 'iı')), '[\p{{L}}\p{{N}}_]+(?:[-./][\p{{L}}\p{{N}}_]+)*'),
  lambda w: CASE WHEN regexp_matches(w, '[-./_]') THEN list_concat([w], list_filter(string_split_regex(w, '[-./_]+'), lambda p: p <> '' AND p <> w)) ELSE [w] END))"""

INDEX = f"""{CHUNKS}, {QUESTIONS},
toks AS (SELECT workspace_id, doc_id, chunk_index, {TOKENS.format("text")} AS t FROM chunks),
each AS (SELECT workspace_id, doc_id, chunk_index, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM toks WHERE len(t) > 0),
post AS (SELECT workspace_id, doc_id, chunk_index, dl, term, count(*) AS tf, min(pos) AS first_pos FROM each GROUP BY ALL),
stats AS (SELECT workspace_id, count(*) AS n_chunks, avg(len(t)) AS avgdl FROM toks GROUP BY 1),
vocab AS (SELECT workspace_id, term, count(*) AS df, min({{'d': doc_id, 'c': chunk_index, 'p': first_pos}}) AS f FROM post GROUP BY ALL),
idfs AS (SELECT workspace_id, term, df, ln((n_chunks - df + 0.5) / (df + 0.5) + 1) AS idf, f FROM vocab JOIN stats USING (workspace_id)),
qtok AS (SELECT q_id, workspace_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT q_id, workspace_id, {TOKENS.format("question")} AS t FROM questions)),
cand AS (
  SELECT q_id, q.workspace_id, pos, token, v.term, idf, row_number() OVER (PARTITION BY q_id, pos ORDER BY (v.term = token) DESC, f) AS rn
  FROM qtok q JOIN idfs v ON v.workspace_id = q.workspace_id AND (v.term = token OR (length(token) >= 4 AND length(v.term) >= 4 AND left(v.term, 4) = left(token, 4)))),
expanded AS (SELECT q_id, workspace_id, pos, token, term, idf FROM cand WHERE rn <= 24),
scores AS (
  SELECT q_id, e.workspace_id, doc_id, chunk_index, round(sum(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (dl / avgdl))))), 9) AS bm25
  FROM expanded e JOIN post p ON p.workspace_id = e.workspace_id AND p.term = e.term JOIN stats s ON s.workspace_id = e.workspace_id GROUP BY ALL),
words AS (
  SELECT q_id, c.doc_id, c.chunk_index, coalesce(bm25, 0.0) AS bm25, row_number() OVER (PARTITION BY q_id ORDER BY coalesce(bm25, 0.0) DESC, c.doc_id, c.chunk_index) - 1 AS bm25_rank
  FROM questions q JOIN chunks c USING (workspace_id) LEFT JOIN scores s USING (q_id, doc_id, chunk_index) QUALIFY bm25_rank < 8)"""

#: Nearest chunks, with the norms' product raised by a billionth (exact) and without (near).
_COSINE = "list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
DENSE = f"""sims AS (
  SELECT q_id, doc_id, chunk_index, round({_COSINE} + 1e-9), 9) AS sim, round({_COSINE}), 9) AS cosine
  FROM questions q JOIN chunks c USING (workspace_id) WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL),
exact AS (SELECT q_id, doc_id, chunk_index, sim, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, doc_id, chunk_index) - 1 AS dense_rank FROM sims QUALIFY dense_rank < 8),
near AS (
  SELECT q_id, doc_id, chunk_index, CASE WHEN cosine >= 1.0 THEN 0.0 ELSE round(cosine, 4) + 0.0 END AS score,
    row_number() OVER (PARTITION BY q_id ORDER BY cosine DESC, doc_id, chunk_index) - 1 AS dense_rank FROM sims QUALIFY dense_rank < 8)"""

FUSED = """fused AS (
  SELECT q_id, doc_id, chunk_index, score, dense_rank, bm25, bm25_rank, rrf, row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST) - 1 AS fused_rank
  FROM (SELECT *, round(coalesce(1.0 / (15 + dense_rank + 1), 0) + coalesce(1.0 / (15 + bm25_rank + 1), 0), 12) AS rrf FROM near FULL JOIN words USING (q_id, doc_id, chunk_index))),
verdict AS (
  SELECT q_id, coalesce((SELECT max(score) FROM near n WHERE n.q_id = q.q_id), 0.0) AS top_dense, coalesce((SELECT max(bm25) FROM words w WHERE w.q_id = q.q_id), 0.0) AS top_bm25 FROM questions q),
passing AS (SELECT *, top_dense >= 0.3 OR top_bm25 >= 1.0 AS passed FROM verdict),
qual AS (
  SELECT q_id, count(*) FILTER (WHERE dense_rank IS NOT NULL AND bm25_rank IS NOT NULL AND (coalesce(score, 0) >= 0.3 OR coalesce(bm25, 0) >= 1.0)) AS qualifying
  FROM fused WHERE fused_rank < 5 GROUP BY 1),
parts AS (
  SELECT q_id, top_dense, top_bm25, qualifying, greatest(0, least(1, (top_dense - 0.15) / 0.45)) AS d, greatest(0, least(1, ln(1 + greatest(top_bm25, 0)) / ln(6))) AS b, least(qualifying / 5.0, 1) AS c
  FROM passing JOIN qual USING (q_id) WHERE passed),
conf AS (
  SELECT q_id, round_even(round(least(100, greatest(92 * d + 8 * c, 64 * b + 28 * c + 8 * d, CASE WHEN d <= 0 AND b >= 0.5 THEN 74 ELSE 0 END, 55)), 9), 0)::DOUBLE AS confidence FROM parts),
levels AS (SELECT q_id, confidence, CASE WHEN confidence >= 85 THEN 'yüksek' WHEN confidence >= 65 THEN 'orta' WHEN confidence >= 45 THEN 'dolaylı' ELSE 'yetersiz' END AS level FROM conf)"""


# page blocks: each line of a text is a block, forty to a page, under a header that every page has

_PAGE_BLOCKS = "explode(concat(array(named_struct('no', 0, 'text', concat('Report ', source))), transform(lines, (x, i) -> named_struct('no', (page - 1) * 40 + i + 1, 'text', x)))) AS b"


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "source", "split(text, '\n') AS l").selectExpr("doc_id", "source", "l", "explode(sequence(1, cast(ceil(size(l) / 40.0) AS int))) AS page")
    rows = rows.selectExpr("doc_id", "source", "page", "slice(l, (page - 1) * 40 + 1, 40) AS lines").selectExpr("doc_id", "page", _PAGE_BLOCKS)
    rows = rows.selectExpr("doc_id", "page", "b.no AS block_no", "b.text AS text", "CASE WHEN b.no = 0 THEN 20.0D ELSE 100.0D + 14 * ((b.no - 1) % 40) END AS y0")
    rows = rows.selectExpr("*", "named_struct('x0', 72.0D, 'y0', y0, 'x1', 540.0D, 'y1', y0 + 12) AS bbox", "CASE WHEN block_no % 40 = 1 THEN 16.0D ELSE 11.0D END AS size", "CASE WHEN (doc_id + block_no) % 9 = 0 THEN 'Courier' ELSE 'Helvetica' END AS font", "CASE WHEN block_no % 7 = 0 THEN 16 ELSE 0 END AS flags")
    return rows.selectExpr("doc_id", "page", "block_no", "0 AS type", "bbox", "text", "size", "array(named_struct('spans', array(named_struct('text', left(text, 5), 'size', size, 'font', font, 'flags', flags), named_struct('text', substring(text, 6), 'size', 10.0D, 'font', font, 'flags', 0)))) AS lines")


PAGE_BLOCKS = """plines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS block_no FROM documents),
blocks AS (SELECT *, CASE WHEN block_no = 0 THEN 20.0 ELSE 100.0 + 14 * ((block_no - 1) % 40) END::DOUBLE AS y0, CASE WHEN block_no % 40 = 1 THEN 16.0 ELSE 11.0 END::DOUBLE AS size,
  CASE WHEN (doc_id + block_no) % 9 = 0 THEN 'Courier' ELSE 'Helvetica' END AS font, CASE WHEN block_no % 7 = 0 THEN 16 ELSE 0 END AS flags
  FROM (SELECT doc_id, ((block_no - 1) // 40 + 1)::INT AS page, block_no, text FROM plines
    UNION ALL SELECT DISTINCT doc_id, ((block_no - 1) // 40 + 1)::INT, 0, 'Report ' || source FROM plines))"""


def pages_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "explode(sequence(1, cast(ceil(size(split(text, '\n')) / 40.0) AS int))) AS page")
    return rows.selectExpr("doc_id", "page", "612.0D AS width", "792.0D AS height")


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table over the lines from 142 to 170 of every page of every third document."""
    cells = "array(array(cast(doc_id AS string), 'a|b'), array('x'), array('', ' '), array('line\nbreak', 'z', 'w'))"
    return pages_geom(spark, sf_dir).where("doc_id % 3 = 0").selectExpr("doc_id", "page", "0 AS table_no", "named_struct('x0', 72.0D, 'y0', 142.0D, 'x1', 540.0D, 'y1', 170.0D) AS bbox", f"{cells} AS rows")


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages_geom(spark, sf_dir).where("doc_id % 4 > 0").selectExpr("doc_id", "page", "explode(sequence(0, cast(doc_id % 4 AS int))) AS image_no")
    return rows.selectExpr("doc_id", "page", "image_no", "cast((doc_id + image_no) % 3 AS int) AS xref", "named_struct('x0', 0.0D, 'y0', 0.0D, 'x1', 50.0D * (1 + (doc_id + image_no) % 9), 'y1', 40.0D * (1 + doc_id % 7)) AS bbox")


PAGE_IMAGES = """imgs AS (SELECT doc_id, page, image_no, (doc_id + image_no) % 3 AS xref, 50.0 * (1 + (doc_id + image_no) % 9) AS w, 40.0 * (1 + doc_id % 7) AS h
  FROM (SELECT DISTINCT doc_id, page, unnest(range(0, doc_id % 4 + 1)) AS image_no FROM (SELECT DISTINCT doc_id, page FROM blocks) WHERE doc_id % 4 > 0))"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "posexplode(split(text, ' ')) AS (word_no, text)")
    return rows.selectExpr("cast(doc_id AS string) AS image_id", "word_no", "text", "CASE WHEN word_no % 10 = 0 THEN -1.0D ELSE cast(60 + doc_id % 40 AS double) END AS conf", "0 AS left", "0 AS top", "cast(5 * length(text) AS int) AS width", "10 AS height", "cast(500 + doc_id AS int) AS img_w", "1000 AS img_h")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line a segment; every fourth a table, every third of the rest an equation."""
    rows = read(spark, sf_dir, "documents").selectExpr("doc_id", "source", "posexplode(split(text, '\n')) AS (order, text)")
    return rows.selectExpr("doc_id", "cast(order div 40 AS int) + 1 AS page_number", "order", "CASE WHEN order % 4 = 3 THEN 'table' WHEN order % 4 = 2 THEN 'equation' ELSE 'text' END AS content_type", "text", "concat('ctx', order div 3) AS page_context", "array(source) AS breadcrumbs", "cast(array() AS array<struct<x0:double,y0:double,x1:double,y1:double>>) AS bbox", "'' AS image_path", "'' AS image_kind")


SEGMENTS = """segs AS (SELECT doc_id, o::INT AS o, (o // 40)::INT + 1 AS page_number, CASE WHEN o % 4 = 3 THEN 'table' WHEN o % 4 = 2 THEN 'equation' ELSE 'text' END AS kind, text, 'ctx' || (o // 3) AS ctx
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS o FROM documents))"""
