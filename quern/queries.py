"""One query for each operator of the library, over whole tables, with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import chunking, citations, dense, enrich, fusion, layout, lexical, ops
from .plans import fixtures as fx
from .plans.answer import answer_batch
from .sources import store
from .sources.event_log import EventLog, LogLayout
from .sources.keyed_store import ChunkStore, Layout, PostingIndex
from .sources.scratch import materialize, scratch
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# lexical


def _index(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Chunks (their keys and the columns named) and their postings, packed, written once side by side: a text that no one asks for is never
    written, and vectors come to the keys of what is written."""
    own = [c for c in columns if c != "embedding"]
    both = materialize(lexical.packed_postings(fx.pieces(spark, sf_dir), *own), "postings")
    chunks = both.select(*lexical.CHUNK, *own)
    return fx.with_vectors(spark, sf_dir, chunks) if "embedding" in columns else chunks, both.select(*lexical.CHUNK, "dl", "terms")


@_query(f"SELECT doc_id, array_to_string({fx.TOKENS.format('text')}, ' ') AS tokens, len({fx.TOKENS.format('text')}) AS n FROM documents")
def o53_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import tokenize

    return fx.read(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("t")).select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n"))


@_query(_with(fx.INDEX) + "SELECT workspace_id, doc_id, chunk_index, term, tf, first_pos, dl FROM post")
def o54_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(fx.pieces(spark, sf_dir)).select("workspace_id", "doc_id", "chunk_index", "term", "tf", F.col("first_pos").cast("long").alias("first_pos"), F.col("dl").cast("long").alias("dl"))


@_query(_with(fx.INDEX) + "SELECT workspace_id, term, df, round(idf, 9) AS idf, n_chunks, round(avgdl, 6) AS avgdl FROM idfs JOIN stats USING (workspace_id)")
def o55_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = _index(spark, sf_dir)
    stats = lexical.corpus_stats(chunks, index)
    return lexical.vocabulary(index, stats).join(stats, "workspace_id").select("workspace_id", "term", "df", F.round("idf", 9).alias("idf"), "n_chunks", F.round("avgdl", 6).alias("avgdl"))


@_query(_with(fx.INDEX) + "SELECT q_id, workspace_id, pos, token, term, round(idf, 9) AS idf FROM expanded")
def o56_expand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = _index(spark, sf_dir)
    vocab = lexical.vocabulary(index, lexical.corpus_stats(chunks, index))
    return lexical.expand_terms(fx.questions(spark, sf_dir), vocab).select("q_id", "workspace_id", F.col("pos").cast("long").alias("pos"), "token", "term", F.round("idf", 9).alias("idf"))


@_query(_with(fx.INDEX) + "SELECT q_id, workspace_id, doc_id, chunk_index, bm25 FROM scores")
def o57_bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = _index(spark, sf_dir)
    stats = materialize(lexical.corpus_stats(chunks, index), "stats")
    expanded = materialize(lexical.expand_terms(fx.questions(spark, sf_dir), lexical.vocabulary(index, stats)), "expanded")
    return lexical.bm25_scores(expanded, index, stats).select("q_id", "workspace_id", "doc_id", "chunk_index", "bm25")


@_query(_with(fx.INDEX) + "SELECT q_id, doc_id, chunk_index, bm25, bm25_rank::INT AS bm25_rank FROM words")
def o58_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = _index(spark, sf_dir)
    return lexical.search(fx.questions(spark, sf_dir), chunks, index=index).select("q_id", "doc_id", "chunk_index", "bm25", "bm25_rank")


def _pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions, chunks and the scores that bounds leave."""
    chunks, index = _index(spark, sf_dir)
    questions, stats = fx.questions(spark, sf_dir), materialize(lexical.corpus_stats(chunks, index), "stats")
    expanded = materialize(lexical.expand_terms(questions, lexical.vocabulary(index, stats)), "expanded")
    return questions, chunks, materialize(lexical.pruned_scores(expanded, index, stats, k=DEFAULT.bm25_k), "scores")


@_query(_with(fx.INDEX) + "SELECT q_id, doc_id, chunk_index, bm25, bm25_rank::INT AS bm25_rank FROM words")
def o58_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of o58, from the blocks that can hold them."""
    questions, chunks, scores = _pruned(spark, sf_dir)
    return lexical.bm25_topk(questions, chunks, scores.where("doc_id is not null"))


@_query()
def o58_scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a question and a chunk with one of its terms there are, and how many o58_block_max scores."""
    counts = _pruned(spark, sf_dir)[-1].agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    return counts.withColumn("share", F.round(F.col("scored") / F.col("pairs"), 4))


@_query(_with(fx.INDEX) + "SELECT workspace_id, doc_id, chunk_index, term, CASE WHEN workspace_id IN ('src1', 'src2') THEN tf * 2 ELSE tf END AS tf FROM post")
def o59_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two workspaces changed (their texts now stand twice in each chunk); only their postings are derived anew."""
    chunks = fx.pieces(spark, sf_dir)
    changed = fx.documents(spark, sf_dir).select("workspace_id").where("workspace_id IN ('src1', 'src2')").distinct()
    new = chunks.withColumn("text", F.when(F.col("workspace_id").isin("src1", "src2"), F.concat_ws("\n", "text", "text")).otherwise(F.col("text")))
    return lexical.refresh_index(lexical.postings(chunks), new, changed).select("workspace_id", "doc_id", "chunk_index", "term", "tf")


_CHANGED = """now AS (SELECT workspace_id, doc_id, chunk_index, CASE WHEN workspace_id = 'src1' THEN text || chr(10) || text ELSE text END AS text FROM chunks WHERE NOT (workspace_id = 'src2' AND doc_id % 2 = 0)),
tok AS (SELECT workspace_id, doc_id, chunk_index, """ + fx.TOKENS.format("text") + """ AS w FROM now)"""


@_query(_with(fx.CHUNKS, _CHANGED) + """SELECT workspace_id, term, count(DISTINCT (doc_id, chunk_index)) AS df, count(*) AS tf, n_chunks, round(tokens / n_chunks, 6) AS avgdl
FROM (SELECT workspace_id, doc_id, chunk_index, unnest(w) AS term FROM tok) JOIN (SELECT workspace_id, count(*) AS n_chunks, sum(len(w)) AS tokens FROM tok GROUP BY 1) USING (workspace_id) GROUP BY ALL""")
def o59_versioned_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all workspaces; then src1's texts stand twice and src2 loses documents, and these two alone are refreshed. Terms with
    their chunks and occurrences, as from scratch."""
    chunks = materialize(fx.pieces(spark, sf_dir).select("workspace_id", "doc_id", "chunk_index", "text"), "chunks")
    index = PostingIndex(spark, scratch(spark, "index"))
    index.refresh(chunks, chunks.select("workspace_id"), "all", 0)
    text = F.when(F.col("workspace_id") == "src1", F.concat_ws("\n", "text", "text")).otherwise(F.col("text"))
    now = chunks.where("NOT (workspace_id = 'src2' AND doc_id % 2 = 0)").withColumn("text", text)
    index.refresh(now, spark.createDataFrame([("src1",), ("src2",)], "workspace_id string"), "all", 1)
    terms = index.postings().groupBy("workspace_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    return terms.join(index.stats(), "workspace_id").withColumn("avgdl", F.round("avgdl", 6))


# dense


@_query(_with(fx.CHUNKS, fx.QUESTIONS, fx.DENSE) + "SELECT q_id, doc_id, chunk_index, round(sim, 6) + 0.0 AS sim, dense_rank::INT AS dense_rank FROM exact")
def o51_exact_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.exact_cosine(fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@_query(_with(fx.CHUNKS, fx.QUESTIONS, fx.DENSE) + "SELECT q_id, doc_id, chunk_index, score, dense_rank::INT AS dense_rank FROM near")
def o50_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.dense_topk(fx.questions(spark, sf_dir), fx.chunks(spark, sf_dir))


@_query()
def o52_approx_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.approx_topk(fx.questions(spark, sf_dir), materialize(fx.chunks(spark, sf_dir).where("embedding IS NOT NULL"), "chunks"))


@_query()
def o52_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of o51's rows the share that o52 has, and of all pairs the share that it scores whole."""
    questions, chunks = fx.questions(spark, sf_dir), materialize(fx.chunks(spark, sf_dir).where("embedding IS NOT NULL"), "chunks")
    found = materialize(dense.bounded_search(questions, chunks), "found")
    counts = found.agg(F.sum("pairs").alias("pairs"), F.sum("scored").alias("scored"), F.count(F.when(F.col("sure"), 1)).alias("sure"))
    return dense.recall(found.where("doc_id is not null"), dense.exact_cosine(questions, chunks)).join(counts)


_COUNTED = "aeiı"


@_query(_with(fx.CHUNKS) + "SELECT doc_id, chunk_index, " + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::FLOAT AS c{i}" for i, c in enumerate(_COUNTED)) + " FROM chunks")
def o48_embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's vector: how often it has each of four letters."""
    import numpy as np

    counted = _COUNTED
    rows = dense.embed_chunks(fx.pieces(spark, sf_dir).select("doc_id", "chunk_index", "text"), lambda texts: np.array([[t.count(c) for c in counted] for t in texts], np.float32))
    return rows.select("doc_id", "chunk_index", *(F.get("embedding", F.lit(i)).alias(f"c{i}") for i in range(len(counted))))


@_query("SELECT any_value(len(embedding))::INT AS dim, 'm1' AS model, min(len(embedding)) AS low, max(len(embedding)) AS high, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL")
def o49_check_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the vectors claims the collection, the second is held against it."""
    vectors, path = spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scratch(spark, "collection")
    dense.claim_collection(vectors.where("vec_id % 2 = 0"), path, "m1")
    found = dense.claim_collection(vectors.where("vec_id % 2 = 1"), path, "m1")
    stats = vectors.where("embedding IS NOT NULL").agg(F.min(F.size("embedding")).cast("long").alias("low"), F.max(F.size("embedding")).cast("long").alias("high"), F.count(F.lit(1)).alias("n"))
    return stats.select(F.lit(found["dim"]).alias("dim"), F.lit(found["model"]).alias("model"), "low", "high", "n")


# fusion


def _channels(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    questions, (chunks, index) = fx.questions(spark, sf_dir), _index(spark, sf_dir, "embedding", *columns)
    near = materialize(dense.dense_topk(questions, chunks), "near")
    return questions, chunks, near, materialize(lexical.search(questions, chunks, index=index), "words")


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + "SELECT q_id, doc_id, chunk_index, dense_rank::INT AS dense_rank, bm25_rank::INT AS bm25_rank, round(rrf, 9) AS rrf, fused_rank::INT AS fused_rank FROM fused")
def o60_rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, near, words = _channels(spark, sf_dir)
    return fusion.rrf_fuse(near, words).select("q_id", "doc_id", "chunk_index", "dense_rank", "bm25_rank", F.round("rrf", 9).alias("rrf"), "fused_rank")


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + "SELECT q_id, top_dense, top_bm25, passed, CASE WHEN NOT passed THEN round(100 * top_dense, 1) END AS confidence, CASE WHEN NOT passed THEN 'yetersiz' END AS level FROM passing")
def o61_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, _, near, words = _channels(spark, sf_dir)
    return fusion.guard(questions, near, words)


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + "SELECT q_id, qualifying::INT AS qualifying FROM qual")
def o62_qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, near, words = _channels(spark, sf_dir)
    return fusion.qualifying(fusion.rrf_fuse(near, words))


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + "SELECT q_id, qualifying::INT AS qualifying, confidence, level FROM levels JOIN qual USING (q_id)")
def o63_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, _, near, words = _channels(spark, sf_dir)
    signals = fusion.guard(questions, near, words).where("passed").select("q_id", "top_dense", "top_bm25").join(fusion.qualifying(fusion.rrf_fuse(near, words)), "q_id")
    return fusion.confidence(signals).select("q_id", "qualifying", "confidence", "level")


def _hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The chunks of each question's context with the columns named."""
    _, chunks, near, words = _channels(spark, sf_dir, *columns)
    context = fusion.rrf_fuse(near, words).where("fused_rank < 5").withColumnRenamed("fused_rank", "rank")
    return context.join(chunks.select("doc_id", "chunk_index", *columns), ["doc_id", "chunk_index"])


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + """SELECT q_id, string_agg('doc_' || doc_id || '.txt=' || n || ' parça', ';' ORDER BY first) AS sources
FROM (SELECT q_id, doc_id, min(fused_rank) AS first, count(*) AS n FROM fused WHERE fused_rank < 5 GROUP BY ALL) GROUP BY q_id""")
def o64_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.sources(_hits(spark, sf_dir, "name"))
    return rows.select("q_id", F.array_join(F.transform("sources", lambda s: F.concat(s["label"], F.lit("="), s["meta"])), ";").alias("sources"))


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + """SELECT q_id, fused_rank::INT AS n, doc_id || ':' || chunk_index AS id, round(coalesce(score, 0), 3) + 0.0 AS dense, round(coalesce(bm25, 0), 3) + 0.0 AS bm25 FROM fused WHERE fused_rank < 5""")
def o65_chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.chunk_scores(_hits(spark, sf_dir)).select("q_id", F.posexplode("chunk_scores").alias("n", "s")).select("q_id", "n", "s.id", "s.dense", "s.bm25")


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + """SELECT q_id, md5(string_agg('[doc_' || f.doc_id || '.txt, sayfa 1, parça ' || (f.chunk_index + 1) || ']' || chr(10) || '[Section: ' || workspace_id || ' > ' || lang || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY fused_rank)) AS context
FROM fused f JOIN chunks c ON c.doc_id = f.doc_id AND c.chunk_index = f.chunk_index WHERE fused_rank < 5 GROUP BY q_id""")
def o66_assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.assemble_context(_hits(spark, sf_dir, "name", "page_number", "content_type", "breadcrumbs", "image_path", "text")).select("q_id", F.md5("context").alias("context"))


@_query(_with(fx.CHUNKS, fx.QUESTIONS, fx.JOBS) + """SELECT q_id, CASE WHEN (SELECT count(*) FROM jobs WHERE status IN ('pending', 'running')) > 0 THEN 'busy' ELSE 'empty' END AS error
FROM questions WHERE (SELECT count(*) FROM jobs WHERE status IN ('pending', 'running')) > 0 OR workspace_id NOT IN (SELECT workspace_id FROM chunks)""")
def o67_no_corpus_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.no_corpus_check(fx.questions(spark, sf_dir), fx.pieces(spark, sf_dir), fx.jobs(spark, sf_dir))


@_query(_with(fx.INDEX, fx.DENSE, fx.FUSED) + """SELECT q_id, fused_rank::INT AS rank, doc_id, chunk_index, coalesce(score, 0) AS score, coalesce(bm25, 0) AS bm25, true AS passed, confidence, level
FROM levels JOIN fused USING (q_id) WHERE fused_rank < 5
UNION ALL SELECT q_id, NULL, NULL, NULL, NULL, NULL, false, round(100 * top_dense, 1), 'yetersiz' FROM passing WHERE NOT passed""")
def o68_answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, index = _index(spark, sf_dir, "embedding")
    return answer_batch(fx.questions(spark, sf_dir), chunks, index=index)


# operational tables


@_query(_with(fx.DOCUMENTS, fx.WORKSPACES, fx.MESSAGES) + "SELECT id, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, strftime((SELECT max(created_at) FROM msgs m WHERE m.workspace_id = ws.id), '%Y-%m-%d %H:%M:%S') AS last_message_at FROM ws")
def o75_list_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.list_workspaces(fx.workspaces(spark, sf_dir), fx.messages(spark, sf_dir)).select("id", "name", _time("created_at"), _time("last_message_at"))


@_query("SELECT DISTINCT 'u' || user_id AS id, 'user' || user_id AS username, CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS user_type FROM events")
def o76_list_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("concat('u', user_id) AS id", "concat('user', user_id) AS username", "md5(cast(user_id AS string)) AS password_hash", "CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS user_type", "TIMESTAMP'2024-01-01 00:00:00' AS created_at").distinct()
    return ops.list_users(users).drop("created_at")


@_query(_with(fx.MESSAGES) + """SELECT workspace_id, id, role, content, n > 10 AS has_more FROM (
SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER (PARTITION BY workspace_id) AS n FROM msgs) WHERE rn <= 10""")
def o77_last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_messages(fx.messages(spark, sf_dir)).drop("created_at")


@_query(_with(fx.MESSAGES) + """, page AS (SELECT * FROM msgs WHERE workspace_id = 'src3' AND (created_at < TIMESTAMP '2024-01-01 00:04:00' OR (created_at = TIMESTAMP '2024-01-01 00:04:00' AND id < '5')) ORDER BY created_at DESC, id DESC LIMIT 21)
SELECT id, role, content, (SELECT count(*) FROM page) > 20 AS has_more FROM (SELECT * FROM page ORDER BY created_at DESC, id DESC LIMIT 20)""")
def o78_messages_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.messages_before(fx.messages(spark, sf_dir), "src3", "2024-01-01T00:04:00Z", "5", 20).drop("created_at")


@_query(_with(fx.DOCUMENTS, fx.DOCUMENT_QUESTIONS, fx.JOBS, fx.LOGS) + """SELECT id, filename, docs.status AS status, coalesce((SELECT string_agg(question, '|' ORDER BY position) FROM dq WHERE document_id = docs.id), '') AS questions,
  jobs.status AS job_status, progress, error AS job_error, (SELECT count(*) FROM (SELECT 1 FROM logs WHERE logs.document_id = docs.id LIMIT 200)) AS n_logs
FROM docs JOIN jobs ON jobs.document_id = docs.id""")
def o79_document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.document_detail(fx.documents(spark, sf_dir), fx.jobs(spark, sf_dir), fx.document_questions(spark, sf_dir), fx.logs(spark, sf_dir))
    return rows.select("id", "filename", "status", F.array_join("questions", "|").alias("questions"), "job_status", "progress", "job_error", F.size("logs").cast("long").alias("n_logs"))


@_query(_with(fx.DOCUMENTS, fx.WORKSPACES, fx.MESSAGES) + "SELECT id, name, (SELECT count(*) FROM docs WHERE workspace_id = ws.id) AS doc_count, (SELECT count(*) FROM msgs WHERE workspace_id = ws.id) AS message_count FROM ws")
def o80_workspace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.workspace_counts(fx.workspaces(spark, sf_dir), fx.documents(spark, sf_dir), fx.messages(spark, sf_dir))


@_query(_with(fx.DOCUMENTS, fx.WORKSPACES, fx.LOGS) + """, hit AS (SELECT logs.*, name FROM logs JOIN ws ON ws.id = logs.workspace_id WHERE level = 'warning')
SELECT id, workspace_id, name AS workspace_name, level, stage, message, (SELECT count(*) FROM hit) AS total, greatest(1, ceil((SELECT count(*) FROM hit) / 50.0))::BIGINT AS pages
FROM hit ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50""")
def o81_qa_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.qa_log_page(fx.logs(spark, sf_dir), fx.workspaces(spark, sf_dir), page=2, level="warning").drop("created_at")


@_query(_with(fx.DOCUMENTS, fx.WORKSPACES, fx.MESSAGES) + "SELECT 'workspaces' AS kind, count(*) AS n FROM ws UNION ALL SELECT 'documents', count(*) FROM docs UNION ALL SELECT 'messages', count(*) FROM msgs")
def o82_service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.service_counts(fx.workspaces(spark, sf_dir), fx.documents(spark, sf_dir), fx.messages(spark, sf_dir))


@_query(_with(fx.DOCUMENTS, fx.JOBS) + "SELECT document_id, workspace_id FROM jobs JOIN docs ON docs.id = document_id WHERE (jobs.status = 'pending' AND updated_at < TIMESTAMP '2024-01-01 08:00:00') OR (jobs.status = 'failed' AND error IS NULL AND progress = 0)")
def o83_recoverable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recoverable_jobs(fx.jobs(spark, sf_dir), fx.documents(spark, sf_dir), "2024-01-01T08:00:00Z")


@_query(_with(fx.JOBS) + "SELECT document_id, CASE WHEN status IN ('pending', 'running') THEN 'failed' ELSE status END AS status FROM jobs")
def o83_reset_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reset_interrupted(fx.jobs(spark, sf_dir)).select("document_id", "status")


@_query(_with(fx.DOCUMENTS, fx.JOBS) + "SELECT document_id, workspace_id FROM jobs JOIN docs ON docs.id = document_id WHERE workspace_id <> 'src0' AND jobs.status IN ('pending', 'running')")
def o83_rival_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rival_jobs(fx.jobs(spark, sf_dir), fx.documents(spark, sf_dir), "src0")


@_query(_with(fx.DOCUMENTS, fx.WORKSPACES) + """, p AS (SELECT workspace_id, count(*) FILTER (WHERE status = 'uploading') AS uploading, count(*) FILTER (WHERE status IN ('pending', 'embedding')) AS embedding, count(*) FILTER (WHERE status = 'embedded') AS embedded,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) AS total FROM docs GROUP BY 1)
SELECT p.*, embedded + failed + cancelled AS done, embedded + failed + cancelled = total AS all_terminal, embedded + failed + cancelled = total AND (embedded = 0 OR summary IS NOT NULL) AS stop_waiting FROM p JOIN ws ON ws.id = workspace_id""")
def o86_workspace_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.workspace_progress(fx.documents(spark, sf_dir), fx.workspaces(spark, sf_dir))


# text and chunking


@_query(f"SELECT doc_id, md5({fx.sql_collapse('lower(text)')}) AS norm FROM documents")
def o16_norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import norm_text

    return fx.read(spark, sf_dir, "documents").select("doc_id", F.md5(norm_text(F.col("text"))).alias("norm"))


@_query(_with(fx.NORMAL) + "SELECT doc_id, md5(t) AS norm FROM normal")
def o41_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import normalize_text

    return fx.read(spark, sf_dir, "documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("norm"))


@_query(_with(fx.SEGMENTS) + """SELECT doc_id, o AS "order", sum(fresh) OVER (PARTITION BY doc_id ORDER BY page_number, o)::BIGINT AS grp FROM (
SELECT *, CASE WHEN kind <> 'table' AND lag(kind) OVER w <> 'table' AND lag(page_number) OVER w = page_number AND lag(ctx) OVER w = ctx THEN 0 ELSE 1 END AS fresh
FROM segs WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, o))""")
def o42_group_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.group_segments(fx.segments(spark, sf_dir)).select("doc_id", "order", "grp")


@_query(_with(fx.NORMAL, fx.CUTS) + "SELECT doc_id, i AS pos, md5(piece) AS piece FROM pieces")
def o43_split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.read(spark, sf_dir, "documents").select("doc_id", chunking.split_text(F.col("text")).alias("p"))
    return rows.select("doc_id", F.posexplode_outer("p").alias("pos", "piece")).where("pos is not null").withColumn("piece", F.md5("piece"))


@_query()
def o44_split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as rows of a table under a caption."""
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("| "), x, F.lit(" |"))), "\n")
    rows = fx.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[Tablo: t]\n| a |\n| --- |\n"), body).alias("t"))
    return rows.select("doc_id", F.posexplode_outer(chunking.split_table(F.col("t"))).alias("pos", "piece")).where("pos is not null").withColumn("piece", F.md5("piece"))


@_query(_with(fx.NORMAL, fx.CUTS) + "SELECT doc_id, i AS chunk_index, 'text' AS content_type, md5('[Bölüm: ' || source || ' > ' || lang || ']' || chr(10) || piece) AS text, md5(piece) AS embed_text FROM pieces JOIN documents USING (doc_id)")
def o45_chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_segments(fx.text_segments(spark, sf_dir)).select("doc_id", "chunk_index", "content_type", F.md5("text").alias("text"), F.md5("embed_text").alias("embed_text"))


@_query(_with(fx.SEGMENTS) + "SELECT doc_id, count(DISTINCT page_number)::INT AS pages, count(*)::INT AS chunks, coalesce(count(*) FILTER (WHERE kind = 'table'), 0)::INT AS tables FROM segs GROUP BY doc_id")
def o46_document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_stats(fx.segments(spark, sf_dir)).select("doc_id", "stats.pages", "stats.chunks", F.coalesce(F.try_element_at("stats.types", F.lit("table")), F.lit(0)).alias("tables"))


@_query(_with(fx.CHUNKS) + "SELECT doc_id, 'no chunks' AS error FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE doc_id % 5 <> 0)")
def o47_assert_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.assert_chunked(fx.read(spark, sf_dir, "documents"), fx.pieces(spark, sf_dir).where("doc_id % 5 <> 0"))


# layout


@_query(_with(fx.PAGE_BLOCKS) + """SELECT doc_id, norm FROM (SELECT doc_id, """ + fx.sql_collapse("lower(text)") + """ AS norm FROM blocks WHERE y0 + 12 <= 79.2 OR y0 >= 792 * 0.9) b
WHERE length(norm) >= 2 AND regexp_matches(norm, '[\\p{L}\\p{N}]') GROUP BY doc_id, norm HAVING count(*) >= (SELECT greatest(2, ceil(count(DISTINCT page) * 0.6)) FROM blocks p WHERE p.doc_id = b.doc_id)""")
def o17_detect_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.detect_repeats(fx.page_blocks(spark, sf_dir), fx.pages_geom(spark, sf_dir))


@_query(_with(fx.PAGE_BLOCKS) + "SELECT doc_id, page, block_no FROM blocks WHERE NOT (block_no = 0 AND doc_id IN (SELECT doc_id FROM blocks GROUP BY doc_id HAVING count(DISTINCT page) > 1))")
def o18_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, pages = fx.page_blocks(spark, sf_dir), fx.pages_geom(spark, sf_dir)
    return layout.drop_repeats(blocks, layout.detect_repeats(blocks, pages), pages).select("doc_id", "page", "block_no")


@_query(_with(fx.PAGE_BLOCKS) + "SELECT doc_id, page, block_no FROM blocks WHERE y0 + 12 >= 792 * 0.07 AND y0 <= 792 * 0.93")
def o19_crop_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.crop_margins(fx.page_blocks(spark, sf_dir), fx.pages_geom(spark, sf_dir)).select("doc_id", "page", "block_no")


@_query(_with(fx.PAGE_BLOCKS) + "SELECT doc_id, page, block_no FROM blocks WHERE NOT (doc_id % 3 = 0 AND greatest(least(y0 + 12, 170) - greatest(y0, 142), 0) / 12 > 0.5)")
def o20_drop_table_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.drop_table_overlaps(fx.page_blocks(spark, sf_dir), fx.page_tables(spark, sf_dir)).select("doc_id", "page", "block_no")


_INK = f"{fx.sql_strip('left(text, 5)')} <> ''"


@_query(_with(fx.PAGE_BLOCKS) + f"""SELECT doc_id, page, block_no, {fx.sql_strip('text')} AS text, greatest(CASE WHEN {_INK} THEN size ELSE 0 END, CASE WHEN {fx.sql_strip('substring(text, 6)')} <> '' THEN 10.0 ELSE 0 END)::DOUBLE AS size, flags = 16 AND {_INK} AS bold
FROM blocks WHERE {fx.sql_strip('text')} <> ''""")
def o21_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.block_text(fx.page_blocks(spark, sf_dir).drop("text", "size")).select("doc_id", "page", "block_no", "text", "size", "bold")


@_query(_with(fx.CHUNKS) + """SELECT doc_id, chunk_index, lang AS section_title, '["' || workspace_id || '","' || lang || '"]' AS breadcrumbs FROM chunks""")
def o22_encode_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.pieces(spark, sf_dir).withColumn("bbox", F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    encoded = layout.encode_meta(chunks)
    again = layout.decode_meta(encoded).select("doc_id", "chunk_index", F.to_json("breadcrumbs").alias("breadcrumbs"))
    return encoded.select("doc_id", "chunk_index", "section_title").join(again, ["doc_id", "chunk_index"])


@_query(_with(fx.PAGE_BLOCKS) + f"SELECT doc_id, page, block_no, font = 'Courier' AND {fx.sql_strip('text')} <> '' AS code FROM blocks")
def o23_is_code_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_blocks(spark, sf_dir).select("doc_id", "page", "block_no", layout.is_code_block(F.col("lines")).alias("code"))


_SYMBOLS = r"[^=+\-*/^_∑∫√αβγδθλε≤≥±≠≈∂∇π∞×⋅÷μφωηρ]"


@_query(_with(fx.PAGE_BLOCKS) + f"SELECT doc_id, page, block_no, length(regexp_replace(text, '{fx.SQL_SPACE}', '', 'g'))::INT AS total, length(regexp_replace(text, '{_SYMBOLS}', '', 'g'))::INT AS symbols FROM blocks")
def o24_equation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_blocks(spark, sf_dir).select("doc_id", "page", "block_no", layout.equation_stats(F.col("lines")).alias("s")).select("doc_id", "page", "block_no", "s.total", "s.symbols")


@_query(_with(fx.PAGE_BLOCKS) + f"""SELECT doc_id, page, block_no, total > 0 AND ((symbols / total >= 0.25 AND total < 250) OR (total <= 12 AND symbols >= 1)) AND regexp_matches({fx.sql_strip('text')}, '\\(\\s*\\d+(?:\\.\\d+)?\\s*\\)\\s*$') AS equation
FROM (SELECT *, length(regexp_replace(text, '{fx.SQL_SPACE}', '', 'g')) AS total, length(regexp_replace(text, '{_SYMBOLS}', '', 'g')) AS symbols FROM blocks)""")
def o25_is_block_equation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_blocks(spark, sf_dir).select("doc_id", "page", "block_no", layout.is_block_equation(F.col("lines"), F.col("bbox"), F.lit(612.0)).alias("equation"))


_ROUTED = f"regexp_replace({fx.sql_strip('text')}, '\\(\\s*\\d+(?:\\.\\d+)?\\s*\\)\\s*$', '')"


@_query(_with(fx.PAGE_BLOCKS) + f"""SELECT doc_id, page, block_no, body, CASE WHEN {fx.sql_strip('text')} = '' THEN NULL WHEN body = '' OR regexp_matches(text, '[\\x{{E000}}-\\x{{F8FF}}]') THEN 'vision'
  WHEN regexp_matches(body, '[\\\\=+\\-^_*/≤≥≠]|[^\\x00-\\x7f]') AND regexp_matches(body, '[\\p{{L}}\\p{{N}}]') AND length(body) >= 2 THEN 'local' ELSE 'vision' END AS route FROM (SELECT *, {fx.sql_strip(_ROUTED)} AS body FROM blocks)""")
def o26_equation_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_blocks(spark, sf_dir).select("doc_id", "page", "block_no", layout.equation_route(F.col("lines")).alias("r")).select("doc_id", "page", "block_no", "r.body", "r.route")


@_query("SELECT doc_id AS item_id, CASE doc_id % 4 WHEN 0 THEN '$$x^' || doc_id || '$$' WHEN 1 THEN '$$y$$' ELSE md5(text) END AS text FROM documents")
def o27_apply_equation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.md5("text").alias("text"))
    latex = items.selectExpr("item_id", r"CASE item_id % 4 WHEN 0 THEN concat('$$ x^', item_id, ' $$') WHEN 1 THEN ' y' WHEN 2 THEN '\\text{okunamadı}' END AS latex")
    return layout.apply_equation_results(items, latex)


@_query(_with(fx.PAGE_BLOCKS) + r"SELECT DISTINCT doc_id, page, '| ' || doc_id || ' | a\|b |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| x |  |  |' || chr(10) || '| line break | z | w |' AS md FROM blocks WHERE doc_id % 3 = 0")
def o28_table_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.page_tables(spark, sf_dir).select("doc_id", "page", layout.table_to_markdown(F.col("rows")).alias("md"))


@_query(_with(fx.PAGE_BLOCKS) + f"""SELECT DISTINCT t.doc_id, t.page, caption FROM blocks t LEFT JOIN (
SELECT doc_id, page, {fx.sql_strip('text')} AS caption FROM blocks WHERE y0 + 12 <= 142 AND y0 + 12 >= 82 AND {fx.sql_strip('text')} <> '' AND length({fx.sql_strip('text')}) <= 90
QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, block_no) = 1) c ON c.doc_id = t.doc_id AND c.page = t.page WHERE t.doc_id % 3 = 0""")
def o29_table_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_caption(fx.page_blocks(spark, sf_dir), fx.page_tables(spark, sf_dir)).select("doc_id", "page", "caption")


@_query(_with(fx.PAGE_BLOCKS) + "SELECT doc_id, page, first(size ORDER BY n DESC, size) AS body FROM (SELECT doc_id, page, size, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY doc_id, page")
def o30_body_font_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_font_size(fx.page_blocks(spark, sf_dir))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with text, and each page's table, as items of a page."""
    text = layout.block_text(fx.page_blocks(spark, sf_dir).drop("text", "size")).select("doc_id", "page", F.col("block_no").alias("item_no"), F.lit("text").alias("kind"), F.lit("text").alias("content_type"), "text", "line_info", "size", "bbox")
    tables = fx.page_tables(spark, sf_dir).select("doc_id", "page", F.lit(100_000_000).alias("item_no"), F.lit("table").alias("kind"), F.lit("table").alias("content_type"), layout.table_to_markdown(F.col("rows")).alias("text"), F.lit(None).cast("array<struct<text:string,size:double,bold:boolean>>").alias("line_info"), F.lit(None).cast("double").alias("size"), "bbox")
    return text.unionByName(tables).withColumns({"caption": F.lit(None).cast("string"), "image_path": F.lit(""), "image_kind": F.lit("")})


@_query(_with(fx.PAGE_BLOCKS) + f"""SELECT doc_id, page, item_no, (row_number() OVER (PARTITION BY doc_id, page ORDER BY mid, anchor DESC, item_no) - 1)::INT AS "order" FROM (
SELECT doc_id, page, block_no AS item_no, y0 + 6 AS mid, false AS anchor FROM blocks WHERE {fx.sql_strip('text')} <> '' UNION ALL SELECT DISTINCT doc_id, page, 100000000, 156.0, true FROM blocks WHERE doc_id % 3 = 0)""")
def o31_order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With tables put in."""
    return layout.order_blocks(materialize(_items(spark, sf_dir).select("doc_id", "page", "item_no", "kind", "bbox"), "items"), fx.pages_geom(spark, sf_dir)).select("doc_id", "page", "item_no", "order")


@_query()
def o35_emit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = materialize(_items(spark, sf_dir), "items")  # for the order and the body's size; the order is then read by lines, texts and tables
    ordered = materialize(layout.order_blocks(items, fx.pages_geom(spark, sf_dir)), "ordered")
    segments = layout.emit_segments(ordered, layout.body_font_size(items))
    return segments.select("doc_id", "page_number", "order", "content_type", F.md5("text").alias("text"), "page_context", F.array_join("breadcrumbs", "|").alias("breadcrumbs"))


_LIST_ITEM = f"regexp_matches(text, '^{fx.SQL_SPACE}*(?:[➨➔→•·∙◦○●◉■▪‣➢]|[-–—]{fx.SQL_SPACE}|\\*{fx.SQL_SPACE}|\\+{fx.SQL_SPACE}|\\p{{Nd}}{{1,3}}[.)]{fx.SQL_SPACE}*|\\(\\p{{Nd}}{{1,3}}\\){fx.SQL_SPACE}*)')"


@_query(_with(fx.PAGE_BLOCKS) + f"SELECT doc_id, page, block_no, {fx.sql_collapse('text')} AS heading, {_LIST_ITEM} AS item FROM blocks")
def o33_clean_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.text import clean_heading, is_list_item

    return fx.page_blocks(spark, sf_dir).select("doc_id", "page", "block_no", clean_heading(F.col("text")).alias("heading"), is_list_item(F.col("text")).alias("item"))


_CLEAN = fx.sql_collapse("regexp_replace(text, '[➨➔→\\x00-\\x1f]', ' ', 'g')")
_PREFIX = f"regexp_extract(text, '^([^:]{{3,60}}):{fx.SQL_SPACE}', 1)"


@_query(_with(fx.PAGE_BLOCKS) + f"""SELECT doc_id, page, block_no, CASE WHEN clean = '' OR length(clean) > 120 OR item THEN NULL WHEN size >= 12.65 OR (block_no % 7 = 0 AND size > 11) THEN clean WHEN length(clean) <= 70 AND ends_with(clean, ':') THEN clean
  WHEN prefix <> '' AND regexp_matches(left(text, 1), '^\\p{{Lu}}') THEN {fx.sql_collapse("regexp_replace(prefix, '[➨➔→\\x00-\\x1f]', ' ', 'g')")} || ':' END AS heading
FROM (SELECT *, {_CLEAN} AS clean, {_PREFIX} AS prefix, {_LIST_ITEM} AS item FROM blocks)""")
def o34_is_heading_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .config import DEFAULT
    from .functions.text import heading_of

    return fx.page_blocks(spark, sf_dir).select("doc_id", "page", "block_no", heading_of(F.col("text"), F.col("size"), F.col("block_no") % 7 == 0, F.lit(11.0), DEFAULT).alias("heading"))


@_query(_with(fx.PAGE_BLOCKS, fx.PAGE_IMAGES) + "SELECT doc_id, page, image_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, xref ORDER BY image_no) AS n FROM imgs) WHERE n = 1 AND least(w, h) >= 100 AND (greatest(w, h) >= 300 OR w * h >= 0.15 * 612 * 792)")
def o36_image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.image_candidates(fx.page_images(spark, sf_dir), fx.pages_geom(spark, sf_dir)).select("doc_id", "page", F.col("image_no").cast("long").alias("image_no"))


_OCR = f"""w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS raw, generate_subscripts(string_split(text, ' '), 1) - 1 AS n FROM documents),
ink AS (SELECT doc_id, n, {fx.sql_strip('raw')} AS t, length(raw) AS len FROM w),
o AS (SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY n) FILTER (WHERE t <> ''), '') AS text, coalesce(avg(60 + doc_id % 40) FILTER (WHERE t <> '' AND n % 10 <> 0), 0)::DOUBLE AS mean_conf, count(*) FILTER (WHERE t <> '') AS word_count,
  least(coalesce(sum(50 * len) FILTER (WHERE t <> ''), 0) / ((500 + any_value(doc_id)) * 1000.0), 1)::DOUBLE AS coverage FROM ink GROUP BY doc_id),
stats AS (SELECT doc_id, text, mean_conf, word_count, coverage, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(text) ELSE 0 END AS alnum FROM o)"""


@_query(_with(_OCR) + "SELECT doc_id::VARCHAR AS image_id, md5(text) AS text, mean_conf, word_count, round(coverage, 6) AS text_coverage, round(alnum, 6) AS alnum_ratio FROM stats")
def o37_ocr_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ocr_stats(fx.ocr_words(spark, sf_dir)).select("image_id", F.md5("text").alias("text"), "mean_conf", "word_count", F.round("text_coverage", 6).alias("text_coverage"), F.round("alnum_ratio", 6).alias("alnum_ratio"))


_IS_TEXT = "mean_conf >= 70 AND alnum >= 0.75 AND word_count >= 10 AND coverage >= 0.05"


@_query(_with(_OCR) + f"SELECT doc_id::VARCHAR AS image_id, {_IS_TEXT} AS mostly_text, word_count < 25 AND coverage < 0.15 AS diagram_like FROM stats")
def o38_is_mostly_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ocr_stats(fx.ocr_words(spark, sf_dir)).select("image_id", layout.is_mostly_text().alias("mostly_text"), layout.is_diagram_like().alias("diagram_like"))


@_query(_with(_OCR) + f"SELECT doc_id::VARCHAR AS image_id, CASE WHEN {_IS_TEXT} AND word_count < 25 AND coverage < 0.15 THEN 'image' WHEN {_IS_TEXT} THEN 'ocr_text' ELSE 'vision' END AS route FROM stats")
def o39_route_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.route_image(layout.ocr_stats(fx.ocr_words(spark, sf_dir)), vision=True).select("image_id", "route")


@_query(_with(fx.PAGE_BLOCKS, fx.PAGE_IMAGES) + "SELECT DISTINCT doc_id, page FROM imgs WHERE doc_id % 2 = 1")
def o40_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.scan_pages(fx.pages_geom(spark, sf_dir), fx.page_blocks(spark, sf_dir).where("doc_id % 2 = 0"), fx.page_images(spark, sf_dir))


# store

_SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.docx' ELSE '' END"


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.read(spark, sf_dir, "documents").selectExpr("doc_id", f"concat('f', doc_id, {_SUFFIX}) AS filename", "cast(octet_length(text) AS bigint) * 1000 AS size", "cast(octet_length(text) AS bigint) AS received", "CASE doc_id % 5 WHEN 0 THEN octet_length(text) + 1 WHEN 1 THEN octet_length(text) - 1 WHEN 2 THEN 0 ELSE octet_length(text) END AS expected", "cast(text AS binary) AS content")


@_query("SELECT doc_id, 'folder=' || doc_id % 16 AS folder, md5(text) AS digest FROM documents")
def o01_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text files in folders, read back as files."""
    path = scratch(spark, "storage")
    lines = fx.read(spark, sf_dir, "documents").selectExpr("doc_id % 16 AS folder", "concat(doc_id, ' ', hex(text)) AS value")
    # a file is one row when it is read, so its size has a bound, whatever a folder holds
    lines.write.option("maxRecordsPerFile", 256).partitionBy("folder").text(path)
    rows = store.scan_files(spark, path, "*.txt").select(F.col("doc_id").alias("folder"), F.explode(F.split(F.rtrim(F.decode("content", "utf-8"), F.lit("\n")), "\n")).alias("line"))
    parts = F.split("line", " ")
    return rows.select(parts[0].cast("long").alias("doc_id"), "folder", F.md5(F.unhex(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))).alias("digest"))


@_query("SELECT doc_id, CASE WHEN doc_id % 4 >= 2 THEN 415 WHEN strlen(text) * 1000 > 26214400 THEN 413 END AS reject_code, doc_id % 4 < 2 AND strlen(text) * 1000 <= 26214400 AS accepted FROM documents")
def o02_admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.admit_files(_uploads(spark, sf_dir)).select("doc_id", "reject_code", "accepted")


@_query("""SELECT doc_id, CASE WHEN e > 0 AND strlen(text) > e THEN 'aborted' WHEN e > 0 AND strlen(text) < e THEN 'incomplete' ELSE 'complete' END AS outcome, CASE WHEN e > 0 AND strlen(text) <> e THEN 'cancelled' ELSE 'pending' END AS status
FROM (SELECT *, CASE doc_id % 5 WHEN 0 THEN strlen(text) + 1 WHEN 1 THEN strlen(text) - 1 WHEN 2 THEN 0 ELSE strlen(text) END AS e FROM documents)""")
def o03_verify_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.verify_upload(_uploads(spark, sf_dir)).select("doc_id", "outcome", "status")


@_query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 'text' END AS handler, doc_id % 4 >= 2 AS failed FROM documents")
def o04_route_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.route_by_type(_uploads(spark, sf_dir)).select("doc_id", "handler", F.col("error").isNotNull().alias("failed"))


@_query(f"SELECT doc_id, md5({fx.sql_strip('text')}) AS text, left({fx.sql_strip('text')}, 200) AS page_context, CASE WHEN {fx.sql_strip('text')} = '' THEN 'empty document' END AS error FROM documents")
def o05_read_text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_text_segments(_uploads(spark, sf_dir)).select("doc_id", F.md5("text").alias("text"), "page_context", "error")


@_query(_with(fx.PAGE_BLOCKS) + "SELECT doc_id, page, block_no, y0, left(text, 5) AS head, 1::INT AS n_lines FROM blocks")
def o06_read_page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page blocks as a parser leaves them, written and read by the declared schema of a block table."""
    path = scratch(spark, "blocks")
    fx.page_blocks(spark, sf_dir).drop("text", "size").write.parquet(path)
    blocks = store.read_page_blocks(spark, path)
    return blocks.select("doc_id", "page", "block_no", "bbox.y0", F.col("lines")[0]["spans"][0]["text"].alias("head"), F.size("lines").alias("n_lines"))


@_query(_with(fx.LOGS) + "SELECT id, level, stage, workspace_id, strftime(created_at, '%Y-%m-%d') AS day FROM logs")
def o13_append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs, appended in two batches."""
    path, rows = scratch(spark, "logs"), fx.logs(spark, sf_dir)
    for part in (0, 1):
        store.append_log(rows.where(f"id % 2 = {part}"), path)
    return spark.read.parquet(path).select("id", "level", "stage", "workspace_id", F.col("day").cast("string").alias("day"))


_STATUS = "element_at(array('pending', 'embedding', 'embedded', 'pending', 'failed', 'embedding', 'cancelled'), cast(event_id % 7 AS int) + 1)"


@_query("""WITH e AS (SELECT user_id AS document_id, event_id AS seq, ['pending', 'embedding', 'embedded', 'pending', 'failed', 'embedding', 'cancelled'][event_id % 7 + 1] AS status FROM events),
f AS (SELECT document_id, list_reduce(list_prepend('uploading:0', list(status ORDER BY seq)), lambda a, w: CASE
    WHEN (split_part(a, ':', 1) = 'uploading' AND w IN ('pending', 'cancelled', 'failed')) OR (split_part(a, ':', 1) = 'pending' AND w IN ('embedding', 'cancelled', 'failed'))
      OR (split_part(a, ':', 1) = 'embedding' AND w IN ('embedded', 'failed', 'cancelled')) THEN w || ':' || split_part(a, ':', 2)
    WHEN split_part(a, ':', 1) = w THEN a ELSE split_part(a, ':', 1) || ':' || (split_part(a, ':', 2)::INT + 1) END) AS r FROM e GROUP BY 1)
SELECT document_id, split_part(r, ':', 1) AS status, split_part(r, ':', 2)::INT AS rejected FROM f""")
def s01_fold_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statuses of documents, dealt over five batches of a stream without regard to their order."""
    path = scratch(spark, "statuses")
    events = fx.read(spark, sf_dir, "events").selectExpr("user_id AS document_id", f"{_STATUS} AS status", "event_id AS seq")
    for part in range(5):
        events.where(F.pmod(F.xxhash64("seq"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.keep_statuses(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.statuses(spark, f"{path}/out", dict(events.dtypes)["document_id"])


_LOG = "id bigint, document_id bigint, workspace_id string, level string, stage string, message string, created_at timestamp"


def _kept_logs(spark: SparkSession, sf_dir: str) -> EventLog:
    """The logs, dealt over five batches of a stream; days' parts are joined on the way."""
    path, rows = scratch(spark, "log"), fx.logs(spark, sf_dir)
    for part in range(5):
        rows.where(F.pmod(F.xxhash64("id"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(f"{path}/in")
    kept = EventLog(spark, f"{path}/log", _LOG, layout=LogLayout(fan=3))
    ingest.keep_events(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), kept, f"{path}/checkpoint").awaitTermination()
    return kept


@_query(_with(fx.LOGS) + "SELECT stage, level, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT id) AS n_ids, sum(document_id)::BIGINT AS documents FROM logs GROUP BY 1, 2, 3")
def s02_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by stage and day of a log that took its batches from a stream, and the last of them once more, which adds nothing."""
    kept = _kept_logs(spark, sf_dir)
    writer, batch = next(iter(kept._state()["writers"].items()))
    kept.append(kept.read(), writer, batch)
    rows = kept.read().withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    return rows.groupBy("stage", "level", "day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_ids"), F.sum("document_id").alias("documents"))


@_query(_with(fx.LOGS) + """SELECT id, workspace_id, level, stage, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM logs
WHERE workspace_id = 'src3' AND level = 'error' AND created_at <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY logs.created_at DESC, id DESC LIMIT 50""")
def o81_recent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of one workspace's errors before a time, from the days that hold it."""
    wanted = (F.col("workspace_id") == "src3") & (F.col("level") == "error")
    rows = _kept_logs(spark, sf_dir).newest_days(50, wanted, "2024-01-20T12:00:00Z")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "workspace_id", "level", "stage", _time("created_at"))


@_query(_with(fx.INDEX) + "SELECT workspace_id, n_chunks, round(avgdl, 6) AS avgdl, n_documents, 0::BIGINT AS n_failed FROM stats JOIN (SELECT source AS workspace_id, count(*) AS n_documents FROM documents GROUP BY 1) USING (workspace_id)")
def s03_ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come in four batches, through the store, the index and the log."""
    path = scratch(spark, "chain")
    files = fx.read(spark, sf_dir, "documents").selectExpr("source AS workspace_id", "doc_id", "cast(text AS binary) AS content", "timestamp_seconds(0) AS modified")
    kept = ChunkStore(spark, f"{path}/store", "workspace_id string, doc_id bigint, chunk_index int, text string, version bigint")
    index, log = PostingIndex(spark, f"{path}/index"), EventLog(spark, f"{path}/log", ingest.DOCUMENT_LOG)
    for part in range(4):  # what a run finds is one batch, of as many files as its rows need
        files.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == part).write.mode("append").parquet(f"{path}/in", compression="zstd")
        ingest.ingest_chain(spark.readStream.schema(files.schema).parquet(f"{path}/in"), kept, index, log, f"{path}/checkpoint").awaitTermination()
    events = log.read().groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("stage") == "failed").alias("n_failed"))
    return index.stats().join(events, "workspace_id").select("workspace_id", "n_chunks", F.round("avgdl", 6).alias("avgdl"), "n_documents", "n_failed")


@_query("SELECT event_id, user_id, event_type FROM events")
def o14_read_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_table(spark, f"{sf_dir}/events.parquet", "event_id bigint, user_id bigint, event_type string")


@_query(_with(fx.CHUNKS) + "SELECT doc_id, chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS text FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def o07_upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fx.pieces(spark, sf_dir)
    target = base.where("doc_id % 2 = 0").select("doc_id", "chunk_index", F.lit("old").alias("text"), F.lit(1).alias("version"))
    batch = base.where("doc_id % 3 = 0").select("doc_id", "chunk_index", F.explode(F.array(F.struct(F.lit("stale").alias("text"), F.lit(2).alias("version")), F.struct(F.lit("new").alias("text"), F.lit(3).alias("version")))).alias("x")).select("doc_id", "chunk_index", "x.text", "x.version")
    return store.upsert_chunks(target, batch).drop("version")


#: Document d comes in batch d % 20, a third of them again (shorter) one batch later; a fifth of those that came two batches before go.
@_query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
last AS (SELECT *, doc_id % 3 = 0 AND doc_id % 20 < 19 AS again FROM lines)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(text) AS text, CAST(doc_id % 20 + again::INT AS BIGINT) AS version FROM last
WHERE NOT (again AND i > 0) AND NOT (doc_id % 5 = 0 AND doc_id % 20 < 18)""")
def o07_store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty batches of new, shortened and deleted documents into the versioned store, every one of them sent twice."""
    docs = materialize(fx.read(spark, sf_dir, "documents").select("doc_id", "text"), "docs")
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("chunk_index", "text")).where("text IS NOT NULL").withColumn("text", F.md5("text"))
    kept = ChunkStore(spark, scratch(spark, "store"), "doc_id bigint, chunk_index int, text string, version bigint", Layout(fan=4, least=1 << 20))
    for batch in range(20):
        new, again = lines.where(F.col("doc_id") % 20 == batch), lines.where((F.col("doc_id") % 20 == batch - 1) & (F.col("doc_id") % 3 == 0) & (F.col("chunk_index") == 0))
        gone = docs.where((F.col("doc_id") % 20 == batch - 2) & (F.col("doc_id") % 5 == 0)).select("doc_id")
        rows = new.union(again).withColumn("version", F.lit(batch).cast("long"))
        for _ in range(2):
            kept.replace(rows, gone, "replay", batch)
    kept.vacuum(keep=1)
    return kept.read()


@_query(_with(fx.CHUNKS) + "SELECT doc_id, chunk_index FROM chunks WHERE doc_id % 10 <> 3")
def o08_delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.pieces(spark, sf_dir)
    return store.delete_document(chunks, chunks.where("doc_id % 10 = 3").select("doc_id").distinct()).select("doc_id", "chunk_index")


@_query(_with(fx.DOCUMENTS, fx.DOCUMENT_QUESTIONS, fx.MESSAGES) + "SELECT 'documents' AS kind, count(*) AS n FROM docs WHERE workspace_id <> 'src5' UNION ALL SELECT 'document_questions', count(*) FROM dq JOIN docs ON docs.id = document_id WHERE workspace_id <> 'src5' UNION ALL SELECT 'chat_messages', count(*) FROM msgs WHERE workspace_id <> 'src5'")
def o09_delete_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"workspaces": fx.workspaces(spark, sf_dir), "documents": fx.documents(spark, sf_dir), "document_questions": fx.document_questions(spark, sf_dir), "chat_messages": fx.messages(spark, sf_dir)}
    left = store.delete_workspace(tables, tables["workspaces"].where("id = 'src5'").select(F.col("id").alias("workspace_id")))
    counts = [left[k].agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("documents", "document_questions", "chat_messages")]
    return counts[0].union(counts[1]).union(counts[2])


@_query(_with(fx.CHUNKS) + "SELECT doc_id, chunk_index, md5(text) AS text FROM chunks WHERE doc_id = 7")
def o10_chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunks_of_document(fx.pieces(spark, sf_dir), 7).select("doc_id", "chunk_index", F.md5("text").alias("text"))


@_query(_with(fx.CHUNKS) + "SELECT id, n::INT AS n, doc_id, doc_id IS NOT NULL AS found FROM (VALUES (0, '3:0'), (1, '5:1'), (2, '8:0')) v(n, id) LEFT JOIN chunks ON doc_id || ':' || chunk_index = id")
def o11_chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunks_by_ids(fx.pieces(spark, sf_dir), [" 3:0", "5:1", "", "8:0 "]).select("id", "n", "doc_id", "found")


@_query(_with(fx.CHUNKS) + "SELECT doc_id, chunk_index, md5(text) AS text FROM chunks WHERE workspace_id = 'src2'")
def o12_chunks_of_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.chunks_of_workspace(fx.pieces(spark, sf_dir), "src2").select("doc_id", "chunk_index", F.md5("text").alias("text"))


@_query(_with(fx.DOCUMENTS, fx.MESSAGES) + """SELECT id AS q_id, unnest([0, 1, 2])::INT AS seq, unnest(['meta', 'delta', 'done']) AS event, unnest([workspace_id, md5(content), NULL]) AS data FROM msgs WHERE role = 'assistant'
UNION ALL SELECT id, 0, 'error', 'busy' FROM msgs WHERE role = 'user'""")
def o15_qa_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.messages(spark, sf_dir).selectExpr("id AS q_id", "CASE WHEN role = 'assistant' THEN workspace_id END AS meta", "CASE WHEN role = 'assistant' THEN array(md5(content)) END AS deltas", "CASE WHEN role = 'user' THEN 'busy' END AS error").where("meta IS NOT NULL OR error IS NOT NULL")
    return store.qa_events(results)


# enrichment and answers


_CLIP = "CASE WHEN length({0}) > 700 THEN left({0}, 700) || '…' ELSE {0} END"


@_query(_with(fx.CHUNKS) + f""", s AS (SELECT doc_id, trim(any_value(page_context), ' ') AS c, list(text ORDER BY chunk_index) AS l, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT doc_id, left(CASE WHEN c <> '' THEN 'BAŞLIKLAR:' || chr(10) || '- ' || c || chr(10) || chr(10) ELSE '' END || 'BELGE BAŞI:' || chr(10) || {_CLIP.format("l[1]")}
  || CASE WHEN n // 2 > 0 AND n // 2 < n - 1 THEN chr(10) || chr(10) || 'BELGE ORTASI:' || chr(10) || {_CLIP.format("l[n // 2 + 1]")} ELSE '' END
  || CASE WHEN n > 1 THEN chr(10) || chr(10) || 'BELGE SONU:' || chr(10) || {_CLIP.format("l[n]")} ELSE '' END, 2500) AS sample FROM s""")
def o69_build_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.build_sample(fx.pieces(spark, sf_dir))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model in five states of repair."""
    body = "to_json(named_struct('summary', concat('S', doc_id), 'questions', array(' q1 ', '', concat('q', doc_id))))"
    return fx.read(spark, sf_dir, "documents").selectExpr("doc_id", f"""CASE doc_id % 5 WHEN 0 THEN {body} WHEN 1 THEN concat('```json\n', {body}, '\n```') WHEN 2 THEN concat('Here: ', {body}, ' done') WHEN 3 THEN concat("{{'summary': 'S", doc_id, "', 'questions': [' q1 ', '', 'q", doc_id, "']}}") ELSE 'nothing' END AS raw""")


@_query("SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN 'S' || doc_id END AS summary, CASE WHEN doc_id % 5 < 4 THEN ' q1 ||q' || doc_id END AS questions FROM documents")
def o70_repair_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.repair_json(_outputs(spark, sf_dir)).select("doc_id", "parsed.summary", F.array_join("parsed.questions", "|").alias("questions"))


@_query("""SELECT doc_id, CASE WHEN doc_id % 10 <> 9 THEN 'S' || doc_id END AS summary, CASE WHEN doc_id % 10 <> 9 THEN 'q1|q' || doc_id END AS questions, doc_id % 10 = 9 AS error, false AS retry FROM documents
UNION ALL SELECT doc_id, NULL, NULL, true, true FROM documents WHERE doc_id % 5 = 4""")
def o71_clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers, of which every fifth is broken and asked for again; half of the second answers can be saved in part."""
    first = _outputs(spark, sf_dir).withColumn("attempt", F.lit(0))
    broken = "concat('{\"summary\": \"S', doc_id, '\", \"questions\": [\" q1 \", \"\", \"q', doc_id, '\"], \"title')"
    second = first.where("doc_id % 5 = 4").selectExpr("doc_id", f"CASE WHEN doc_id % 10 = 4 THEN {broken} ELSE 'sorry' END AS raw", "1 AS attempt")
    read = enrich.repair_json(first.select("doc_id", "raw", "attempt").unionByName(second))
    asked = enrich.clean_summary(read.where("attempt = 0")).where("retry")
    last = enrich.clean_summary(enrich.latest_answers(read)).where("not (error and retry)")
    return last.unionByName(asked).withColumn("questions", F.array_join("questions", "|"))


#: The number of an id and the signature of a workspace's ids, as enrich.signatures has them.
_NUMBER = "('0x' || left(md5(id::VARCHAR), 15))::BIGINT"
_SIGNATURE = f"count(*) || ':' || sum({_NUMBER})"


@_query(_with(fx.DOCUMENTS) + f"SELECT workspace_id, {_SIGNATURE} AS signature FROM docs GROUP BY 1 HAVING count(*) FILTER (WHERE summary_status = 'pending') = 0 AND count(summary) > 0 AND right(workspace_id, 1) <> '2'")
def o72_workspace_summary_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.workspace_summary_due(fx.workspaces(spark, sf_dir), fx.documents(spark, sf_dir))


@_query(_with(fx.DOCUMENTS) + f""", usable AS (SELECT *, {_NUMBER} % ceil(count(*) OVER (PARTITION BY workspace_id) / 256.0)::BIGINT AS block FROM docs WHERE summary IS NOT NULL)
SELECT workspace_id, block::INT AS block, count(*)::INT AS n, string_agg('- ' || filename || ': ' || summary, chr(10) ORDER BY id) AS digest FROM usable GROUP BY 1, 2""")
def o73_workspace_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.workspace_digest(fx.documents(spark, sf_dir))


@_query(_with(fx.DOCUMENTS, fx.WORKSPACES) + f""", due AS (SELECT workspace_id, {_SIGNATURE} AS signature FROM docs GROUP BY 1 HAVING count(*) FILTER (WHERE summary_status = 'pending') = 0 AND count(summary) > 0 AND right(workspace_id, 1) <> '2')
SELECT ws.id, CASE WHEN due.signature IS NOT NULL AND right(ws.id, 1) IN ('1', '3', '5') THEN 'Title of ' || ws.id ELSE name END AS name, CASE WHEN due.signature IS NOT NULL AND right(ws.id, 1) <> '7' THEN 'New' ELSE summary END AS summary,
  CASE WHEN right(ws.id, 1) = '2' THEN (SELECT {_SIGNATURE} FROM docs d WHERE d.workspace_id = ws.id) WHEN right(ws.id, 1) <> '7' THEN due.signature END AS signature FROM ws LEFT JOIN due ON due.workspace_id = ws.id""")
def o73_store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model: some without a title, those of workspaces that end in 7 without a summary."""
    spaces = fx.workspaces(spark, sf_dir)
    due = enrich.workspace_summary_due(spaces, fx.documents(spark, sf_dir))
    answers = due.selectExpr("workspace_id", "CASE WHEN right(workspace_id, 1) = '7' THEN ' ' ELSE ' New ' END AS summary", "CASE WHEN right(workspace_id, 1) IN ('1', '3', '5') THEN concat(' Title of ', workspace_id) ELSE '' END AS title")
    return enrich.store_workspace_summary(spaces, answers, due).select("id", "name", "summary", "signature")


@_query(_with(fx.DOCUMENTS, fx.DOCUMENT_QUESTIONS) + """SELECT workspace_id, question, place::INT AS place FROM (SELECT workspace_id, question, row_number() OVER (PARTITION BY workspace_id ORDER BY md5(question || ':1'), question) AS place
FROM dq JOIN docs ON docs.id = document_id WHERE status = 'embedded') WHERE place <= 4""")
def o74_sample_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = fx.document_questions(spark, sf_dir).withColumn("id", F.col("question"))
    return enrich.sample_questions(fx.documents(spark, sf_dir), questions)


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message cites a document by its name, a fifth by a part of it, a fifth by more than it, and once more within code."""
    n = fx.read(spark, sf_dir, "documents").count()
    rows = fx.messages(spark, sf_dir).withColumn("_d", (F.length("content") % max(1, n)).cast("string"))
    kind = F.length("content") % 5
    name = F.when(kind == 0, F.concat(F.lit("DOC_"), "_d")).when(kind == 1, F.concat(F.lit("My doc_"), "_d", F.lit(".txt copy"))).otherwise(F.concat(F.lit("DOC_"), "_d", F.lit(".txt")))
    return rows.withColumn("content", F.concat("content", F.lit(" `[Belge: code.txt, parça 1]` $$x[y, parça 1]$$ [Belge: "), name, F.lit(", sayfa 2, parça 1, 4; Görsel: "), "_d", F.lit("/a.png]"))).drop("_d")


@_query(_with(fx.CHUNKS, fx.DOCUMENTS, fx.MESSAGES) + """, c AS (
  SELECT id AS message_id, workspace_id, d, CASE length(content) % 5 WHEN 0 THEN 'DOC_' || d WHEN 1 THEN 'My doc_' || d || '.txt copy' ELSE 'DOC_' || d || '.txt' END AS target
  FROM (SELECT *, length(content) % (SELECT count(*) FROM documents) AS d FROM msgs WHERE role = 'assistant')),
t AS (SELECT DISTINCT workspace_id, target FROM c),
m AS (SELECT t.workspace_id, target, coalesce(min(docs.id) FILTER (lower(filename) = lower(target)), min(docs.id)) AS document_id
  FROM t JOIN docs ON docs.workspace_id = t.workspace_id AND (contains(filename, lower(target)) OR contains(lower(target), filename)) GROUP BY 1, 2)
SELECT message_id, 0 AS n, 'citation' AS kind, target, 2 AS page, 1 AS part, document_id, document_id IN (SELECT doc_id FROM chunks) AND document_id IS NOT NULL AS supported FROM c LEFT JOIN m USING (workspace_id, target)
UNION ALL SELECT message_id, 1, 'image', d || '/a.png', NULL, NULL, NULL, false FROM c""")
def o84_extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.extract_citations(_cited(spark, sf_dir), fx.documents(spark, sf_dir), fx.pieces(spark, sf_dir))


@_query("SELECT doc_id, md5('[doc_' || doc_id || '.txt]') AS answer FROM documents")
def o85_model_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions.hooks import complete, first_block

    prompts = fx.read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[doc_"), F.col("doc_id").cast("string"), F.lit(".txt]\n\n"), "text").alias("context"))
    return complete(prompts, first_block).select("doc_id", F.md5("answer").alias("answer"))


@_query(_with(fx.CHUNKS, fx.MESSAGES) + """, c AS (SELECT id AS message_id, length(content) % (2 * (SELECT count(*) FROM documents)) AS d FROM msgs WHERE role = 'assistant')
SELECT message_id, 0 AS n, d || ':0' AS chunk_id, 0.5 AS dense, CAST(NULL AS DOUBLE) AS bm25, md5(text) AS text FROM c LEFT JOIN chunks ON doc_id = d AND chunk_index = 0
UNION ALL SELECT message_id, 1, d || ':9', CAST(NULL AS DOUBLE), 2.0, md5(text) FROM c LEFT JOIN chunks ON doc_id = d AND chunk_index = 9""")
def o87_inspect_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.read(spark, sf_dir, "documents").count()
    rows = fx.messages(spark, sf_dir).where("role = 'assistant'").selectExpr("id", f"cast(length(content) % {2 * max(1, n)} AS string) AS d")
    cited = rows.selectExpr("id", "named_struct('sources', cast(array() AS array<struct<label:string,meta:string>>), 'chunk_ids', array(concat(d, ':0'), concat(d, ':9')), 'chunk_scores', array(named_struct('id', concat(d, ':0'), 'dense', 0.5D, 'bm25', cast(NULL AS double)), named_struct('id', concat(d, ':9'), 'dense', cast(NULL AS double), 'bm25', 2.0D))) AS citations")
    return citations.inspect_answer(cited, fx.pieces(spark, sf_dir)).withColumn("text", F.md5("text"))
