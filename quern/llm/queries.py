"""The queries opN_* with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vocabulary(name: str) -> str:
    """The place of a vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, n_chunks, ids_sum (sum of ids by place in their chunk, from 1) and round_trip (decoded ids equal the text).

    Rows of one id are one document, whose numbers are summed, and so are rows without id; null and empty texts have one chunk and no
    tokens; an empty table gives no rows.
    """
    from .sentencepiece_scan import decode, encode

    model = vocabulary("piece_bpe_32k.model")
    read = decode(encode(_documents(spark, sf_dir), model), model)
    weighted = F.expr("aggregate(transform(ids, (x, i) -> cast(x as bigint) * (i + 1)), 0L, (a, x) -> a + x)")
    rows = read.select("doc_id", F.size("ids").cast("long").alias("n"), weighted.alias("w"), (F.col("text") == F.col("decoded")).alias("same"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_chunks"), F.sum("w").alias("ids_sum"), F.bool_and("same").alias("round_trip"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary_records import record_starts, write_records
    from .common import scratch

    path = scratch(spark, "records")
    write_records(_documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return record_starts(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "length")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, repeated ids too; a null id is not held out, and empty and null texts score as texts without
    words. Without labels of both classes all texts score alike."""
    from .toxicity import score_toxicity, train

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = score_toxicity(docs, train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns n_changed_paragraphs: how many different paragraphs the edited text lacks. A row for each row of
    documents; null ids stand last in the order, repeated ids in that of their texts' hashes, and null texts are empty."""
    from .fingerprints import likeness, marks, merkle_tree, n_changed, root, with_next

    pairs = with_next(_documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.expr("cast(n_chars div 3 as int)")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 3 as int))"), F.substring("next_text", F.lit(1), cut))
    trees = pairs.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(merkle_tree(F.col(c)).alias(t) for c, t in (("text", "_a"), ("edited", "_b"), ("next_text", "_c"))))
    parts = trees.select("doc_id", "n_chars", "edited_sha256", root(F.col("_a")).alias("fingerprint"), root(F.col("_b")).alias("edited_fingerprint"), n_changed(F.col("_a"), F.col("_b")).alias("n_changed_paragraphs"), *(marks(F.col(t)).alias(m) for t, m in (("_a", "_ma"), ("_b", "_mb"), ("_c", "_mc"))))
    return parts.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("_ma"), F.col("_mb")).alias("near_edited"), likeness(F.col("_ma"), F.col("_mc")).alias("near_next"), "n_changed_paragraphs")


#: Fixed values of the contract: verdict, host, path.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build_index, search, valid_vectors

    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    index = build_index(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return search(index, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vec"), k=5)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import Settings, near_duplicates

    return near_duplicates(_documents(spark, sf_dir), Settings(words=3, percent=85))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import Settings, remove_repeats

    return remove_repeats(_documents(spark, sf_dir), Settings(length=50))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of null lang are in part ''; repeated rows count each; rows without id fail no E and have no labels; of several labels
    of one id any counts. An empty table has no parts and gives no rows."""
    from .filter_audit import audit, failure_masks

    return audit(failure_masks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of base spans; n_added says how many the method adds. A row for each row of documents, repeated ids and null ids
    too; null and empty texts have no spans; an empty table gives no rows."""
    from .pii import find_personal_data

    return find_personal_data(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have no words, repeated rows count again, and rows without id hash their words as with an empty id. An empty
    table gives no rows."""
    from .spelling import variant_groups, word_counts

    return variant_groups(word_counts(_documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_token_counts, op3_fingerprints, op4_toxicity, op5_url_filter, op6_binary_records, op7_nearest, op8_packing, op9_suffix_dedup, op10_near_duplicates, op11_filter_audit, op12_personal_data, op13_spelling_variants)}

ORACLES: dict[str, str] = {
    "op10_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
parts AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN parts USING (doc_id) LEFT JOIN sizes USING (doc_id)
""",
    "op11_filter_audit": r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT d.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places AS (SELECT o, s, o[s] AS x, '[' || o[1:s] || ']' AS until, '[' || o[1:s - 1] || ']' AS earlier FROM orders, range(1, 6) r(s)),
steps AS (
  SELECT part, o, s, x, sum(n) FILTER (s = 1 OR NOT regexp_matches(mask, earlier)) AS before, sum(n) FILTER (contains(mask, x) AND (s = 1 OR NOT regexp_matches(mask, earlier))) AS removed,
    sum(n) FILTER (contains(mask, x)) AS fails, sum(n) FILTER (mask = x) AS unique_fails,
    sum(good) FILTER (contains(mask, x) AND (s = 1 OR NOT regexp_matches(mask, earlier))) AS good_lost, sum(toxic) FILTER (contains(mask, x) AND (s = 1 OR NOT regexp_matches(mask, earlier))) AS toxic_lost
  FROM c, (SELECT o, s, x, until, CASE WHEN s = 1 THEN 'none' ELSE earlier END AS earlier FROM places) GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(coalesce(before, 0) - coalesce(removed, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(fails, 0) - coalesce(removed, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM steps
""",
    # the hash is CRC-32, byte by byte with its table of 256
    "op13_spelling_variants": r"""
WITH RECURSIVE table8 AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
found AS (SELECT w, count(*) AS n, concat(doc_id, ':', w) AS k FROM runs WHERE length(w) >= 7 GROUP BY doc_id, w),
bytes AS (SELECT w, n, flatten(list_transform(range(1, length(k) + 1), lambda i: CASE WHEN unicode(k[i]) < 128 THEN [unicode(k[i])::BIGINT] ELSE [192 + (unicode(k[i]) >> 6)::BIGINT, 128 + (unicode(k[i]) & 63)::BIGINT] END)) AS b FROM found),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, table8),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 1000) r(i) WHERE i <= length(word)),
links AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT word, rest FROM less WHERE rest IN (SELECT word FROM words) UNION SELECT rest, word FROM less WHERE rest IN (SELECT word FROM words)),
best AS (
  SELECT a AS word, b AS near, n AS near_n, count(*) OVER (PARTITION BY a) AS n_near FROM links JOIN words ON word = b QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.root AND g.form IS NULL
""",
    # exact search: the index finds all of it on tables of this size
    "op7_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
""",
    # pages of these tables have no redirects or canonical links, so aliases decide nothing
    "op5_url_filter": """
WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
places AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM places)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""",
}
