"""Documents, search and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.base import query, table
from tidemark.functions import text as tx
from tidemark.functions import vector as vec
from tidemark.operators import documents as docs_ops
from tidemark.operators import embed
from tidemark.operators import search as s
from tidemark.operators.segments import SegmentedIndex
from tidemark.plans.components import shared_folder
from tidemark.plans.state import VersionedTable

QUERY = "the hander, thing"
DOCS = "docs AS (SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS doc_key, source AS channel, left(text, 40) AS title, lang AS description, text AS content FROM documents)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("'doc:' || doc_id AS doc_key", "source AS channel", "left(text, 40) AS title", "lang AS description", "text AS content", "doc_id AS ts")


def _count(field: str, term: str) -> str:
    return f"((length({field}) - length(replace({field}, '{term}', ''))) // {len(term)})"


_TERMS = tx.split_terms(QUERY)
_SCORE = " + ".join(f"{w} * {_count(f'lower({c})', t)}" for c, w in (("title", 3), ("description", 2), ("content", 1)) for t in _TERMS)
LEXICAL = f"{DOCS}, lex AS (SELECT *, CAST({_SCORE} AS DOUBLE) AS lexical FROM docs)"


@query(f"WITH {LEXICAL}, m AS (SELECT *, lexical / (SELECT MAX(lexical) FROM lex) AS score FROM lex) SELECT doc_key, channel, round(score, 9) AS score FROM m ORDER BY m.score DESC, doc_key LIMIT 20")
def lexical_topk(spark, sf_dir):
    return s.search_documents(_docs(spark, sf_dir), QUERY, use_lexical=True, limit=20).select("doc_key", "channel", F.round("score", 9).alias("score"))


_TOKENS = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents), post AS (SELECT term, doc_id, COUNT(*) AS tf FROM tok GROUP BY term, doc_id), len AS (SELECT doc_id, COUNT(*) AS dl FROM tok GROUP BY doc_id), st AS (SELECT COUNT(*) AS n_docs, AVG(dl) AS avgdl FROM len)"
_BM25 = f"{_TOKENS}, w AS (SELECT * FROM post WHERE term IN ('hander', 'thing', 'reedin', 'elleque')), df AS (SELECT term, COUNT(*) AS n FROM w GROUP BY term), sc AS (SELECT w.doc_id, SUM(greatest(0.000001, ln((n_docs - n + 0.5) / (n + 0.5))) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM w JOIN df ON df.term = w.term JOIN len ON len.doc_id = w.doc_id CROSS JOIN st GROUP BY w.doc_id)"


def _index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("content"))
    return s.postings(docs, stem=False)


@query(f"WITH {_BM25} SELECT doc_id AS event_id, round(bm25, 6) AS score FROM sc ORDER BY bm25 DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    index = _index(spark, sf_dir)
    scores = s.bm25(index, s.corpus_stats(index), "hander thing reedin elleque", stem=False)
    return s.top(scores, "bm25", "event_id", 20).select("event_id", F.round("bm25", 6).alias("score"))


@query(f"WITH {_TOKENS} SELECT term, COUNT(*) AS n_docs, CAST(SUM(tf) AS BIGINT) AS n FROM post GROUP BY term")
def index_terms(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


_FINAL = "texts AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(left(text, 200)) || ' hander hander' ELSE text END AS text FROM documents WHERE doc_id % 7 != 0)"


@query(f"WITH {_FINAL}, {_BM25.replace('FROM documents', 'FROM texts')} SELECT CAST(doc_id AS VARCHAR) AS id, round(bm25, 6) AS score FROM sc ORDER BY bm25 DESC, CAST(doc_id AS VARCHAR) LIMIT 20")
def segmented_search(spark, sf_dir):
    """All documents go into an index, a third of them change, a seventh are deleted, a merge in between."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", parts=8, buckets=4, stem=False)
    index.update(docs)
    index.update(docs.where("id % 3 = 0").withColumn("text", F.expr("lower(left(text, 200)) || ' hander hander'")))
    index.merge()
    index.update(docs.where("id % 7 = 0").withColumn("text", F.lit(None).cast("string")))
    return index.search("hander thing reedin elleque").select("id", F.round("bm25", 6).alias("score"))


class LetterEmbedder:
    """How a text's characters fall into eight classes: a model that needs none."""

    model = "letters-8"

    def embed(self, texts):
        return [[sum(ord(c) % 8 == k for c in t) / len(t) for k in range(8)] for t in texts]


@query("SELECT 'customer' AS target_type, CAST(c_custkey AS VARCHAR) AS target_id, sha256(t) AS hash, 8 AS dimension, CAST(round(1000000 * len(list_filter(string_split(t, ''), lambda c: ord(c) % 8 = 1)) / length(t)) AS BIGINT) AS second, CAST(0 AS BIGINT) AS left_over FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS t FROM customer)")
def embedded_texts(spark, sf_dir):
    """Names of customers are embedded, a fourth of them change and are embedded again; nothing is left then."""
    names = table(spark, sf_dir, "customer").selectExpr("'customer' AS target_type", "cast(c_custkey as string) AS target_id", "c_name AS text", "c_custkey % 4 = 0 AS changes")
    kept = VersionedTable(spark, f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}", schemas.EMBEDDINGS, schemas.KEYS["embeddings"], buckets=4)
    embed.embed_stale(names.drop("changes"), kept, LetterEmbedder(), batch_rows=32)
    new = names.withColumn("text", F.when(F.col("changes"), F.upper("text")).otherwise(F.col("text"))).drop("changes")
    embed.embed_stale(new, kept, LetterEmbedder(), batch_rows=32)
    left = embed.stale(new, kept.read(), LetterEmbedder.model).agg(F.count("*").alias("left_over"))
    out = kept.read().select("target_type", "target_id", F.col("source_text_hash").alias("hash"), "dimension", F.round(1000000 * F.col("embedding")[1]).cast("long").alias("second"))
    return out.join(F.broadcast(left))  # one row


VECTORS = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), q AS (SELECT e AS qe FROM vecs WHERE vec_id = 0)"


def _vectors(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    return own.select("vec_id", vec.doubles(F.col("embedding")).alias("embedding"), "label")


def _query_vector(spark, sf_dir) -> list[float]:
    rows = _vectors(spark, sf_dir).where("vec_id = 0").select("embedding").take(1)
    return list(rows[0].embedding) if rows else []


@query(f"WITH {VECTORS}, sc AS (SELECT vec_id, label, list_cosine_similarity(e, qe) AS cos FROM vecs CROSS JOIN q) SELECT vec_id, label, round((greatest(-1, least(1, cos)) + 1) / 2, 6) AS score FROM sc ORDER BY round(cos, 9) DESC, vec_id LIMIT 15")
def cosine_topk(spark, sf_dir):
    scored = _vectors(spark, sf_dir).withColumn("cos", F.round(vec.query_cosine(F.col("embedding"), _query_vector(spark, sf_dir)), 9))
    return s.top(scored, "cos", "vec_id", 15).select("vec_id", "label", F.round(vec.normalize_cosine(F.col("cos")), 6).alias("score"))


def _as_table(spark, sf_dir, kind):
    return _vectors(spark, sf_dir).select(F.lit(kind).alias("target_type"), F.col("vec_id").cast("string").alias("target_id"), F.lit("m").alias("model"), "embedding")


@query(f"WITH {VECTORS}, sc AS (SELECT CAST(vec_id AS VARCHAR) AS episode_id, label, list_cosine_similarity(e, qe) AS cos FROM vecs CROSS JOIN q), best AS (SELECT * FROM sc WHERE cos > 0.1 ORDER BY cos DESC, episode_id LIMIT 40) SELECT CAST(ev.event_id AS VARCHAR) AS event_id, round(MAX(best.cos), 6) AS vector FROM best JOIN events ev ON CAST(ev.event_id % 300 AS VARCHAR) = best.episode_id WHERE ev.event_type IN ('click', 'view') GROUP BY ev.event_id")
def episode_best_score(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr("cast(event_id as string) AS event_id", "event_type AS channel", "event_id AS n")
    members = events.selectExpr("cast(n % 300 as string) AS episode_id", "event_id")
    found = s.search_events_vector(events, members, _as_table(spark, sf_dir, "episode"), _query_vector(spark, sf_dir), 40, channels=["click", "view"])
    return found.select("event_id", F.round("vector", 6).alias("vector"))


@query(f"WITH {LEXICAL}, {VECTORS}, sc AS (SELECT 'doc:' || CAST(vec_id AS VARCHAR) AS doc_key, (greatest(-1, least(1, list_cosine_similarity(e, qe))) + 1) / 2 AS vector FROM vecs CROSS JOIN q), h AS (SELECT lex.doc_key, 0.6 * COALESCE(sc.vector, 0) + 0.4 * lexical / (SELECT MAX(lexical) FROM lex) AS score FROM lex LEFT JOIN sc ON sc.doc_key = lex.doc_key) SELECT doc_key, round(score, 6) AS score FROM h ORDER BY h.score DESC, doc_key LIMIT 20")
def hybrid_topk(spark, sf_dir):
    own = _as_table(spark, sf_dir, "document").withColumn("target_id", F.concat(F.lit("doc:"), "target_id"))
    found = s.search_documents(_docs(spark, sf_dir), QUERY, own, _query_vector(spark, sf_dir), limit=20)
    return found.select("doc_key", F.round("score", 6).alias("score"))


@query(f"WITH {_BM25}, {VECTORS}, f AS (SELECT doc_id, bm25 FROM sc ORDER BY bm25 DESC, doc_id LIMIT 30), v AS (SELECT vec_id AS doc_id, list_cosine_similarity(e, qe) AS vector FROM vecs CROSS JOIN q), best AS (SELECT * FROM v WHERE vector > 0.1 ORDER BY vector DESC, doc_id LIMIT 30), ok AS (SELECT b.* FROM best b JOIN documents d ON d.doc_id = b.doc_id), b AS (SELECT COALESCE(f.doc_id, ok.doc_id) AS doc_id, COALESCE(bm25, 0) / (SELECT MAX(bm25) FROM f) AS fts, COALESCE(vector, 0) AS vector FROM f FULL OUTER JOIN ok ON ok.doc_id = f.doc_id) SELECT doc_id AS event_id, round(0.6 * vector + 0.4 * fts, 6) AS score FROM b ORDER BY 0.6 * vector + 0.4 * fts DESC, doc_id LIMIT 15")
def hybrid_events_topk(spark, sf_dir):
    events = table(spark, sf_dir, "documents").selectExpr("doc_id AS event_id", "text AS content", "source AS channel", "doc_id AS ts")
    index = _index(spark, sf_dir)
    own = _vectors(spark, sf_dir).select(F.col("vec_id").alias("target_id"), "embedding")
    members = _vectors(spark, sf_dir).select(F.col("vec_id").alias("episode_id"), F.col("vec_id").alias("event_id"))
    found = s.search_events(events, index, s.corpus_stats(index), "hander thing reedin elleque", members, own, _query_vector(spark, sf_dir), limit=15, stem=False)
    return found.select("event_id", F.round("score", 6).alias("score"))


_VERSIONS = "inputs AS (SELECT 'doc:' || CAST(doc_id % 200 AS VARCHAR) AS doc_key, lang AS title, source AS description, text AS content, doc_id AS ts FROM documents), hashed AS (SELECT *, sha256(concat_ws(chr(10), COALESCE(title, ''), COALESCE(description, ''), COALESCE(content, ''))) AS content_hash FROM inputs), versions AS (SELECT * FROM (SELECT *, LAG(content_hash) OVER (PARTITION BY doc_key ORDER BY ts, content_hash) AS before FROM hashed) WHERE before IS DISTINCT FROM content_hash)"


def _inputs(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("'doc:' || (doc_id % 200) AS doc_key", "lang AS title", "source AS description", "text AS content", "doc_id AS ts", "source AS channel")


@query(f"WITH {_VERSIONS} SELECT doc_key, ts, content_hash, CASE WHEN ROW_NUMBER() OVER (PARTITION BY doc_key ORDER BY ts, content_hash) = 1 THEN 'created' ELSE 'updated' END AS action FROM versions")
def doc_versions(spark, sf_dir):
    return docs_ops.versions(_inputs(spark, sf_dir)).select("doc_key", "ts", "content_hash", "action")


@query(f"WITH {_VERSIONS} SELECT doc_key, content_hash, title FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_key ORDER BY ts DESC, content_hash DESC) AS r FROM versions) WHERE r = 1")
def doc_upsert_heads(spark, sf_dir):
    return docs_ops.heads(docs_ops.versions(_inputs(spark, sf_dir))).select("doc_key", "content_hash", "title")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unprocessed_anti(spark, sf_dir):
    return docs_ops.unprocessed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), e AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN h WHEN toxic = 1 THEN NULL ELSE 'old' END AS h FROM labels JOIN d USING (doc_id)) SELECT d.doc_id FROM d LEFT JOIN e ON e.doc_id = d.doc_id WHERE e.doc_id IS NULL OR e.h IS NULL OR e.h != d.h")
def stale_embeddings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    e = table(spark, sf_dir, "labels").join(d, "doc_id").selectExpr("doc_id AS target_id", "CASE WHEN quality = 1 AND toxic = 0 THEN content_hash WHEN toxic = 1 THEN NULL ELSE 'old' END AS source_text_hash")
    return docs_ops.stale_embeddings(d, e, id="doc_id").select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def not_in_subquery(spark, sf_dir):
    return docs_ops.not_in(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey")


@query("SELECT doc_id, CASE WHEN length(trim(text, ' ')) <= 240 THEN trim(text, ' ') ELSE left(trim(text, ' '), 240) || '...' END AS snippet, sha256(text) AS hash FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"), F.sha2("text", 256).alias("hash"))
