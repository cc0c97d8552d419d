"""Search: lexical, BM25, vector and hybrid, over documents, events and episodes.

A search is one pass over its table with a bounded top-k; the query vector is a literal of the
plan, corpus statistics are one-row aggregates. The inverted index is a table, (term, event_id,
tf, dl), to be written partitioned by term so that a search reads the postings of its terms only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions import vector as vec

VECTOR_WEIGHT, LEXICAL_WEIGHT = 0.6, 0.4
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
EVENT_VECTOR_LEAST = 0.1


def top(df: DataFrame, score: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(limit)


# --- documents ---


def lexical_scores(docs: DataFrame, query: str) -> DataFrame:
    """`docs` (doc_key, title, description, content) with their lexical score."""
    return docs.withColumn("lexical", tx.lexical_score(F.col("title"), F.col("description"), F.col("content"), query))


def vector_scores(embeddings: DataFrame, query: list[float], model: str | None = None) -> DataFrame:
    """(target_id, vector): cosine on [0, 1] of every vector of the query's dimension."""
    own = embeddings if model is None else embeddings.where(F.col("model") == model)
    own = own.where(F.size("embedding") == len(query))
    return own.select("target_id", vec.normalize_cosine(vec.query_cosine(F.col("embedding"), query)).alias("vector"))


def search_documents(docs: DataFrame, query: str, embeddings: DataFrame | None = None, query_vector: list[float] | None = None, use_lexical: bool = False, use_embeddings: bool = False, channels: list[str] | None = None, model: str | None = None, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """Documents by 0.6 vector + 0.4 lexical score (either alone if only it is asked for).

    Without a query vector the search is lexical. The lexical score is over the greatest one.
    Documents that score 0 stay unless `min_score` says otherwise.
    """
    if not query.strip():
        raise ValueError("a query is required")
    if not use_lexical and not use_embeddings:
        use_lexical = use_embeddings = True
    use_embeddings = use_embeddings and bool(query_vector) and embeddings is not None
    if channels:
        docs = docs.where(F.col("channel").isin(channels))
    scored = lexical_scores(docs, query) if use_lexical else docs.withColumn("lexical", F.lit(0.0))
    most = scored.agg(F.max("lexical").alias("most"))  # one row
    scored = scored.join(F.broadcast(most)).withColumn("lexical", F.when(F.col("most") > 0, F.col("lexical") / F.col("most")).otherwise(0.0)).drop("most")
    if use_embeddings:
        scored = scored.join(vector_scores(embeddings, query_vector, model), scored.doc_key == F.col("target_id"), "left").drop("target_id").withColumn("vector", F.coalesce("vector", F.lit(0.0)))
    else:
        scored = scored.withColumn("vector", F.lit(0.0))
    both = VECTOR_WEIGHT * F.col("vector") + LEXICAL_WEIGHT * F.col("lexical")
    score = both if use_lexical and use_embeddings else F.col("vector") if use_embeddings else F.col("lexical")
    out = scored.withColumn("score", score).where(F.col("score") >= min_score)
    out = top(out, "score", "doc_key", limit)
    return out.withColumn("snippet", tx.snippet(F.col("content"))).withColumn("score_breakdown", breakdown(vector="vector", lexical="lexical"))


def breakdown(**parts: str) -> Column:
    """A map of the parts that are over 0."""
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.col(c).alias("value")) for name, c in parts.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


# --- full text ---


def postings(events: DataFrame, id: str = "event_id", text: str = "content", stem: bool = True) -> DataFrame:
    """(term, id, tf, dl) of every term of every text."""
    tokens = tx.index_tokens(F.col(text))
    if stem:
        tokens = tx.stemmed_tokens(tokens)
    words = events.select(id, tokens.alias("tokens")).where(F.size("tokens") > 0)
    one = words.select(id, F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return one.groupBy("term", id, "dl").agg(F.count("*").alias("tf")).select("term", id, "tf", "dl")


def term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def term_lists(texts: DataFrame, id: str = "event_id", text: str = "content", stem: bool = True, parts: int = 64) -> DataFrame:
    """(part, id, dl, terms, tfs): the postings of each text as lists, one for each `term_part` that it has terms of.

    A text's words are put in order and counted within its row, so no row meets another one.
    """
    tokens = tx.index_tokens(F.col(text))
    if stem:
        tokens = tx.stemmed_tokens(tokens)
    words = texts.select(id, F.sort_array(tokens).alias("w")).where(F.size("w") > 0).withColumn("dl", F.size("w"))
    first = F.transform("w", lambda t, i: F.when((i == 0) | (t != F.get("w", i - 1)), F.struct(t.alias("term"), i.alias("at"))))
    runs = words.select(id, "dl", F.filter(first, lambda x: x.isNotNull()).alias("r"))
    counted = F.transform("r", lambda x, i: F.struct(term_part(x["term"], parts).alias("part"), x["term"].alias("term"), (F.coalesce(F.get("r", i + 1)["at"], "dl") - x["at"]).alias("tf")))
    ordered = runs.select(id, "dl", F.sort_array(counted).alias("c"))
    heads = F.filter(F.transform("c", lambda x, i: F.when((i == 0) | (x["part"] != F.get("c", i - 1)["part"]), i)), lambda i: i.isNotNull())
    cut = ordered.select(id, "dl", "c", heads.alias("h")).select(id, "dl", F.explode(F.transform("h", lambda a, i: F.slice("c", a + 1, F.coalesce(F.get("h", i + 1), F.size("c")) - a))).alias("l"))
    return cut.select(F.get("l", F.lit(0))["part"].alias("part"), id, F.col("dl").cast("long").alias("dl"), F.col("l.term").alias("terms"), F.col("l.tf").alias("tfs"))


def corpus_stats(postings_: DataFrame, id: str = "event_id") -> DataFrame:
    """(n_docs, avgdl), one row. A text's length is the sum of its term counts."""
    lengths = postings_.groupBy(id).agg(F.first("dl").alias("dl"))
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(query: str, stem: bool = True) -> list[str]:
    import re

    words = re.findall(r"[^\W_]+", query.lower())
    return sorted({tx.stem(tx.fold(w)) if stem else w for w in words})


def bm25(postings_: DataFrame, stats: DataFrame, query: str, id: str = "event_id", stem: bool = True) -> DataFrame:
    """(id, bm25) of the texts with any of the query's terms."""
    wanted = postings_.where(F.col("term").isin(query_terms(query, stem)))
    frequency = wanted.groupBy("term").agg(F.count("*").alias("n"))  # one row a query term
    own = wanted.join(F.broadcast(frequency), "term").join(F.broadcast(stats))
    idf = F.greatest(F.lit(LEAST_IDF), F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    score = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return own.groupBy(id).agg(F.sum(score).alias("bm25"))


def mark(text: Column, query: str, window: int = 64) -> Column:
    """A passage around the first query word, its words marked."""
    import re

    words = sorted({re.escape(w) for w in re.findall(r"[^\W_]+", query.lower())}, key=len, reverse=True)
    if not words:
        return tx.snippet(text, window)
    pattern = rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(words)})(?![\p{{L}}\p{{N}}])"
    around = F.regexp_extract(text, rf"(?s)((?:\S+\s+){{0,{window // 2}}}\S*?{pattern}\S*(?:\s+\S+){{0,{window // 2}}})", 1)
    return F.regexp_replace(around, pattern, "<mark>$1</mark>")


def _filters(events: DataFrame, channels, thread_id, since, until) -> DataFrame:
    if channels:
        events = events.where(F.col("channel").isin(channels))
    if thread_id is not None:
        events = events.where(F.col("thread_id") == thread_id)
    if since is not None:
        events = events.where(F.col("ts") >= since)
    if until is not None:
        events = events.where(F.col("ts") <= until)
    return events


def search_events_text(events: DataFrame, index: DataFrame, stats: DataFrame, query: str, limit: int, channels=None, thread_id=None, since=None, until=None, stem: bool = True) -> DataFrame:
    """(event_id, fts): the best of those events that meet the filters."""
    own = _filters(events, channels, thread_id, since, until).select("event_id")
    return top(bm25(index, stats, query, stem=stem).join(own, "event_id", "left_semi"), "bm25", "event_id", limit).withColumnRenamed("bm25", "fts")


def search_events_vector(events: DataFrame, episode_events: DataFrame, embeddings: DataFrame, query_vector: list[float], limit: int, channels=None, thread_id=None, since=None, until=None) -> DataFrame:
    """(event_id, vector): events by their best episode. The best `limit` episodes are taken
    before the events are filtered, so a filter never lets a lesser episode in."""
    own = embeddings.where(F.size("embedding") == len(query_vector)).select(F.col("target_id").alias("episode_id"), vec.query_cosine(F.col("embedding"), query_vector).alias("vector"))
    best = top(own.where(F.col("vector") > EVENT_VECTOR_LEAST), "vector", "episode_id", limit)
    hit = F.broadcast(best).join(episode_events.select("episode_id", "event_id"), "episode_id")  # `limit` rows
    hit = _filters(events, channels, thread_id, since, until).select("event_id").join(hit, "event_id")
    return hit.groupBy("event_id").agg(F.max("vector").alias("vector"))


def search_events(events: DataFrame, index: DataFrame, stats: DataFrame, query: str, episode_events: DataFrame | None = None, embeddings: DataFrame | None = None, query_vector: list[float] | None = None, use_fts: bool = False, use_embeddings: bool = False, limit: int = 20, min_score: float = 0.0, stem: bool = True, **filters) -> DataFrame:
    """Events by 0.6 vector + 0.4 full-text score over the greatest one."""
    if not use_fts and not use_embeddings:
        use_fts = use_embeddings = True
    empty = events.sparkSession.createDataFrame([], "event_id string, score double")
    found = search_events_text(events, index, stats, query, limit * 2, stem=stem, **filters) if use_fts else empty.withColumnRenamed("score", "fts")
    near = search_events_vector(events, episode_events, embeddings, query_vector, limit * 2, **filters) if use_embeddings and query_vector else empty.withColumnRenamed("score", "vector")
    both = found.join(near, "event_id", "full_outer").fillna(0.0, ["fts", "vector"])
    most = found.agg(F.max("fts").alias("most"))  # one row
    both = both.join(F.broadcast(most)).withColumn("fts", F.when(F.col("most") > 0, F.col("fts") / F.col("most")).otherwise(0.0)).drop("most")
    mixed = VECTOR_WEIGHT * F.col("vector") + LEXICAL_WEIGHT * F.col("fts")
    score = mixed if use_fts and use_embeddings else F.col("vector") if use_embeddings else F.col("fts")
    best = top(both.withColumn("score", score).where(F.col("score") >= min_score), "score", "event_id", limit)
    out = events.join(F.broadcast(best), "event_id")  # `limit` rows
    marked = mark(F.col("content"), query)
    out = out.withColumn("snippet", F.when((F.col("fts") > 0) & (marked != ""), marked).otherwise(tx.snippet(F.col("content"))))
    return out.withColumn("score_breakdown", breakdown(fts="fts", vector="vector")).orderBy(F.desc("score"), "event_id")


# --- episodes ---


def search_episodes(embeddings: DataFrame, episodes: DataFrame, query_vector: list[float], model: str | None = None, channels: list[str] | None = None, definitions: list[str] | None = None, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """Episodes by the cosine on [0, 1] of their vectors; filters come before the top."""
    near = vector_scores(embeddings, query_vector, model)
    out = near.join(episodes, near.target_id == episodes.episode_id).drop("target_id")
    if channels:
        out = out.where(F.col("channel").isin(channels))
    if definitions:
        out = out.where(F.col("definition").isin(definitions))
    return top(out.withColumnRenamed("vector", "score").where(F.col("score") >= min_score), "score", "episode_id", limit)


def route(embeddings: DataFrame, episodes: DataFrame, query_vector: list[float], definition: str = "ai_turn_pair", limit: int = 5, **more) -> DataFrame:
    """The turns that most resemble a request."""
    return search_episodes(embeddings, episodes, query_vector, definitions=[definition], limit=limit, **more)


def previews(members: DataFrame, events: DataFrame, contact_labels: DataFrame, most: int = 200, n: int = 5) -> DataFrame:
    """(episode_id, preview): the first `n` events as `name: text`, cut after `most` characters."""
    first = members.where(F.col("position") <= n).select("episode_id", "event_id", "position")
    line = F.concat_ws(": ", F.coalesce("label", F.lit("Unknown")), F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " "))
    lines = first.join(events.select("event_id", "content", "contact_id"), "event_id").join(contact_labels.select("contact_id", "label"), "contact_id", "left")
    joined = lines.groupBy("episode_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), " | ").alias("preview"))
    return joined.withColumn("preview", F.when(F.length("preview") > most, F.concat(F.left("preview", F.lit(most)), F.lit("..."))).otherwise(F.col("preview")))


def idf(n_docs: int, n: int) -> float:
    return max(LEAST_IDF, math.log((n_docs - n + 0.5) / (n + 0.5)))
