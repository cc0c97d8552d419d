"""The bi-temporal knowledge graph: traversal, resolution, edges, contradictions, merging.

Entities, aliases and relationships are tables; a hop is an equi-join with the other end's
unmerged entities. Validity times are text and compare as text, so partial dates are legal.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import identity as fid
from tidemark.plans import grid
from tidemark.plans.classes import crossed, expanded
from tidemark.plans.components import components, written
from tidemark.plans.state import insert_new, merge_df

# Codes, names and descriptions of entity types.
ENTITY_TYPES = [(0, "Entity"), (1, "Person"), (2, "Organization"), (3, "Project"), (4, "Location"), (5, "Event"), (6, "Document"), (7, "Pet")]
# Relation types whose target is a literal, and the alias types of identities.
IDENTITY_RELATIONS = {"HAS_EMAIL": "email", "HAS_PHONE": "phone", "HAS_HANDLE": "handle", "HAS_USERNAME": "username", "ALSO_KNOWN_AS": "nickname"}
TEMPORAL_RELATIONS = ["BORN_ON", "ANNIVERSARY_ON", "OCCURRED_ON", "SCHEDULED_FOR", "STARTED_ON", "ENDED_ON"]
# Relation types of which one at a time is true.
EXCLUSIVE_RELATIONS = ["WORKS_AT", "LIVES_IN", "SPOUSE_OF", "MARRIED_TO", "DATING"]
SOURCE_TYPES = ["self_disclosed", "mentioned", "inferred"]
HARD_ALIASES = ["email", "phone", "handle"]
# Names of assistants, which are no entities.
ASSISTANTS = ["claude", "gpt", "chatgpt", "gpt-4", "gpt-3", "gpt-3.5", "gemini", "bard", "copilot", "llama", "mistral", "anthropic assistant"]

# Scores and thresholds.
ALIAS_NAME, ALIAS_CONTACT, ALIAS_EXACT, SHARED_FACTOR = 0.85, 0.95, 1.0, 0.7
EMBEDDING_LEAST, HIGH_CONFIDENCE, CLEAR_GAP, LEAST_MATCH = 0.85, 0.9, 0.15, 0.35
ONE_HARD, MANY_HARD, NAME_BIRTHDATE, NAME_EMPLOYER = 0.95, 0.99, 0.90, 0.85


@dataclass(frozen=True)
class QueryOptions:
    direction: str = "both"
    relation_types: tuple[str, ...] = ()
    include_invalidated: bool = False
    as_of: str | None = None
    now: str | None = None
    limit: int | None = 100


def valid(options: QueryOptions, prefix: str = "") -> Column:
    """Validity at `as_of` (or now): not invalidated by then, and, if asked as of a time, begun."""
    at = options.as_of or options.now
    out = F.lit(True)
    if not options.include_invalidated:
        end = F.col(f"{prefix}invalid_at")
        out = end.isNull() if at is None else end.isNull() | (end > at)
    if options.as_of is not None:
        begin = F.col(f"{prefix}valid_at")
        out = out & (begin.isNull() | (begin <= options.as_of))
    return out


def _chosen(relationships: DataFrame, options: QueryOptions) -> DataFrame:
    out = relationships.where(valid(options))
    return out.where(F.col("relation_type").isin(list(options.relation_types))) if options.relation_types else out


def _alive(entities: DataFrame) -> DataFrame:
    return entities.where("merged_into IS NULL")


EDGE = ["relationship_id", "relation_type", "fact", "valid_at", "invalid_at", "created_at"]


def related(entities: DataFrame, relationships: DataFrame, start: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
    """Entities one hop from each of `start` (start_id), outgoing then incoming, `limit` in all for each."""
    other = _alive(entities).select("entity_id", "canonical_name", "entity_type_id")
    edges = _chosen(relationships, options).where("target_entity_id IS NOT NULL")
    found = []
    if options.direction in ("both", "outgoing"):
        found.append(edges.join(start, edges.source_entity_id == start.start_id).join(other, F.col("target_entity_id") == F.col("entity_id")).select("start_id", F.lit("outgoing").alias("direction"), *other.columns, *EDGE))
    if options.direction in ("both", "incoming"):
        found.append(edges.join(start, edges.target_entity_id == start.start_id).join(other, F.col("source_entity_id") == F.col("entity_id")).select("start_id", F.lit("incoming").alias("direction"), *other.columns, *EDGE))
    return _limited(reduce(DataFrame.unionByName, found), options.limit, F.desc("direction"))


def _limited(rows: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    if limit is None:
        return rows
    w = Window.partitionBy("start_id").orderBy(*order, F.desc("created_at"), "relationship_id")
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= limit).drop("__rank")


def entity_relationships(entities: DataFrame, relationships: DataFrame, start: DataFrame, options: QueryOptions = QueryOptions()) -> DataFrame:
    """All edges of each start, literal targets too. A merged target shows without a name; an
    incoming edge needs an unmerged source."""
    alive = _alive(entities).select("entity_id", "canonical_name")
    edges = _chosen(relationships, options)
    found = []
    if options.direction in ("both", "outgoing"):
        out = edges.join(start, edges.source_entity_id == start.start_id).join(alive, F.col("target_entity_id") == F.col("entity_id"), "left")
        found.append(out.select("start_id", F.lit("outgoing").alias("direction"), F.col("target_entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"), "target_literal", *EDGE))
    if options.direction in ("both", "incoming"):
        into = edges.join(start, edges.target_entity_id == start.start_id).join(alive, F.col("source_entity_id") == F.col("entity_id"))
        found.append(into.select("start_id", F.lit("incoming").alias("direction"), F.col("source_entity_id").alias("other_id"), F.col("canonical_name").alias("other_name"), "target_literal", *EDGE))
    return _limited(reduce(DataFrame.unionByName, found), options.limit, F.desc("direction"))


def entity(entities: DataFrame, entity_id) -> DataFrame:
    return _alive(entities).where(F.col("entity_id") == entity_id)


def find_by_name(entities: DataFrame, name: str, entity_type_id: int | None = None, limit: int = 100) -> DataFrame:
    out = _alive(entities).where(F.contains(F.lower("canonical_name"), F.lit(name.lower())))
    if entity_type_id is not None:
        out = out.where(F.col("entity_type_id") == entity_type_id)
    return out.orderBy("canonical_name", "entity_id").limit(limit)


def find_by_relation(entities: DataFrame, relationships: DataFrame, relation_type: str, options: QueryOptions = QueryOptions()) -> DataFrame:
    """Distinct unmerged sources of a relation type; neither a lower time bound nor a limit applies."""
    edges = relationships.where(F.col("relation_type") == relation_type).where(valid(QueryOptions(include_invalidated=options.include_invalidated, now=options.as_of or options.now)))
    return _alive(entities).join(edges.select(F.col("source_entity_id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def aliases_of(aliases: DataFrame, entity_id) -> DataFrame:
    return aliases.where(F.col("entity_id") == entity_id).orderBy("alias_type", "alias")


def reachable(entities: DataFrame, relationships: DataFrame, start: DataFrame, hops: int, options: QueryOptions = QueryOptions(limit=None)) -> DataFrame:
    """(start_id, entity_id, hops): entities within `hops`, each at its least distance."""
    seen = start.select("start_id", F.col("start_id").alias("entity_id"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, hops + 1):
        step = related(entities, relationships, front.select(F.col("entity_id").alias("start_id")).distinct(), QueryOptions(**{**options.__dict__, "limit": None})).select(F.col("start_id").alias("__from"), F.col("entity_id").alias("__to"))
        front = front.join(step, front.entity_id == step["__from"]).select("start_id", F.col("__to").alias("entity_id")).distinct().join(seen.select("start_id", "entity_id"), ["start_id", "entity_id"], "left_anti").withColumn("hops", F.lit(h))
        seen = seen.unionByName(front)
    return seen


# --- resolution of extracted names ---


def valid_entities(extracted: DataFrame) -> DataFrame:
    """Extracted entities (name, entity_type_id) without assistants; unknown types are 0."""
    known = [k for k, _ in ENTITY_TYPES]
    out = extracted.where((F.trim("name") != "") & ~F.lower(F.trim("name")).isin(ASSISTANTS))
    return out.withColumn("entity_type_id", F.when(F.col("entity_type_id").isin(known), F.col("entity_type_id")).otherwise(0))


def alias_candidates(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id, alias_score, matched_alias, alias_type) for mentions (mention_id, name).

    Mentions with the same names are a class, which has its candidates once; mentions and candidates of a class
    meet in blocks, so pairs of the two are neither moved nor grouped.
    """
    classes = written(mentions.groupBy("mention_id").agg(F.sort_array(F.collect_set("name")).alias("names")).withColumn("class", F.sha2(F.to_json("names"), 256)))
    each = classes.groupBy("class").agg(F.first("names").alias("names")).select(F.col("class").alias("mention_id"), F.explode("names").alias("name"))
    found = written(_class_candidates(each, aliases, entities).withColumnRenamed("mention_id", "class"))
    return crossed(classes.where("mention_id IS NOT NULL").select("class", "mention_id"), found)


def _class_candidates(mentions: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """As `alias_candidates`, of mentions that are few."""
    own = aliases.join(_alive(entities).select("entity_id"), "entity_id", "left_semi").select("entity_id", "alias", "alias_type", "normalized", "is_shared")
    m = mentions.select("mention_id", "name", F.lower(F.trim("name")).alias("norm"))
    # Two equi-joins in place of an OR.
    hits = m.join(own, m["norm"] == own["normalized"]).unionByName(m.join(own, (m["name"] == own["alias"]) & ~m["norm"].eqNullSafe(own["normalized"])))
    base = F.when(F.col("normalized").eqNullSafe(F.col("norm")), ALIAS_EXACT).when(F.col("alias_type").isin("email", "phone"), ALIAS_CONTACT).otherwise(ALIAS_NAME)
    score = F.when(F.coalesce("is_shared", F.lit(False)), base * SHARED_FACTOR).otherwise(base)
    best = F.struct(score.alias("alias_score"), F.col("alias").alias("matched_alias"), "alias_type")
    return hits.groupBy("mention_id", "entity_id").agg(F.max(best).alias("b")).select("mention_id", "entity_id", "b.*")


def embedding_candidates(mentions: DataFrame, embeddings: DataFrame, least: float = EMBEDDING_LEAST, block: int = grid.QUERIES) -> DataFrame:
    """(mention_id, entity_id, embedding_score) for mentions with an embedding, against all entities.

    Vectors of different sizes, empty and zero ones have cosine 0, a score of 0.5.
    """
    entities = embeddings.where("target_type = 'entity'").select(F.col("target_id").alias("item_id"), F.col("embedding").alias("vector"))
    found = grid.cosine_pairs(mentions.select(F.col("mention_id").alias("query_id"), F.col("embedding").alias("vector")), entities, least, query_block=block)
    return found.select(F.col("query_id").alias("mention_id"), F.col("item_id").alias("entity_id"), F.col("score").alias("embedding_score"))


def context_scores(candidates: DataFrame, relationships: DataFrame, co_mentioned: DataFrame, recent: DataFrame) -> DataFrame:
    """`candidates` with context_score: 0.3 for an edge to an entity of the same episode, 0.2 for a
    recent mention in the channel. co_mentioned: (mention_id, other_id); recent: (mention_id, entity_id)."""
    ends = relationships.where("target_entity_id IS NOT NULL").select(F.col("source_entity_id").alias("a"), F.col("target_entity_id").alias("b"))
    ends = ends.union(ends.select("b", "a")).distinct()
    linked = candidates.select("mention_id", "entity_id").join(co_mentioned, "mention_id").join(ends, (F.col("entity_id") == F.col("a")) & (F.col("other_id") == F.col("b")), "left_semi").select("mention_id", "entity_id").distinct().withColumn("__rel", F.lit(0.3))
    out = candidates.join(linked, ["mention_id", "entity_id"], "left").join(recent.select("mention_id", "entity_id").distinct().withColumn("__recent", F.lit(0.2)), ["mention_id", "entity_id"], "left")
    return out.withColumn("context_score", F.coalesce("__rel", F.lit(0.0)) + F.coalesce("__recent", F.lit(0.0))).drop("__rel", "__recent")


def resolve(mentions: DataFrame, candidates: DataFrame, by: str = "mention_id") -> DataFrame:
    """A decision for every mention from its candidates' alias, embedding and context scores.

    (mention_id, decision, entity_id, confidence, candidates_count, is_new); entity_id is null
    for a new entity. `top_entity_id` is whom an ambiguous one might be. Candidates are those of a mention or,
    with `by`, of all mentions that have the same value in that column.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = candidates.withColumn("total", zero("alias_score") * 0.5 + zero("embedding_score") * 0.3 + zero("context_score") * 0.2)
    # The two best are kept as rows are added up, so no task orders all candidates of a name.
    two = F.struct((-F.col("total")).alias("t"), "entity_id", *[c for c in scored.columns if c not in ("entity_id", by)])
    first = scored.groupBy(by).agg(F.min(two).alias("top"), F.count("*").alias("n"))
    rest = scored.join(first.select(by, F.col("top.entity_id").alias("__top")), by).where("entity_id != __top").groupBy(by).agg(F.max("total").alias("second"))
    top = first.join(rest, by, "left").select(by, "top.*", "n", "second")
    gap = F.col("total") - F.col("second")
    decision = (
        F.when(F.col("n").isNull(), "created_new")
        .when(F.col("total") >= HIGH_CONFIDENCE, "high_confidence")
        .when(zero("alias_score") >= ALIAS_EXACT, "exact_alias")
        .when((F.col("n") == 1) & (F.col("total") >= LEAST_MATCH), "clear_winner")
        .when((F.col("n") >= 2) & (gap >= CLEAR_GAP) & (F.col("total") >= LEAST_MATCH), "clear_winner")
        .otherwise("ambiguous")
    )
    out = mentions.select(*dict.fromkeys(("mention_id", by))).join(top, by, "left").withColumn("decision", decision)
    new = F.col("decision").isin("created_new", "ambiguous")
    return out.select("mention_id", "decision", F.when(~new, F.col("entity_id")).alias("entity_id"), F.when(F.col("decision") == "created_new", 1.0).otherwise(F.col("total")).alias("confidence"), F.coalesce("n", F.lit(0)).alias("candidates_count"), new.alias("is_new"), F.when(F.col("decision") == "ambiguous", F.col("entity_id")).alias("top_entity_id"))


def _decide(rows: list[tuple], resolved: set) -> tuple:
    """(decision, entity_id, confidence) of one mention's (entity_id, base, alias, recent, neighbours)."""
    scored = sorted((-(base + 0.2 * (0.3 * bool(resolved & near) + 0.2 * recent)), entity, alias) for entity, base, alias, recent, near in rows)
    total, entity, alias = -scored[0][0], scored[0][1], scored[0][2]
    clear = len(scored) == 1 or total + scored[1][0] >= CLEAR_GAP
    if total >= HIGH_CONFIDENCE:
        decision = "high_confidence"
    elif alias >= ALIAS_EXACT:
        decision = "exact_alias"
    else:
        decision = "clear_winner" if clear and total >= LEAST_MATCH else "ambiguous"
    return decision, entity, total


def _lists(column: pa.Array) -> list[list]:
    """The lists of a column, a null one empty; much faster than list after list."""
    ends, values = column.offsets.to_pylist(), column.values.to_pylist()
    return [values[a:b] for a, b in pairwise(ends)]


def resolve_in_order(mentions: DataFrame, candidates: DataFrame, relationships: DataFrame, recent: DataFrame, by: str = "mention_id") -> DataFrame:
    """As `resolve`, but within an episode mention after mention in the order of `ref`: each sees as
    context the entities that those before it resolved to. With episode_id and ref.

    mentions (mention_id, episode_id, ref); recent (mention_id, entity_id). Candidates are those of a
    mention or, with `by`, of all mentions that have the same value in that column. New entities have no
    edges, so they are no context.

    Only a candidate that is recent or has an edge to an entity resolved before gains by it, and the two
    best come from these and the two that are best without context. So these two and the recent ones are
    taken, then the two best and the recent ones of those with an edge to one taken for an earlier mention,
    until there are no more; a task walks them in order and holds no more than one mention's, and what its episode resolved to.

    The two best are a key's, so what edges lead from them to is worked out for pairs of keys, and a mention meets
    it by an earlier one's key. A mention is moved to the walk once, with what is known of its key, and once for each edge.
    """
    placed = mentions.select("mention_id", "episode_id", "ref", F.col(by).alias("key"))
    at = F.struct("ref", "mention_id")
    base = F.coalesce("alias_score", F.lit(0.0)) * 0.5 + F.coalesce("embedding_score", F.lit(0.0)) * 0.3
    own = written(candidates.select(F.col(by).alias("key"), "entity_id", base.alias("base"), F.coalesce("alias_score", F.lit(0.0)).alias("alias")))
    best = own.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("base"), "entity_id"))).where("r <= 2")
    best = best.groupBy("key").agg(F.collect_list(F.struct("entity_id", "base", "alias")).alias("best"))
    best = written(best.join(own.groupBy("key").agg(F.count("*").alias("n")), "key"))
    top = best.select("key", F.explode("best.entity_id").alias("entity_id"))
    lately = written(placed.join(recent.select("mention_id", "entity_id").distinct(), "mention_id").join(own, ["key", "entity_id"]).select(*placed.columns, "entity_id", "base", "alias"))
    ends = relationships.where("target_entity_id IS NOT NULL").select(F.col("source_entity_id").alias("other"), F.col("target_entity_id").alias("entity_id"))
    # By the key of the far end, so that an entity with many edges meets only those that a mention may be.
    ends = ends.union(ends.select("entity_id", "other")).distinct().join(own, "entity_id").select("other", "key", "entity_id", "base", "alias")
    # All that have an edge to one gain the same by it, so of these too only the two best and the recent ones can win.
    ends = ends.withColumn("r", F.row_number().over(Window.partitionBy("other", "key").orderBy(F.desc("base"), "entity_id")))
    ends = written(ends.join(lately.select("key", "entity_id", F.lit(True).alias("recent")).distinct(), ["key", "entity_id"], "left").where("r <= 2 OR recent").select("other", "key", "entity_id", "base", "alias"))
    from_top = top.select(F.col("key").alias("before"), F.col("entity_id").alias("other")).join(ends, "other")
    from_top = written(from_top.join(top.withColumn("is_top", F.lit(True)), ["key", "entity_id"], "left"))
    # Dealt out by episode once, for both sides.
    dealt = placed.repartition("episode_id")
    before = dealt.groupBy("episode_id", F.col("key").alias("before")).agg(F.min(at).alias("at"))
    met = written(dealt.join(before, "episode_id").where(at > F.col("at")).join(from_top, ["before", "key"]).select(*placed.columns, "entity_id", "base", "alias", "other", "is_top"))
    links = met.drop("is_top")
    each = [*placed.columns, "entity_id"]
    seen = front = written(met.where("is_top IS NULL").select(*each).union(lately.join(top, ["key", "entity_id"], "left_anti").select(*each)).distinct())
    while not front.isEmpty():
        before = front.groupBy("episode_id", F.col("entity_id").alias("other")).agg(F.min(at).alias("at"))
        met = written(placed.join(before, "episode_id").where(at > F.col("at")).join(ends, ["other", "key"]).select(*links.columns))
        links = links.union(met)
        front = written(met.select(*each).distinct().join(top, ["key", "entity_id"], "left_anti").join(seen.select("mention_id", "entity_id"), ["mention_id", "entity_id"], "left_anti").select(*each))
        seen = seen.union(front)
    place = ["episode_id", "ref", "mention_id"]
    one = [F.array(c).alias(c) for c in ("entity_id", "base", "alias")]
    none = F.lit(None).cast(links.schema["other"].dataType).alias("other")
    rows = placed.join(best, "key", "left").select(*place, "best.entity_id", "best.base", "best.alias", "n", none, F.lit(False).alias("recent"))
    rows = rows.union(links.select(*place, *one, F.lit(None).cast("long"), "other", F.lit(False))).union(lately.select(*place, *one, F.lit(None).cast("long"), none, F.lit(True)))
    rows = rows.repartition("episode_id").sortWithinPartitions(*place)
    kinds = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in place)
    kind = candidates.schema["entity_id"].dataType.simpleString()

    def in_order(batches):
        episode, resolved, at, n, held, out = None, set(), None, 0, {}, []
        types = None

        def close():
            if at is None:
                return
            if not held:
                out.append((*at, "created_new", None, 1.0, 0))
                return
            decision, entity, total = _decide([(e, *h) for e, h in held.items()], resolved)
            if decision != "ambiguous":
                resolved.add(entity)
            out.append((*at, decision, entity, total, n))

        def flushed():
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[*place, "decision", "top", "confidence", "n"])

        for batch in batches:
            types = [*(batch.schema.field(c).type for c in place), pa.string(), batch.schema.field("entity_id").type.value_type, pa.float64(), pa.int64()]
            for row in zip(*(_lists(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    close()
                    if at is None or row[0] != episode:
                        episode, resolved = row[0], set()
                    at, n, held = row[:3], 0, {}
                if row[6] is not None:
                    n = row[6]
                for entity, base, alias in zip(*row[3:6], strict=True):
                    base, alias, recent, near = held.get(entity, (base, alias, False, set()))
                    if row[7] is not None:
                        near.add(row[7])
                    held[entity] = (base, alias, recent or row[8], near)
            if out:
                yield flushed()
                out = []
        close()
        if out:
            yield flushed()

    found = rows.mapInArrow(in_order, f"{kinds}, decision string, top {kind}, confidence double, n long")
    new = F.col("decision").isin("created_new", "ambiguous")
    return found.select("mention_id", "episode_id", "ref", "decision", F.when(~new, F.col("top")).alias("entity_id"), "confidence", F.col("n").alias("candidates_count"), new.alias("is_new"), F.when(F.col("decision") == "ambiguous", F.col("top")).alias("top_entity_id"))


def merge_scores(alias: DataFrame, embedding: DataFrame) -> DataFrame:
    return alias.join(embedding, ["mention_id", "entity_id"], "full_outer")


# --- relationships ---


def valid_relationships(extracted: DataFrame) -> DataFrame:
    """Extracted edges (source_ref, target_ref, target_literal, relation_type, fact, source_type,
    entity_count) that make sense, each with one target and a known source type."""
    literal = F.coalesce("target_literal", F.lit("")) != ""
    target = F.col("target_ref").isNotNull()
    prefers_literal = F.col("relation_type").isin([*IDENTITY_RELATIONS, *TEMPORAL_RELATIONS])
    out = extracted.where((F.coalesce("relation_type", F.lit("")) != "") & (F.coalesce("fact", F.lit("")) != "") & (target | literal) & F.col("source_ref").between(0, F.col("entity_count") - 1))
    out = out.withColumn("__t", F.when(target & ~(literal & prefers_literal), F.col("target_ref"))).withColumn("target_literal", F.when(literal & (~target | prefers_literal), F.col("target_literal"))).withColumn("target_ref", F.col("__t")).drop("__t")
    out = out.where(F.col("target_ref").isNull() | F.col("target_ref").between(0, F.col("entity_count") - 1))
    return out.withColumn("source_type", F.when(F.col("source_type").isin(SOURCE_TYPES), F.col("source_type")).otherwise("mentioned"))


def promote_identities(edges: DataFrame, aliases: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aliases, mentions, other edges): identity edges become aliases where people said so of
    themselves, and always a mention; telephone numbers that aren't any are dropped."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in IDENTITY_RELATIONS.items() for x in kv]), F.col("relation_type"))
    own = edges.where(F.col("relation_type").isin(list(IDENTITY_RELATIONS)) & F.col("target_literal").isNotNull()).withColumn("alias_type", kind)
    own = own.where((F.col("alias_type") != "phone") | fid.valid_phone(F.col("target_literal")))
    own = own.withColumn("normalized", fid.alias(F.col("target_literal"), F.col("alias_type")))
    new = own.where("source_type = 'self_disclosed'").groupBy(F.col("source_entity_id").alias("entity_id"), "normalized", "alias_type").agg(F.min("target_literal").alias("alias")).withColumn("is_shared", F.lit(False)).withColumn("created_at", F.lit(created_at))
    after = mark_shared(insert_new(aliases, new, ["entity_id", "normalized", "alias_type"]))
    known = after.select(F.col("entity_id").alias("source_entity_id"), "normalized", "alias_type", F.concat_ws("|", "entity_id", "alias_type", "normalized").alias("alias_id"))
    mentions = own.join(known, ["source_entity_id", "normalized", "alias_type"], "left").select("episode_id", F.lit(None).cast("string").alias("relationship_id"), F.col("fact").alias("extracted_fact"), "source_type", "target_literal", "alias_id", F.lit(1.0).alias("confidence"))
    rest = edges.where(~F.col("relation_type").isin(list(IDENTITY_RELATIONS)))
    return after, mentions, rest


def mark_shared(aliases: DataFrame) -> DataFrame:
    """Aliases that more than one entity has are shared, on every one of them."""
    groups = aliases.groupBy("normalized", "alias_type").agg((F.countDistinct("entity_id") > 1).alias("__shared"))
    out = aliases.join(groups.where("__shared"), ["normalized", "alias_type"], "left")
    return out.withColumn("is_shared", F.coalesce("is_shared", F.lit(False)) | F.coalesce("__shared", F.lit(False))).select(*aliases.columns)


EDGE_KEY = ["source_entity_id", "target_entity_id", "target_literal", "relation_type", "valid_at"]


def resolve_edges(state: DataFrame, edges: DataFrame, created_at: str) -> tuple[DataFrame, DataFrame]:
    """(relationships, mentions): equal edges are one, null-safe on every part of the key; each
    occurrence is a mention. Another valid_at is another edge."""
    rid = F.sha2(F.concat_ws("|", *[F.coalesce(k, F.lit("\0")) for k in EDGE_KEY]), 256)
    keyed = edges.withColumn("relationship_id", rid)
    new = keyed.groupBy(*EDGE_KEY).agg(F.min("relationship_id").alias("relationship_id"), F.min("fact").alias("fact"), F.max("confidence").alias("confidence")).withColumn("invalid_at", F.lit(None).cast("string")).withColumn("created_at", F.lit(created_at))
    after = insert_new(state, new, EDGE_KEY)
    ids = after.select("relationship_id", *[F.col(k).alias(f"__{k}") for k in EDGE_KEY])
    mentions = keyed.drop("relationship_id").join(ids, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in EDGE_KEY]).select("episode_id", "relationship_id", F.col("fact").alias("extracted_fact"), "source_type", "target_literal", "confidence")
    return after, mentions


def contradictions(relationships: DataFrame, new: DataFrame, fallback: str | None = None) -> DataFrame:
    """(relationship_id, invalid_at, by): current edges that newer ones of an exclusive type rule out.

    An edge is older if it has no valid_at or an earlier one; of two undated ones each rules out
    the other. Of several newer edges that with the least valid_at sets invalid_at, so the result
    doesn't depend on the order in which they came; undated ones give `fallback`.
    new: (relationship_id) of the edges to test.
    """
    target = F.coalesce("target_entity_id", "target_literal")
    kind = F.col("target_entity_id").isNotNull()
    own = relationships.where(F.col("relation_type").isin(EXCLUSIVE_RELATIONS)).withColumn("__target", target).withColumn("__kind", kind)
    fresh = own.join(new.select("relationship_id").distinct(), "relationship_id", "left_semi").select("source_entity_id", "relation_type", "__kind", F.col("__target").alias("n_target"), F.col("valid_at").alias("n_valid"), F.col("relationship_id").alias("n_id"))
    old = own.where("invalid_at IS NULL")
    pairs = old.join(fresh, ["source_entity_id", "relation_type", "__kind"]).where((F.col("__target") != F.col("n_target")) & (F.col("relationship_id") != F.col("n_id")))
    ruled = pairs.where(F.when(F.col("n_valid").isNotNull(), F.col("valid_at").isNull() | (F.col("valid_at") < F.col("n_valid"))).otherwise(F.col("valid_at").isNull()))
    at = F.coalesce("n_valid", F.lit(fallback).cast("string"))
    return ruled.groupBy("relationship_id").agg(F.min(F.struct(at.isNull().alias("none"), at.alias("invalid_at"), F.col("n_id").alias("by"))).alias("m")).select("relationship_id", "m.invalid_at", "m.by")


def contradictions_in_order(relationships: DataFrame) -> DataFrame:
    """(relationship_id, invalid_at) if all dated edges of exclusive types come in order of time:
    each ends when the next one with another target begins.

    Times at which only one target is named form runs of that target. An edge ends at the next
    time, unless that belongs to a run of its own target: then where that run ends.
    """
    target = F.coalesce("target_entity_id", "target_literal")
    keys = ["source_entity_id", "relation_type"]
    dated = relationships.where(F.col("relation_type").isin(EXCLUSIVE_RELATIONS) & F.col("valid_at").isNotNull() & F.col("invalid_at").isNull()).select("relationship_id", *keys, "valid_at", target.alias("__target")).where("__target IS NOT NULL")
    low, high = F.min("__target"), F.max("__target")
    times = dated.groupBy(*keys, "valid_at").agg(F.when(low == high, low).alias("only"))
    order = Window.partitionBy(*keys).orderBy("valid_at")
    # A new run begins where the one target isn't that of the time before; several make a run of their own.
    begins = ~F.coalesce(F.col("only") == F.lag("only").over(order), F.lit(False))
    times = times.withColumn("__begin", F.when(begins, F.col("valid_at")))
    back = Window.partitionBy(*keys).orderBy(F.desc("valid_at")).rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumns({"next": F.lead("valid_at").over(order), "next_only": F.lead("only").over(order), "__run": F.min("__begin").over(back)})
    # The run after the next time's: the first beginning after it.
    times = times.withColumn("after", F.lead("__run").over(order))
    ends = F.when(F.coalesce(F.col("next_only") == F.col("__target"), F.lit(False)), F.col("after")).otherwise(F.col("next"))
    return dated.join(times, [*keys, "valid_at"]).withColumn("invalid", ends).where("invalid IS NOT NULL").select("relationship_id", F.col("invalid").alias("invalid_at"))


def invalidate(relationships: DataFrame, found: DataFrame) -> DataFrame:
    f = found.select("relationship_id", F.col("invalid_at").alias("__at"))
    return relationships.join(f, "relationship_id", "left").withColumn("invalid_at", F.coalesce("invalid_at", "__at")).select(*relationships.columns)


# --- collisions and merging of entities ---


#: Kinds of shared keys, the strongest first.
_HARD, _BORN, _WORKS = 0, 1, 2


def _shared_keys(entities: DataFrame, aliases: DataFrame, relationships: DataFrame) -> DataFrame:
    """(key, entity_id, fact) of all that lets entities collide and that two or more share; keys are
    numbers, those of a stronger kind are less."""
    # Written, and met by relationships once: Spark refuses joins of unions of joins if these come in different numbers of partitions.
    own = written(aliases.join(_alive(entities).select("entity_id"), "entity_id", "left_semi").where("entity_id IS NOT NULL AND normalized IS NOT NULL").select("entity_id", "alias_type", "normalized", "is_shared"))
    hard = own.where(F.col("alias_type").isin(HARD_ALIASES) & ~F.coalesce("is_shared", F.lit(False)))
    rows = hard.select(F.lit(_HARD).alias("kind"), F.col("alias_type").alias("x"), F.col("normalized").alias("y"), "entity_id")
    names = own.where("alias_type = 'name'").select("entity_id", F.col("normalized").alias("x"))
    kind = F.when(F.col("relation_type") == "BORN_ON", _BORN).otherwise(_WORKS).alias("kind")
    facts = relationships.where(F.col("relation_type").isin("BORN_ON", "WORKS_AT") & F.col("invalid_at").isNull()).select(F.col("source_entity_id").alias("entity_id"), kind, F.coalesce("target_entity_id", F.lower("target_literal")).alias("y"))
    rows = rows.union(names.join(facts.where("y IS NOT NULL"), "entity_id").select("kind", "x", "y", "entity_id"))
    rows = written(rows.distinct())
    keys = rows.groupBy("kind", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
    # Written, as numbers must not change when a task runs again.
    keys = written(keys.select("kind", "x", "y", (F.col("kind").cast("long") * F.lit(1 << 60) + F.monotonically_increasing_id()).alias("key")))
    fact = F.when(F.col("kind") == _HARD, F.concat_ws(":", "x", "y")).otherwise(F.concat_ws(":", F.when(F.col("kind") == _BORN, "name_birthdate").otherwise("name_employer"), F.concat_ws("/", "x", "y")))
    return rows.join(keys, ["kind", "x", "y"]).select("key", "entity_id", fact.alias("fact"))


def _kind(key: Column) -> Column:
    return F.shiftright(key, 60)


def _collision(kind: Column, hard: Column) -> list[Column]:
    """confidence, reason, compound_type and hard_matches of a pair whose strongest shared key is of `kind`, with `hard` hard ones."""
    by_kind = lambda *values: F.when(kind == _HARD, F.when(hard > 1, F.lit(values[0])).otherwise(F.lit(values[1]))).when(kind == _BORN, F.lit(values[2])).otherwise(F.lit(values[3]))
    return [by_kind(MANY_HARD, ONE_HARD, NAME_BIRTHDATE, NAME_EMPLOYER).alias("confidence"), by_kind("multiple_hard_identifiers", "hard_identifier", "compound", "compound").alias("reason"), by_kind(None, None, "name_birthdate", "name_employer").cast("string").alias("compound_type"), hard.alias("hard_matches")]


def _matching(shared: Column, kind: Column, facts: str) -> Column:
    """The facts of those keys of `shared` that are of `kind`."""
    return F.sort_array(F.transform(F.filter(shared, lambda k: _kind(k) == kind), lambda k: F.element_at(facts, k))).alias("matching_facts")


def entity_collisions(entities: DataFrame, aliases: DataFrame, relationships: DataFrame, facts: bool = True, conflicts: bool = False) -> DataFrame:
    """(entity_a_id, entity_b_id, confidence, reason, compound_type, matching_facts, hard_matches).

    One hard identifier 0.95, several 0.99, name and birthdate 0.90, name and employer 0.85; of a
    pair the most confident reason counts, equal ones join their facts. Shared aliases and merged
    entities don't collide.

    Entities with the same hard identifiers are a class, and what two classes share is worked out once for all
    pairs of their entities. Pairs that share none meet under the first name and fact they share, and nowhere
    else, by the keys that each brings along; no pair of entities is moved or grouped. Without `facts` matching_facts
    is left out, with `conflicts` there is what `merge_conflicts` adds, both from what entities bring along.
    """
    each = _shared_keys(entities, aliases, relationships)
    each = written(each if facts else each.drop("fact"))
    own = each.groupBy("entity_id").agg(F.sort_array(F.collect_list("key")).alias("keys"), *([F.map_from_entries(F.collect_list(F.struct("key", "fact"))).alias("facts")] if facts else []))
    own = own.withColumn("hard", F.filter("keys", lambda k: _kind(k) == _HARD))
    if conflicts:
        own = own.join(_conflict_values(aliases, relationships), "entity_id", "left")
    own = written(own)
    return _by_hard_keys(own, facts, conflicts).unionByName(_by_names(each, own, facts, conflicts))


def _by_hard_keys(own: DataFrame, facts: bool, conflicts: bool) -> DataFrame:
    """The collisions of entities (entity_id, keys, hard, facts, values) that share hard identifiers."""
    # Birthdates are compared pair by pair: they are many, so classes would be too.
    rest = [F.sort_array(F.col("values")[k]).alias(k) for k in _CONFLICT_KINDS[1:]] if conflicts else []
    columns = ["hard", *(["facts"] if facts else []), *(_CONFLICT_KINDS[1:] if conflicts else [])]
    members = own.where(F.size("hard") > 0).select("entity_id", *[c for c in columns if c in own.columns], *rest, *([F.get("values.birthdate", F.lit(0)).alias("born")] if conflicts else []))
    alike = [c for c in columns if c != "facts"]
    members = written(members.withColumn("class", F.sha2(F.to_json(F.struct(*alike)), 256)))
    classes = written(members.groupBy("class").agg(*[F.first(c).alias(c) for c in columns]))
    keyed = classes.select(F.explode("hard").alias("key"), F.col("class").alias("own"), *columns).withColumnRenamed("key", "class")
    by_key = keyed.select(F.col("class").alias("c1"), F.col("class").alias("c2"), F.col("class").alias("key")).distinct()
    met = expanded(by_key, keyed, "own", tell=tuple(columns)).withColumn("shared", F.array_intersect("hard1", "hard2")).where(F.get("shared", F.lit(0)) == F.col("key")).drop("key")
    alone = classes.select(F.col("class").alias("p1"), F.col("class").alias("p2"), *[F.col(c).alias(f"{c}{n}") for c in columns for n in (1, 2)], F.col("hard").alias("shared"))
    differ = [F.when(~F.arrays_overlap(f"{k}1", f"{k}2"), F.lit(k)) for k in _CONFLICT_KINDS[1:]]
    said = _collision(F.lit(_HARD), F.size("shared").cast("long")) + ([_matching(F.col("shared"), F.lit(_HARD), "facts1")] if facts else [])
    said += [F.array_compact(F.array(*differ)).alias("same_birth"), F.array_compact(F.array(F.lit(_CONFLICT_KINDS[0]), *differ)).alias("other_birth")] if conflicts else []
    related = written(met.unionByName(alone).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), *said))
    found = expanded(related, members, "entity_id", tell=("born",) if conflicts else ()).withColumnsRenamed({"p1": "entity_a_id", "p2": "entity_b_id"})
    if conflicts:
        found = found.withColumn("conflicts", F.when(F.col("born1") != F.col("born2"), F.col("other_birth")).otherwise(F.col("same_birth"))).drop("born1", "born2", "same_birth", "other_birth")
    return found


def _by_names(each: DataFrame, own: DataFrame, facts: bool, conflicts: bool) -> DataFrame:
    """The collisions of entities, as in `_by_hard_keys`, that share names and facts (key, entity_id) but no hard identifier."""
    tell = ["before", *(["keys", "facts"] if facts else []), *(["values"] if conflicts else [])]
    soft = each.where(_kind(F.col("key")) != _HARD).select("key", "entity_id")
    # Two that share a key before this one meet there.
    members = soft.join(own, "entity_id").withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).select(F.col("key").alias("class"), "entity_id", *tell)
    by_key = soft.select(F.col("key").alias("c1"), F.col("key").alias("c2"), *(["key"] if facts else []), *_collision(_kind(F.col("key")), F.lit(0).cast("long"))).distinct()
    met = expanded(by_key, members, "entity_id", tell=tuple(tell)).where(~F.arrays_overlap("before1", "before2")).drop("before1", "before2")
    found = met.withColumnsRenamed({"p1": "entity_a_id", "p2": "entity_b_id"})
    if facts:
        found = found.withColumn("matching_facts", _matching(F.array_intersect("keys1", "keys2"), _kind(F.col("key")), "facts1")).drop("key", "keys1", "keys2", "facts1", "facts2")
    if conflicts:
        found = found.withColumn("conflicts", _differing(F.col("values1"), F.col("values2"))).drop("values1", "values2")
    return found


def colliding(entities: DataFrame, aliases: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity_id) of all that collide with another."""
    return _shared_keys(entities, aliases, relationships).select("entity_id").distinct()


def collisions_of(entities: DataFrame, aliases: DataFrame, relationships: DataFrame, entity_id) -> DataFrame:
    """The collisions of one entity, with those alone that share a key with it."""
    each = written(_shared_keys(entities, aliases, relationships))
    mine = each.where(F.col("entity_id") == entity_id).select("key")
    near = each.join(mine, "key", "left_semi").where(F.col("entity_id") != entity_id)
    found = near.groupBy("entity_id").agg(F.sort_array(F.collect_list("key")).alias("shared"), F.map_from_entries(F.collect_list(F.struct("key", "fact"))).alias("facts"))
    one, kind = F.lit(entity_id), _kind(F.get("shared", F.lit(0)))
    hard = F.size(F.filter("shared", lambda k: _kind(k) == _HARD)).cast("long")
    return found.select(F.least("entity_id", one).alias("entity_a_id"), F.greatest("entity_id", one).alias("entity_b_id"), *_collision(kind, hard), _matching(F.col("shared"), kind, "facts"))


def upsert_candidates(state: DataFrame, found: DataFrame | Column) -> DataFrame:
    """A pending candidate keeps the greatest confidence; decided ones are left as they are.

    `found` are candidates or, where all of them are in `state` already, the confidence with which each is found
    again, null if it isn't: then no pair is moved to meet itself."""
    if isinstance(found, Column):
        again = (F.col("status") == "pending") & found.isNotNull()
        best = F.when(again, F.greatest("confidence", found)).otherwise(F.col("confidence"))
        eligible = F.coalesce("auto_eligible", F.lit(False)) | (found >= ONE_HARD)
        return state.withColumns({"confidence": best, "auto_eligible": F.when(again, eligible).otherwise(F.col("auto_eligible"))}).select(*state.columns)
    new = found.withColumn("auto_eligible", F.col("confidence") >= ONE_HARD).withColumn("status", F.lit("pending"))
    return merge_df(state, new, ["entity_a_id", "entity_b_id"], {"confidence": "max", "auto_eligible": "or", "status": "old"}, when=F.col("old.status") == "pending")


_CONFLICT_KINDS = ["birthdate", "email", "phone"]


def _conflict_values(aliases: DataFrame, relationships: DataFrame) -> DataFrame:
    """(entity_id, values) with the distinct phones, emails and the newest birthdate of an entity, null where it has none."""
    known = aliases.where(F.col("alias_type").isin("phone", "email")).select("entity_id", F.col("alias_type").alias("kind"), F.col("normalized").alias("v"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("relationship_id"))
    born = relationships.where("relation_type = 'BORN_ON' AND invalid_at IS NULL AND target_literal IS NOT NULL").select(F.col("source_entity_id").alias("entity_id"), F.lit("birthdate").alias("kind"), F.col("target_literal").alias("v"), F.col("created_at").cast("string"), F.col("relationship_id").cast("string"))
    rows = known.union(born)
    newest = F.max_by(F.when(F.col("kind") == "birthdate", F.col("v")), F.when(F.col("kind") == "birthdate", F.struct("created_at", "relationship_id")))
    each = lambda kind: F.when(F.count_if(F.col("kind") == kind) > 0, F.collect_set(F.when(F.col("kind") == kind, F.col("v")))).alias(kind)
    return rows.groupBy("entity_id").agg(F.struct(F.when(newest.isNotNull(), F.array(newest)).alias("birthdate"), each("email"), each("phone")).alias("values"))


def _differing(a: Column, b: Column) -> Column:
    """The kinds in which both have values and share none."""
    return F.array_compact(F.array(*[F.when(~F.arrays_overlap(a[k], b[k]), F.lit(k)) for k in _CONFLICT_KINDS]))


def merge_conflicts(candidates: DataFrame, aliases: DataFrame, relationships: DataFrame) -> DataFrame:
    """`candidates` with conflicts: kinds (phone, email, birthdate) in which the two differ."""
    values = _conflict_values(aliases, relationships)
    a, b = (values.select(F.col("entity_id").alias(f"entity_{x}_id"), F.col("values").alias(f"__{x}")) for x in "ab")
    out = candidates.drop("conflicts").join(a, "entity_a_id", "left").join(b, "entity_b_id", "left")
    return out.withColumn("conflicts", _differing(F.col("__a"), F.col("__b"))).select(*[c for c in candidates.columns if c != "conflicts"], "conflicts")


def auto_merges(candidates: DataFrame) -> DataFrame:
    """`candidates` with auto_merge: no conflict, and a strong enough reason."""
    strong = F.col("reason").isin("hard_identifier", "multiple_hard_identifiers") & (F.col("confidence") >= ONE_HARD)
    born = (F.col("reason") == "compound") & (F.col("compound_type") == "name_birthdate") & (F.col("confidence") >= NAME_BIRTHDATE)
    return candidates.withColumn("auto_merge", (F.size("conflicts") == 0) & (strong | (F.col("hard_matches") >= 2) | F.coalesce(born, F.lit(False))))


def pending_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where("status = 'pending'").orderBy(F.desc("confidence"), "created_at", "entity_a_id", "entity_b_id")


def review(candidates: DataFrame, aliases: DataFrame, relationships: DataFrame, checked: bool = False) -> DataFrame:
    """`candidates` with conflicts and outcome: `conflict` (and no longer eligible), `merge` or
    `review` for pending ones, null for those that were decided. `checked` ones have their conflicts."""
    pending = F.col("status") == "pending"
    checked = auto_merges(candidates if checked else merge_conflicts(candidates, aliases, relationships))
    torn = F.size("conflicts") > 0
    outcome = F.when(pending, F.when(torn, "conflict").when(F.col("auto_merge"), "merge").otherwise("review"))
    return checked.withColumn("outcome", outcome).withColumn("auto_eligible", F.col("auto_eligible") & ~(pending & torn)).drop("auto_merge")


def settle(candidates: DataFrame, chosen: DataFrame | Column, status: str, by: str, reason: str | None, now: str) -> DataFrame:
    """`candidates` with those of `chosen`, pairs (entity_a_id, entity_b_id) or a condition, rejected, deferred or merged."""
    if status not in ("rejected", "deferred", "merged"):
        raise ValueError(f"unknown status: {status}")
    key = ["entity_a_id", "entity_b_id"]
    if isinstance(chosen, Column):
        out = candidates.withColumn("__chosen", chosen)
    else:
        out = candidates.join(chosen.select(*key).distinct().withColumn("__chosen", F.lit(True)), key, "left")
    for column, value in (("status", status), ("resolved_at", now), ("resolved_by", by), ("resolution_reason", reason)):
        out = out.withColumn(column, F.when(F.col("__chosen"), F.lit(value)).otherwise(F.col(column)))
    return out.select(*candidates.columns)


def merge_events(merged: DataFrame, mapping: DataFrame, by: str, now: str) -> DataFrame:
    """What was merged into what, and why: a row for each pair of `merged` whose ends the mapping joins."""
    into = lambda c, n: mapping.select(F.col("entity_id").alias(c), F.col("into").alias(n))
    ends = merged.join(into("entity_a_id", "__a"), "entity_a_id", "left").join(into("entity_b_id", "__b"), "entity_b_id", "left")
    target = F.coalesce("__a", "entity_a_id")
    # The source is the end that went; of two that went to a third both did.
    gone = F.filter(F.array("entity_a_id", "entity_b_id"), lambda e: e != target)
    return ends.where(target == F.coalesce("__b", "entity_b_id")).select(F.explode(gone).alias("source_entity_id"), target.alias("target_entity_id"), F.col("reason").alias("merge_type"), F.col("matching_facts").alias("triggering_facts"), F.col("confidence").alias("similarity_score"), F.lit(now).alias("created_at"), F.lit(by).alias("resolved_by"))


def merge_history(events: DataFrame, target_entity_id=None) -> DataFrame:
    """Merges into an entity (or all), newest first."""
    out = events if target_entity_id is None else events.where(F.col("target_entity_id") == target_entity_id)
    return out.orderBy(F.desc("created_at"), "source_entity_id")


def merge_mapping(merges: DataFrame) -> DataFrame:
    """(entity_id, into): components of the pairs to merge, without the ones that stay."""
    found = components(merges, "entity_a_id", "entity_b_id").where("node != component")
    return found.select(F.col("node").alias("entity_id"), F.col("component").alias("into"))


def merge_entities(entities: DataFrame, aliases: DataFrame, relationships: DataFrame, mentions: DataFrame, mapping: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, relationships, mentions) after merging: aliases and both ends of edges
    move, mention counts add up, the better name wins, merged entities point to their target."""
    names = entities.select("entity_id", F.col("canonical_name").alias("__source")).join(mapping, "entity_id")
    best = names.groupBy("into").agg(F.max_by("__source", F.struct(F.when(F.col("__source") == F.upper("__source"), 0).otherwise(1), F.length("__source"), "__source")).alias("__source"))
    out = entities.join(mapping, "entity_id", "left").join(best.withColumnRenamed("into", "__id"), F.col("entity_id") == F.col("__id"), "left")
    gain = F.col("__id").isNotNull() & fid.better_name(F.col("__source"), F.col("canonical_name"))
    # All at once: the better name is judged by the name as it was.
    out = out.withColumns({"canonical_name": F.when(gain, F.col("__source")).otherwise(F.col("canonical_name")), "updated_at": F.when(gain | F.col("into").isNotNull(), F.lit(now)).otherwise(F.col("updated_at")), "merged_into": F.coalesce("into", "merged_into")}).select(*entities.columns)

    def remap(df, column):
        m = mapping.select(F.col("entity_id").alias("__m"), F.col("into").alias("__into"))
        return df.join(m, F.col(column) == F.col("__m"), "left").withColumn(column, F.coalesce("__into", column)).select(*df.columns)

    moved = remap(remap(relationships, "source_entity_id"), "target_entity_id").where(~F.col("source_entity_id").eqNullSafe(F.col("target_entity_id")))
    own = remap(mentions, "entity_id").groupBy("episode_id", "entity_id").agg(F.sum("mention_count").alias("mention_count"), F.min("created_at").alias("created_at")).select(*mentions.columns)
    return out, remap(aliases, "entity_id").dropDuplicates(["entity_id", "alias_type", "normalized"]), moved, own


def count_mentions(state: DataFrame, resolved: DataFrame, created_at: str) -> DataFrame:
    """Mention counts with those of a batch (episode_id, entity_id) added."""
    new = resolved.groupBy("episode_id", "entity_id").agg(F.count("*").alias("mention_count")).withColumn("created_at", F.lit(created_at))
    return merge_df(state, new, ["episode_id", "entity_id"], {"mention_count": "sum", "created_at": "old"})


def unprocessed_episodes(episodes: DataFrame, mentions: DataFrame) -> DataFrame:
    """Episodes without any mention yet: processing one twice does nothing."""
    return episodes.join(mentions.select("episode_id").distinct(), "episode_id", "left_anti")


def memory_stats(entities: DataFrame, aliases: DataFrame, relationships: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row of counts."""
    parts = [
        entities.agg(F.count("*").alias("entities"), F.count_if(F.col("merged_into").isNull()).alias("active_entities")),
        aliases.agg(F.count("*").alias("aliases"), F.count_if(F.coalesce("is_shared", F.lit(False))).alias("shared_aliases")),
        relationships.agg(F.count("*").alias("relationships"), F.count_if(F.col("invalid_at").isNull()).alias("current_relationships")),
        mentions.agg(F.coalesce(F.sum("mention_count"), F.lit(0)).alias("mentions"), F.countDistinct("episode_id").alias("episodes")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def entity_texts(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity_id, text, text_hash) to embed: the name and other aliases in order."""
    own = aliases.groupBy("entity_id").agg(F.sort_array(F.collect_set("alias")).alias("a"))
    text = F.array_join(F.concat(F.array("canonical_name"), F.array_remove(F.coalesce("a", F.array().cast("array<string>")), F.col("canonical_name"))), ", ")
    return _alive(entities).join(own, "entity_id", "left").select("entity_id", text.alias("text"), F.sha2(text, 256).alias("text_hash"))
