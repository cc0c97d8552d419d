"""From what models extracted out of episodes to the knowledge graph, for a whole batch at once.

Episodes go through the stages together. Within an episode mentions are resolved one after another,
each with the entities that those before it resolved to as context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import alias as alias_form
from tidemark.operators import graph
from tidemark.plans.components import written
from tidemark.plans.state import insert_new


def process(state: dict[str, DataFrame], episodes: DataFrame, entities: DataFrame, relationships: DataFrame, now: str, recent: DataFrame | None = None) -> dict[str, DataFrame]:
    """The next state of entities, aliases, relationships, entity_mentions and relationship_mentions.

    episodes (episode_id, reference_time); entities (episode_id, ref, name, entity_type_id), refs
    counting from 0 in each episode; relationships (episode_id, source_ref, target_ref,
    target_literal, relation_type, fact, source_type, valid_at, confidence). `recent`
    (episode_id, entity_id) are entities of the channel's last week. Episodes with mentions
    were processed before and are left out.
    """
    new = graph.unprocessed_episodes(episodes, state["entity_mentions"])
    said = graph.valid_entities(entities.join(new.select("episode_id"), "episode_id", "left_semi")).withColumn("mention_id", F.concat_ws("#", "episode_id", "ref"))
    found = graph.alias_candidates(said, state["aliases"], state["entities"]).withColumn("embedding_score", F.lit(None).cast("double"))
    lately = said.select("mention_id", "episode_id").join(recent, "episode_id").select("mention_id", "entity_id") if recent is not None else said.select("mention_id", F.lit(None).cast("string").alias("entity_id")).limit(0)
    decided = graph.resolve_in_order(said, found, state["relationships"], lately).drop("episode_id", "ref").join(said, "mention_id")
    # A new entity's id follows from its mention, so a batch that runs again makes the same ones.
    decided = written(decided.withColumn("entity_id", F.coalesce("entity_id", F.sha2(F.concat(F.lit("entity|"), "mention_id"), 256))))

    made = decided.where("is_new")
    fresh = made.select("entity_id", F.col("name").alias("canonical_name"), "entity_type_id", F.lit(None).cast("string").alias("summary"), F.lit("extracted").alias("origin"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("merged_into"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    named = made.select("entity_id", F.col("name").alias("alias"), F.lit("name").alias("alias_type"), alias_form(F.col("name"), F.lit("name")).alias("normalized"), F.lit(False).alias("is_shared"), F.lit(now).alias("created_at"))
    out = dict(state)
    out["entities"] = insert_new(state["entities"], fresh, ["entity_id"])
    aliases = insert_new(state["aliases"], named, ["entity_id", "normalized", "alias_type"])

    counts = entities.groupBy("episode_id").agg((F.max("ref") + 1).alias("entity_count"))
    edges = graph.valid_relationships(relationships.join(counts, "episode_id").join(new.select("episode_id"), "episode_id", "left_semi"))
    ends = decided.select("episode_id", "ref", "entity_id")
    edges = edges.join(ends.withColumnsRenamed({"ref": "source_ref", "entity_id": "source_entity_id"}), ["episode_id", "source_ref"])
    edges = edges.join(ends.withColumnsRenamed({"ref": "target_ref", "entity_id": "target_entity_id"}), ["episode_id", "target_ref"], "left").where("target_ref IS NULL OR target_entity_id IS NOT NULL")
    out["aliases"], identity_mentions, rest = graph.promote_identities(edges, aliases, now)
    after, edge_mentions = graph.resolve_edges(state["relationships"], rest, now)
    after = written(after)
    added = after.join(state["relationships"].select("relationship_id"), "relationship_id", "left_anti")
    # Only episodes that made an edge test theirs; the latest reference time dates undated ones.
    fallback = new.agg(F.max("reference_time")).first()[0]
    out["relationships"] = graph.invalidate(after, graph.contradictions(after, added, fallback))
    out["relationship_mentions"] = state["relationship_mentions"].unionByName(identity_mentions, allowMissingColumns=True).unionByName(edge_mentions, allowMissingColumns=True)
    out["entity_mentions"] = graph.count_mentions(state["entity_mentions"], decided, now)
    out["merge_candidates"] = decided.where("top_entity_id IS NOT NULL").select(F.least("entity_id", "top_entity_id").alias("entity_a_id"), F.greatest("entity_id", "top_entity_id").alias("entity_b_id"), "confidence", F.lit("ambiguous_resolution").alias("reason"))
    return out
