"""Episodes: how an event ledger falls into conversations.

Events are (event_id, ts, channel, thread_id, direction, ...). Every strategy is one window
over the partition that an episode can't leave. Where that could be a whole channel, or all
there is, windows go over stretches of time and what one stretch leaves to the next is carried
from a table with one row a stretch; a thread (or a channel's episodes) of more than `most` rows
is divided into stretches likewise (see plans.scan). Ids are hashes of what defines the episode, so running a
strategy again gives the same ids and an anti-join makes it idempotent.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.scan import MOST, Scan

# The definitions that a new ledger starts with.
SEEDED = [
    {"name": "imessage_3hr", "strategy": "time_gap", "channel": "imessage", "config": {"gap_seconds": 10800, "scope": "thread"}},
    {"name": "gmail_thread", "strategy": "thread", "channel": "gmail", "config": {}},
    {"name": "single_event", "strategy": "single_event", "channel": None, "config": {}},
    {"name": "ai_session", "strategy": "thread", "channel": "cursor", "config": {}},
    {"name": "ai_turn_pair", "strategy": "turn_pair", "channel": "cursor", "config": {"include_tools": True}},
]


def episode_id(definition: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(definition), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def _in_channel(events: DataFrame, channel: str | None) -> DataFrame:
    """A definition without a channel takes all."""
    return events if channel is None else events.where(F.col("channel") == channel)


#: Seconds of a stretch of time, the unit that one task orders where a scope may hold any number of events.
STRETCH = 3600


def _scoped(events: DataFrame, scope: str) -> DataFrame:
    if scope == "thread":
        events = events.where("thread_id IS NOT NULL")
        key = F.when(F.col("thread_id").cast("string") == "", "global").otherwise(F.col("thread_id").cast("string"))
    elif scope == "channel":
        key = F.col("channel")
    else:
        key = F.lit("global")
    return events.withColumn("scope_key", key)


_CELL = ["__scope", "__cell"]


def _in_stretches(events: DataFrame, gap_seconds: int, stretch: int) -> DataFrame:
    """`events` (with scope_key) with episode_no, and the stretch of each event."""
    # Nulls are a scope and a stretch of their own.
    events = events.withColumns({"__scope": F.coalesce(F.col("scope_key").cast("string"), F.lit("\0")), "__cell": F.coalesce(F.floor(F.col("ts") / stretch), F.lit(-(1 << 62)))})
    w = Window.partitionBy(*_CELL).orderBy("ts", "event_id")
    inner = events.withColumn("__start", F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap_seconds).cast("int"), F.lit(0))).withColumn("__nth", F.sum("__start").over(w))
    cells = inner.groupBy(*_CELL).agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.sum("__start").alias("starts"))
    order = Window.partitionBy("__scope").orderBy("__cell")
    cells = cells.withColumn("first", F.coalesce((F.col("begin") - F.lag("end").over(order) > gap_seconds).cast("int"), F.lit(1)))
    cells = cells.select(*_CELL, (F.sum(F.col("first") + F.col("starts")).over(order) - F.col("starts")).alias("__base"))
    return inner.join(cells, _CELL).withColumn("episode_no", F.col("__base") + F.col("__nth")).drop("__start", "__nth", "__base")


def gap_groups(events: DataFrame, gap_seconds: int, scope: str = "thread", stretch: int | None = None) -> DataFrame:
    """`events` with scope_key and episode_no: a gap strictly over `gap_seconds` starts another.

    With `stretch` (the default beyond threads) no task orders more than a stretch of a scope.
    """
    events = _scoped(events, scope)
    stretch = stretch or (None if scope == "thread" else STRETCH)
    if stretch:
        return _in_stretches(events, gap_seconds, stretch).drop(*_CELL)
    w = Window.partitionBy("scope_key").orderBy("ts", "event_id")
    starts = F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap_seconds).cast("int"), F.lit(1))
    return events.withColumn("__start", starts).withColumn("episode_no", F.sum("__start").over(w)).drop("__start")


def _placed_in_stretches(grouped: DataFrame) -> DataFrame:
    """Positions in episodes that may go on over many stretches, their first events and sizes."""
    own = [*_CELL, "episode_no"]
    parts = grouped.groupBy(*own).agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts", "event_id")).alias("opens"))
    episode = Window.partitionBy("__scope", "episode_no")
    order = episode.orderBy("__cell")
    parts = parts.select(*own, (F.sum("n").over(order) - F.col("n")).alias("__before"), F.first("opens").over(order).alias("__first"), F.sum("n").over(episode).alias("__n"))
    within = F.row_number().over(Window.partitionBy(*own).orderBy("ts", "event_id"))
    return grouped.withColumn("__within", within).join(parts, own).withColumn("position", (F.col("__before") + F.col("__within")).cast("int"))


def time_gap(events: DataFrame, gap_seconds: int, scope: str = "thread", channel: str | None = None, definition: str = "time_gap", least_events: int = 1, stretch: int | None = None) -> DataFrame:
    """(episode_id, event_id, ts, channel, thread_id, position) of time-gap episodes."""
    events = _in_channel(events, channel)
    stretch = stretch or (None if scope == "thread" else STRETCH)
    if stretch:
        placed = _placed_in_stretches(_in_stretches(_scoped(events, scope), gap_seconds, stretch))
    else:
        grouped = gap_groups(events, gap_seconds, scope)
        episode = Window.partitionBy("scope_key", "episode_no")
        w = episode.orderBy("ts", "event_id")
        placed = grouped.withColumn("position", F.row_number().over(w)).withColumn("__first", F.first("event_id").over(w))
        if least_events > 1:
            placed = placed.withColumn("__n", F.count("*").over(episode))
    if least_events > 1:
        placed = placed.where(F.col("__n") >= least_events)
    return placed.select(episode_id(definition, F.col("scope_key"), F.col("__first")).alias("episode_id"), "event_id", "ts", "channel", "thread_id", "position")


def by_thread(events: DataFrame, channel: str | None = None, definition: str = "thread", existing: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """One episode a thread; threads of `existing` episodes are left as they are."""
    events = _in_channel(events, channel).where("thread_id IS NOT NULL AND cast(thread_id AS string) != ''")
    if existing is not None:
        events = events.join(existing.select("thread_id").distinct(), "thread_id", "left_anti")
    placed = Scan(events, ["thread_id"], ["ts", "event_id"], most).total(F.lit(1), "position").result()
    return placed.withColumn("position", F.col("position").cast("int")).select(episode_id(definition, F.col("thread_id")).alias("episode_id"), "event_id", "ts", "channel", "thread_id", "position")


def single_events(events: DataFrame, channel: str | None = None, source_adapter: str | None = None, definition: str = "single_event", existing: DataFrame | None = None) -> DataFrame:
    """Each event an episode of its own; `existing` episode events of the definition are skipped."""
    events = _in_channel(events, channel)
    if source_adapter is not None:
        events = events.where(F.col("source_adapter") == source_adapter)
    if existing is not None:
        events = events.join(existing.select("event_id").distinct(), "event_id", "left_anti")
    return events.select(episode_id(definition, F.col("event_id")).alias("episode_id"), "event_id", "ts", "channel", "thread_id", F.lit(1).alias("position"))


def _answers(turns: DataFrame, include_tools: bool) -> DataFrame:
    return turns if include_tools else turns.where(F.col("direction").isin("sent", "received"))


def turn_pairs(events: DataFrame, include_tools: bool = False, channel: str | None = None, definition: str = "turn_pair", existing: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """A sent event and what answers it: received ones, and with `include_tools` all others.

    What a thread received before its first sent event belongs to no turn.
    """
    events = _in_channel(events, channel).where("thread_id IS NOT NULL AND cast(thread_id AS string) != ''")
    scan = Scan(events, ["thread_id"], ["ts", "event_id"], most).total((F.col("direction") == "sent").cast("int"), "turn")
    if scan.divided:
        # A turn can be as long as its thread: places are counted from where the turn begins.
        kept = F.lit(1) if include_tools else F.coalesce(F.col("direction").isin("sent", "received").cast("int"), F.lit(0))
        turns = _answers(scan.total(kept, "__kept").result().where("turn > 0"), include_tools)
        begins = turns.groupBy("thread_id", "turn").agg(F.min("__kept").alias("__begin"), F.min_by("event_id", "__kept").alias("__first"))
        placed = turns.join(begins, ["thread_id", "turn"]).withColumn("position", (F.col("__kept") - F.col("__begin") + 1).cast("int"))
    else:
        t = Window.partitionBy("thread_id", "turn").orderBy("ts", "event_id")
        placed = _answers(scan.result().where("turn > 0"), include_tools).withColumn("position", F.row_number().over(t)).withColumn("__first", F.first("event_id").over(t))
    if existing is not None:
        used = existing.where("position = 1").select(F.col("event_id").alias("__first")).distinct()
        placed = placed.join(used, "__first", "left_anti")
    return placed.select(episode_id(definition, F.col("thread_id"), F.col("__first")).alias("episode_id"), "event_id", "ts", "channel", "thread_id", "turn", "position")


def by_count(events: DataFrame, size: int, definition: str = "count", least_events: int = 1, most: int = MOST) -> DataFrame:
    """Runs of `size` events of a thread, the last one if it has `least_events` at least."""
    scan = Scan(events.where("thread_id IS NOT NULL"), ["thread_id"], ["ts", "event_id"], most).total(F.lit(1), "__nth")
    cut = scan.result().withColumn("chunk", F.floor((F.col("__nth") - 1) / size)).withColumn("position", ((F.col("__nth") - 1) % size + 1).cast("int"))
    placed = cut.withColumn("__n", F.count("*").over(Window.partitionBy("thread_id", "chunk"))).where(F.col("__n") >= least_events)
    return placed.select(episode_id(definition, F.col("thread_id"), F.col("chunk")).alias("episode_id"), "event_id", "ts", "channel", "thread_id", "position")


def by_window(events: DataFrame, duration: str = "1 day", definition: str = "window") -> DataFrame:
    """Fixed windows of a channel."""
    w = F.window(F.timestamp_seconds("ts"), duration)
    cut = events.withColumn("window", w.start.cast("long"))
    order = Window.partitionBy("channel", "window").orderBy("ts", "event_id")
    return cut.withColumn("position", F.row_number().over(order)).select(episode_id(definition, F.col("channel"), F.col("window")).alias("episode_id"), "event_id", "ts", "channel", "thread_id", "position")


def newest(episodes: DataFrame, n: int) -> DataFrame:
    """The `n` episodes that ended last."""
    return episodes.orderBy(F.desc("end_time"), "episode_id").limit(n)


def rows(members: DataFrame, definition: str) -> DataFrame:
    """Episode rows from their events: bounds, count, first and last event."""
    order = F.struct("ts", "event_id")
    return members.groupBy("episode_id").agg(
        F.lit(definition).alias("definition"),
        F.min_by("channel", order).alias("channel"),
        F.min_by("thread_id", order).alias("thread_id"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("event_count"),
        F.min_by("event_id", order).alias("first_event_id"),
        F.max_by("event_id", order).alias("last_event_id"),
    )


Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {"time_gap": time_gap, "thread": by_thread, "single_event": single_events, "turn_pair": turn_pairs, "count": by_count, "window": by_window}


def run_definition(events: DataFrame, definition: dict, existing: DataFrame | None = None) -> DataFrame:
    """Members of a definition's episodes; an unknown strategy is an error."""
    strategy = definition["strategy"]
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    config = dict(definition.get("config") or json.loads(definition.get("config_json") or "{}"))
    if strategy in ("thread", "single_event", "turn_pair") and existing is not None:
        config["existing"] = existing
    if strategy not in ("count", "window"):
        config["channel"] = definition.get("channel")
    members = STRATEGIES[strategy](events, definition=definition["name"], **config)
    if strategy == "time_gap" and existing is not None:
        members = members.join(existing.select("episode_id").distinct(), "episode_id", "left_anti")
    return members


def create_definition(definitions: list[dict], name: str, strategy: str, channel: str | None = None, config: dict | None = None) -> tuple[list[dict], dict]:
    """Get or create by name."""
    for d in definitions:
        if d["name"] == name:
            return definitions, d
    new = {"name": name, "strategy": strategy, "channel": channel, "config": config or {}}
    return [*definitions, new], new


def before(episodes: DataFrame, channel: str, start_time: int, k: int) -> DataFrame:
    """The `k` episodes of a channel that began last before a time, newest first."""
    return episodes.where((F.col("channel") == channel) & (F.col("start_time") < start_time)).orderBy(F.desc("start_time"), "episode_id").limit(k)


def before_each(episodes: DataFrame, k: int, most: int = MOST) -> DataFrame:
    """For every episode its `k` predecessors in the channel, as (episode_id, previous_id, rank)."""
    found = Scan(episodes.select("episode_id", "channel", "start_time"), ["channel"], ["start_time", "episode_id"], most).previous(F.col("episode_id"), k, "before").result()
    return found.select("episode_id", F.posexplode("before").alias("rank", "previous_id")).select("episode_id", "previous_id", (F.col("rank") + 1).alias("rank"))


def around(events: DataFrame, event_id, n_before: int, n_after: int) -> DataFrame:
    """Events of the centre's thread around it, in order, with their distance from it."""
    centre = events.where(F.col("event_id") == event_id).select("thread_id", F.col("ts").alias("c_ts"), F.col("event_id").alias("c_id"))
    near = events.join(F.broadcast(centre), "thread_id")  # one row
    later = (F.col("ts") > F.col("c_ts")) | ((F.col("ts") == F.col("c_ts")) & (F.col("event_id") > F.col("c_id")))
    ahead = near.where(later).orderBy("ts", "event_id").limit(n_after)
    behind = near.where(~later).orderBy(F.desc("ts"), F.desc("event_id")).limit(n_before + 1)
    w = Window.orderBy("ts", "event_id")  # n_before + n_after + 1 rows
    return behind.unionByName(ahead).withColumn("place", F.row_number().over(w)).drop("c_ts", "c_id")


def mask_labels(members: DataFrame, me: Column | None = None) -> DataFrame:
    """(episode_id, contact_id, label): User for oneself, Participant1, 2, ... by first appearance."""
    firsts = members.groupBy("episode_id", "contact_id").agg(F.min("position").alias("first"), F.max((me if me is not None else F.lit(False)).cast("int")).alias("own"))
    w = Window.partitionBy("episode_id", "own").orderBy("first", "contact_id")
    label = F.when(F.col("own") == 1, "User").otherwise(F.concat(F.lit("Participant"), F.row_number().over(w).cast("string")))
    return firsts.select("episode_id", "contact_id", label.alias("label"))


def sent_before(events: DataFrame, most: int = MOST) -> DataFrame:
    """`events` with the number of sent events strictly earlier in the thread."""
    sent = F.coalesce((F.col("direction") == "sent").cast("long"), F.lit(0))
    counted = Scan(events, ["thread_id"], ["ts"], most).total(sent, "__sent").result()
    # Of events of one second the first has none of their own before it.
    return counted.withColumn("sent_before", F.min(F.col("__sent") - sent).over(Window.partitionBy("thread_id", "ts"))).drop("__sent")


def membership_flip(events: DataFrame) -> DataFrame:
    """Membership events with `action`: one's own removal before one sent anything means added."""
    own = (F.col("action") == "removed") & F.col("is_self") & (F.col("sent_before") == 0)
    return sent_before(events).withColumn("action", F.when(own, "added").otherwise(F.col("action")))
