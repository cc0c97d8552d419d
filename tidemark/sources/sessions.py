"""AI sessions: messages, trimmed turns, tool commands, full-fidelity tables. Times are in ms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_tool_and_thinking
from tidemark.operators.runs import after_watermark
from tidemark.plans.components import written
from tidemark.schemas import TABLES
from tidemark.sources.base import ledger_id, missing

# Names of the tools that run terminal commands.
TERMINAL_TOOLS = ["run_terminal_cmd", "run_terminal_command_v2"]
TOOL_META = "struct<toolFormerData:struct<name:string,status:string,toolCallId:string,params:string,rawArgs:string,additionalData:struct<status:string>>>"
DIRECTION = {"user": "sent", "assistant": "received"}


def seconds(ms: Column) -> Column:
    return F.floor(ms / 1000).cast("long")


def direction(role: Column) -> Column:
    return F.when(role == "user", "sent").when(role == "assistant", "received").otherwise("observed")


def threads(sessions: DataFrame, adapter: str) -> DataFrame:
    return sessions.select(ledger_id(adapter, F.col("id")).alias("thread_id"), F.lit(adapter).alias("channel"), F.coalesce(missing(F.trim(F.coalesce("summary", F.lit("")))), missing(F.coalesce("task_description", F.lit(""))), F.col("project")).alias("name"), F.lit(adapter).alias("source_adapter"), F.col("id").alias("source_id"), F.when(missing(F.col("parent_session_id")).isNotNull(), ledger_id(adapter, F.col("parent_session_id"))).alias("parent_thread_id"))


def messages(raw: DataFrame, sessions: DataFrame, adapter: str, last_ts: int | None = None, last_id: str | None = None) -> DataFrame:
    """Message events after the tuple watermark (ms, id); empty messages are left out."""
    new = after_watermark(raw.withColumn("ts", F.coalesce("timestamp", F.lit(0))), last_ts, last_id)
    own = new.join(sessions.where(F.col("source") == adapter).select(F.col("id").alias("session_id"), "model", F.col("created_at").alias("session_ms")), "session_id")
    return own.where(F.trim(F.coalesce("content", F.lit(""))) != "").select(ledger_id(adapter, F.col("id")).alias("event_id"), seconds(F.coalesce("timestamp", "session_ms")).alias("ts"), F.lit(adapter).alias("channel"), F.array(F.lit("text")).alias("content_types"), "content", direction(F.col("role")).alias("direction"), ledger_id(adapter, F.col("session_id")).alias("thread_id"), F.lit(adapter).alias("source_adapter"), F.col("id").alias("source_id"), "metadata_json", "role", "model")


def tool_commands(raw: DataFrame, adapter: str) -> DataFrame:
    """Events of the terminal commands in messages' metadata, under `<adapter>_tool`.

    Cancelled, pending and running calls are no commands; params come before raw arguments.
    """
    m = raw.where(F.contains("metadata_json", F.lit("toolFormerData"))).withColumn("t", F.from_json("metadata_json", TOOL_META)["toolFormerData"])
    status, more = F.lower(F.trim(F.coalesce("t.status", F.lit("")))), F.lower(F.trim(F.coalesce("t.additionalData.status", F.lit(""))))
    command = F.trim(F.coalesce(missing(F.get_json_object("t.params", "$.command")), F.get_json_object("t.rawArgs", "$.command")))
    own = m.where(F.trim("t.name").isin(TERMINAL_TOOLS) & status.isin("", "completed", "error") & ~more.isin("cancelled", "pending", "running")).withColumn("command", command).where("command != ''")
    return own.select(F.concat(ledger_id(adapter, F.col("id")), F.lit(":tool")).alias("event_id"), seconds(F.col("timestamp")).alias("ts"), F.lit(adapter).alias("channel"), F.array(F.lit("tool_call")).alias("content_types"), F.col("command").alias("content"), F.lit("observed").alias("direction"), ledger_id(adapter, F.col("session_id")).alias("thread_id"), F.lit(f"{adapter}_tool").alias("source_adapter"), F.col("id").alias("source_id"), F.col("t.name").alias("tool_name"), F.col("t.toolCallId").alias("tool_call_id"))


def turn_events(turns: DataFrame, raw: DataFrame, adapter: str) -> DataFrame:
    """One `:user` and one `:assistant` event a turn, without tool and thinking blocks.

    A turn's question is its user messages in order of (sequence, id), joined by blank lines.
    """
    ids = F.coalesce(F.from_json("query_message_ids", "array<string>"), F.array("query_message_ids"))
    asked = turns.select(F.col("id").alias("turn_id"), F.explode(ids).alias("message_id"))
    body = raw.where("role = 'user'").select(F.col("id").alias("message_id"), "sequence", F.trim("content").alias("content")).where("content != ''")
    question = asked.join(body, "message_id").groupBy("turn_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "message_id", "content"))), lambda x: x["content"]), "\n\n").alias("content"))
    base = turns.select(F.col("id").alias("turn_id"), "session_id", "response_message_id", seconds(F.col("timestamp")).alias("ts"))
    answer = base.join(raw.select(F.col("id").alias("response_message_id"), strip_tool_and_thinking(F.col("content")).alias("content")), "response_message_id")

    def event(rows, side, way):
        return rows.where("content != ''").select(F.concat(ledger_id(adapter, F.col("turn_id")), F.lit(f":{side}")).alias("event_id"), "ts", F.lit(adapter).alias("channel"), F.array(F.lit("text")).alias("content_types"), "content", F.lit(way).alias("direction"), ledger_id(adapter, F.col("session_id")).alias("thread_id"), F.lit(adapter).alias("source_adapter"), F.concat("turn_id", F.lit(f":{side}")).alias("source_id"))

    return event(base.join(question, "turn_id"), "user", "sent").unionByName(event(answer, "assistant", "received"))


def full_fidelity(sessions: DataFrame, messages_: DataFrame, turns: DataFrame, tool_calls: DataFrame) -> dict[str, DataFrame]:
    """The four session tables as they are, in the ledger's types, for upserts by id."""
    rows = {"sessions": sessions, "messages": messages_, "turns": turns, "tool_calls": tool_calls}
    return {name: df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in TABLES[name]]) for name, df in rows.items()}


def turn_depths(turns: DataFrame) -> DataFrame:
    """(id, root_id, depth) of every turn in the tree, however deep; orphans are roots.

    By pointer jumping over written tables: a round doubles how far each turn sees, so a chain of
    n turns takes about log2(n) rounds. Turns on a cycle, or below one, have no root: root_id and
    depth are null. Of rows that repeat an id the smallest parent counts; rows without id are left out.
    """
    own = turns.where("id IS NOT NULL").groupBy("id").agg(F.min("parent_turn_id").alias("parent"))
    known = own.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    own = own.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))
    seen = written(own.select("id", F.coalesce("parent", "id").alias("top"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col("parent").isNull().alias("done")))
    left = seen.where("NOT done").count()
    while left:
        above = seen.select(F.col("id").alias("top"), F.col("top").alias("further"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        jumped = seen.where("NOT done").join(above, "top").select("id", F.col("further").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        seen = written(seen.where("done").unionByName(jumped))
        still = seen.where("NOT done").count()
        # Every round reaches a root from some turn, unless what is left hangs on cycles.
        if still == left:
            break
        left = still
    return seen.select("id", F.when(F.col("done"), F.col("top")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))
