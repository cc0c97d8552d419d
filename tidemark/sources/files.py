"""Event logs, document folders, configuration, raw SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.base import ledger_id

LOG = "id string, ts string, timestamp_ms long, source string, type string, session_id string, content string, payload string, _corrupt string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of `*.jsonl` files; lines that are no JSON are skipped."""
    rows = spark.read.schema(LOG).option("pathGlobFilter", "*.jsonl").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt")


def log_events(raw: DataFrame, adapter: str = "event_log") -> DataFrame:
    ts = F.coalesce(F.expr("timestamp_ms div 1000"), F.try_to_timestamp("ts").cast("long"))
    channel = F.when(F.contains(F.lower(F.coalesce("source", F.lit(""))), F.lit("agent")), "agent").otherwise("terminal")
    return raw.select(ledger_id(adapter, F.col("id")).alias("event_id"), ts.alias("ts"), channel.alias("channel"), F.array(F.coalesce("type", F.lit("text"))).alias("content_types"), F.coalesce("content", "payload").alias("content"), F.lit("observed").alias("direction"), F.when(F.col("session_id").isNotNull(), ledger_id(adapter, F.col("session_id"))).alias("thread_id"), F.lit(adapter).alias("source_adapter"), F.col("id").alias("source_id")).where("source_id IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["source_adapter", "source_id"])


def read_documents(spark: SparkSession, path: str, glob: str = "*.md", channel: str = "docs", prefix: str = "doc") -> DataFrame:
    """Document inputs of a folder of Markdown files.

    Title and description come from a `name:`/`description:` front matter, else from the first
    heading and paragraph; the key is the parent folder of a file that is named for its role.
    """
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    raw = raw.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").cast("long").alias("ts"))
    front = F.regexp_extract("content", r"(?s)\A---\s*\n(.*?)\n---", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(front, rf"(?m)^{name}:\s*(.+)$", 1), r"^[\"']|[\"']$", "")), F.lit(""))
    title = F.coalesce(field("name"), field("title"), F.nullif(F.regexp_extract("content", r"(?m)^#\s+(.+)$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)$", 1))
    about = F.coalesce(field("description"), F.nullif(F.trim(F.regexp_extract("content", r"(?m)^(?!#|---|\s|\w+:)(.+)$", 1)), F.lit("")))
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) if glob.isupper() or glob == "SKILL.md" else F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select(F.concat(F.lit(f"{prefix}:"), F.coalesce(field("name"), name)).alias("doc_key"), F.lit(channel).alias("channel"), title.alias("title"), about.alias("description"), "content", "ts")


def read_config(text: str) -> dict:
    """The adapters of a YAML configuration (JSON, a subset of it, without a YAML library)."""
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text).get("adapters", {})
    return (yaml.safe_load(text) or {}).get("adapters", {})


_READS = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Distinct", "Join", "Union", "UnresolvedWith", "WithWindowDefinition", "UnresolvedInlineTable", "OneRowRelation", "UnresolvedRelation", "SubqueryAlias", "Intersect", "Except", "UnresolvedHaving", "Pivot", "UnresolvedSubqueryColumnAliases", "LateralJoin", "Generate", "Window", "Offset", "LocalRelation", "Tail", "Sample"}


def _writes(spark: SparkSession, plan) -> list[str]:
    """The commands and other statements in a parsed plan, at any depth."""
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    kinds = [spark._jvm.org.apache.spark.util.Utils.classForName(f"{logical}.{k}", False, False) for k in ("Command", "ParsedStatement")]
    found, work = [], [plan]
    while work:
        node = work.pop()
        if any(k.isInstance(node) for k in kinds):
            found.append(node.getClass().getSimpleName())
        for part in (node.children(), node.innerChildren(), node.subqueries()):
            work += [part.apply(i) for i in range(part.size())]
    return found


def raw_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None, write: bool = False) -> DataFrame:
    """Any SQL over the tables as views; without `write`, only statements that read.

    Every node of the parsed statement is looked at, so no write passes that hides behind WITH,
    FROM or a comment, or stands in a part of the statement.
    """
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    if not write:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        kind = plan.getClass().getSimpleName()
        refused = [kind] if kind not in _READS else _writes(spark, plan)
        if refused:
            raise PermissionError(f"only queries may run here, not {refused[0]}")
    return spark.sql(sql)
