"""Conversations, audit rows and the figures of the admin pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions.values import conversation_title, period_starts
from docketry.operators.common import carry_forward


# --- counts ---------------------------------------------------------------------
def _one_row(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Single counts side by side, gathered by a union rather than by cross joins."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        for name, df in parts
    ]
    return reduce(DataFrame.unionByName, counts).agg(*[
        F.max(F.when(F.col("entity") == name, F.col("n"))).alias(name) for name, _ in parts])


def entity_counts(**tables: DataFrame) -> DataFrame:
    """Number of rows of each table in one row."""
    return _one_row(list(tables.items()))


def dashboard_counts(caps: dict[str, int], **tables: DataFrame) -> DataFrame:
    """Counts that stop at a cap, as list pages show them, and a warning on conflicts."""
    row = _one_row([(name, df.limit(caps[name]) if name in caps else df) for name, df in tables.items()])
    return row.withColumn("warn", F.col("conflicts") > 0) if "conflicts" in tables else row


def external_usage_summary(usage: DataFrame, now: Column) -> DataFrame:
    """(period, calls, input_tokens, output_tokens, successful) since the start of the
    UTC day and month, in one pass over the month."""
    starts = period_starts(now)
    recent = usage.filter(F.col("created_at") >= starts["month"])

    def figures(name: str, start: Column) -> Column:
        since = F.col("created_at") >= start

        def total(col) -> Column:
            return F.coalesce(F.sum(F.when(since, col)), F.lit(0)).cast("long")

        return F.struct(
            F.lit(name).alias("period"), F.count_if(since).alias("calls"),
            total(F.col("input_tokens")).alias("input_tokens"),
            total(F.col("output_tokens")).alias("output_tokens"),
            total(F.when(F.col("success"), 1).otherwise(0)).alias("successful"))

    rows = recent.agg(figures("today", starts["day"]).alias("d"), figures("month", starts["month"]).alias("m"))
    return rows.select(F.inline(F.array("d", "m")))


def usage_department(usage: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """usage with the department name of its user, NULL when there is none."""
    names = users.join(departments, "department_id").select("user_id", F.col("name").alias("department"))
    return usage.join(names, "user_id", "left").select(*usage.columns, "department")


# --- audit ------------------------------------------------------------------------
def append_audit_event(events: DataFrame) -> DataFrame:
    """Audit rows as they are appended: ids as text, a result and details always set."""
    empty = F.create_map().cast("map<string,string>")
    return events.select(
        "action", "user_id", "resource_type", F.col("resource_id").cast("string").alias("resource_id"),
        F.coalesce("result", F.lit("success")).alias("result"), "ip_address", "detail",
        F.coalesce("session_meta", empty).alias("session_meta"))


def recent_audit(audit: DataFrame, n: int = 100) -> DataFrame:
    """Newest events first, never more than 500."""
    return audit.orderBy(F.desc("created_at"), F.desc("event_id")).limit(min(n, 500))


def recent_users(users: DataFrame, keys: DataFrame, n: int = 500) -> DataFrame:
    """The newest users with their permission keys; keys are joined to those n only."""
    newest = users.orderBy(F.desc("created_at"), F.desc("user_id")).limit(n)
    return newest.join(keys, "user_id", "left").orderBy(F.desc("created_at"), F.desc("user_id"))


def enabled_agents(agents: DataFrame) -> DataFrame:
    return agents.filter("enabled").orderBy("name")


def integrations_by_name(integrations: DataFrame) -> DataFrame:
    return integrations.orderBy("name")


def api_projection(df: DataFrame, entity: str, fill: bool = False) -> DataFrame:
    """The columns an entity shows. One that the frame lacks is an error, or NULL if `fill` asks for it."""
    shown = vocab.ENTITY_COLUMNS[entity]
    absent = [c for c in shown if c not in df.columns]
    if absent and not fill:
        raise ValueError(f"{entity} lacks {', '.join(absent)}")
    return df.select(*[F.lit(None).alias(c) if c in absent else F.col(c) for c in shown])


# --- conversations ------------------------------------------------------------------
def user_visible_conversations(convs: DataFrame, user_id: Column | None = None) -> DataFrame:
    """Unarchived conversations, of one user or of all."""
    shown = convs.filter(~F.col("archived"))
    return shown if user_id is None else shown.filter(F.col("user_id") == user_id)


def conversation_order(convs: DataFrame, n: int | None = None) -> DataFrame:
    """Pinned first, then the most recently updated."""
    ordered = convs.orderBy(F.desc("pinned"), F.desc("updated_at"), "conversation_id")
    return ordered if n is None else ordered.limit(n)


def titled_conversations(convs: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with the title their first question gives them."""
    first = messages.filter("role = 'user'").groupBy("conversation_id").agg(
        F.min_by("content", "position").alias("first_question"))
    titled = convs.join(first, "conversation_id", "left")
    return titled.withColumn(
        "title", conversation_title(F.col("title"), F.col("first_question"))).drop("first_question")


def owned_conversation(requests: DataFrame, convs: DataFrame) -> DataFrame:
    """Requests (conversation_id, user_id, ...) made by the owner of the conversation."""
    return requests.join(convs.select("conversation_id", "user_id"), ["conversation_id", "user_id"], "left_semi")


def conversation_messages(messages: DataFrame, sources: DataFrame, convs: DataFrame) -> DataFrame:
    """Messages of the given (owned) conversations with the sources of each.

    A message has at most as many sources as chunks were retrieved for it.
    """
    listed = sources.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct(
        "source_rank", "document_id", "document_title", "page"))).alias("sources"))
    own = messages.join(convs.select("conversation_id"), "conversation_id", "left_semi")
    return own.join(listed, "message_id", "left").select(
        "conversation_id", "position", "message_id", "role", "content",
        F.coalesce("sources", F.array()).alias("sources"))


def conversation_history(messages: DataFrame, convs: DataFrame, system: Column) -> DataFrame:
    """(conversation_id, seq, role, content): the system prompt as seq 0, then the user
    and assistant messages in order. One row per message, so a long conversation is
    never gathered in one place and nothing is shuffled."""
    prompt = convs.select("conversation_id", F.lit(0).cast("long").alias("seq"),
                          F.lit("system").alias("role"), system.alias("content"))
    said = messages.filter(F.col("role").isin("user", "assistant")).select(
        "conversation_id", (F.col("position") + 1).alias("seq"), "role", "content")
    return prompt.unionByName(said)


def question_to_escalate(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """requests(request_id, conversation_id, message_id) -> (request_id, question)."""
    asked = messages.filter((F.col("role") == "user"))
    named = asked.filter("content <> ''").select(
        "message_id", "conversation_id", F.col("content").alias("named"))
    last = asked.groupBy("conversation_id").agg(F.max_by("content", "position").alias("last"))
    return (
        requests.join(named, ["message_id", "conversation_id"], "left").join(last, "conversation_id", "left")
        .select("request_id", F.coalesce("named", "last").alias("question"))
        .filter("question <> ''")
    )


def active_document(events: DataFrame) -> DataFrame:
    """events(conversation_id, seq, document_id) with the last document picked so far."""
    return carry_forward(events, ["conversation_id"], "seq", "document_id")


def agent_defaults(requests: DataFrame, convs: DataFrame, agents: DataFrame, instructions: str = "",
                   temperature: float = 0.2) -> DataFrame:
    """requests(request_id, conversation_id, agent_id) with the settings that apply."""
    own = convs.select("conversation_id", F.col("agent_id").alias("conv_agent"))
    settings = agents.select("agent_id", "model", F.lit(True).alias("known"), "instructions",
                             F.col("temperature").alias("agent_temperature"))
    chosen = requests.join(own, "conversation_id").withColumn(
        "agent_id", F.coalesce("agent_id", "conv_agent"))
    return chosen.join(settings, "agent_id", "left").select(
        "request_id", "agent_id", F.nullif("model", F.lit("")).alias("model"),
        F.when(F.col("known"), F.col("agent_temperature")).otherwise(temperature).alias("temperature"),
        F.coalesce(F.nullif("instructions", F.lit("")), F.lit(instructions)).alias("instructions"))


def delete_conversation_cascade(
    convs: DataFrame, messages: DataFrame, sources: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the conversations named in ids(conversation_id, user_id)
    by their owner, their messages, and the sources of those."""
    gone = owned_conversation(ids, convs).select("conversation_id").distinct()
    dead = messages.join(gone, "conversation_id", "left_semi").select("message_id")
    return (
        convs.join(gone, "conversation_id", "left_anti"),
        messages.join(gone, "conversation_id", "left_anti"),
        sources.join(dead, "message_id", "left_anti"),
    )


def message_source_rows(answers: DataFrame, id_type: str = "bigint") -> DataFrame:
    """answers(message_id, sources) -> one row per source; an invalid id becomes NULL."""
    one = answers.select("message_id", F.explode("sources").alias("s"))
    return one.select(
        "message_id", F.col("s.document_id").try_cast(id_type).alias("document_id"),
        F.col("s.page").alias("page"), F.col("s.document_title").alias("document_title"),
        F.coalesce("s.rank", F.lit(1)).alias("rank"))


def import_external_answers(answers: DataFrame, convs: DataFrame) -> DataFrame:
    """answers(conversation_id, user_id, answer) of owners -> labelled assistant messages."""
    return owned_conversation(answers, convs).select(
        "conversation_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"),
        F.lit("EXTERNAL_IMPORTED").alias("origin"), F.lit("external (user-imported)").alias("model"),
        F.lit("external").alias("provider"))
