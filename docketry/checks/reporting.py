"""Queries over conversations, audit rows and admin figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.checks.access import keys
from docketry.checks.base import Data, query
from docketry.functions import values
from docketry.operators import policies, reporting as op

NOW = "2024-01-30 12:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("entity_counts", """
select (select count(*) from users) as users, (select count(*) from documents) as documents,
  (select count(*) from convs) as conversations, (select count(*) from vehicles) as vehicles,
  (select count(*) from conflicts) as conflicts""")
def _(d: Data):
    return op.entity_counts(users=d.users, documents=d.table("documents"), conversations=d.convs,
                            vehicles=d.vehicles, conflicts=policies.detect_conflicts(d.policies))


@query("dashboard_counts", """
select least((select count(*) from documents), 200) as documents,
  (select count(*) from convs) as conversations, least((select count(*) from vehicles), 500) as vehicles,
  least((select count(*) from conflicts), 500) as conflicts, true as warn""")
def _(d: Data):
    return op.dashboard_counts(
        {"documents": 200, "vehicles": 500, "conflicts": 500}, documents=d.table("documents"),
        conversations=d.convs, vehicles=d.vehicles, conflicts=policies.detect_conflicts(d.policies))


def usage_sql(period: str, start: str) -> str:
    return f"""select '{period}' as period, count(*) as calls,
  cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens,
  cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens,
  count(*) filter (success) as successful from usage where created_at >= timestamp '{start}'"""


@query("external_usage_summary",
       usage_sql("today", "2024-01-30") + " union all " + usage_sql("month", "2024-01-01"))
def _(d: Data):
    return op.external_usage_summary(d.usage, now())


@query("period_starts", """
select event_id, cast(date_trunc('day', ts) as varchar) as day_start,
  cast(date_trunc('month', ts) as varchar) as month_start
from (select event_id, ts from events) e""")
def _(d: Data):
    starts = values.period_starts(F.col("ts"))
    return d.table("events").select(
        "event_id", F.date_format(starts["day"], "yyyy-MM-dd HH:mm:ss").alias("day_start"),
        F.date_format(starts["month"], "yyyy-MM-dd HH:mm:ss").alias("month_start"))


@query("usage_department", """
select e.event_id, 'Dept ' || u.department_id as department from usage e left join users u on u.user_id = e.user_id""")
def _(d: Data):
    departments = d.users.filter("department_id is not null").select("department_id").distinct().withColumn(
        "name", F.concat(F.lit("Dept "), F.col("department_id")))
    return op.usage_department(d.usage, d.users, departments).select("event_id", "department")


@query("append_audit_event", """
select event_type as action, user_id, cast(event_id as varchar) as resource_id,
  case when value > 10 then 'failure' else 'success' end as result,
  case when event_id % 2 = 0 then 'k=' || json_extract_string(props, '$.k') else '' end as meta
from events""")
def _(d: Data):
    meta = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    rows = op.append_audit_event(d.table("events").select(
        F.col("event_type").alias("action"), "user_id", F.lit("event").alias("resource_type"),
        F.col("event_id").alias("resource_id"), F.when(F.col("value") > 10, "failure").alias("result"),
        F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("string").alias("detail"),
        meta.alias("session_meta")))
    shown = F.array_join(F.transform(F.map_entries("session_meta"), lambda e: F.concat_ws("=", e.key, e.value)), ",")
    return rows.select("action", "user_id", "resource_id", "result", shown.alias("meta"))


@query("client_ip", """
select event_id, case when event_id % 3 = 0 then '10.0.' || user_id || '.1' else '192.0.2.7' end as ip from events""")
def _(d: Data):
    header = F.when(F.col("event_id") % 3 == 0, F.format_string(" 10.0.%d.1 , 198.51.100.2", "user_id")).when(
        F.col("event_id") % 3 == 1, "")
    return d.table("events").select("event_id", values.client_ip(header, F.lit("192.0.2.7")).alias("ip"))


@query("recent_audit", "select event_id, event_type from events order by ts desc, event_id desc limit 500")
def _(d: Data):
    rows = d.table("events").select("event_id", "event_type", F.col("ts").alias("created_at"))
    return op.recent_audit(rows, 900).select("event_id", "event_type")


@query("recent_users", """
select u.user_id, k.keys from (select user_id from users order by user_id % 50 desc, user_id desc limit 500) u
join action_keys k on k.user_id = u.user_id""")
def _(d: Data):
    users = d.users.withColumn("created_at", F.col("user_id") % 50)
    return op.recent_users(users, keys(d)).select("user_id", F.array_join("keys", ",").alias("keys"))


@query("enabled_agents", "select agent_id, name from agents where enabled order by name")
def _(d: Data):
    return op.enabled_agents(d.agents).select("agent_id", "name")


@query("integrations_by_name", "select n_name as name, n_regionkey as kind from nation order by name")
def _(d: Data):
    rows = d.table("nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("kind"))
    return op.integrations_by_name(rows)


@query("api_projections", """
select 'document' as entity, document_id as id, title from docs
union all select 'policy', id, policy_number from policies
union all select 'message', message_id, md5(content) from messages""")
def _(d: Data):
    docs = op.api_projection(d.docs.withColumnRenamed("document_id", "id"), "document", fill=True)
    rows = op.api_projection(d.policies, "policy", fill=True)
    said = op.api_projection(d.messages.withColumnRenamed("message_id", "id"), "message", fill=True)
    return docs.select(F.lit("document").alias("entity"), "id", "title").unionByName(
        rows.select(F.lit("policy").alias("entity"), "id", F.col("policy_number").alias("title"))).unionByName(
        said.select(F.lit("message").alias("entity"), "id", F.md5("content").alias("title")))


# --- conversations --------------------------------------------------------------------
@query("user_visible_conversations", "select conversation_id, user_id from convs where not archived")
def _(d: Data):
    return op.user_visible_conversations(d.convs).select("conversation_id", "user_id")


@query("conversation_order", """
select conversation_id, pinned from convs where not archived
order by pinned desc, updated_at desc, conversation_id limit 6""")
def _(d: Data):
    return op.conversation_order(op.user_visible_conversations(d.convs), 6).select("conversation_id", "pinned")


@query("conversation_title", """
select c.conversation_id, case when coalesce(c.title, 'New conversation') <> 'New conversation' then c.title
  else coalesce(nullif(left(trim(f.content), 60), ''), 'New conversation') end as title
from convs c left join (select conversation_id, min_by(content, position) as content from messages
  where role = 'user' group by 1) f on f.conversation_id = c.conversation_id""")
def _(d: Data):
    return op.titled_conversations(d.convs, d.messages).select("conversation_id", "title")


@query("owned_conversation", """
select r.request_id from requests r join convs c
  on c.conversation_id = r.document_id and c.user_id = r.user_id % 15""")
def _(d: Data):
    asked = d.requests.select("request_id", F.col("document_id").alias("conversation_id"),
                              (F.col("user_id") % 15).alias("user_id"))
    return op.owned_conversation(asked, d.convs).select("request_id")


@query("conversation_messages", """
select m.message_id, m.position, m.role, coalesce(cast(s.document_id as varchar) || '@' || s.page, '') as sources
from messages m join convs c on c.conversation_id = m.conversation_id
left join sources s on s.message_id = m.message_id""")
def _(d: Data):
    shown = F.array_join(F.transform("sources", lambda s: F.concat_ws("@", s.document_id, s.page)), ",")
    return op.conversation_messages(d.messages, d.sources, d.convs).select(
        "message_id", "position", "role", shown.alias("sources"))


@query("conversation_history", """
select conversation_id, 0 as seq, 'system' as role, md5('Be brief.') as digest from convs
union all select conversation_id, position + 1, role, md5(content) from messages where role in ('user', 'assistant')""")
def _(d: Data):
    return op.conversation_history(d.messages, d.convs, F.lit("Be brief.")).select(
        "conversation_id", "seq", "role", F.md5("content").alias("digest"))


def escalations(d: Data):
    return d.convs.select(
        F.col("conversation_id").alias("request_id"), "conversation_id", "user_id",
        (F.col("conversation_id") * 1000 + F.col("conversation_id") % 4).alias("message_id"))


ESCALATED = """
select c.conversation_id as request_id, coalesce(n.content, l.content) as question
from convs c
left join messages n on n.message_id = c.conversation_id * 1000 + c.conversation_id % 4
  and n.role = 'user' and n.content <> ''
left join (select conversation_id, max_by(content, position) as content from messages
  where role = 'user' group by 1) l on l.conversation_id = c.conversation_id
where coalesce(n.content, l.content) <> ''"""


@query("question_to_escalate", f"select request_id, md5(question) as digest from ({ESCALATED}) e")
def _(d: Data):
    return op.question_to_escalate(escalations(d), d.messages).select(
        "request_id", F.md5("question").alias("digest"))


@query("active_document", """
select conversation_id, position as seq, cast(last_value(doc ignore nulls) over (
  partition by conversation_id order by position) as varchar) as document_id
from (select *, case when role = 'assistant' and message_id % 3 = 0 then message_id % 200 end as doc from messages) m""")
def _(d: Data):
    picked = F.when((F.col("role") == "assistant") & (F.col("message_id") % 3 == 0), F.col("message_id") % 200)
    events = d.messages.select("conversation_id", F.col("position").alias("seq"), picked.alias("document_id"))
    return op.active_document(events).select(
        "conversation_id", "seq", F.col("document_id").cast("string").alias("document_id"))


@query("agent_defaults", """
select c.conversation_id as request_id,
  cast(coalesce(case when c.conversation_id % 5 = 0 then 4 end, c.agent_id) as varchar) as agent_id,
  a.model, cast(round(case when a.agent_id is null then 0.2 else a.temperature end, 6) as varchar) as temperature,
  coalesce(nullif(a.instructions, ''), 'Be brief.') as instructions
from convs c left join agents a
  on a.agent_id = coalesce(case when c.conversation_id % 5 = 0 then 4 end, c.agent_id)""")
def _(d: Data):
    asked = d.convs.select(
        F.col("conversation_id").alias("request_id"), "conversation_id",
        F.when(F.col("conversation_id") % 5 == 0, F.lit(4)).cast("long").alias("agent_id"))
    return op.agent_defaults(asked, d.convs, d.agents, "Be brief.").select(
        "request_id", F.col("agent_id").cast("string").alias("agent_id"), "model",
        F.round(F.col("temperature").cast("double"), 6).cast("string").alias("temperature"), "instructions")


@query("delete_conversation_cascade", """
select 'conversation' as kind, conversation_id as id from convs where not (conversation_id % 5 = 0 and user_id < 10)
union all select 'message', m.message_id from messages m join convs c on c.conversation_id = m.conversation_id
  where not (c.conversation_id % 5 = 0 and c.user_id < 10)
union all select 'source', s.message_id from sources s join messages m on m.message_id = s.message_id
  join convs c on c.conversation_id = m.conversation_id where not (c.conversation_id % 5 = 0 and c.user_id < 10)""")
def _(d: Data):
    ids = d.convs.filter("conversation_id % 5 = 0").select(
        "conversation_id", F.when(F.col("user_id") < 10, F.col("user_id")).otherwise(-1).alias("user_id"))
    convs, messages, sources = op.delete_conversation_cascade(d.convs, d.messages, d.sources, ids)
    return convs.select(F.lit("conversation").alias("kind"), F.col("conversation_id").alias("id")).unionByName(
        messages.select(F.lit("message").alias("kind"), F.col("message_id").alias("id"))).unionByName(
        sources.select(F.lit("source").alias("kind"), F.col("message_id").alias("id")))


@query("message_source_rows", """
select message_id, case when message_id % 2 = 0 then cast(document_id as varchar) end as document_id,
  document_title, page, case when message_id % 4 = 0 then 1 else 3 end as rank
from sources""")
def _(d: Data):
    listed = d.sources.select("message_id", F.array(F.struct(
        F.when(F.col("message_id") % 2 == 0, F.col("document_id").cast("string")).otherwise("sss.pdf")
        .alias("document_id"), "document_title", "page",
        F.when(F.col("message_id") % 4 != 0, F.lit(3)).alias("rank"))).alias("sources"))
    return op.message_source_rows(listed).select(
        "message_id", F.col("document_id").cast("string").alias("document_id"), "document_title", "page", "rank")


@query("import_external_answers", """
select m.conversation_id, md5(m.content) as digest, 'EXTERNAL_IMPORTED' as origin, 'external' as provider
from messages m join convs c on c.conversation_id = m.conversation_id and c.user_id = m.position % 15
where m.role = 'assistant'""")
def _(d: Data):
    pasted = d.messages.filter("role = 'assistant'").select(
        "conversation_id", (F.col("position") % 15).alias("user_id"), F.col("content").alias("answer"))
    return op.import_external_answers(pasted, d.convs).select(
        "conversation_id", F.md5("content").alias("digest"), "origin", "provider")


@query("document_status_label", """
select document_id, case when document_id % 4 = 0 then 'indexed' when document_id % 4 = 1 then 'needs OCR'
  when document_id % 4 = 2 then 'failed' else 'processing' end as label from docs""")
def _(d: Data):
    turn = F.col("document_id") % 4
    indexing = F.when(turn == 0, "indexed").when(turn == 1, "skipped_needs_ocr").when(turn == 2, "error: x")
    processing = F.when(turn == 2, "FAILED").otherwise("RUNNING")
    return d.docs.select("document_id", values.document_status_label(processing, indexing).alias("label"))


@query("confidence_band", """
select document_id, field_name, case when confidence >= 0.85 then 'high' when confidence >= 0.5 then 'medium'
  else 'low' end as band from extractions""")
def _(d: Data):
    return d.extractions.select("document_id", "field_name", values.confidence_band(F.col("confidence")).alias("band"))


@query("confidence_gate", """
select document_id, field_name, case when confidence >= 0.6 then value end as value from extractions""")
def _(d: Data):
    return d.extractions.select(
        "document_id", "field_name", values.confidence_gate(F.col("value"), F.col("confidence")).alias("value"))
