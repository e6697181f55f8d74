"""Domain tables derived from the given tables by plain SQL.

Each text runs in Spark and, with its few dialect words replaced, in DuckDB, so
an operator and the SQL it is checked against start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docketry.sources.tables import SCHEMAS, read_table, spread

TEXTS = {
    "docs": """
select doc_id as document_id, 'doc-' || cast(doc_id as varchar(20)) as title,
  doc_id % 15 as owner_id, doc_id % 7 as department_id,
  case doc_id % 4 when 0 then 'PUBLIC' when 1 then 'INTERNAL' when 2 then 'CONFIDENTIAL'
    else 'RESTRICTED' end as classification,
  (doc_id % 11 = 0) as is_deleted, @sha(text) as content_hash, doc_id as arrival, lang, text
from documents""",
    "users": """
select user_id, case when user_id % 5 = 0 then null else user_id % 7 end as department_id,
  (user_id = 0) as is_superuser, 'User' || cast(user_id as varchar(20)) || '@Example.org' as email
from (select distinct user_id from events) u""",
    "user_roles": """
select user_id, user_id % 6 as role_id from (select distinct user_id from events) a
union all
select user_id, 6 as role_id from (select distinct user_id from events) b where user_id % 4 = 1""",
    "grants": """
select doc_id as document_id, doc_id % 15 + 1 as user_id, cast(null as bigint) as role_id,
  cast(null as bigint) as department_id from documents where doc_id % 9 = 0
union all
select doc_id, cast(null as bigint), doc_id % 6, cast(null as bigint)
from documents where doc_id % 10 = 0
union all
select doc_id, cast(null as bigint), cast(null as bigint), doc_id % 7
from documents where doc_id % 13 = 0""",
    "requests": """
select event_id as request_id, user_id, event_id % 1200 as document_id,
  case event_type when 'click' then 'VIEW' when 'error' then 'GLOBAL_AI_ESCALATION'
    when 'view' then 'EXPORT' else 'UPLOAD' end as action
from events""",
    "policies": """
select o_orderkey as id,
  case when o_orderkey % 23 = 0 then ''
       when o_orderkey % 2 = 0 then lpad(cast(o_custkey as varchar(20)), 7, '0')
       else substr(lpad(cast(o_custkey as varchar(20)), 7, '0'), 1, 2) || '-' ||
            substr(lpad(cast(o_custkey as varchar(20)), 7, '0'), 3, 3) || '-' ||
            substr(lpad(cast(o_custkey as varchar(20)), 7, '0'), 6, 2) end as vehicle_number,
  case o_orderkey % 4 when 0 then 'COMPULSORY' when 2 then 'THIRD_PARTY'
       else 'COMPREHENSIVE' end as insurance_type,
  case when o_orderkey % 7 = 0 then null
       else 'POL-' || cast(o_custkey as varchar(20)) || '-' || cast(o_orderkey % 6 as varchar(20))
       end as policy_number,
  case when o_orderkey % 13 = 0 then null
       when o_orderkey % 2 = 0 then 'Insurer ' || cast(o_orderkey % 3 as varchar(20))
       else 'INSURER ' || cast(o_orderkey % 3 as varchar(20)) end as insurer,
  case when o_orderkey % 29 = 0 then null else cast(o_orderdate as date) end as start_date,
  case when o_orderkey % 17 = 0 then null
       when o_orderkey % 19 = 0 then cast(o_orderdate as date) + -10
       else cast(o_orderdate as date) +
            case o_orderkey % 3 when 0 then 180 when 1 then 364 else 90 end end as end_date,
  case when o_orderkey % 31 = 0 then 'dup-' || cast(o_custkey as varchar(20))
       else 'h-' || cast(o_orderkey as varchar(20)) end as file_hash
from orders""",
    "vehicles": """
select distinct lpad(cast(c_custkey as varchar(20)), 7, '0') as normalized_number,
  c_name as registration_number
from customer where c_nationkey < 20""",
    "convs": """
select conv_id as conversation_id, conv_id % 15 as user_id,
  case when conv_id % 3 = 0 then null when conv_id % 3 = 1 then 'New conversation'
    else 'Topic ' || cast(conv_id as varchar(20)) end as title,
  (conv_id % 7 = 0) as pinned, (conv_id % 6 = 0) as archived,
  max(turn) * 1000 + conv_id as updated_at,
  case when conv_id % 4 = 0 then null else conv_id % 3 end as agent_id
from conversations group by conv_id""",
    "messages": """
select conv_id as conversation_id, turn as position, role, text as content,
  conv_id * 1000 + turn as message_id
from conversations""",
    "sources": """
select conv_id * 1000 + turn as message_id, (conv_id + turn) % 200 as document_id,
  'doc-' || cast((conv_id + turn) % 200 as varchar(20)) as document_title,
  1 + turn % 3 as page, 1 as source_rank
from conversations where role = 'assistant'""",
    "agents": """
select n_regionkey as agent_id, min(n_name) as name, (n_regionkey <> 2) as enabled,
  case when n_regionkey = 1 then null else 0.1 * n_regionkey end as temperature,
  case when n_regionkey = 0 then null else 'Answer for ' || min(n_name) end as instructions,
  case when n_regionkey = 1 then null else 'model-' || cast(n_regionkey as varchar(20)) end as model
from nation group by n_regionkey""",
    "usage": """
select event_id, user_id, ts as created_at,
  cast(@json(props, k) as bigint) as input_tokens,
  cast(@json(props, k) as bigint) * 2 as output_tokens,
  (event_type <> 'error') as success
from events""",
    "contact_texts": """
select doc_id as document_id, text ||
  case when doc_id % 20 = 0 then ' call 050-000-0000 now' else '' end ||
  case when doc_id % 20 = 1 then ' car 12-345-67 here' else '' end ||
  case when doc_id % 20 = 2 then ' id 000000018 end' else '' end ||
  case when doc_id % 20 = 3 then ' see https://example.org/a?b=c now' else '' end ||
  case when doc_id % 20 = 4 then ' pay IL00 0000 0000 0000 0000 000 now' else '' end ||
  case when doc_id % 20 = 5 then ' number 12345678 left' else '' end ||
  case when doc_id % 50 = 6 then ' the password is here' else '' end ||
  case when doc_id % 50 = 7 then ' one api_key and a secret' else '' end as text
from documents""",
    "extractions": """
select o_orderkey as document_id, 'insurer' as field_name,
  case when o_orderkey % 13 = 0 then null else 'Insurer ' || cast(o_orderkey % 3 as varchar(20)) end as value,
  (o_orderkey % 100) / 100.0e0 as confidence from orders
union all
select o_orderkey, 'policy_number', 'POL-' || cast(o_custkey as varchar(20)) || '-' ||
  cast(o_orderkey % 6 as varchar(20)), (o_orderkey % 90) / 100.0e0 from orders where o_orderkey % 7 <> 0
union all
select o_orderkey, 'vehicle_number', lpad(cast(o_custkey as varchar(20)), 7, '0'), 0.9e0
from orders where o_orderkey % 3 <> 0
union all
select o_orderkey, 'insurance_start', @iso(o_orderdate), 0.98e0 from orders""",
    "corrections": """
select o_orderkey as document_id, 'insurer' as field_name,
  'Checked ' || cast(o_orderkey % 5 as varchar(20)) as corrected from orders where o_orderkey % 8 = 0
union all
select o_orderkey, 'vehicle_number', lpad(cast(o_custkey + 1 as varchar(20)), 7, '0')
from orders where o_orderkey % 16 = 0""",
    "vdocs": """
select o_orderkey as document_id, o_custkey % 15 as user_id,
  cast(o_orderdate as date) as created_at, (o_orderkey % 5 <> 0) as has_fields,
  case when o_orderkey % 3 = 0 then null else lpad(cast(o_custkey as varchar(20)), 7, '0') end as vehicle_key,
  case o_orderkey % 4 when 0 then 'COMPULSORY_INSURANCE' when 2 then 'THIRD_PARTY_INSURANCE'
    when 1 then 'VEHICLE_REGISTRATION' else 'UNKNOWN_VEHICLE_DOCUMENT' end as document_type,
  'file-' || cast(o_orderkey % 5000 as varchar(20)) as content_hash
from orders""",
    "questions": """
select b.item_id as question_id, b.item_id % 15 as user_id, replace(b.text, chr(10), ' ') as question, e.embedding as vector
from benchmark b join embeddings e on e.vec_id = b.item_id""",
    "vectors": """
select vec_id % 200 as document_id, @div(vec_id, 200) as position, embedding as vector from embeddings""",
}

_DIALECT = {
    "spark": {"sha": "sha2({0}, 256)", "div": "({0} div {1})",
              "json": "get_json_object({0}, '$.{1}')", "iso": "date_format({0}, 'yyyy-MM-dd')"},
    "duckdb": {"sha": "sha256({0})", "div": "({0} // {1})",
               "json": "json_extract_string({0}, '$.{1}')", "iso": "strftime({0}, '%Y-%m-%d')"},
}


def binding_sql(name: str, dialect: str) -> str:
    """The text of a domain table in one of the two dialects."""
    def word(match: re.Match) -> str:
        return _DIALECT[dialect][match[1]].format(*[a.strip() for a in match[2].split(",")])

    return re.sub(r"@(\w+)\(([^()]*)\)", word, TEXTS[name])


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = read_table(spark, folder, name)
    return spread(df, "doc_id") if name == "documents" else df


def bind(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A domain table over the tables in `folder`."""
    text = binding_sql(name, "spark")
    used = {t: _table(spark, folder, t) for t in SCHEMAS if re.search(rf"\b(from|join) {t}\b", text)}
    for table in used:
        text = re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", text)
    return spark.sql(text, **used)
