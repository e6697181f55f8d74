"""Queries over documents, users and grants."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry import vocab
from docketry.checks.base import Data, common, query
from docketry.operators import access as op
from docketry.session import literal_table

_PERMISSIONS = [(i, role, action) for i, (role, actions) in enumerate(vocab.ROLE_MATRIX.items())
                for action in actions]
common("role_permissions", "select * from (values " + ", ".join(
    f"({i}, '{role}', '{action}', '*')" for i, role, action in _PERMISSIONS)
    + ") t(role_id, role, action, resource)")
# The plain form of the rule: one disjunction over all (user, document) pairs.
common("reach", """
select u.user_id, d.document_id, d.arrival
from users u join docs d on true
where not d.is_deleted and (u.is_superuser or d.classification = 'PUBLIC' or d.owner_id = u.user_id
  or (u.department_id is not null and d.department_id = u.department_id)
  or d.document_id in (select g.document_id from grants g where g.user_id = u.user_id
    or g.department_id = u.department_id
    or g.role_id in (select r.role_id from user_roles r where r.user_id = u.user_id)))""")
common("document_keys", """
select document_id, 'all' as key from docs where not is_deleted
union select document_id, 'public' from docs where not is_deleted and classification = 'PUBLIC'
union select document_id, 'user:' || owner_id from docs where not is_deleted
union select document_id, 'dept:' || department_id from docs where not is_deleted
union select g.document_id, coalesce('user:' || g.user_id, 'role:' || g.role_id, 'dept:' || g.department_id)
  from grants g join docs d on d.document_id = g.document_id where not d.is_deleted""")
common("user_keys", """
select user_id, 'all' as key from users where is_superuser
union select user_id, 'public' from users union select user_id, 'user:' || user_id from users
union select user_id, 'dept:' || department_id from users where department_id is not null
union select user_id, 'role:' || role_id from user_roles""")
common("action_keys", """
select u.user_id, array_to_string(list_sort(list_distinct(
  coalesce(list(r.action || ':' || r.resource) filter (r.action is not null), [])
  || case when bool_or(u.is_superuser) then ['*'] else [] end)), ',') as keys
from users u left join user_roles ur on ur.user_id = u.user_id
left join role_permissions r on r.role_id = ur.role_id group by u.user_id""")


def permissions(d: Data):
    matrix = literal_table(d.spark, list(vocab.ROLE_MATRIX.items()), "role string, actions array<string>")
    ids = literal_table(d.spark, [(r, i) for i, r in enumerate(vocab.ROLE_MATRIX)], "role string, role_id long")
    return op.role_matrix_explode(matrix).join(ids, "role")


def keys(d: Data):
    return op.user_permission_keys(d.users, d.user_roles, permissions(d))


@query("live_documents", "select document_id, title from docs where not is_deleted")
def _(d: Data):
    return op.live_documents(d.docs).select("document_id", "title")


@query("grant_union", """
select distinct document_id,
  coalesce('user:' || user_id, 'role:' || role_id, 'dept:' || department_id) as key from grants""")
def _(d: Data):
    return op.grant_union(d.grants)


@query("accessible_documents", """
select k.document_id, k.key, count(*) as users from document_keys k join user_keys u on u.key = k.key
group by k.document_id, k.key""")
def _(d: Data):
    return op.accessible_documents(d.docs, d.users, d.user_roles, d.grants)


@query("document_access_check", """
select q.request_id, q.user_id, q.document_id, r.user_id is not null as allowed
from requests q left join reach r on r.user_id = q.user_id and r.document_id = q.document_id""")
def _(d: Data):
    return op.document_access_check(
        d.requests.drop("action"), d.docs, d.users, d.user_roles, d.grants)


@query("can_access", """
select q.request_id, u.is_superuser or d.classification = 'PUBLIC' or d.owner_id = u.user_id
  or coalesce(d.department_id = u.department_id, false) as allowed
from requests q join docs d on d.document_id = q.document_id join users u on u.user_id = q.user_id
where not d.is_deleted""")
def _(d: Data):
    held = op.principals(d.users, d.user_roles).select("user_id", "keys")
    docs = op.live_documents(d.docs).select("document_id", op._own_keys().alias("own"))
    return d.requests.join(docs, "document_id").join(held, "user_id").select(
        "request_id", op.can_access(F.col("keys"), F.col("own")).alias("allowed"))


@query("accessible_count", """
select u.user_id, count(r.document_id) as n from users u left join reach r on r.user_id = u.user_id
group by u.user_id""")
def _(d: Data):
    return op.accessible_count(d.docs, d.users, d.user_roles, d.grants)


def dated(d: Data):
    return d.docs.withColumn("created_at", F.col("arrival") % 500)


@query("recent_documents", """
select user_id, document_id, rank from (select user_id, document_id, row_number() over (
  partition by user_id order by arrival % 500 desc, document_id desc) as rank from reach) r where rank <= 200""")
def _(d: Data):
    return op.recent_documents(dated(d), d.users, d.user_roles, d.grants, 200)


@query("default_document", """
select user_id, document_id from (select user_id, document_id, row_number() over (
  partition by user_id order by arrival % 500 desc, document_id desc) as rank from reach) r where rank = 1""")
def _(d: Data):
    return op.default_document(dated(d), d.users, d.user_roles, d.grants)


@query("user_permission_keys", "select user_id, keys from action_keys")
def _(d: Data):
    return keys(d).select("user_id", F.array_join("keys", ",").alias("keys"))


@query("role_matrix_explode", """
select u.user_id, r.role, r.action, r.resource
from user_roles u join role_permissions r on r.role_id = u.role_id""")
def _(d: Data):
    return d.user_roles.join(permissions(d), "role_id").select("user_id", "role", "action", "resource")


@query("permission_check", """
select q.request_id, list_has_any(string_split(k.keys, ','), [q.action || ':documents', q.action || ':*', '*'])
  as allowed
from requests q join action_keys k on k.user_id = q.user_id""")
def _(d: Data):
    asked = d.requests.withColumn("resource", F.lit("documents"))
    return op.permission_check(asked, keys(d)).select("request_id", "allowed")


@query("roles_by_name", """
select distinct u.user_id, r.role_id from users u join role_permissions r
  on r.role in (case when u.user_id % 2 = 0 then 'Finance' else 'Guest' end, 'Read Only', 'Nobody')""")
def _(d: Data):
    names = F.array(F.when(F.col("user_id") % 2 == 0, "Finance").otherwise("Guest"),
                    F.lit("Read Only"), F.lit("Nobody"))
    roles = permissions(d).select(F.col("role").alias("name"), "role_id").distinct()
    return op.roles_by_name(d.users.select("user_id", names.alias("role_names")), roles)
