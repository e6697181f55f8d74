"""Who may read which document.

Documents: document_id, owner_id, department_id, classification, is_deleted.
Users: user_id, department_id, is_superuser. user_roles: user_id, role_id.
Grants: document_id and one of user_id, role_id, department_id.

A user holds keys (all, public, user:<id>, dept:<id>, role:<id>) and a document
lists the keys that open it. Both are linear in the data. All (user, document)
pairs are never written out: a department or the public key alone would multiply
users by documents. Counts and newest documents are taken per set of keys instead.
The keys all and public would be held by whole tables; they are never joined. What
they open is the same for everybody: a count, or one list of the newest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.common import top_per
from docketry.session import settle


#: held by every superuser, and by everybody
WIDE_KEYS = ("all", "public")


def _key(kind: str, col) -> Column:
    """'<kind>:<id>', NULL for a NULL id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(kind + ":"), col.cast("string"))


def live_documents(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("is_deleted"))


def principals(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """(user_id, is_superuser, department_id, keys); superusers hold the key 'all'."""
    roles = user_roles.groupBy("user_id").agg(F.collect_set("role_id").alias("role_ids"))
    personal = F.array_compact(F.array(
        F.when(F.col("is_superuser"), F.lit("all")), F.lit("public"),
        _key("user", "user_id"), _key("dept", "department_id")))
    by_role = F.transform(F.coalesce("role_ids", F.array().cast("array<bigint>")),
                          lambda r: _key("role", r))
    return users.join(roles, "user_id", "left").select(
        "user_id", "is_superuser", "department_id", F.concat(personal, by_role).alias("keys"))


def grant_union(grants: DataFrame) -> DataFrame:
    """Distinct (document_id, key) of the user, role and department grants."""
    keys = F.array_compact(F.array(
        _key("user", "user_id"), _key("role", "role_id"), _key("dept", "department_id")))
    return grants.select("document_id", F.explode(keys).alias("key")).distinct()


def _is_public() -> Column:
    return F.coalesce(F.col("classification") == "PUBLIC", F.lit(False))


def _named_keys() -> Column:
    return F.array_compact(F.array(_key("user", "owner_id"), _key("dept", "department_id")))


def wide_keys() -> Column:
    """The keys of a document that whole tables of users hold."""
    return F.array_compact(F.array(F.lit("all"), F.when(_is_public(), F.lit("public"))))


def _own_keys() -> Column:
    return F.concat(wide_keys(), _named_keys())


def audience(docs: DataFrame, grants: DataFrame) -> DataFrame:
    """Distinct (document_id, key) of the user, department and role keys that open each live document."""
    live = live_documents(docs)
    own = live.select("document_id", F.explode(_named_keys()).alias("key"))
    granted = grant_union(grants).join(live.select("document_id"), "document_id", "left_semi")
    return own.unionByName(granted).distinct()


def can_access(keys: Column, doc_keys: Column, grant_keys: Column | None = None) -> Column:
    """Does a user with `keys` hold one of the document's own or granted keys?"""
    allowed = F.arrays_overlap(keys, doc_keys)
    if grant_keys is not None:
        allowed = allowed | F.coalesce(F.arrays_overlap(keys, grant_keys), F.lit(False))
    return allowed


def accessible_documents(
    docs: DataFrame, users: DataFrame, user_roles: DataFrame, grants: DataFrame
) -> DataFrame:
    """(document_id, key, users): each way into each live document and how many hold it."""
    held = principals(users, user_roles).select(F.explode("keys").alias("key")).filter(
        ~F.col("key").isin(*WIDE_KEYS)).groupBy("key").agg(F.count(F.lit(1)).alias("users"))
    named = audience(docs, grants).join(held, "key").select("document_id", "key", "users")
    # everybody holds public and every superuser all: two numbers
    n = users.agg(F.count(F.lit(1)).alias("everybody"), F.count_if("is_superuser").alias("superusers")).first()
    wide = F.array_compact(F.array(
        F.when(F.lit(n["superusers"] > 0), F.struct(F.lit("all").alias("key"), F.lit(n["superusers"]).alias("users"))),
        F.when(_is_public() & F.lit(n["everybody"] > 0),
               F.struct(F.lit("public").alias("key"), F.lit(n["everybody"]).alias("users")))))
    return named.unionByName(
        live_documents(docs).select("document_id", F.explode(wide).alias("w")).select("document_id", "w.key", "w.users"))


def documents_of_user(
    docs: DataFrame, grants: DataFrame, user_id, department_id=None, role_ids=(), is_superuser=False
) -> DataFrame:
    """Live documents one user may read: a filter and one semi-join."""
    live = live_documents(docs)
    if is_superuser:
        return live
    tests = [F.col("user_id") == user_id]
    if department_id is not None:
        tests.append(F.col("department_id") == department_id)
    if role_ids:
        tests.append(F.col("role_id").isin(*role_ids))
    granted = grants.filter(reduce(Column.__or__, tests)).select("document_id").distinct()
    direct = (F.col("classification") == "PUBLIC") | F.coalesce(F.col("owner_id") == user_id, F.lit(False))
    if department_id is not None:
        direct = direct | F.coalesce(F.col("department_id") == department_id, F.lit(False))
    return live.filter(direct).unionByName(
        live.filter(~direct).join(granted, "document_id", "left_semi"))


def document_access_check(
    requests: DataFrame, docs: DataFrame, users: DataFrame, user_roles: DataFrame, grants: DataFrame
) -> DataFrame:
    """requests(user_id, document_id, ...) with `allowed`."""
    pairs = requests.select("user_id", "document_id").distinct()
    own = live_documents(docs).select("document_id", _own_keys().alias("own_keys"))
    known = pairs.join(own, "document_id").join(
        principals(users, user_roles).select("user_id", "keys"), "user_id")
    direct = known.filter(can_access(F.col("keys"), F.col("own_keys"))).select("user_id", "document_id")
    through_grant = (
        known.filter(~can_access(F.col("keys"), F.col("own_keys")))
        .select("user_id", "document_id", F.explode("keys").alias("key"))
        .join(grant_union(grants), ["document_id", "key"], "left_semi")
        .select("user_id", "document_id").distinct()
    )
    allowed = direct.unionByName(through_grant).withColumn("allowed", F.lit(True))
    return requests.join(allowed, ["user_id", "document_id"], "left").select(
        *requests.columns, F.coalesce("allowed", F.lit(False)).alias("allowed"))


# --- per-user figures without (user, document) pairs --------------------------------
def _is_personal(key) -> Column:
    return F.startswith(key, F.lit("user:"))


def _group_keys(keys: Column) -> Column:
    return F.array_sort(F.filter(keys, lambda k: ~_is_personal(k)))


def _document_groups(docs: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the documents that are not public: (document_id, group_keys) and the personal entries
    (document_id, user_key).

    Group keys of a document are at most its department and the departments and roles that exist.
    """
    opened = settle(audience(docs.filter(~_is_public()), grants))
    groups = opened.filter(~_is_personal(F.col("key"))).groupBy("document_id").agg(
        F.array_sort(F.collect_set("key")).alias("group_keys"))
    personal = opened.filter(_is_personal(F.col("key"))).withColumnRenamed("key", "user_key")
    return groups, personal


def _user_groups(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    """Users who are not superusers, with their group keys but for `public`."""
    held = principals(users.filter(~F.coalesce("is_superuser", F.lit(False))), user_roles)
    return held.select("user_id", _key("user", "user_id").alias("user_key"),
                       F.array_remove(_group_keys(F.col("keys")), "public").alias("held"))


def _open_sets(groups: DataFrame, people: DataFrame) -> DataFrame:
    """Distinct (held, group_keys) sets that share a key."""
    documents = groups.select("group_keys").distinct().withColumn("key", F.explode("group_keys"))
    holders = people.select("held").distinct().withColumn("key", F.explode("held"))
    return holders.join(documents, "key").select("held", "group_keys").distinct()


def _personal_extra(groups: DataFrame, personal: DataFrame, people: DataFrame) -> DataFrame:
    """(user_id, document_id) a user reaches by name only, not through a group."""
    return (
        personal.join(people, "user_key").join(groups, "document_id", "left")
        .filter(~F.coalesce(F.arrays_overlap("held", "group_keys"), F.lit(False))).select("user_id", "document_id")
    )


def accessible_count(
    docs: DataFrame, users: DataFrame, user_roles: DataFrame, grants: DataFrame
) -> DataFrame:
    """(user_id, n): live documents each user may read."""
    groups, personal = _document_groups(docs, grants)
    people = _user_groups(users, user_roles)
    known = live_documents(docs).agg(F.count(F.lit(1)).alias("all"), F.count_if(_is_public()).alias("public")).first()
    sizes = groups.groupBy("group_keys").agg(F.count(F.lit(1)).alias("size"))
    by_set = _open_sets(groups, people).join(sizes, "group_keys").groupBy("held").agg(
        F.sum("size").alias("shared"))
    extra = _personal_extra(groups, personal, people).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("own"))
    named = people.join(by_set, "held", "left").join(extra, "user_id", "left").select(
        "user_id", (F.coalesce("shared", F.lit(0)) + F.coalesce("own", F.lit(0)) + F.lit(known["public"])).alias("n"))
    return named.unionByName(users.filter("is_superuser").select("user_id", F.lit(known["all"]).alias("n")))


def recent_documents(
    docs: DataFrame, users: DataFrame, user_roles: DataFrame, grants: DataFrame, n: int = 200
) -> DataFrame:
    """(user_id, document_id, rank): the n newest documents each user may read.

    The newest n are first taken per set of document keys, then per set of user keys; the
    newest n public ones, and of all for superusers, are one list each. A user's own list is
    merged from at most 3n rows.
    """
    newest = [F.desc("created_at"), F.desc("document_id")]
    groups, personal = _document_groups(docs, grants)
    people = _user_groups(users, user_roles)
    dates = live_documents(docs).select("document_id", "created_at", _is_public().alias("is_public"))
    per_documents = top_per(
        groups.join(dates.drop("is_public"), "document_id"), ["group_keys"], newest, n)
    per_holders = top_per(
        _open_sets(groups, people).join(per_documents.drop("rank"), "group_keys"), ["held"], newest, n)
    shared = people.join(per_holders, "held").select("user_id", "document_id", "created_at")
    extra = _personal_extra(groups, personal, people).join(dates, "document_id").select(
        "user_id", "document_id", "created_at")

    def for_each(who: DataFrame, rows: DataFrame) -> DataFrame:
        """The n newest of `rows`, the same list for each of `who`."""
        top = rows.select("document_id", "created_at").orderBy(*newest).limit(n)
        shape = top.schema
        listed = F.array(*[
            F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in shape]) for r in top.collect()])
        return who.select("user_id", F.explode(listed.cast(f"array<{shape.simpleString()}>")).alias("d")).select(
            "user_id", "d.*")

    rows = shared.unionByName(extra).unionByName(for_each(people, dates.filter("is_public"))).unionByName(
        for_each(users.filter("is_superuser"), dates))
    return top_per(rows, ["user_id"], newest, n).select("user_id", "document_id", "rank")


def default_document(
    docs: DataFrame, users: DataFrame, user_roles: DataFrame, grants: DataFrame
) -> DataFrame:
    """(user_id, document_id): the newest document each user may read."""
    return recent_documents(docs, users, user_roles, grants, 1).drop("rank")


# --- actions ------------------------------------------------------------------------
def role_matrix_explode(matrix: DataFrame) -> DataFrame:
    """matrix(role, actions) -> (role, action, resource)."""
    return matrix.select("role", F.explode("actions").alias("action"), F.lit("*").alias("resource"))


def user_permission_keys(users: DataFrame, user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user_id, keys): sorted ACTION:resource keys, with '*' for superusers."""
    pairs = user_roles.join(role_permissions, "role_id").select(
        "user_id", F.concat_ws(":", "action", "resource").alias("key"))
    held = pairs.groupBy("user_id").agg(F.collect_set("key").alias("held"))
    none = F.array().cast("array<string>")
    star = F.when(F.col("is_superuser"), F.array(F.lit("*"))).otherwise(none)
    return users.join(held, "user_id", "left").select(
        "user_id", F.array_sort(F.array_union(F.coalesce("held", none), star)).alias("keys"))


def holds_any(keys: Column, wanted: list[Column]) -> Column:
    return F.coalesce(F.arrays_overlap(keys, F.array(*wanted)), F.lit(False))


def permission_check(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests(user_id, action, resource, ...) with `allowed`."""
    wanted = [F.concat_ws(":", "action", "resource"), F.concat(F.col("action"), F.lit(":*")), F.lit("*")]
    joined = requests.join(keys.select("user_id", "keys"), "user_id", "left")
    return joined.select(*requests.columns, holds_any(F.col("keys"), wanted).alias("allowed"))


def roles_by_name(users: DataFrame, roles: DataFrame) -> DataFrame:
    """users(user_id, role_names) -> (user_id, role_id) of the names that exist."""
    named = users.select("user_id", F.explode("role_names").alias("name")).distinct()
    return named.join(roles.select("name", "role_id"), "name").select("user_id", "role_id")
