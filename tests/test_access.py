import itertools
import random

from docketry import vocab
from docketry.operators import access as op
from docketry.session import literal_table


def world(spark, seed=5):
    rng = random.Random(seed)
    docs = [(d, rng.choice([None, 1, 2, 3]), rng.choice([None, 7, 8]), rng.choice(vocab.CLASSIFICATIONS),
             rng.random() < 0.15, d % 9) for d in range(60)]
    users = [(u, rng.choice([None, 7, 8, 9]), u == 0) for u in range(8)]
    roles = [(u, r) for u in range(8) for r in range(3) if rng.random() < 0.3]
    grants = [(rng.randrange(60), *rng.choice([(rng.randrange(8), None, None), (None, rng.randrange(3), None),
                                               (None, None, rng.choice([7, 8, 9]))])) for _ in range(40)]
    frames = (
        spark.createDataFrame(docs, "document_id long, owner_id long, department_id long, classification string, is_deleted boolean, created_at int"),
        spark.createDataFrame(users, "user_id long, department_id long, is_superuser boolean"),
        spark.createDataFrame(roles, "user_id long, role_id long"),
        spark.createDataFrame(grants, "document_id long, user_id long, role_id long, department_id long"))
    allowed = set()
    for (d, owner, dept, cls, gone, _), (u, udept, top) in itertools.product(docs, users):
        mine = {r for x, r in roles if x == u}
        by_grant = any(g == d and (gu == u or gr in mine or (gd is not None and gd == udept)) for g, gu, gr, gd in grants)
        if not gone and (top or cls == "PUBLIC" or owner == u or (dept is not None and dept == udept) or by_grant):
            allowed.add((u, d))
    return frames, allowed, docs, users, roles


def test_checks_counts_and_lists_agree_with_the_rule(spark):
    (docs, users, roles, grants), allowed, rows, people, held = world(spark)
    pairs = users.select("user_id").crossJoin(docs.select("document_id"))
    got = op.document_access_check(pairs, docs, users, roles, grants).filter("allowed").collect()
    assert {(r.user_id, r.document_id) for r in got} == allowed
    counts = {r.user_id: r.n for r in op.accessible_count(docs, users, roles, grants).collect()}
    assert counts == {u: sum(a == u for a, _ in allowed) for u, _, _ in people}
    order = {d: (-c, -d) for d, *_, c in rows}
    recent = op.recent_documents(docs, users, roles, grants, 5).collect()
    for u, _, _ in people:
        want = sorted((d for a, d in allowed if a == u), key=order.get)[:5]
        assert [r.document_id for r in sorted(recent, key=lambda r: r.rank) if r.user_id == u] == want
    for u, dept, top in people:
        one = op.documents_of_user(docs, grants, u, dept, [r for x, r in held if x == u], top).collect()
        assert {r.document_id for r in one} == {d for a, d in allowed if a == u}
    reach = op.accessible_documents(docs, users, roles, grants).join(
        op.principals(users, roles).selectExpr("user_id", "explode(keys) as key"), "key")
    assert {(r.user_id, r.document_id) for r in reach.collect()} == allowed


def test_permission_keys(spark):
    users = spark.createDataFrame([(1, False), (2, True), (3, False)], "user_id long, is_superuser boolean")
    roles = spark.createDataFrame([(1, 10), (1, 11)], "user_id long, role_id long")
    allowed = spark.createDataFrame([(10, "VIEW", "*"), (11, "VIEW", "*"), (11, "EXPORT", "documents")],
                                    "role_id long, action string, resource string")
    keys = op.user_permission_keys(users, roles, allowed)
    assert {r.user_id: r["keys"] for r in keys.collect()} == {1: ["EXPORT:documents", "VIEW:*"], 2: ["*"], 3: []}
    asked = spark.createDataFrame([(1, "VIEW", "x"), (1, "EXPORT", "x"), (2, "ADMIN", "x"), (3, "VIEW", "x")],
                                  "user_id long, action string, resource string")
    got = {(r.user_id, r.action): r.allowed for r in op.permission_check(asked, keys).collect()}
    assert got == {(1, "VIEW"): True, (1, "EXPORT"): False, (2, "ADMIN"): True, (3, "VIEW"): False}


def test_role_matrix(spark):
    matrix = literal_table(spark, list(vocab.ROLE_MATRIX.items()), "role string, actions array<string>")
    rows = op.role_matrix_explode(matrix).collect()
    assert sum(r.role == "System Administrator" for r in rows) == 11
    assert {r.action for r in rows if r.role == "Guest"} == {"VIEW"}
