import random

import numpy as np
from pyspark.sql import functions as F

from docketry.operators import release
from docketry.operators import retrieval as op
from docketry.plans import answers

WORDS = "alpha beta gamma delta omega rule cover plate holder".split()


def world(spark, n=300, questions=23, dim=6, seed=2):
    rng = random.Random(seed)
    # a third of all chunks sit in document 0 and share one vector
    chunks, vectors = [], []
    for i in range(n):
        doc = 0 if i % 3 == 0 else 1 + i % 11
        chunks.append((i, doc, i, 1, " ".join(rng.choice(WORDS) for _ in range(12))))
        vectors.append([1.0] * dim if doc == 0 else [rng.uniform(-1, 1) for _ in range(dim)])
    docs = [(d, f"doc-{d}", 1, d % 3, "PUBLIC" if d % 2 == 0 else "INTERNAL", d == 4) for d in range(12)]
    users = [(u, u, u == 2) for u in range(3)]
    asked = [(q, q % 3, " ".join(rng.choice(WORDS) for _ in range(2)), [rng.uniform(-1, 1) for _ in range(dim)],
              7 if q % 5 == 0 else None) for q in range(questions)]
    frames = dict(
        chunks=spark.createDataFrame(chunks, "chunk_id long, document_id long, position int, page int, content string"),
        vectors=spark.createDataFrame([(c[1], c[2], v) for c, v in zip(chunks, vectors)], "document_id long, position int, vector array<float>"),
        docs=spark.createDataFrame(docs, "document_id long, title string, owner_id long, department_id long, classification string, is_deleted boolean"),
        users=spark.createDataFrame(users, "user_id long, department_id long, is_superuser boolean"),
        roles=spark.createDataFrame([(0, 5)], "user_id long, role_id long"),
        grants=spark.createDataFrame([(9, None, 5, None)], "document_id long, user_id long, role_id long, department_id long"),
        queries=spark.createDataFrame(asked, "query_id long, user_id long, question string, vector array<float>, scope_id long"))

    def readable(user, doc):
        _, _, owner, dept, cls, gone = docs[doc]
        return not gone and (user == 2 or cls == "PUBLIC" or owner == user or dept == user or (user == 0 and doc == 9))

    semantic, keyword = {}, {}
    for q, user, text, vector, scope in asked:
        fit = [c for c in chunks if readable(user, c[1]) and scope in (None, c[1])]
        a = np.float32(vector).astype(float)

        def cosine(c):
            b = np.float32(vectors[c[0]]).astype(float)
            return round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)

        semantic[q] = [c[0] for c in sorted(fit, key=lambda c: (-cosine(c), c[0]))[:8]]
        keyword[q] = [c[0] for c in sorted((c for c in fit if text in c[4]), key=lambda c: (c[1], c[2]))[:8]]
    return frames, semantic, keyword


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def test_both_ways_agree_with_brute_force(spark):
    f, semantic, keyword = world(spark)
    asked = op.with_keys(f["queries"], f["users"], f["roles"])
    open_chunks = op.permitted_chunks(f["chunks"], asked, f["docs"], f["grants"])
    index = op.chunks_with_embedding(open_chunks, f["vectors"])
    want = {q: v for q, v in semantic.items() if v}
    for pivots in (64, 5, 1):
        assert ranked(op.semantic_topk(asked, index, pivots=pivots)) == want
    assert ranked(op.keyword_ilike(open_chunks, asked)) == {q: v for q, v in keyword.items() if v}
    # the same index grown in three appends
    parts = [index.filter(F.col("chunk_id") % 3 == i) for i in range(3)]
    grown = op.semantic_index(parts[0], 9)
    for part in parts[1:]:
        grown.append(part.select(*grown.schema.names))
    found, read = op.semantic_search(asked, grown)
    assert ranked(found) == want
    assert all(0 < r.cells_read <= r.cells <= 9 for r in read.collect()) and read.count() == asked.count()


def test_index_reads_only_cells_that_can_matter(spark):
    rng = random.Random(4)
    centres = [[10.0 if k == i else 0.0 for k in range(6)] for i in range(6)]
    rows = [(i, i, ["public"], [c + rng.gauss(0, 0.3) for c in centres[i % 6]]) for i in range(600)]
    index = op.semantic_index(spark.createDataFrame(rows, "chunk_id long, document_id long, readers array<string>, vector array<double>"), 12)
    asked = spark.createDataFrame([(i, centres[i], ["public"]) for i in range(6)], "query_id long, vector array<double>, keys array<string>")
    found, read = op.semantic_search(asked, index, 5)

    def cosine(a, b):
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    assert ranked(found) == {i: [r[0] for r in sorted(rows, key=lambda r: (-cosine(centres[i], r[3]), r[0]))[:5]] for i in range(6)}
    got = read.collect()
    assert sum(r.cells_read for r in got) < 0.7 * sum(r.cells for r in got)


def test_no_rows_no_questions(spark):
    index = op.semantic_index(spark.createDataFrame([], "chunk_id long, document_id long, readers array<string>, vector array<double>"))
    asked = spark.createDataFrame([(1, [1.0], ["public"])], "query_id long, vector array<double>, keys array<string>")
    assert op.semantic_search(asked, index)[0].collect() == []
    one = op.semantic_index(spark.createDataFrame([(1, 1, ["public"], [1.0])], "chunk_id long, document_id long, readers array<string>, vector array<double>"))
    assert op.semantic_search(asked.filter("false"), one)[0].collect() == []
    assert [r.chunk_id for r in op.semantic_search(asked, one)[0].collect()] == [1]


def test_short_repeated_and_empty_needles(spark):
    texts = ["Alpha BETA", "b", "", None, "ab ab ab", "日本 x", "a_b%c", "beta"]
    rows = [(i, i, 0, ["public"] if i != 7 else ["user:9"], t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, position int, readers array<string>, content string")
    needles = ["b", "ab", "beta", " BETA ", "", "日本", "zzz", "a_b", "%", None, "alpha beta"]
    for raw in (False, True):
        asked = spark.createDataFrame([(q, t, ["public"]) for q, t in enumerate(needles)], "query_id long, question string, keys array<string>")
        got = ranked(op.keyword_ilike(chunks, asked, 3, raw_pattern=raw))
        want = {}
        for q, t in enumerate(needles):
            if t is None:
                continue
            n = t.strip().lower()
            if raw:
                import re
                fits = re.compile(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in n) + ".*", re.S)
                hits = [i for i, x in enumerate(texts[:7]) if x is not None and fits.fullmatch(x.lower())]
            else:
                hits = [i for i, x in enumerate(texts[:7]) if x is not None and n in x.lower()]
            if hits:
                want[q] = hits[:3]
        assert got == want


def test_wildcards_only_on_request(spark):
    f, *_ = world(spark, n=30, questions=1)
    asked = op.with_keys(f["queries"].withColumn("question", F.lit("a%a")).drop("scope_id"), f["users"], f["roles"])
    open_chunks = op.permitted_chunks(f["chunks"], asked, f["docs"], f["grants"])
    assert op.keyword_ilike(open_chunks, asked).count() == 0
    assert op.keyword_ilike(open_chunks, asked, raw_pattern=True).count() > 0


def test_merge_keeps_the_higher_score(spark):
    schema = "query_id int, chunk_id int, document_id int, score double, rank int"
    semantic = spark.createDataFrame([(1, 10, 1, 0.9, 1), (1, 11, 1, 0.5, 2), (1, 12, 1, 0.2, 3)], schema)
    keyword = spark.createDataFrame([(1, 12, 1, 0.5, 1), (1, 13, 1, 0.5, 2)], schema)
    got = op.hybrid_topk(semantic, keyword, 4).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [(10, 0.9), (11, 0.5), (12, 0.5), (13, 0.5)]


CHUNK = "query_id int, chunk_id string, document_id string, title string, page int, content string, score double, rank int"


def test_rerank_prefers_matching_words(spark):
    rows = [(1, "a", "d1", "t", 1, "General notes on the firm.", 0.7, 1),
            (1, "b", "d1", "t", 1, "A valid driving licence is needed.", 0.65, 2)]
    queries = spark.createDataFrame([(1, "Is a valid driving licence needed?")], "query_id int, question string")
    got = op.rerank(spark.createDataFrame(rows, CHUNK), queries, 2).orderBy("rank").collect()
    assert got[0].chunk_id == "b"


def test_context_and_citations(spark):
    texts = ["rule alpha about cars and roads", "totally different words here now", "third text without any likeness",
             "four is the last of these lines", "five should not fit any more"]
    rows = [(1, f"c{i}", "d1", "T", 1 if i < 3 else None, t, 0.9 - i * 0.05, i + 1) for i, t in enumerate(texts)]
    queries = spark.createDataFrame([(1, "cars")], "query_id int, question string")
    contexts, cited = answers.build_context(spark.createDataFrame(rows, CHUNK), queries)
    context = contexts.first()["context"]
    assert context.startswith("CONTEXT:\n\n[1] T, page 1:\nrule alpha") and "[4] T:\nfour" in context and "five" not in context
    assert [(r.rank, r.chunk_id, r.page) for r in cited.orderBy("rank").collect()] == [(1, "c0", 1), (2, "c3", None)]


def test_release_reasons(spark):
    requests = spark.createDataFrame([(1, "fine"), (2, "my password"), (3, "fine")], "user_id int, text string")
    keys = spark.createDataFrame([(1, ["GLOBAL_AI_ESCALATION:*"]), (2, ["*"])], "user_id int, keys array<string>")

    def reasons(configured, mode):
        rows = release.external_release_policy(requests, keys, configured, mode).collect()
        return [(r.allowed, r.reason, r.category) for r in sorted(rows, key=lambda r: r.user_id)]

    assert reasons(True, "manual") == [(True, "ok", None), (False, "blocked_category", "password"), (False, "user_not_permitted", None)]
    assert {r[1] for r in reasons(False, "manual")} == {"openai_not_configured"}
    assert {r[1] for r in reasons(True, "disabled")} == {"escalation_disabled"}


def test_escalation_never_keeps_the_text(spark):
    rows = spark.createDataFrame([(1, 1, 1, "call 050-000-0000", "", "")],
                                 "request_id int, user_id int, conversation_id int, question string, context string, problem string")
    prepared = release.prepare_escalations(rows)
    row = prepared.first()
    assert "[PHONE]" in row.prompt and "(none provided)" in row.prompt and row.sensitivity == "medium"
    record = release.escalation_event_record(prepared)
    assert record.first().sensitive_types_detected == ["phone"] and "prompt" not in record.columns
