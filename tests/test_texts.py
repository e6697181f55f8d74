import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docketry import vocab
from docketry.functions import pii, text
from docketry.operators import ingest, similarity


def masked(one, value, **kw):
    return one(pii.sanitize_text(F.lit(value), **kw))


def test_every_kind_of_personal_data(one):
    got = masked(one, "mail x@example.org call 050-000-0000 id 000000018 at 10.0.0.9")
    assert got.text == "mail [EMAIL] call [PHONE] id [ID] at [IP]"
    assert got.counts == {"email": 1, "phone": 1, "id": 1, "ip": 1}
    assert one(pii.sensitivity_level(F.lit(None).cast("map<string,int>"))) is not None
    assert one(pii.sensitivity_level(pii.pii_counts(F.lit("id 000000018")))) == "high"
    assert one(pii.sensitivity_level(pii.pii_counts(F.lit("x@example.org")))) == "medium"
    assert one(pii.sensitivity_level(pii.pii_counts(F.lit("When does it end?")))) == "low"


def test_plate_url_and_order_of_stages(one):
    assert masked(one, "Vehicle 12-345-67 needs service.").text == "Vehicle [VEHICLE] needs service."
    assert masked(one, "See https://a.example/b at 10.0.0.5").text == "See [URL] at [IP]"
    assert masked(one, "IL00 0000 0000 0000 0000 x").text == "[ACCOUNT]x"


def test_international_number_default_and_strict(one):
    value = "tel +972-50-000-0000"
    assert masked(one, value).text == "tel +[VEHICLE]-0000"
    assert masked(one, value, patterns=vocab.PII_PATTERNS_STRICT).text == "tel [PHONE]"


def test_redaction_hides_eight_digits(one):
    got = one(pii.redact_text(F.lit("number 12345678 and x@example.org")))
    assert got.text == "number [ID] and [EMAIL]" and got.types == ["email", "id"]
    off = one(pii.redact_text(F.lit("number 12345678"), enabled=False))
    assert off.text == "number 12345678" and off.types == []


def test_blocked_categories_in_order(one):
    assert one(pii.blocked_category(F.lit("my API_KEY and Password"))) == "password"
    assert one(pii.blocked_category(F.lit("סיסמה כאן"))) == "password"
    assert one(pii.blocked_category(F.lit("api-key"), ["token", "api_key"])) == "api_key"
    assert one(pii.blocked_category(F.lit("nothing"))) is None


def test_clean_context(one):
    raw = "עמוד\n12\n[1] Section 3: a  b.\nsection 3: A b.\n\n  - 7 -\nend"
    assert one(text.clean_context(F.lit(raw))) == "עמוד\nSection 3: a b.\nend"


def test_words_and_overlap(one):
    assert one(text.words_of(F.lit("  a\tb  c\n"))) == ["a", "b", "c"]
    assert one(text.keyword_overlap(F.lit("need valid licence"), F.lit("A VALID licence, yes"))) == 2 / 3
    assert one(text.keyword_overlap(F.lit("a b"), F.lit("a b"))) == 0.0


def test_language_and_content(one):
    assert [one(text.detect_language(F.lit(t))) for t in ("abc", "שלום", "abc سلام שלום")] == ["en", "he", "ar"]
    assert one(text.has_content(F.lit("abcdefgh"))) and not one(text.has_content(F.lit("abc 123")))


PARA = "Under the policy the insurer is released when the driver holds no valid licence."


def test_clean_answer(one):
    out = one(similarity.clean_answer(F.lit(f"{PARA} [1] {PARA} [2]\n{PARA}\nNew rule. New rule.")))
    assert "[1]" not in out and out.count("insurer is released") == 1 and out.count("New rule") == 1
    for junk in ("context>.pdf>", "SOURCES: <chunk> x.pdf>"):
        assert not one(text.has_content(similarity.clean_answer(F.lit(junk))))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcא ", max_size=40), st.text("abcא ", max_size=40))
def test_common_subsequence(a, b):
    assert similarity.common_length(a, b) == lcs(a, b)


def test_similar_chunks_keep_the_best(spark):
    rows = [(1, i, i, s, t) for i, (s, t) in enumerate([
        (0.9, PARA), (0.8, PARA + " "), (0.7, PARA[:40]), (0.6, "A driver must be 24 or older."), (0.95, PARA + " x")])]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, rank int, score double, content string")
    kept = {r.chunk_id for r in similarity.dedupe_similar_chunks(df).collect()}
    assert kept == {4, 3}


def windows(words, size, overlap):
    step, out, i = size - overlap, [], 0
    while i < len(words):
        out.append(" ".join(words[i:i + size]))
        if i + size >= len(words):
            break
        i += step
    return out


def test_chunks(spark):
    pages = [(d, p, " ".join(f"w{d}-{p}-{i}" for i in range(n))) for d, p, n in
             [(1, 1, 500), (2, 1, 100), (2, 2, 0), (2, 3, 101), (3, 1, 180), (3, 2, 181), (4, 1, 0)]]
    df = ingest.chunk_pages(spark.createDataFrame(pages, "document_id int, page int, text string"), 100, 20)
    got = {d: [] for d in (1, 2, 3)}
    for r in df.orderBy("document_id", "position").collect():
        assert r.position == len(got[r.document_id])
        got[r.document_id].append(r.content)
    for d in got:
        want = [c for doc, _, t in pages if doc == d for c in windows(t.split(), 100, 20)]
        assert got[d] == want
    assert [len(got[d]) for d in (1, 2, 3)] == [6, 3, 5]


def test_positions_of_a_very_long_document(spark):
    from docketry.operators.common import running_total

    df = spark.range(5000).selectExpr("1 as k", "id as page", "id % 3 as n")
    got = running_total(df, ["k"], "page", "n", block=64).orderBy("page").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.n


def test_repeated_chunks_are_dropped(spark):
    rows = [(1, 0, 1, "A  b"), (1, 1, 1, "c"), (1, 2, 2, "a B"), (1, 3, 2, "d"), (2, 0, 1, "a b"), (2, 1, 1, " ")]
    df = ingest.chunk_dedupe_positions(spark.createDataFrame(rows, "document_id int, position int, page int, content string"))
    assert sorted((r.document_id, r.position, r.content) for r in df.collect()) == [
        (1, 0, "A  b"), (1, 1, "c"), (1, 2, "d"), (2, 0, "a b")]


def test_embedding_failures(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, content string")
    good = ingest.embed_with(df, ingest.hashing_embedder(8), ["id"]).collect()
    assert all(len(r.vector) == 8 for r in good)

    def broken(texts):
        raise RuntimeError("no provider")

    assert [r.vector for r in ingest.embed_with(df, broken, ["id"], failures="null").collect()] == [None, None]
    with pytest.raises(Exception, match="no provider"):
        ingest.embed_with(df, broken, ["id"]).collect()


def test_read_text_documents(spark, tmp_path):
    from docketry.sources.files import read_text_documents

    (tmp_path / "a.TXT").write_bytes("שלום x".encode())
    (tmp_path / "b.csv").write_bytes(b"1,2\n3,\xff4")
    got = {r.ext: (r.page, r.text) for r in read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"txt": (1, "שלום x"), "csv": (1, "1,2\n3,�4")}


def test_a_file_per_document_needs_no_folder_per_document(spark, tmp_path):
    import os

    from docketry.checks import load_all
    from docketry.session import shared_folder
    from docketry.sources.tables import SCHEMAS

    rows = [(i, f"text {i}" if i % 3 else None, "en", "s", None) for i in range(20)]
    spark.createDataFrame(rows, SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    root = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    got = load_all()[0]["read_text_documents"](spark, str(tmp_path))
    assert sorted(r.chars for r in got.collect()) == sorted(len(t or "") + 1 for _, t, *_ in rows)
    (folder,) = [n for n in set(os.listdir(root)) - before if n.startswith("texts-")]
    assert not [n for n in os.listdir(f"{root}/{folder}") if os.path.isdir(f"{root}/{folder}/{n}")]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    from docketry.sources import files, sinks

    rows = [(i, "" if i == 7 else f"é {i}\nx") for i in range(300)] + [(None, "nobody's")]
    texts = spark.createDataFrame(rows, "name long, text string").repartition(3)
    folder = f"file://{tmp_path}/texts"
    sinks.write_text_files(texts, folder)
    sinks.write_text_files(texts.filter("name < 5"), folder)  # as a task that runs again
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        found = files.read_text_documents(spark, folder)
        assert found.rdd.getNumPartitions() <= 16
        assert sorted(r.text for r in found.collect()) == sorted(t + "\n" for _, t in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "none").mkdir()
    sinks.write_text_files(texts.limit(0), f"{tmp_path}/none")
    assert files.read_text_documents(spark, f"{tmp_path}/none").count() == 0


def test_text_without_signs_is_not_searched(spark):
    """A run that a search for addresses would go through once per letter; signs further on are still found."""
    import time

    run = "a." * 60000
    rows = [(1, run), (2, "mail a.b@c.org at 10.0.0.1 or 12345678, see HTTPS://x.org/1"), (3, None), (4, "id ٣٣٣٣٣٣٣٣٣"), (5, "")]
    texts = spark.createDataFrame(rows, "i int, t string")
    start = time.time()
    got = {r.i: r.r for r in texts.select("i", pii.redact_text(F.col("t")).alias("r")).collect()}
    assert time.time() - start < 10
    assert got[1].text == run and got[1].types == []
    assert got[2].text == "mail [EMAIL] at [IP] or [ID], see [URL]" and got[2].types == ["email", "id", "ip", "url"]
    assert got[3].text is None and got[3].types == [] and got[5].text == ""
    assert got[4].text == "id [ID]" and got[4].types == ["id"]


def test_custom_placeholder_with_digits_is_searched_again(spark):
    """What a stage puts in may be what the next one looks for."""
    digits = [p for p in vocab.PII_PATTERNS if p[0] == "id"]
    patterns = [("word", " 123456789 ", r"\bnumber\b", False), *digits]
    row = spark.createDataFrame([("a number",)], "t string").select(pii.sanitize_text(F.col("t"), patterns).alias("r")).first().r
    assert row.counts == {"word": 1, "id": 1}


def test_chunking_moves_texts_and_short_keys(spark):
    """No array of words and no digest of a short text is shuffled; equal chunks are told by their whole text."""
    pages = spark.createDataFrame([(1, 1, "A b c a B c d"), (1, 2, "a b  c " + "y" * 40 + " z z"), (1, 3, "y" * 40 + " Z z")],
                                  "document_id long, page int, text string")
    chunks = ingest.chunk_pages(pages, 3, 0)
    plan = chunks._sc._jvm.PythonSQLUtils.explainString(chunks._jdf.queryExecution(), "formatted")
    moved = [p.split("\n")[1] for p in plan.split("\n\n") if " Exchange\n" in p]
    assert moved and not any("parts#" in p for p in moved)
    got = sorted((r.position, r.page, r.content) for r in ingest.chunk_dedupe_positions(chunks).collect())
    assert got == [(0, 1, "A b c"), (1, 1, "d"), (2, 2, "y" * 40 + " z z")]
