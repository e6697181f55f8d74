import random

from pyspark.sql import functions as F

from docketry.functions import geometry as geo
from docketry.operators import fields as fo
from docketry.operators import layout as op
from docketry.plans import vehicle

WORD = "doc_id int, word_idx int, page int, x0 double, y0 double, x1 double, y1 double, text string, conf double, source string"
ANCHORS = {"vehicle_number": ["plate mark"], "id_number": ["holder mark"], "policy_number": ["policy mark"],
           "policy_holder": ["name mark"], "insurance_start": ["starts on"]}


def words(spark, rows):
    return spark.createDataFrame([
        (1, i, page, float(x), float(y), float(x) + 10.0 * len(t), float(y) + 10, t, 1.0, "pdf_text")
        for i, (t, x, y, page) in enumerate(rows)], WORD)


# label groups stand further apart than words of one label do
FORM = [("plate", 465, 140, 1), ("mark", 525, 140, 1), ("holder", 290, 140, 1), ("mark", 355, 140, 1),
        ("policy", 630, 140, 1), ("mark", 695, 140, 1), ("1112223", 470, 160, 1), ("33344455", 292, 160, 1),
        ("900-11122233344-00", 635, 160, 1), ("name", 100, 300, 1), ("mark", 145, 300, 1), ("Doe", 100, 320, 1),
        ("Jo", 140, 320, 1), ("starts", 100, 400, 2), ("on", 165, 400, 2), ("5/3/2027", 100, 420, 2)]


def test_fields_of_a_form(spark):
    w = words(spark, FORM)
    texts = spark.createDataFrame([(1, "paper")], "doc_id int, text string")
    fields, candidates, classes = vehicle.extract_vehicle_fields(w, texts, ANCHORS)
    got = {r.field: r for r in fields.collect()}
    assert got["vehicle_number"].value == "1112223" and got["vehicle_number"].confidence >= 0.8
    assert got["policy_number"].value == "900-11122233344-00"
    assert got["id_number"].value == "33344455"
    assert got["policy_holder"].value == "Jo Doe"
    assert got["insurance_start"].value == "2027-03-05"
    chosen = [r.value for r in candidates.filter("selected").collect()]
    assert chosen == ["1112223"] and classes.first()["type"] == "UNKNOWN_VEHICLE_DOCUMENT"


def test_rows_follow_the_greedy_rule(spark):
    rng = random.Random(4)
    rows = [(1 + i % 3, i, 1 + i % 2, rng.uniform(0, 500), y := rng.uniform(0, 200), 0.0, y + rng.choice([4, 10, 30]), "w", 1.0, "s")
            for i in range(400)]
    got = {r.word_idx: r.row_id for r in op.visual_rows(spark.createDataFrame(rows, WORD)).collect()}
    want, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], (r[4] + r[6]) / 2, r[1])):
        mine = groups.setdefault((r[0], r[2]), [])
        cy, h = (r[4] + r[6]) / 2, max(1.0, r[6] - r[4])
        for n, (cy0, h0) in enumerate(mine):
            if abs(cy - cy0) <= 0.6 * max(h0, h):
                want[r[1]] = n
                break
        else:
            want[r[1]] = len(mine)
            mine.append((cy, h))
    assert got == want


def test_pages_are_cut_where_no_row_reaches(spark):
    rows = [(1, i, 1, 0.0, 14.0 * (i // 4) + (200 if i > 60 else 0), 9.0, 14.0 * (i // 4) + (200 if i > 60 else 0) + (10 if i % 4 else 6), "w", 1.0, "s")
            for i in range(120)]
    lines = op._lines(spark.createDataFrame(rows, WORD), 0.6)
    assert lines.select("island").distinct().count() > 20 and lines.count() < 120
    got = {r.word_idx: r.row_id for r in op.visual_rows(spark.createDataFrame(rows, WORD)).collect()}
    assert got == greedy_rows(rows)


def greedy_rows(rows):
    want, groups = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], (r[4] + r[6]) / 2, r[1])):
        mine = groups.setdefault((r[0], r[2]), [])
        cy, h = (r[4] + r[6]) / 2, max(1.0, r[6] - r[4])
        n = next((n for n, (cy0, h0) in enumerate(mine) if abs(cy - cy0) <= 0.6 * max(h0, h)), len(mine))
        if n == len(mine):
            mine.append((cy, h))
        want[r[1]] = n
    return want


def test_best_value_matches_all_pairs(spark):
    rng = random.Random(9)
    rows = [(1, i, 1, x := rng.uniform(0, 900), y := rng.uniform(0, 900), x + rng.uniform(5, 300), y + rng.uniform(0, 20), f"t{i}", 1.0, "s")
            for i in range(250)]
    w = spark.createDataFrame(rows, WORD)
    labels = w.filter("word_idx % 10 = 0").select("doc_id", "page", F.col("word_idx").cast("string").alias("label_id"),
                                                   F.lit("f").alias("field"), "text", F.lit(1.0).alias("score"), *op.BOX)
    got = {r.label_id: (r.word_idx, round(r.score, 9)) for r in op.best_value_per_label(labels, w).collect()}
    a, b = geo.with_center(labels), geo.with_center(w)
    left = a.select("label_id", F.struct("page", *op.BOX, "cx", "cy").alias("l"))
    right = b.select("word_idx", F.struct("page", *op.BOX, "cx", "cy").alias("w"))
    pairs = left.crossJoin(right).select("label_id", "word_idx", geo.relation_score(F.col("l"), F.col("w"))["score"].alias("s"),
                                         geo.is_label_itself(F.col("l"), F.col("w")).alias("own")).collect()
    want = {}
    for r in sorted(pairs, key=lambda r: (-r.s, r.word_idx)):
        if r.s > 0 and not r.own:
            want.setdefault(r.label_id, (r.word_idx, round(r.s, 9)))
    assert got == want


def test_label_matching_is_cautious(spark):
    anchors = {"start": ["start of cover"], "id": ["id card"], "plate": ["plate"]}
    phrases = ["start of cover", "Start of cover", "the start of cover", "start", "cover", "id", "id card", "id cart", "plates", "plate:", "of cover start"]
    got = {r.phrase: (r.field, round(r.score, 2)) for r in op.match_label(
        spark.createDataFrame([(p,) for p in phrases], "phrase string"), anchors).collect()}
    assert got == {"start of cover": ("start", 1.0), "Start of cover": ("start", 0.93), "the start of cover": ("start", 0.9),
                   "id card": ("id", 1.0), "plates": ("plate", 0.91), "plate:": ("plate", 1.0)}


def test_prefilter_loses_no_label(spark):
    rng = random.Random(1)
    anchors = [t for _, t in op._anchor_rows(op.vocab.ANCHORS)]
    phrases = set()
    for a in anchors:
        for _ in range(30):
            p = list(a)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(p) + 1)
                p[k:k + rng.randrange(2)] = rng.choice(["", "ב", "x", " "])
            phrases.add(" ".join("".join(p).split()))
    df = spark.createDataFrame([(p,) for p in sorted(phrases) if p], "norm string")
    full = {r.norm for r in op._match_normalized(df, op.vocab.ANCHORS, 0.86).collect()}
    near = {r.norm for r in df.filter(op._plausible(F.col("norm"), op.vocab.ANCHORS, 0.86)).collect()}
    assert len(full) > 200 and full <= near


def test_median_is_the_upper_one(spark):
    for n in (1, 2, 3, 4, 7, 10):
        rows = [(1, i, 1, 0.0, 0.0, 1.0, float(i + 2), "w", 1.0, "s") for i in range(n)]
        assert op.median_word_height(spark.createDataFrame(rows, WORD)).first()["h"] == float(n // 2 + 2)


def test_flat_text(spark):
    text = "ביטוח מקיף, רכב 12-345-67, הראל, מתאריך 01/01/2027 עד 31/12/2027, פוליסה 998877"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "document_id int, text string")
    got = {(r.document_id, r.field): r.value for r in fo.extract_fields_from_text(df).collect()}
    assert got == {
        (1, "document_type"): "COMPREHENSIVE_INSURANCE", (1, "registration_number"): "1234567", (1, "policy_number"): "998877",
        (1, "insurer"): "הראל", (1, "insurance_type"): "COMPREHENSIVE", (1, "start_date"): "2027-01-01",
        (1, "end_date"): "2027-12-31", (2, "document_type"): "UNKNOWN_VEHICLE_DOCUMENT"}


def test_intents(one):
    asked = {
        "מה מספר הרכב": "vehicle_number", "מספר רישוי": "vehicle_number", "רכב": "vehicle_number", "תחילה": "insurance_start",
        "תחילת הביטוח": "insurance_start", "תום": "insurance_end", "תום הביטוח": "insurance_end", "מספר פוליסה": "policy_number",
        "פוליסה": "policy_number", "מי בעל הפוליסה": "policy_holder", "מחיר": "premium", "رقم السيارة": "vehicle_number",
        "بداية التأمين": "insurance_start", "vehicle number": "vehicle_number", "insurance expiry": "insurance_end",
        "מה התנאים לביטול הפוליסה?": None, "what are the cancellation conditions?": None, "": None}
    for question, field in asked.items():
        assert one(fo.intent_of(F.lit(question))).field == field, question


def test_answers_are_stated_or_hedged(one, spark):
    assert one(fo.field_answer(F.lit("insurance_start"), F.lit("2027-03-05"), F.lit("he"))) == "תחילת הביטוח היא **05/03/2027**"
    assert one(fo.field_answer(F.lit("premium"), F.lit("234.00"), F.lit("en"))) == "Premium: **234.00 ₪**"
    docs = spark.createDataFrame([(1, 5, 1, True, "WARRANTY", 0.8), (2, 6, 2, True, "WARRANTY", 0.8)],
                                 "document_id int, user_id int, created_at int, has_fields boolean, document_type string, type_confidence double")
    values = spark.createDataFrame([(1, "premium", "10.00", 0.9, 1), (1, "insurer", "Alpha", 0.7, 2), (1, "chassis", "X", 0.5, 1)],
                                   "document_id int, field string, value string, confidence double, page int")
    questions = spark.createDataFrame([(1, 5, "price", None), (2, 5, "insurer", None), (3, 5, "chassis number", None),
                                       (4, 5, "document type", None), (5, 7, "price", None), (6, 7, "price", 1)],
                                      "question_id int, user_id int, question string, document_id int")
    got = {r.question_id: r.content for r in vehicle.structured_answers(questions, docs, values).collect()}
    assert got == {1: "Premium: **10.00 ₪**", 2: "Found in the document: Insurer: **Alpha**",
                   4: "Document type: **Warranty**", 6: "Premium: **10.00 ₪**"}
    shared = vehicle.structured_answers(questions, docs, values, share_latest=True).filter("question_id = 5")
    assert shared.count() == 0  # the newest document of all has no such field


def test_runs_may_hold_words_that_normalize_to_nothing(spark):
    w = words(spark, [("aa", 0, 0, 1), ('"', 25, 0, 1), ("bb", 40, 0, 1), ("cc", 65, 0, 1)])
    hits = op.label_hits(op.visual_rows(w), {"pair": ["aa bb"]}).collect()
    assert sorted(h.span for h in hits) == [3, 4]


def test_phrases_meet_every_anchor_they_are_like(spark):
    """The key join against all pairs, with so many anchors that nothing is sifted before it."""
    from docketry.operators.similarity import ratio

    rng = random.Random(12)
    pool = ["plate", "mark", "of", "the", "holder", "policy", "no", "number", "a", "id", "date", "end", "starts", "on", "מספר", "רכב"]
    anchors = {f"f{i}": [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 4)))] for i in range(260)}
    rows = op._anchor_rows(anchors)
    phrases = set()
    for _ in range(700):
        text = list(rng.choice(rows)[1] if rng.random() < 0.8 else " ".join(rng.choice(pool) for _ in range(3)))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text) + 1)
            if rng.random() < 0.5:
                text.insert(at, rng.choice("abemx "))
            elif at < len(text) > 1:
                del text[at]
        phrases.add(" ".join("".join(text).split()))
    phrases |= {"xx plate mark", "late marks", "plate mark x y", "x"}
    want = {}
    for p in phrases:
        best = (None, 0.0)
        for field, text in rows:
            n, m = len(p.split(" ")), len(text.split(" "))
            score = 1.0 if p == text else 0.9 if m >= 2 and text in p and n <= m + 1 else 0.0 if (
                n != m or abs(len(p) - len(text)) > max(3, len(text) // 4)) else ratio(p, text)
            if score > best[1]:
                best = (field, score)
        if p and best[1] >= op.vocab.LABEL_THRESHOLD:
            want[p] = (best[0], round(best[1], 9))
    df = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    assert {r.phrase: (r.field, round(r.score, 9)) for r in op.match_label(df, anchors).collect()} == want and len(want) > 200
    few = dict(list(anchors.items())[:150])  # sifted by letters first
    rows = op._anchor_rows(few)
    direct = {r.norm: (r.field, r.score) for r in op._match_normalized(df.withColumnRenamed("phrase", "norm"), few, 0.86).collect()}
    assert {r.phrase: (r.field, r.score) for r in op.match_label(df, few).collect()} == direct


def test_a_hundred_thousand_anchors(spark):
    anchors = {f"f{i}": [f"label {i * 7919 % 1000003:06d} of form"] for i in range(100_000)}
    df = spark.createDataFrame([(f"label {i * 7919 % 1000003:06d} of forn",) for i in range(50)] + [("nothing like it at all",)], "phrase string")
    got = {r.phrase: r.field for r in op.match_label(df, anchors).collect()}
    assert len(got) == 50 and got["label 007919 of forn"] == "f1"


def _shuffled(plan) -> int:
    """Rows written by the exchanges of a plan that has run."""
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_text_of_labels_is_found_without_moving_pairs(spark):
    rows = spark.range(800).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("word_idx"), F.lit(1).alias("page"),
        (F.col("id") % 8 * 60.0).alias("x0"), (F.floor(F.col("id") / 8) * 14.0).alias("y0"),
        (F.col("id") % 8 * 60.0 + 30).alias("x1"), (F.floor(F.col("id") / 8) * 14.0 + 12).alias("y1"),
        F.when(F.col("id") % 16 == 3, "see").when(F.col("id") % 8 == 3, F.concat(F.lit("w"), "id")).otherwise(
            F.col("id").cast("string")).alias("text"),
        F.lit(1.0).alias("conf"), F.lit("pdf_text").alias("source"), F.floor(F.col("id") / 8).cast("int").alias("row_id"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # no constants to plan by
    labels = rows.filter("text = 'see'").select(
        "doc_id", "page", F.concat(F.lit("w"), "word_idx").alias("label_id"), F.lit("policy_holder").alias("field"),
        "text", F.lit(1.0).alias("score"), "x0", "y0", "x1", "y1")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = op.resolve_text_field(labels, rows, {"policy_holder": ["see"]}).select("label_id", "value")
        got = sorted(map(tuple, found.collect()))
        moved = _shuffled(found._jdf.queryExecution().executedPlan())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # the next row below holds one word with letters in the label's column; its neighbours have none
    assert got == sorted((f"w{i}", f"w{i + 8}") for i in range(3, 800, 16))
    assert moved < 50 * 800 / 4, moved  # 50 labels meet 800 words


def test_plain_sift_passes_whatever_is_plausible(spark):
    anchors = {"a": ["name mark", "plate"], "b": ["id"]}
    many = {"a": [f"name m{k}" for k in range(30)] + ["plate"]}
    said = ["name mark", "the name mark", "name  mark", "plat", "plates", "id", "x", "one two three four five six", "name m7 and", "", None]
    rows = spark.createDataFrame([(t,) for t in said], "norm string")
    for known in (anchors, many):
        got = rows.select("norm", op._sized(F.col("norm"), known).alias("sized"),
                          op._plausible(F.col("norm"), known, 0.86).alias("plausible")).collect()
        assert any(r.plausible for r in got) and all(r.sized for r in got if r.plausible)
        assert not next(r.sized for r in got if r.norm == "one two three four five six")


def test_words_meet_labels_without_columns_nobody_reads(spark):
    words = spark.range(40).selectExpr(
        "1L doc_id", "id word_idx", "1 page", "id * 20.0 x0", "0.0 y0", "id * 20.0 + 15 x1", "12.0 y1", "'unread' text", "1.0 conf",
        "'unread' source")
    labels = words.filter("word_idx = 3").selectExpr(
        "doc_id", "page", "'w' label_id", "'f' field", "text", "1.0 score", "x0", "y0", "x1", "y1")
    found = op.label_word_relation(labels, words)
    plan = found.select("doc_id", "label_id", "word_idx", "score")._jdf.queryExecution().optimizedPlan().toString()
    assert "unread" not in plan
    near = {r.word_idx: r for r in found.collect()}
    assert near[4].w.text == "unread" and near[4].l.field == "f" and near[4].relation == "same_row"


def moved(df):
    """What the plan of `df` shuffles: the columns of each exchange."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [p.split("\n")[1] for p in plan.split("\n\n") if " Exchange\n" in p]


def placed(spark, lines):
    """Texts that lie by document, their words, and the same words from a table of no order."""
    from docketry.checks import layout as checks
    from docketry.session import settle_by

    texts = spark.createDataFrame(lines, "doc_id long, text string")
    by_doc = settle_by(texts, "doc_id")
    return by_doc, checks.words(None, lambda d: by_doc), spark.createDataFrame(
        checks.words(None, lambda d: texts).collect(), checks.words(None, lambda d: texts).schema)


def spy(monkeypatch, spark):
    """Plans of everything that the layout operators and the vehicle plan settle."""
    from docketry import session

    seen = []

    def settle(df, in_place=False):
        with session._in_place(spark) if in_place else session.nullcontext():
            seen.append(moved(df.select("*")))
        return session.settle(df, in_place)

    def settle_by(df, key):
        with session._in_place(spark):
            seen.append(moved(df.select("*")))
        return session.settle_by(df, key)

    for module in (op, vehicle):
        monkeypatch.setattr(module, "settle", settle)
        monkeypatch.setattr(module, "settle_by", settle_by)
    return seen


LINES = [(i, f"the call 555{i}\nsee Jo Doe\ncar number 12345{i:02} id 77{i}\non the one pay 5/3/2027\nplain words") for i in range(12)]
TERMS = {"vehicle_number": ["car", "number"], "id_number": ["id"], "policy_number": ["call"],
         "agent_number": ["on the", "the one"], "policy_holder": ["see"], "insurance_start": ["pay"]}


def test_words_that_lie_by_document_are_not_shuffled_for_labels(spark, monkeypatch):
    _, words_by_doc, loose = placed(spark, LINES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(tuple, op.label_hits(op.visual_rows(loose), TERMS).collect()))
        seen = spy(monkeypatch, spark)
        hits = op.label_hits(op.visual_rows(words_by_doc), TERMS, heights=op.median_word_height(words_by_doc))
        assert sorted(map(tuple, hits.collect())) == want and len(want) > 50
        assert seen and not [x for plan in seen + [moved(hits)] for x in plan if "word_idx#" in x or "w0#" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_that_lie_by_document_are_not_shuffled_for_texts(spark, monkeypatch):
    from docketry.session import settle_by

    _, words_by_doc, loose = placed(spark, LINES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = settle_by(op.visual_rows(words_by_doc), "doc_id")
        labels = op.label_hit_dedupe(op.label_hits(rows, TERMS)).filter("field = 'policy_holder'").localCheckpoint()
        want = sorted(map(tuple, op.resolve_text_field(labels, op.visual_rows(loose), TERMS).collect()))
        seen = spy(monkeypatch, spark)
        found = op.resolve_text_field(labels, rows, TERMS)
        assert sorted(map(tuple, found.collect())) == want and len(want) == 12
        everything = [x for plan in seen + [moved(found)] for x in plan]
        assert seen and not [x for x in everything if " ws#" in x or "w_text#" in x]
        # once, to learn which are labels, as no table is broadcast here
        assert len([x for x in everything if "source#" in x and "row_id#" in x]) <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_words_that_lie_by_document_are_not_shuffled_for_fields(spark, monkeypatch):
    texts, words_by_doc, loose = placed(spark, [*LINES, (50, LINES[3][1])])
    vehicles = spark.createDataFrame([("1234503", "a")], "normalized_number string, registration_number string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = vehicle.process_vehicle_documents(loose, texts, vehicles, None, TERMS)
        want = [sorted(map(str, want[k].collect())) for k in ("documents", "fields", "candidates")]
        seen = spy(monkeypatch, spark)
        done = vehicle.process_vehicle_documents(words_by_doc, texts, vehicles, None, TERMS)
        assert [sorted(map(str, done[k].collect())) for k in ("documents", "fields", "candidates")] == want
        assert len(want[0]) == 12 and len(want[1]) > 30
        everything = [x for plan in seen for x in plan]
        assert seen and not [x for x in everything if " ws#" in x or "w_text#" in x and "w_value#" not in x and "l_text#" not in x]
        # once, to learn which are labels, as no table is broadcast here; tokens that may be vehicle numbers move too
        assert len([x for x in everything if "source#" in x and "row_id#" in x and "value#" not in x]) <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
