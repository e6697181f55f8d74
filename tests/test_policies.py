import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import policies as op

SCHEMA = ("id string, vehicle_number string, insurance_type string, policy_number string, "
          "insurer string, start_date date, end_date date, file_hash string")


def day(text):
    return dt.date.fromisoformat(text) if text else None


def policy(id, start=None, end=None, kind="COMPREHENSIVE", plate="12-345-67", number=None, insurer="Alpha", hash=None):
    return (id, plate, kind, number, insurer, day(start), day(end), hash)


def found(spark, *rows, **kw):
    df = op.detect_conflicts(spark.createDataFrame(list(rows), SCHEMA), **kw)
    return {(r.a_id, r.b_id): r for r in df.collect()}


A = policy("a", "2027-01-01", "2027-12-31")
B = policy("b", "2027-06-01", "2028-05-31", plate="1234567", insurer="Beta")


def test_overlap_counts_both_ends(spark):
    hit = found(spark, A, B)[("a", "b")]
    assert (hit.conflict_type, hit.severity, hit.overlap_days) == ("OVERLAPPING_SAME_TYPE", "HIGH", 214)
    assert hit.overlap_start == day("2027-06-01") and hit.overlap_end == day("2027-12-31")


def test_third_party_overlap_is_a_warning(spark):
    rows = [policy(i, s, e, "THIRD_PARTY") for i, s, e in (("a", "2027-01-01", "2027-06-30"), ("b", "2027-06-30", "2027-12-31"))]
    hit = found(spark, *rows)[("a", "b")]
    assert (hit.severity, hit.overlap_days) == ("WARNING", 1)


def test_renewal_and_its_limit(spark):
    near = policy("c", "2028-06-15", "2029-06-14")
    hit = found(spark, B, near)[("b", "c")]
    assert (hit.conflict_type, hit.severity, hit.message) == (
        "LIKELY_RENEWAL", "INFO", "Likely renewal (gap of 15 day(s)).")
    assert ("b", "c") in found(spark, B, policy("c", "2028-07-01", "2029-06-14"))
    assert not found(spark, B, policy("c", "2028-07-02", "2029-06-14"))
    earlier = found(spark, policy("x", "2028-06-15", "2029-06-14"), policy("y", "2027-06-01", "2028-05-31"))
    assert list(earlier) == [("y", "x")]


def test_duplicates_by_number_and_by_file(spark):
    same = found(spark, policy("a", number="N-1", insurer="Alpha"), policy("d", number="N-1", insurer="ALPHA"))
    assert same[("a", "d")].message == "Same policy number and insurer."
    file = found(spark, policy("a", hash="h"), policy("d", hash="h", number="N-1"))
    assert file[("a", "d")].conflict_type == "EXACT_DUPLICATE"
    assert not found(spark, policy("a", number="", hash=""), policy("d", number="", hash=""))


def test_redundant_cover_and_other_types(spark):
    other = policy("b", "2027-06-01", "2028-05-31", "THIRD_PARTY")
    assert found(spark, A, other)[("a", "b")].conflict_type == "POTENTIAL_REDUNDANT_COVERAGE"
    assert not found(spark, A, policy("b", "2027-06-01", "2028-05-31", "COMPULSORY"))
    assert not found(spark, A, policy("b", "2027-06-01", "2028-05-31", plate="99-999-99"))


def rule(a, b):
    """The pair rule, written out for one pair in id order."""
    if a[7] and a[7] == b[7]:
        return (a[0], b[0], "EXACT_DUPLICATE")
    if a[3] and a[3] == b[3] and (a[4] or "").lower() == (b[4] or "").lower():
        return (a[0], b[0], "EXACT_DUPLICATE")
    meets = all((a[5], a[6], b[5], b[6])) and max(a[5], b[5]) <= min(a[6], b[6])
    if meets and a[2] == b[2]:
        return (a[0], b[0], "OVERLAPPING_SAME_TYPE")
    if meets and {a[2], b[2]} == {"COMPREHENSIVE", "THIRD_PARTY"}:
        return (a[0], b[0], "POTENTIAL_REDUNDANT_COVERAGE")
    if a[2] == b[2] and a[6] and b[5]:
        old, new = (a, b) if a[6] <= b[5] else (b, a)
        if old[6] and new[5] and 0 <= (new[5] - old[6]).days <= 31:
            return (old[0], new[0], "LIKELY_RENEWAL")
    return None


def test_against_all_pairs_with_odd_dates_and_one_hot_vehicle(spark):
    rng = random.Random(3)
    rows = []
    for i in range(260):
        start = dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(2000))
        length = rng.choice([-20, 0, 29, 90, 364, 1100, 20000, 900000])
        rows.append((
            f"p{i:03d}", "1112223" if i % 3 else f"77{i % 7:05d}", rng.choice(["COMPREHENSIVE", "THIRD_PARTY", "COMPULSORY"]),
            rng.choice([None, "", f"N{rng.randrange(40)}"]), rng.choice([None, "Alpha", "ALPHA"]),
            rng.choice([None, start, start, start]), rng.choice([None, start + dt.timedelta(days=length), start + dt.timedelta(days=length)]),
            rng.choice([None, f"h{i}", f"h{rng.randrange(60)}"])))
    want = {rule(a, b) for a, b in itertools.combinations(rows, 2) if a[1] == b[1]} - {None}
    df = op.detect_conflicts(spark.createDataFrame(rows, SCHEMA))
    got = [(r.a_id, r.b_id, r.conflict_type) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [199, 200, 201])
def test_copies_are_pairs_whatever_their_number(spark, n):
    rows = [policy(f"p{i:03d}", hash="same") for i in range(n)]
    assert len(set(found(spark, *rows))) == n * (n - 1) // 2


def test_blocks_of_copies_list_each_pair_once(spark):
    rows = [policy(f"p{i:02d}", hash="same") for i in range(30)]
    pairs = found(spark, *rows, copy_block=7)
    assert len(pairs) == len(set(pairs)) == 30 * 29 // 2


def test_quality_codes(spark):
    rows = [policy("bad", "2027-05-01", "2027-04-01", insurer=None, plate="??"), A]
    df = op.quality_issues(spark.createDataFrame(rows, SCHEMA), F.lit("99-999-99"), F.lit("2028-01-01").cast("date"))
    got = {(r.id, r.code) for r in df.collect()}
    assert got == {("bad", "invalid_dates"), ("bad", "missing_insurer"), ("bad", "no_vehicle"), ("bad", "vehicle_mismatch"),
                   ("bad", "already_expired"), ("a", "vehicle_mismatch"), ("a", "already_expired")}


def test_rescan_keeps_reviewed_rows(spark):
    old = spark.createDataFrame([("v1", "needs_review"), ("v1", "resolved"), ("v2", "needs_review")], "vehicle string, status string")
    fresh = spark.createDataFrame([("v1",)], "vehicle string")
    got = op.replace_unreviewed_conflicts(old, fresh, spark.createDataFrame([("v1",)], "vehicle string"))
    assert sorted(map(tuple, got.collect())) == [("v1", "needs_review"), ("v1", "resolved"), ("v2", "needs_review")]


def test_pairs_do_not_depend_on_how_many_policies_a_vehicle_may_gather(spark):
    """policies of small vehicles are shuffled once, and give the rows that the joins give."""
    pick = random.Random(5)
    rows = []
    for i in range(240):
        start = dt.date(2024, 1, 1) + dt.timedelta(days=pick.randrange(0, 300))
        rows.append((
            pick.choice([i, i // 2, None]), pick.choice(["11-22", "1122", "", None, "33", "x44", "55"]),
            pick.choice(["COMPREHENSIVE", "THIRD_PARTY", "COMPULSORY", "", None]), pick.choice(["p1", "p2", "", None]),
            pick.choice(["A", "a", "B", None]), pick.choice([start, start, None]),
            pick.choice([start + dt.timedelta(days=pick.choice([-5, 0, 90, 364, 3000])), None]),
            pick.choice([f"h{i % 60}", f"h{i}", "", None])))
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["vehicle", "a_id", "b_id", "basis", "insurance_type", "overlap_start", "overlap_end", "gap"]
    gathered, joined, some = (
        op.policy_pairs(df, few=few).select(*names) for few in (1000, 0, 60))
    want = sorted(map(repr, joined.collect()))
    assert len(want) > 100
    assert sorted(map(repr, gathered.collect())) == want
    assert sorted(map(repr, some.collect())) == want
    assert gathered._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
