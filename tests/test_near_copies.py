"""Near copies across a corpus against the plain rule."""

import random

import pytest

from docketry.functions.grams import grams, points
from docketry.operators import near_copies as nc
from docketry.operators.similarity import at_least, ratio

ROW = "document_id long, content string, score double"


def by_force(rows, threshold=0.85):
    kept, out = [], {}
    for i, text, score in sorted(rows, key=lambda r: (-(r[2] or 0), r[0])):
        x = " ".join((text or "").split()).lower()
        by = next((k for k, y in kept if x and y and (x in y or y in x or at_least(x, y, threshold))), None)
        out[i] = by
        if by is None:
            kept.append((i, x))
    return out


def answer(spark, rows, **kw):
    got = nc.corpus_near_duplicates(spark.createDataFrame(rows, ROW), **kw).collect()
    assert all(r.kept == (r.duplicate_of is None) for r in got) and len(got) == len(rows)
    return {r.document_id: r.duplicate_of for r in got}


def short_rows(rng, n):
    words = ["ab", "the", "lorem", "ipsum", "x", "yz", "dolor", "sit", "amet", "é", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), rng.choice([0.1, 0.5, None, 0.9])) for i in range(n)]
    return rows + [(1000, None, 0.5), (1001, "", 0.5), (1002, " ", 0.9)]


def long_rows(rng, n):
    def word(low, high):
        return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high)))

    base = [" ".join(word(2, 8) for _ in range(rng.randint(20, 300))) for _ in range(30)]
    rows = []
    for i in range(n):
        words, what = rng.choice(base).split(), rng.random()
        if what < 0.4:
            for _ in range(rng.randint(0, len(words) // 8)):
                words[rng.randrange(len(words))] = word(5, 5)
        elif what < 0.6:
            at = rng.randrange(len(words))
            words = words[at: at + rng.randint(1, 60)]
        rows.append((i, " ".join(words), rng.random()))
    return rows


@pytest.mark.parametrize("rounds", [2, 8])
def test_equals_the_plain_rule(spark, rounds):
    """Also when what is left after two rounds is compared pair by pair."""
    short, long = short_rows(random.Random(3), 250), long_rows(random.Random(4), 150)
    rows = short + [(i + 2000, t, s) for i, t, s in long]
    assert answer(spark, rows, rounds=rounds) == by_force(rows)


def test_other_thresholds(spark):
    rows = short_rows(random.Random(5), 120)
    for threshold in (0.7, 0.95):
        assert answer(spark, rows, threshold=threshold) == by_force(rows, threshold)


def test_the_prefix_of_rare_grams_misses_no_similar_pair():
    """Any two strings alike enough share a looked-up gram, whatever the order of grams."""
    import numpy as np

    from docketry.functions.grams import TABLE, numbered, rare_first

    rng = random.Random(6)
    counts = np.array([rng.randrange(100) for _ in range(TABLE)])
    for threshold in (0.6, 0.85, 0.92):
        rule, alike = nc.Rule(threshold, 200), 0
        for _ in range(4000):
            a = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
            b = list(a)
            for _ in range(rng.randint(0, max(1, len(a) // 3))):
                at = rng.randrange(len(b) + 1)
                if rng.random() < 0.5:
                    b.insert(at, rng.choice("abcd"))
                elif at < len(b) > 1:
                    del b[at]
            a, b = "".join(a), "".join(b)
            if ratio(a, b) < threshold:
                continue
            alike += 1
            keys = [{(q, k) for q in rule.kinds(len(t)) for k in
                     rare_first(numbered(grams(points(t), q)), counts)[: rule.sized(len(t), q)].tolist()} for t in (a, b)]
            assert keys[0] & keys[1], (a, b)
        assert alike > 300


def test_a_large_group_costs_rows_not_pairs(spark):
    """Three hundred near copies of one text: a row per member and key, and one kept."""
    rng = random.Random(7)
    words = [f"word{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(150)] = f"other{i}"
        rows.append((i, " ".join(own), 1.0))
    df = spark.createDataFrame(rows, ROW)
    got = nc.corpus_near_duplicates(df).collect()
    assert [r.document_id for r in got if r.kept] == [0] and {r.duplicate_of for r in got if not r.kept} == {0}


def test_planted_copies_of_documents_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(120).collect()
    rng, rows, planted = random.Random(8), [], {}
    for r in docs:
        rows.append((r.doc_id, r.text, 2.0))
        words = r.text.split()
        if len(words) > 40:
            for _ in range(len(words) // 25):
                words[rng.randrange(len(words))] = "changed"
            rows.append((10_000 + r.doc_id, " ".join(words), 1.0))
            planted[10_000 + r.doc_id] = r.doc_id
    got = answer(spark, rows)
    assert len(planted) > 50 and all(got[i] is not None for i in planted)


def test_no_rows(spark):
    assert nc.corpus_near_duplicates(spark.createDataFrame([], ROW)).collect() == []


def test_gram_hashes_mix_each_character_once(monkeypatch):
    """As many mixing passes for long grams as for short ones, and the same hashes as run by run."""
    from docketry.functions import grams as g

    of, calls, plain = points("Ünï cödé ☃ the end of it"), [], g.mixed
    expected = []
    for i in range(len(of) - 7):
        total = 8
        for k in range(8):
            total += int(plain(of[i + k: i + k + 1] + g.U64(1))[0]) * int(g._ODD[k])
        expected.append(int(plain(g.np.array([total & (1 << 64) - 1], g.U64))[0]))
    monkeypatch.setattr(g, "mixed", lambda x: calls.append(len(x)) or plain(x))
    assert grams(of, 8).tolist() == expected
    assert len(calls) == 2


def test_texts_whose_lengths_rule_them_out_are_not_sent(spark, monkeypatch):
    """They share a passage, so they meet at a key; one that lies in another is found all the same."""
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(120)).strip()
    sizes = [220, 300, 900, 2700, 8000]
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(n)) + " " + passage, float(n)) for i, n in enumerate(sizes)]
    rows.append((9, rows[2][1][100:700], 1.0))
    sent, plain = [], nc._alike

    def alike(pairs, texts, threshold):
        sent.extend(tuple(r) for r in pairs.select("id", "by").collect())
        return plain(pairs, texts, threshold)

    monkeypatch.setattr(nc, "_alike", alike)
    assert answer(spark, rows) == by_force(rows)
    assert set(sent) <= {(0, 1), (1, 0), (9, 2), (2, 9)} and (9, 2) in sent


def test_beginnings_rule_out_only_what_is_not_alike(monkeypatch):
    from docketry.operators import similarity

    rng, ruled, alike = random.Random(10), 0, 0
    for _ in range(1500):
        letters = rng.choice(["ab", "abcdefgh", "aé日😀xyz "])
        a = [rng.choice(letters) for _ in range(rng.randint(100, 400))]
        b = list(a) if rng.random() < 0.8 else [rng.choice(letters) for _ in a]
        for _ in range(int(len(a) * rng.random() * 0.4)):  # also many edits at the start only
            at = rng.randrange(1 + (len(b) if rng.random() < 0.5 else len(b) // 4))
            b[at:at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
        a, b = "".join(a), "".join(b)
        for threshold in (0.6, 0.85, 0.95):
            no = similarity.starts_too_differently(a, b, threshold)
            assert not (no and ratio(a, b) >= threshold), (a, b)
            ruled, alike = ruled + no, alike + (ratio(a, b) >= threshold)
    assert ruled > 300 and alike > 1000
    # of two long texts with nothing in common only the beginnings are read
    steps, plain = [], similarity.open_bits_of
    monkeypatch.setattr(similarity, "open_bits_of", lambda x, y: steps.append(len(y)) or plain(x, y))
    a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(4000)) for _ in range(2))
    assert not at_least(a, b, 0.85) and sum(steps) < 2000
