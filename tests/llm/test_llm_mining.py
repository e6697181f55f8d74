"""Hard negatives and collocations against brute force, with every odd row."""

import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from docketry.llm import collocations, hard_negatives, queries, zone_blocks
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def test_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(product(range(1 << bits), repeat=dims)))
        places = [bytes(k) for k in zone_blocks.hilbert(cells, bits)]
        assert len(set(places)) == len(cells)
        path = cells[np.argsort(np.array([int.from_bytes(p, "big") for p in places], dtype=object))]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def by_force(rows, is_anchor):
    """All negatives in plain Python; rows are (vec_id, label, whole components)."""
    out = []
    anchors = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if is_anchor(r[0]):
            anchors.setdefault(r[0], r)
    for anchor_id, label, v in anchors.values():
        scored = sorted((-sum(map(int.__mul__, v, w)), i, lab) for i, lab, w in rows)
        own = [(-s, i) for s, i, lab in scored if lab == label and i != anchor_id][:5]
        for high, positive in own:
            fits = [(-s, i) for s, i, lab in scored if lab != label and 80 * high <= -100 * s <= 100 * high][:5]
            out += [(anchor_id, positive, k + 1, i, high, s) for k, (s, i) in enumerate(fits)]
    return sorted(out)


def made(rng, n, dims, spread):
    rows = []
    for i in range(n):
        v = [rng.gauss(0, spread) + (1 if k == i % 3 else 0) for k in range(dims)]
        rows.append((i, v, rng.randrange(4)))
    return rows


@pytest.mark.parametrize("block_rows, group", [(8, 3), (64, 64)])
def test_equals_brute_force(spark, block_rows, group):
    rng = random.Random(block_rows)
    rows = made(rng, 600, 6, 0.4)
    rows += [(700 + i, [0.5] * 6, i % 3) for i in range(90)]  # one vector very often
    rows += [(7, rows[7][1], rows[7][2]), (20, [0.1] * 6, 0), (801, [1.0], 1), (802, [], 2), (803, [0.0] * 6, 1)]
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 6, 1), (903, [math.inf] * 6, 1), (904, [0.1] * 6, None),
             (None, [0.1] * 6, 1)]
    given = spark.createDataFrame(rows, VECTORS).withColumn("place", F.lit("clash")).withColumn("vector", F.lit(1))
    prepared = hard_negatives.prepared(given, F.col("label"))
    got = hard_negatives.mine(prepared, F.col("vec_id") % 20 == 0, block_rows=block_rows, group=group)
    whole = [(i, lab, [*(math.floor(256 * float(np.float32(x))) for x in v), *[0] * (6 - len(v))]) for i, v, lab in rows
             if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    have = got.collect()
    assert sorted(tuple(r)[:6] for r in have) == by_force(whole, lambda i: i % 20 == 0)
    if block_rows == 8:  # the ranges spare some blocks
        assert min(r["blocks_read"] / (2 * r["blocks"]) for r in have) < 0.8


def test_query_moves_labels_and_floors(spark, tmp_path):
    rows = made(random.Random(5), 400, 8, 0.5)
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows]
    got = queries.op11_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == by_force(moved, lambda i: i % 100 == 0)


def test_scores_beyond_doubles_are_exact_and_beyond_longs_refused(spark):
    rows = [(0, [3e5, 1.0], 0), (1, [3e5, 0.99], 0), (2, [3e5, 0.5], 1), (3, [3e5, 0.25], 1)]
    prepared = hard_negatives.prepared(spark.createDataFrame(rows, VECTORS), F.col("label"))
    whole = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows]
    got = hard_negatives.mine(prepared, F.col("vec_id") == 0).collect()
    assert [tuple(r)[:6] for r in got] == by_force(whole, lambda i: i == 0)
    huge = hard_negatives.prepared(spark.createDataFrame([(0, [1e30], 0), (1, [1e30], 1)], VECTORS), F.col("label"))
    with pytest.raises(ValueError):
        hard_negatives.mine(huge, F.col("vec_id") == 0)


def test_no_vectors_and_no_anchors(spark):
    empty = hard_negatives.prepared(spark.createDataFrame([], VECTORS), F.col("label"))
    assert hard_negatives.mine(empty, F.col("vec_id") == 0).collect() == []
    rows = hard_negatives.prepared(spark.createDataFrame([(1, [0.5], 1)], VECTORS), F.col("label"))
    assert hard_negatives.mine(rows, F.col("vec_id") == 0).collect() == []
    assert hard_negatives.mine(rows, F.col("vec_id") == 1).collect() == []


def phrases_by_force(docs, min_count, top):
    n, f = Counter(), Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i: i + k])] += 1
    out = []
    for lang in n:
        found = {p: c for (x, p), c in f.items() if x == lang and c >= min_count and len(p) > 1}
        rows = []
        for p, a in found.items():
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 80 * a and any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))
                       for q, b in found.items() if len(q) > len(p)):
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    common = ["der", "New", "York", "city", "of", "é", "日本", "x-y", "it's", " "]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(["new york city", "state of the art", rng.choice(common), f"w{rng.randrange(500)}"]))
            words.append(rng.choice([" ", "  ", "\t", " ", ", ", ".", "\n", "\x0b"]))
        out.append((rng.choice(["en", "de", None, "und", ""]), "".join(words)))
    return out


@pytest.mark.parametrize("most_bits, slice_bytes, top", [(1 << 27, 2_000_000, 2000), (1 << 6, 500, 7)])
def test_collocations_equal_brute_force(spark, most_bits, slice_bytes, top):
    """With a filter that lets nearly everything through, and in many slices, nothing changes."""
    docs = texts(most_bits, 300)
    docs += [("en", None), ("en", ""), (None, "..."), ("fr", "new york city " * 4000), ("it", "a " * 100), *[("pt", "um dois tres quatro cinco")] * 31]
    table = spark.createDataFrame(docs, "lang string, text string").withColumns(
        {c: F.lit("clash") for c in ("w1", "h", "c", "f", "words", "phrase", "doc_id")}).repartition(5)
    got = collocations.collocations(table, min_count=12, top=top, most_bits=most_bits, slice_bytes=slice_bytes)
    assert sorted(map(tuple, got.collect())) == phrases_by_force(docs, 12, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).collect() == []


def test_scores_beyond_64_bits(spark):
    exact = "decimal(19,0)"
    got = spark.sql(f"select cast(2000000 as decimal(10,0)) * cast(9000000000000000000 as {exact}) div "
                    f"(cast(9000000000000000001 as {exact}) + cast(9000000000000000000 as {exact})) as v").first()["v"]
    assert got == 2_000_000 * 9 * 10 ** 18 // (18 * 10 ** 18 + 1)
