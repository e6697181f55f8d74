"""Jaccard join, decontamination and byte deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketry.llm import components, decontaminate, jaccard_join, rtree, runindex, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("node", "n", "component", "doc", "low", "high", "words", "hit_words", "items", "given", "shingle", "key", "text_id")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text, pattern):
    return re.findall(pattern, (text or "").translate(LOWER))


def jaccard_classes(rows):
    """component by brute force; rows with the same doc_id are nodes of their own."""
    sets = []
    for _, text in rows:
        w = words(text, r"[^\x20\x09-\x0D]+")
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)].append(doc)
    return Counter((doc, len(sets[i]), min(least[root(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def test_jaccard_join_on_odd_rows(frame, odd_docs):
    got = Counter(map(tuple, jaccard_join.join(frame(odd_docs, DOCS, CLASH)).collect()))
    assert got == jaccard_classes([r[:2] for r in odd_docs])


def test_jaccard_join_finds_chains_and_the_exact_threshold(frame):
    rng = random.Random(5)
    base = [f"t{rng.randint(0, 9999)}" for _ in range(60)]
    rows, now = [], list(base)
    for k in range(25):  # a chain: each text is near the next only
        rows.append((100 - k, " ".join(now)))
        at = rng.randrange(len(now))
        now = now[:at] + [f"n{k}"] + now[at + 1:]
    # sets of 7 shingles, 6 of them shared: 6/8 is exactly 0.75; and 5/9 below it
    w = [f"q{i}" for i in range(11)]
    rows += [(1, " ".join(w)), (2, " ".join(w[1:] + ["z"])), (3, " ".join(w[2:] + ["z", "y"]))]
    got = Counter(map(tuple, jaccard_join.join(frame([(i, t, None, None, None) for i, t in rows], DOCS)).collect()))
    assert got == jaccard_classes(rows)


def test_shards_split_into_blocks_give_the_same_pairs(spark, frame):
    rng = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for k in range(60):
        w = common[:] if k % 2 else common[:25] + [f"u{k}_{i}" for i in range(6)]
        w[rng.randrange(20)] = f"x{k % 9}"
        rows.append((k, " ".join(w), None, None, None))
    docs = frame(rows, DOCS)
    like = jaccard_join.Similarity()
    nodes = jaccard_join.nodes_of(docs, jaccard_join.rarity(docs, 5), like).cache()
    shards = jaccard_join.shards_of(nodes, 75).cache()
    sets = jaccard_join.sets_table(docs, nodes, like).cache()
    none = spark.createDataFrame([], "node long, component long")
    whole, split = (
        {tuple(r) for r in jaccard_join.tree_pairs(shards, none, sets, 75, size).collect()} for size in (2048, 5))
    assert whole and whole == split


def test_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    base = rng.poisson(2.0, (40, 32))
    points = np.vstack([base + (rng.random((40, 32)) < 0.05) for _ in range(5)]).astype(np.int64)
    sizes, groups = points.sum(axis=1), np.arange(len(points)) % 50
    got = {(min(i, j), max(i, j)) for a, b in rtree.pairs(points, sizes, groups, 75, leaf=6) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if groups[i] != groups[j]
            and np.minimum(points[i], points[j]).sum() >= rtree.needed(sizes[i], sizes[j], 75)
            and 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j])}
    assert got == want and want


def test_one_of_each_keeps_the_smallest(frame, odd_docs):
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(frame(odd_docs, DOCS, ("component", "given"))).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 6, 7, 8, 9, 11, 12, 14, 15, 16, 17]
    assert kept.count(None) == 1  # the NULL text; the other NULL row has a partner with an id


def test_components_of_a_long_path(spark):
    links = spark.range(300).selectExpr("id * 8 % 301 as a", "(id + 1) * 8 % 301 as b").selectExpr("least(a, b) v", "greatest(a, b) u")
    got = {r["node"]: r["component"] for r in components.components(links.repartition(7)).collect()}
    assert set(got.values()) == {0} and len(got) == 300


ITEMS = "item_id long, text string"


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination_against_brute_force(frame, odd_docs, block):
    rows = [r[:2] for r in odd_docs]
    a = rows[0][1].split()
    items = [(1, " ".join(a[20:45])), (2, " ".join(rows[10][1].split()[8980:])), (3, "one two"), (4, None), (5, "..."),
             (1, " ".join(a[20:45])), (None, " ".join(a[100:115])), (12, " ".join(a[40:60])), (20, "not there at all in any of these many texts")]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for item, text in items:
        w = words(text, pattern)
        for k in range(max(len(w) - 9, min(1, len(w)))):
            windows[tuple(w[k:k + 10])].add(item)
    want = Counter()
    for doc, text in rows:
        w, hit, found = words(text, pattern), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k:k + size])]
        found.discard(None)
        want[(doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())] += 1
    docs, bench = frame(odd_docs, DOCS, CLASH), frame(items, ITEMS, ("words", "shingle", "window"))
    if block == 200_000:
        got = decontaminate.contamination(docs, bench)
        assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got.collect())
        assert Counter(tuple(r)[:5] for r in got.collect()) == want
    else:
        got = decontaminate.find_windows(docs, bench, block_windows=block).selectExpr("doc_id", "n_words", "size(hit_words)")
        assert Counter(map(tuple, got.collect())) == Counter({(d, n, h): 0 for d, n, h, _, _ in want}) + Counter(
            k[:3] for k in want.elements())


@pytest.mark.parametrize("block", [200_000, 2])
def test_whole_rows_move_with_their_text_once(frame, odd_docs, block):
    """pipeline: rows that hold the text as a field are searched without a second copy of it."""
    from pyspark.sql import functions as F

    docs = frame(odd_docs, DOCS)
    bench = frame([(1, " ".join(odd_docs[0][1].split()[:14])), (2, "one two"), (3, None)], ITEMS)
    given = docs.select(F.struct("*").alias("given"), "text")
    once = decontaminate.find_windows(given, bench, keep=("given",), block_windows=block, inside="given")
    twice = decontaminate.find_windows(docs, bench, block_windows=block)
    rows = [sorted(map(repr, df.selectExpr(f"{of}doc_id", "n_words", "hit_words", "sort_array(items)").collect()))
            for df, of in ((once, "given."), (twice, ""))]
    assert rows[0] == rows[1] and any("items" in r and "[1]" in r for r in rows[0])
    plan = decontaminate.clean_documents(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("MapInArrow"):].splitlines()[1]
    assert "given" in sent and " text#" not in sent[sent.index("AS given"):]


def test_clean_documents_keep_all_columns(frame, odd_docs):
    docs = frame(odd_docs, DOCS, ("hit_words", "given"))
    clean = decontaminate.clean_documents(docs, frame([(1, " ".join(odd_docs[0][1].split()[:12]))], ITEMS))
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r[0]) for r in odd_docs if r[0] not in (1, 2, 3, 13))


def test_no_items_and_no_documents(frame, odd_docs):
    docs, none = frame(odd_docs, DOCS), frame([], ITEMS)
    assert not any(r["contaminated"] for r in decontaminate.contamination(docs, none).collect())
    empty = frame([], DOCS)
    assert decontaminate.contamination(empty, frame([(1, "a b")], ITEMS)).count() == 0
    assert jaccard_join.join(empty).count() == 0
    assert suffix_dedup.dedup(empty).count() == 0


def repeats(rows, length=100):
    """n_removed, spans and digest by brute force; rows with one doc_id and text are one document."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    first = {}
    for none, doc, text in order:
        raw = text.encode()
        for s in range(len(raw) - length + 1):
            first.setdefault(raw[s:s + length], (none, doc, s))
    out = Counter()
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s:s + length]] < (doc is None, doc or 0, s):
                gone[s:s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[(doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_bytes_against_brute_force(frame, odd_docs):
    got = Counter(map(tuple, suffix_dedup.dedup(frame(odd_docs, DOCS, CLASH)).collect()))
    assert got == repeats([r[:2] for r in odd_docs])


def test_repeated_bytes_in_edited_copies(frame):
    rng = random.Random(11)
    base = "".join(rng.choice("abcde \n") for _ in range(900))
    rows = [(k, base[rng.randrange(300):][: rng.randrange(250, 700)]) for k in range(30)]
    for k in range(30, 60):
        text = list(base)
        for _ in range(4):
            text[rng.randrange(900)] = rng.choice("xyz")
        rows.append((k, "".join(text)))
    rows += [(60, "ab" * 400), (61, "é" * 150), (62, "\x00" * 130)]
    rng.shuffle(rows)
    got = Counter(map(tuple, suffix_dedup.dedup(frame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(5)).collect()))
    assert got == repeats(rows)


def test_run_length_index_marks_later_places():
    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        parts += [p[rng.randint(0, 3):] for p in parts]
        symbols, ends = [], []
        for p in parts:
            symbols += [b + 1 for b in p] + [0]
            ends += [len(symbols) - 1] * (len(p) + 1)
        got = runindex.repeated(np.array(symbols, np.uint16), 6, np.array(ends))
        seen, want = set(), []
        for i in range(len(symbols)):
            w = tuple(symbols[i:i + 6]) if ends[i] - i >= 6 else None
            want.append(w is not None and w in seen)
            seen.add(w)
        assert got.tolist() == want
    index = runindex.build(np.array([2, 3] * 50 + [0], np.uint16))
    assert len(index.heads) < 8 and index.lengths.sum() == 101  # a repetitive text has few runs


def test_star_steps_need_no_join_and_keep_all_links(spark):
    edges = spark.createDataFrame([(5, 1), (5, 1), (5, 2), (9, 5), (9, 3), (7, 6)], "u long, v long")
    step = components._star(components._star(edges, large=True), large=False)
    assert "Join" not in step._jdf.queryExecution().optimizedPlan().toString()
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {2: 1, 3: 1, 5: 1, 9: 1, 7: 6}


def test_shard_keys_are_kept_in_six_bytes(frame):
    text = " ".join(f"w{k}" for k in range(30))
    docs = frame([(1, text, None, None, None), (2, text + " more", None, None, None), (3, "", None, None, None)], DOCS)
    nodes = jaccard_join.nodes_of(docs, jaccard_join.rarity(docs, 5), jaccard_join.Similarity())
    sizes = {r["doc_id"]: len(r["keys"]) if r["keys"] else None for r in nodes.collect()}
    assert sizes == {1: 6 * (26 - 20 + 1), 2: 6 * (27 - 21 + 1), 3: None}
    assert {r["n"] for r in jaccard_join.shards_of(nodes, 75).collect()} == {26, 27}
