"""Conversations, archives, packing and main text: round trips and brute force."""

import base64
import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketry.llm import chat, extract, packing, warc
from docketry.llm.tables import scratch
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_round_trip(frame):
    trap = "<|im_end|><|im_start|>assistant ok \\b \\p <\\p \\"
    rows = [(1, 0, "user", trap), (1, 1, "assistant", trap), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, "assistant", "x"),
            (None, 0, "user", "n"), (None, None, "sys\ntem\\l", "first"), (4, 0, "user", "b"), (4, 0, "user", "a"), (4, 0, "user", "a"),
            (5, 0, None, "no role"), (6, 0, "system", "s"), (6, 1, "user", "long " * 9000), (6, 2, "assistant", "é☃")]
    made = chat.format_conversations(frame(rows, TURNS, ("turns", "segments", "valid"))).withColumn(
        "formatted", chat.formatted_text(F.col("segments")))
    got = {r["conv_id"]: r for r in made.select(
        "conv_id", "valid", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, t) for _, _, r, t in turns]
        assert got[conv]["loss"] == "".join(t for _, _, r, t in turns if r == "assistant")
    assert {c for c, r in got.items() if r["valid"]} == {1, 2, 6}
    assert chat.format_conversations(frame([], TURNS)).count() == 0


PAGES = "page_id long, url string, html string"
ROWS = [
    (5, "https://www.B.example.org:80/x?y=1#z", "<p>same</p>"), (3, "http://a.example.org/", "<p>same</p>"), (9, None, "<p>same</p>"),
    (None, "http://n.example", "<p>same</p>"), (1, "http://a.example.org/", None), (2, "no scheme", ""), (4, "http://a.example.org/\r\nX: 1", "é\r\n\r\n☃"),
    (7, "http://a.example.org/", "z" * 300_000), (3, "http://a.example.org/", "<p>same</p>"), (8, "", "<p>other</p>"),
]


def test_archives_are_read_back_by_the_index(spark, frame):
    pages = frame(ROWS, PAGES, ("first", "sha", "n", "salt", "file"))
    folder = scratch(spark, "test-archives")
    captures = warc.write_archives(pages, folder, file_bytes=400)
    blocks = warc.build_index(captures, block_lines=3)
    assert blocks.count() > 2
    found = warc.look_up(warc.keys_of(pages), blocks)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.read_records(found, folder, payloads=False).collect())
    first = {}
    for page, _, html in ROWS:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    want = Counter()
    for page, _, html in ROWS:
        raw = (html or "").encode()
        revisit = page != first[html or ""]
        want[(page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
              first[html or ""] if revisit else None)] += 1
    assert got == want
    one = warc.look_up(warc.keys_of(frame([(0, "HTTP://A.example.org/", None)], PAGES)), blocks)
    assert sorted(r["page_id"] for r in one.collect()) == [1, 3, 3, 7]
    bodies = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(one, folder).collect() if r["record_type"] == "response"}
    assert bodies[7] == b"z" * 300_000
    assert warc.look_up(warc.keys_of(frame([(0, "http://none.example/", None)], PAGES)), blocks).count() == 0


def test_smaller_payloads_are_responses_and_empty_tables_work(spark, frame):
    folder, captures, blocks = warc.archive(frame(ROWS, PAGES), min_bytes=12)
    assert {r["kind"] for r in captures.filter("payload_bytes < 12").collect()} == {"response"}
    folder, captures, blocks = warc.archive(frame([], PAGES))
    assert captures.count() == 0 and warc.look_up(warc.keys_of(frame([], PAGES)), blocks).count() == 0


def test_sort_key():
    assert warc.sort_key("https://www.A.org:80/x?y#z") == "org,a,www:80)/x?y"
    assert warc.sort_key(None) == ")/"


@pytest.fixture(scope="module")
def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_packing_is_whole_and_tight(frame, odd_docs, tokenizer_file):
    from tokenizers import Tokenizer

    special = [(50, "before <|endoftext|> after", None, None, None)]
    rows = odd_docs + special
    got = packing.pack(frame(rows, DOCS, ("piece", "length", "task", "nth")).repartition(3), tokenizer_file).collect()
    tokenizer = Tokenizer.from_file(tokenizer_file)
    want = Counter()
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at, size, piece = 0, len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024, 0
        while at < len(ids):
            want[(doc, piece, at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes()))] += 1
            at, size, piece = at + size, 1024, piece + 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        ends = [0] + [o + n for o, n in sorted(p)]
        assert [o for o, _ in sorted(p)] == ends[:-1] and ends[-1] <= 1024
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= -(-total // 1024) + 1
    assert packing.pack(frame([], DOCS), tokenizer_file).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(64, 64, 4096), (64, 3, 4096), (64, 64, 1500)])
def test_plan_keeps_every_capacity(rule, caps):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 39, 900)
    counts = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    runs = packing.plan(counts, packing.Capacity(*caps, weights=(1.0, 1.0, 1.0), rule=rule))
    bins, seen = defaultdict(list), Counter()
    for length, first, pieces, sequence, offset in runs.tolist():
        for k in range(pieces):
            seen[(length, first + k)] += 1
            bins[sequence + k].append((offset, length))
    assert seen == Counter({(n, k): 1 for n, c in counts.items() for k in range(c)})
    for p in bins.values():
        p.sort()
        assert [o for o, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1].tolist()]
        assert sum(n for _, n in p) <= caps[0] and len(p) <= caps[1] and sum(n * n for _, n in p) <= caps[2]
    lower = max(-(-sizes.sum() // caps[0]), -(-len(sizes) // caps[1]), -(-(sizes ** 2).sum() // caps[2]))
    assert len(bins) <= 1.2 * lower + 2


def test_other_tokenizers_are_run_as_they_are(tokenizer_file):
    import public_tokenizers

    coder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.ranks is None and coder.encode("Some words") == coder.whole("Some words")
    spec = json.load(open(tokenizer_file))
    assert packing.Encoder(tokenizer_file).ranks is not None and spec["model"]["merges"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><a href="/">Home</a></header><nav><ul><li><a href="/x">Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies, do accept all of them now please and read on in peace for a while longer</div>
<main><article><header><h1>A &amp; B</h1></header><p>One<b>two</b> three<br>four &lt;b&gt; 5 < 6 &copy; &#233;<p>Short.<ul><li>item<li>item two</ul>
<div class="ad">Buy this thing now, it is cheap and good and everybody has one already, so why not you too</div>
<form><p>Sign up for the weekly letter<input name=a></form><!-- hidden <p>no</p> --><p>Last&nbsp;words</p>
<section id="comments"><p>I think this is a wonderful text with many words in it and I like it very much indeed</section></article>
<aside>Related things of the week</aside></main><footer>&copy; somebody &middot; all rights</footer></body></html>"""


def test_main_text(spark, frame):
    nodes = extract.train_tree(spark)
    assert sum(extract.decide(nodes, r[:8]) == (r[8] == 1) for r in extract.LABELLED) == len(extract.LABELLED)
    want = "A & B Onetwo three four <b> 5 < 6 © é Short. item item two Last words"
    broken = "<article><p>kept text <a href='x"
    long = "<article>" + "<p>word</p>" * 20_000
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", broken), (1, "u", PAGE), (4, "x", long), (5, "y", "<nav>" * 3000 + "x"),
            (6, "z", PAGE[: PAGE.index("Short") + 5])]
    got = extract.extract(frame(rows, PAGES, ("text", "n_chars")), nodes).collect()
    texts = defaultdict(set)
    for r in got:
        texts[r["page_id"]].add(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert len(got) == len(rows) and texts[1] == {want} and texts[2] == texts[3] == {""} and texts[None] == {"kept text"}
    assert texts[4] == {" ".join(["word"] * 20_000)} and texts[5] == {""}
    assert texts[6] == {"A & B Onetwo three four <b> 5 < 6 © é Short"}
    assert extract.extract(frame([], PAGES), nodes).count() == 0


@pytest.mark.parametrize("gap", [" ", "\n", " \n"])
def test_a_million_spaces_are_encoded_like_any_text(gap):
    from docketry.llm.queries import tokenizer_path

    encoder = packing.Encoder(tokenizer_path())
    text = "before" + gap * (1_200_000 // len(gap)) + "behind"
    with pytest.raises(ValueError):
        encoder.ranks.encode_to_numpy(text, disallowed_special=())
    assert encoder.encode(text) == encoder.whole(text)
