"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks of text at block-level tags. Each block has its number of words
and its share of linked words, those of its neighbours, and the kind of region it stands in
(inside an article, inside a menu, footer, advert and so on, or neither). A decision tree
trained on the small labelled table below says which blocks are main text.

The tree is fitted by Spark ML on the driver (the table has a few dozen rows); its nodes,
a handful of numbers, travel with the tasks, which read each page once.

Defined results for odd input: NULL and empty html give an empty text; broken, cut-off and
unclosed markup is read as far as it goes; a page of any length is read whole; repeated and
NULL page_ids are rows of their own; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: comments, declarations, tags with quoted attributes; a `<` that starts none of them is text
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HINT_WORDS = re.compile(r"[a-z]+")
#: elements whose content is no text of the page
HIDDEN = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "select", "textarea", "title",
          "canvas", "audio", "video", "button", "datalist")
#: tags that end a block; br and the inline tags do not
BLOCK = frozenset(
    "address article aside blockquote body caption center col dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "p pre section summary table tbody td tfoot th thead tr ul".split())
SPACING = frozenset(("br", "wbr", "img", "input", "td", "th"))
#: tags that are kept on the stack of regions
REGIONS = frozenset(
    "article aside blockquote details dialog div fieldset figure footer form header main menu nav section table "
    "ul ol dl".split())
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog"))
MAIN_HINTS = frozenset(("article", "content", "main", "post", "story", "entry"))
OTHER_HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "pagination popup promo promotion related reply replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split())
NONE, MAIN, OTHER = 0, 1, 2

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_other")
#: labelled blocks: the features above, then 1 for main text
LABELLED = (
    (120, .00, 60, .00, 80, .00, 1, 0, 1), (45, .00, 9, .00, 110, .00, 1, 0, 1), (8, .00, 2, 1.0, 90, .00, 1, 0, 1),
    (3, .00, 80, .00, 40, .00, 1, 0, 1), (1, .00, 30, .00, 25, .00, 1, 0, 1), (1, .00, 12, .00, 14, .00, 1, 0, 1),
    (60, .10, 45, .00, 30, .05, 1, 0, 1), (20, .30, 70, .00, 65, .00, 1, 0, 1), (12, .60, 40, .00, 55, .00, 1, 0, 1),
    (5, 1.0, 50, .00, 48, .00, 1, 0, 1), (2, .00, 4, .00, 3, .00, 1, 0, 1), (15, .00, 0, .00, 20, .00, 1, 0, 1),
    (25, .00, 30, .00, 0, .00, 1, 0, 1), (200, .02, 150, .00, 180, .01, 1, 0, 1), (6, .00, 1, 1.0, 7, .00, 1, 0, 1),
    (1, 1.0, 0, .00, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 8, .00, 0, 1, 0),
    (8, .00, 1, 1.0, 9, .00, 0, 1, 0), (14, .00, 80, .00, 0, .00, 0, 1, 0), (30, .00, 120, .00, 0, .00, 0, 1, 0),
    (25, .00, 40, .00, 35, .00, 0, 1, 0), (60, .00, 55, .00, 70, .00, 0, 1, 0), (3, .00, 60, .00, 45, .00, 0, 1, 0),
    (5, .40, 90, .00, 2, 1.0, 0, 1, 0), (40, .00, 3, 1.0, 35, .00, 0, 1, 0), (12, .50, 0, .00, 6, 1.0, 0, 1, 0),
    (110, .00, 90, .00, 60, .00, 0, 1, 0), (2, .00, 1, .00, 2, .00, 0, 1, 0), (18, .20, 100, .00, 22, .10, 0, 1, 0),
    (1, 1.0, 0, .00, 2, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0), (6, .80, 1, 1.0, 2, 1.0, 0, 0, 0),
    (12, .90, 3, 1.0, 5, .70, 0, 0, 0), (4, .00, 1, 1.0, 3, 1.0, 0, 0, 0), (2, .00, 0, .00, 3, 1.0, 0, 0, 0),
    (5, .00, 4, .50, 2, 1.0, 0, 0, 0), (20, .70, 10, .60, 15, .80, 0, 0, 0), (7, .00, 3, .00, 1, 1.0, 0, 0, 0),
    (90, .00, 60, .00, 75, .00, 0, 0, 1), (40, .00, 8, .00, 60, .00, 0, 0, 1), (150, .05, 2, 1.0, 90, .00, 0, 0, 1),
    (30, .00, 45, .00, 5, .00, 0, 0, 1), (22, .10, 30, .00, 28, .00, 0, 0, 1), (16, .00, 40, .00, 50, .00, 0, 0, 1),
    (70, .15, 3, .00, 1, 1.0, 0, 0, 1), (25, .00, 0, .00, 40, .00, 0, 0, 1), (18, .20, 55, .00, 33, .00, 0, 0, 1),
)


def train_tree(spark: SparkSession, labelled: tuple = LABELLED, depth: int = 5, seed: int = 1) -> list[tuple]:
    """Fit the tree; its nodes as (feature, threshold, left, right), leaves as (-1, class, 0, 0)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [tuple(map(float, r)) for r in labelled]
    table = spark.createDataFrame(rows, [*FEATURES, "label"]).coalesce(1)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    model = DecisionTreeClassifier(maxDepth=depth, seed=seed).fit(data.select("features", "label"))
    nodes: list[tuple] = []

    def walk(node) -> int:
        at = len(nodes)
        nodes.append(())
        if node.subtreeDepth() == 0:
            nodes[at] = (-1, node.prediction(), 0, 0)
        else:
            split = node.split()
            left, right = walk(node.leftChild()), walk(node.rightChild())
            nodes[at] = (split.featureIndex(), split.threshold(), left, right)
        return at

    walk(model._java_obj.rootNode())
    return nodes


def decide(nodes: list[tuple], features: tuple) -> bool:
    at = 0
    while nodes[at][0] >= 0:
        feature, threshold, left, right = nodes[at]
        at = left if features[feature] <= threshold else right
    return nodes[at][1] > 0.5


def region_of(tag: str, attributes: str) -> int:
    """What an element says about the text inside: main text, something else, or nothing."""
    if tag in OTHER_TAGS:
        return OTHER
    if tag in MAIN_TAGS:
        kind = MAIN
    else:
        kind = OTHER if tag == "header" else NONE
    if attributes:
        hints: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            hints.update(HINT_WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
        if hints & OTHER_HINTS:
            return OTHER if not hints & MAIN_HINTS or kind != MAIN else MAIN
        if hints & MAIN_HINTS:
            return MAIN
    return kind


def blocks_of(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, share of linked words, region) of every block of a page, in order."""
    found: list[tuple[str, int, float, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    in_link, at, size = False, 0, len(page)

    def flush() -> None:
        nonlocal in_link
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                links = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                found.append((" ".join(words), len(words), min(1.0, links / len(words)), stack[-1][1] if stack else NONE))
            parts.clear()
            linked.clear()

    while at < size:
        m = MARKUP.search(page, at)
        text = page[at: m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if in_link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in HIDDEN and not m[1]:
            if tag in ("script", "style", "title", "textarea") or not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|</{tag}\Z", re.I).search(page, at)
                at = end.end() if end else size
            parts.append(" ")
            continue
        if tag == "a":
            in_link = not m[1]
        elif tag in SPACING:
            parts.append(" ")
        if tag in BLOCK:
            flush()
            in_link = False
            if tag in REGIONS:
                if not m[1]:
                    inherited = stack[-1][1] if stack else NONE
                    kind = region_of(tag, m[3])
                    if tag == "header" and inherited == MAIN and kind == OTHER and not m[3].strip():
                        kind = MAIN  # the heading of an article
                    if not m[3].endswith("/"):
                        stack.append((tag, kind or inherited))
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
    flush()
    return found


def main_text(page: str | None, nodes: list[tuple]) -> str:
    blocks = blocks_of(page or "")
    kept = []
    for k, (text, words, links, region) in enumerate(blocks):
        before = blocks[k - 1] if k else ("", 0, 0.0, NONE)
        after = blocks[k + 1] if k + 1 < len(blocks) else ("", 0, 0.0, NONE)
        if decide(nodes, (words, links, before[1], before[2], after[1], after[2], region == MAIN, region == OTHER)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, nodes: list[tuple]) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), nodes) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")
