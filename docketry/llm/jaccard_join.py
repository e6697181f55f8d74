"""All documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

The candidate search is an R-tree over count vectors (see `rtree`), sharded so that no shard
is compared with another. The steps, each a table:

1. A sketch of fixed size counts the shingles of all documents, so that every set can be put
   in one global order, rare shingles first.
2. Each set gets a 64-bit signature; equal sets are one node from here on, however many copies
   there are. Two sets that are similar enough must share one of the first
   n - ceil(t*n) + 1 shingles in that order: those are the shards a node stands in. Shards with
   the same members are one; a shard is cut where sizes jump by more than the threshold allows.
3. Stars: in each shard one member, the pivot, is held against the others. Pairs that the count
   vectors do not rule out are verified on the sets; links give first components. The next
   rounds take other pivots in the shards that still have several components.
4. Tree: shards whose members are still in different components are searched with the R-tree
   for pairs between components; survivors are verified. Members already connected are not
   compared again, so a shard of copies stays linear, and no link between components is missed.
5. Components of all links; each document gets the smallest doc_id of its component.

A shard with more members than SHARD_ROWS is split into blocks, and each pair of blocks is a
task's work of its own. Links, sets and components never go to the driver.

Shingles are 64-bit hashes, and sets are compared by the upper 48 bits of them: two texts of a
thousand words share a hash by chance once in 10**8 pairs.

Defined results for odd input: a text without words is an empty set, linked with nothing, its
component is its own doc_id; fewer words than a shingle are one shingle; repeated rows and
equal texts are linked; a NULL doc_id takes part but never names a component, unless it is
all there is; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import rtree
from docketry.llm.components import components
from docketry.llm.tables import at_most, settle
from docketry.llm.textbytes import NOT_SPACE, U64, Words, mixed, slices

SKETCH_BITS = 20
CHUNK = 4096
GROUPS = 512
#: rounds of pivots before the tree; a work setting, results do not depend on it
ROUNDS = 4
SHARD_ROWS = 2048
#: nodes whose keys are listed in one batch
OPENED = 256
#: a table of so many ids at most (16 bytes a row) is broadcast; a larger one is joined by shuffle
CARRIED_NODES = 1_000_000


@dataclass(frozen=True)
class Similarity:
    shingle: int = 5
    percent: int = 75


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, NOT_SPACE)
    hashes = words.hashes()
    starts, values = words.shingles(hashes, size)
    bounds = np.searchsorted(starts, words.first)
    out = []
    for k in range(len(texts)):
        n = int(words.first[k + 1] - words.first[k])
        if n >= size:
            out.append(np.unique(values[bounds[k]: bounds[k + 1]]))
        elif n:
            out.append(words_as_one(hashes[words.first[k]: words.first[k + 1]]))
        else:
            out.append(values[:0])
    return out


def words_as_one(hashes: np.ndarray) -> np.ndarray:
    value = U64(len(hashes))
    for h in hashes:
        value = mixed(np.array([value ^ h], U64))[0]
    return np.array([value], U64)


def signature(values: np.ndarray) -> int:
    """A 64-bit name of a set, never 0 for a set that is not empty."""
    if not len(values):
        return 0
    with np.errstate(over="ignore"):
        a = mixed(values ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
        b = mixed(values + U64(0x1234567)).sum(dtype=U64)
        return int(mixed(np.array([a ^ mixed(np.array([b + U64(len(values))], U64))[0]], U64)).view(np.int64)[0]) or 1


def bucket(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SKETCH_BITS)).astype(np.int64)


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each bucket occur over all documents; an array of fixed size.

    Tasks add up their own counts (kept below 65536 each, which leaves the order the same for
    everyone); the sums are added chunk by chunk, in groups of at most 256 tasks at a time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                words = Words(texts, NOT_SPACE)
                _, values = words.shingles(words.hashes(), size)
                np.add.at(total, bucket(values), 1) if len(values) < 1000 else np.add(
                    total, np.bincount(bucket(values), minlength=len(total)), out=total)
        small = np.minimum(total, 65535).astype("<u2")
        n = len(small) // CHUNK
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n), pa.int32()), pa.array([TaskContext.get().partitionId()] * n, pa.int32()),
             pa.array([small[k * CHUNK: (k + 1) * CHUNK].tobytes() for k in range(n)], pa.binary())],
            names=["chunk", "task", "counts"])

    def add(kind: str):
        def of(table: pa.Table) -> pa.Table:
            total = np.zeros(CHUNK, "<i8")
            for raw in table.column("counts"):
                total += np.frombuffer(raw.as_py(), kind)
            return pa.table({"chunk": table.column("chunk")[:1], "task": table.column("task")[:1],
                             "counts": pa.array([total.tobytes()], pa.binary())})
        return of

    shape = "chunk int, task int, counts binary"
    parts = docs.select("text").mapInArrow(count, shape).withColumn("task", (F.col("task") / 256).cast("int"))
    some = parts.groupBy("chunk", "task").applyInArrow(add("<u2"), shape)
    rows = some.groupBy("chunk").applyInArrow(add("<i8"), shape).collect()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        out[r["chunk"] * CHUNK: (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<i8")
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


def nodes_of(docs: DataFrame, order: np.ndarray, like: Similarity) -> DataFrame:
    """doc_id, text_id, n, node of every document, and once per node and task the shards it stands in.

    text_id is a hash of the text; with the doc_id it says which row is meant.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, nodes, keys = [], [], []
            for _, texts in slices(batch.column(2)):
                for values in sets_of(texts, like.shingle):
                    node = signature(values)
                    n.append(len(values))
                    nodes.append(node)
                    if not node or node in seen:
                        keys.append(None)
                        continue
                    if len(seen) < 1_000_000:
                        seen.add(node)
                    first = len(values) + like.percent * len(values) // -100 + 1
                    rare = np.lexsort((values, order[bucket(values)]))[:first]
                    keys.append(as_bytes(values[rare]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(keys, pa.binary())], names=["doc_id", "text_id", "n", "node", "keys"])

    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), "text").mapInArrow(
        make, "doc_id long, text_id long, n long, node long, keys binary")


def shards_of(nodes: DataFrame, percent: int) -> DataFrame:
    """shard, node, n: members of every shard with two members or more; shards with equal members once."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, OPENED):
                part = batch.slice(k, OPENED)
                raw = part.column(0).to_pylist()
                own = np.repeat(np.arange(len(raw)), [len(r) // 6 for r in raw])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(from_bytes(b"".join(raw)).view(np.int64)), part.column(1).take(pa.array(own)),
                     part.column(2).take(pa.array(own))], names=["key", "n", "node"])

    rows = nodes.filter("keys is not null").select("keys", "n", "node").mapInArrow(
        opened, "key long, n long, node long").repartition("key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if last:
                yield members(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield members(*held)

    def members(key: np.ndarray, n: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(key), bool)  # a node comes once per task that saw it
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, n, node = key[new], n[new], node[new]
        starts = np.ones(len(key), bool)
        starts[1:] = (key[1:] != key[:-1]) | (percent * n[1:] > 100 * n[:-1])
        run = np.cumsum(starts) - 1
        sizes = np.bincount(run)
        with np.errstate(over="ignore"):
            name = mixed(np.add.reduceat(mixed(node.view(U64)), np.flatnonzero(starts)) + sizes.astype(U64))
        many = np.flatnonzero(sizes > 1)
        _, once = np.unique(name[many], return_index=True)
        wanted = np.zeros(len(sizes), bool)
        wanted[many[once]] = True
        keep = wanted[run]
        return pa.RecordBatch.from_arrays(
            [pa.array(name[run[keep]].view(np.int64)), pa.array(node[keep]), pa.array(n[keep])], names=["shard", "node", "n"])

    return rows.sortWithinPartitions("key", "n", "node").select("key", "n", "node").mapInArrow(
        cut, "shard long, node long, n long").dropDuplicates(["shard", "node"])


def vector(values: np.ndarray) -> bytes:
    """Counts of a set's shingles per group, cut at 255, and its size."""
    counts = np.bincount((mixed(values) & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + len(values).to_bytes(8, "little")


def read_vectors(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts per group and sizes."""
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS + 8)
    return rows[:, :GROUPS], np.ascontiguousarray(rows[:, GROUPS:]).view("<i8").ravel()


def as_bytes(values: np.ndarray) -> bytes:
    """The upper 48 bits of each value, in order."""
    return values.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(U64).ravel()


def sets_table(docs: DataFrame, wanted: DataFrame, like: Similarity) -> DataFrame:
    """node, vector, tokens of the documents named by `wanted` (doc_id, text_id).

    Repeated rows of one document may come twice. That does no harm: it repeats pairs, and
    links are a set.
    """
    named = wanted.select(F.col("doc_id").alias("of"), F.col("text_id").alias("of_text"))
    if at_most(named, CARRIED_NODES):
        named = F.broadcast(named)
    chosen = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id")).join(
        named, (F.col("text_id") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [values for _, texts in slices(batch.column(0)) for values in sets_of(texts, like.shingle)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([signature(v) for v in sets], pa.int64()), pa.array([vector(v) for v in sets], pa.binary()),
                 pa.array([as_bytes(v) for v in sets], pa.binary())], names=["node", "vector", "tokens"])

    return chosen.select("text").mapInArrow(make, "node long, vector binary, tokens binary")


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sizes and count vectors do not rule out."""
    side = sets.select("node", "vector")
    both = pairs.join(side.select(F.col("node").alias("u"), F.col("vector").alias("a")), "u").join(
        side.select(F.col("node").alias("v"), F.col("vector").alias("b")), "v")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, n), (b, m) = (read_vectors(batch.column(c).to_pylist()) for c in (2, 3))
            over = [x - y.sum(axis=1, dtype=np.int64) for x, y in ((n, a), (m, b))]
            keep = np.minimum(a, b).sum(axis=1, dtype=np.int64) + np.minimum(*over) >= rtree.needed(n, m, percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "a", "b").mapInArrow(bound, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int = 2000) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough.

    The set of u stands in front of the sets of its partners, in parts of about `per_task`
    partners, so a node with very many partners is many tasks' work.
    """
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / per_task).alias("parts"))
    spread = pairs.join(parts, "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    mentioned = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if at_most(mentioned, CARRIED_NODES):
        mentioned = F.broadcast(mentioned)
    tokens = sets.select("node", "tokens").join(mentioned, "node", "left_semi")
    partners = spread.select("u", "part", "v").join(tokens.withColumnRenamed("node", "v"), "v")
    heads = parts.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(
        tokens.withColumnRenamed("node", "u"), "u").withColumn("v", F.lit(None).cast("long"))
    shape = ["u", "part", "v", "tokens"]
    rows = heads.select(*shape).unionByName(partners.select(*shape)).repartition("u", "part").sortWithinPartitions(
        "u", "part", F.col("v").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U64)
        for batch in batches:
            us, vs = [], []
            for u, v, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                values = from_bytes(raw.as_py())
                if v is None:
                    own = values
                    continue
                both = np.concatenate([own, values])
                both.sort(kind="stable")  # two sorted halves
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return rows.mapInArrow(compare, "u long, v long")


def star_pairs(shards: DataFrame, labels: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs (u, v) of a pivot per shard with the members of other components.

    The first pivot is the smallest member; later ones go by a hash of node and turn, which
    tends to take the same node in all shards where it stands.
    """
    label = F.col("node") if labels is None else F.coalesce("component", "node")
    named = (shards if labels is None else shards.join(labels, "node", "left")).select("shard", "node", "n", label.alias("label"))
    first = F.struct("n", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
    pivots = named.groupBy("shard").agg(
        F.min_by(F.struct("node", "n", "label"), first).alias("p"), F.min("label").alias("low"),
        F.max("label").alias("high")).filter("low <> high").select("shard", "p")
    return named.join(pivots, "shard").filter(
        (F.col("p.label") != F.col("label")) & (100 * F.least("p.n", "n") >= percent * F.greatest("p.n", "n"))).select(
        F.col("p.node").alias("u"), F.col("node").alias("v")).distinct()


def tree_pairs(shards: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs (u, v) of different components that the R-trees of their shards let through."""
    named = shards.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    mixed_ = named.groupBy("shard").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("rows")).filter(
        "low <> high and rows > 2").select("shard", F.ceil(F.col("rows") / shard_rows).alias("blocks"))
    rows = named.join(mixed_, "shard").join(sets.select("node", "vector"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    # every block meets every block once: (i, j) with i <= j; a member of block b stands in all of b's pairs
    placed = rows.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label",
        "n", "vector").repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, found, size = None, [], 0

        def once() -> pa.RecordBatch:  # a pair may meet in many shards
            u, v = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, a])
                if held and key != now:
                    for pairs_ in joined(pa.Table.from_batches(held)):
                        found.append(pairs_)
                        size += pairs_.shape[1]
                        if size > 500_000:
                            yield once()
                            found, size = [], 0
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            found.extend(joined(pa.Table.from_batches(held)))
        yield once()

    def joined(rows_: pa.Table) -> Iterator[np.ndarray]:
        i, j = rows_.column("i")[0].as_py(), rows_.column("j")[0].as_py()
        node, label, n, own = (rows_.column(c).to_numpy() for c in ("node", "label", "n", "block"))
        points, _ = read_vectors(rows_.column("vector").to_pylist())
        for a, b in rtree.pairs(points, n, label, percent, None if i == j else own == i):
            yield np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])])

    return placed.mapInArrow(search, "u long, v long").distinct()


def as_links(labels: DataFrame) -> DataFrame:
    """Components found so far, as links: they stand for all links that led to them."""
    return labels.select(F.col("node").alias("u"), F.col("component").alias("v"))


def classes(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """doc_id, text_id, n_shingles, component of every document; linked documents share a component."""
    nodes = settle(nodes_of(docs, rarity(docs, like.shingle), like))
    shards = settle(shards_of(nodes, like.percent))
    one = F.min(F.struct("doc_id", "text_id")).alias("one")
    involved = settle(nodes.join(shards.select("node").distinct(), "node", "left_semi").groupBy("node").agg(one).select("one.*"))
    sets = settle(sets_table(docs, involved, like))
    labels = None
    for turn in range(ROUNDS):
        stars = star_pairs(shards, labels, turn, like.percent)
        found = settle(verified(settle(may_link(stars, sets, like.percent)), sets, like.percent))
        if labels is not None and not found.limit(1).count():
            break
        labels = components(found if labels is None else found.unionByName(as_links(labels)))
    more = settle(verified(settle(tree_pairs(shards, labels, sets, like.percent)), sets, like.percent))
    final = components(more.unionByName(as_links(labels))) if more.limit(1).count() else labels
    return nodes.join(final, "node", "left").select(
        "doc_id", "text_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


def join(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (component_id: smallest doc_id linked with it)."""
    members = classes(docs, like)
    smallest = members.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(smallest, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """The rows of docs, with all columns, that stay: of each group of linked documents the smallest doc_id.

    Texts without words all stay, but rows with the same doc_id and text are one document.
    A NULL doc_id stays only where its group has no other.
    """
    members = classes(docs, like)
    empty = F.col("n_shingles") == 0
    group = F.struct(empty.alias("empty"), F.when(empty, F.col("text_id")).otherwise(F.col("component")).alias("name"),
                     F.when(empty, F.col("doc_id")).alias("of"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_id")
    stay = settle(members.groupBy(group.alias("g")).agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("of"), F.col("first.text_id").alias("of_text")))
    if at_most(stay, CARRIED_NODES):
        stay = F.broadcast(stay)
    given = docs.select(
        F.struct("*").alias("given"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    kept = given.join(stay, (F.col("text_id") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    # texts are only moved to drop repeated rows if there are any
    repeated = members.groupBy("doc_id", "text_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    if repeated.limit(1).count():
        kept = kept.dropDuplicates(["text_id", "doc_id"])
    return kept.select("given.*")
