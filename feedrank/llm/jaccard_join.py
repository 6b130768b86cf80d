"""N-gram Jaccard join over a MinHash LSH forest.

Texts with the same set of word shingles are one node. A node's signature is a
row of minima; each tree of the forest has its own eight of them, and the nodes
sorted by these labels are the tree's prefix trie: nodes below one trie node share
a prefix. Matches start at whole paths. Prefixes are then shortened label by label,
but only under trie nodes whose members are not connected yet; a trie node that
is one group is closed, and nothing below it is compared again. Shortening goes
on until the prefix is so short that a pair at the threshold meets in some tree as
often as the target recall asks. In an open trie node, signatures of different
groups are compared, and pairs that may be similar connect candidate groups. Inside
those, shingle sets are compared exactly: every link counts, and links join classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C
from . import hashing as H
from .arrow import groups, list_array, slices
from .components import components

SHINGLE = 5
THRESHOLD = (4, 5)  # Jaccard 0.8, in whole numbers
TREES = 24
DEPTH = 8
RECALL = 0.9999
#: Pairs with fewer equal labels are not compared exactly: at 0.8, more than five standard deviations.
LEAST_ESTIMATE = 0.64
BUCKET_BLOCK = 1024
EXACT_BLOCK = 256
_RNG = np.random.default_rng(104_729)
_XOR = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The length at which shortening ends: a pair at the threshold meets in some tree as often as asked."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, firsts = H.words(texts)
    return [np.unique(H.word_runs(hashes[a:b], size)) for a, b in zip(firsts[:-1], firsts[1:])]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each seeded permutation over the set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_XOR), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        part = (low[start : start + 2048] ^ _XOR[:, None]) * _TIMES[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sketch(batches, prefix: int):
    weights = H._WEIGHTS[:prefix]
    trees = np.arange(TREES, dtype=np.uint64)
    for batch, texts in slices(batches, "text"):
        high, low, sizes, labels, keys = [], [], [], [], []
        for own in shingle_sets(texts):
            mixed = H.mix(own * H._WEIGHTS[0])
            high.append(np.bitwise_xor.reduce(mixed) if len(own) else np.uint64(0))
            low.append(mixed.sum(dtype=np.uint64) if len(own) else np.uint64(0))
            sizes.append(len(own))
            minima = signature(own)
            labels.append(minima.astype(np.uint8).tobytes() if len(own) else b"")
            tree = minima.reshape(TREES, DEPTH)[:, :prefix].astype(np.uint64)
            keys.append(H.mix((tree * weights).sum(axis=1, dtype=np.uint64) + trees).astype(np.int64) if len(own) else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(np.array(high, np.uint64).astype(np.int64)),
                pa.array(np.array(low, np.uint64).astype(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(labels, pa.binary()),
                list_array(keys, pa.int64()),
                batch.column(2),
            ],
            ["doc_id", "high", "low", "size", "labels", "keys", "check"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the shingle set's 128-bit fingerprint (high, low) and size, labels, a bucket key per tree, a text hash."""
    prefix = prefix_depth(THRESHOLD[0] / THRESHOLD[1])
    return docs.select("doc_id", "text", C.text_check()).mapInArrow(
        lambda batches: _sketch(batches, prefix),
        "doc_id long, high long, low long, size long, labels binary, keys array<long>, check long",
    )


def _blocks(members: DataFrame, group: str, count: str, node: str, block: int) -> DataFrame:
    """Rows of a group meet in pairs of blocks (part_a <= part_b) of about ``block`` rows each.

    The number of partitions is stated, so that they are not packed by their bytes, which
    do not tell the cost of comparing.
    """
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.ceil(F.col(count) / block).cast("int")
    own = F.pmod(F.xxhash64(node), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    return (
        members.withColumn("_own", own)
        .withColumn("_other", other)
        .withColumn("part_a", F.least("_own", "_other"))
        .withColumn("part_b", F.greatest("_own", "_other"))
        .drop("_other", count)
        .repartition(tasks, group, "part_a", "part_b")
        .sortWithinPartitions(group, "part_a", "part_b", node)
    )


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
    return root


def _near(batches):
    """Edges between groups (roots) of a trie node, where signatures are close enough; what is connected is not compared."""
    for rows in groups(batches, ["cell", "part_a", "part_b"]):
        roots, group = np.unique(rows.column("root").to_numpy(), return_inverse=True)
        if len(roots) == 1:
            continue
        labels = np.frombuffer(b"".join(rows.column("labels").to_pylist()), np.uint8).reshape(len(group), -1)
        own, cross = rows.column("_own").to_numpy(), rows.column("part_a")[0].as_py() != rows.column("part_b")[0].as_py()
        least = int(LEAST_ESTIMATE * labels.shape[1])
        root = np.arange(len(roots))  # what each group has been joined to here
        for i in range(len(group) - 1):
            other = root[group[i + 1 :]] != root[group[i]]
            if cross:
                other &= own[i + 1 :] != own[i]
            later = np.flatnonzero(other) + i + 1
            close = later[(labels[later] == labels[i]).sum(axis=1) >= least]
            if len(close):
                joined = np.unique(root[group[np.append(close, i)]])
                root[np.isin(root, joined)] = joined[0]  # the least, since roots are sorted
                if not root.any():
                    break
        moved = np.flatnonzero(root != np.arange(len(roots)))
        yield pa.RecordBatch.from_arrays([pa.array(roots[moved]), pa.array(roots[root[moved]])], ["a", "b"])


def _linked(sets: list[np.ndarray], own: np.ndarray, cross: bool) -> np.ndarray:
    """Index pairs (i < j) whose Jaccard similarity reaches the threshold, exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    codes = np.concatenate(sets)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    count = np.diff(np.append(edge, len(codes)))
    both = np.zeros((n, n), np.int64)
    shared = np.repeat(count > 1, count)
    columns = np.repeat(np.cumsum(count > 1) - 1, count)[shared]
    rows = owner[shared]
    step = max(1, (8 << 20) // n)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, step):
        a, b = np.searchsorted(columns, [start, start + step])
        dense = np.zeros((n, step), np.float32)
        dense[rows[a:b], columns[a:b] - start] = 1
        both += np.rint(dense @ dense.T).astype(np.int64)
    up, down = THRESHOLD
    linked = np.triu(down * both >= up * (sizes[:, None] + sizes[None, :] - both), 1)
    if cross:
        linked &= own[:, None] != own[None, :]
    return np.argwhere(linked)


def _exact(batches):
    """For each node of a candidate group: its links here, and the least node that they lead to."""
    for rows in groups(batches, ["root", "part_a", "part_b"]):
        nodes, own = rows.column("node").to_numpy(), rows.column("_own").to_numpy()
        cross = rows.column("part_a")[0].as_py() != rows.column("part_b")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
        pairs = _linked(sets, own, cross)
        links = np.bincount(pairs.ravel(), minlength=len(nodes))
        root = _roots(len(nodes), pairs)
        kept = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[kept]), pa.array(links[kept]), pa.array(nodes[root[kept]])], ["node", "links", "to"]
        )


def _shingles(batches):
    for batch, texts in slices(batches, "text"):
        sets = shingle_sets(texts)
        mixed = [H.mix(s * H._WEIGHTS[0]) for s in sets]
        high = np.array([np.bitwise_xor.reduce(m) if len(m) else 0 for m in mixed], np.uint64).astype(np.int64)
        right = np.flatnonzero(high == np.asarray(batch.column(batch.schema.get_field_index("high"))))
        kept = batch.take(pa.array(right)).select(["root", "count", "node"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array([sets[i].tobytes() for i in right], pa.binary())],
            ["root", "count", "node", "shingles"],
        )


def _trie(nodes: DataFrame, prefix: int) -> DataFrame:
    """Rows (bucket, path, node): the trees below their prefixes of the least length that two or more nodes share.

    ``path`` holds the labels after that prefix. Prefixes of several trees with the same members are taken once.
    """
    places = nodes.select("node", "labels", F.posexplode("keys").alias("tree", "bucket")).select(
        "node", "bucket", F.expr(f"substring(labels, tree * {DEPTH} + {prefix + 1}, {DEPTH - prefix})").alias("path")
    )
    shared = (
        places.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("count"), F.min("node").alias("least"), F.max("node").alias("most"),
            F.bit_xor(F.xxhash64("node")).alias("members"),
        )
        .filter("count > 1")
        .groupBy("count", "least", "most", "members")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    return materialize(places.join(shared, "bucket").sortWithinPartitions("bucket", "path"), "jaccard-trie")


def candidates(nodes: DataFrame) -> DataFrame:
    """Rows (node, root) of the groups in which links are looked for; ``nodes`` has node, labels and keys.

    One round for each length of prefix, the longest first. A round reads the
    trie with the groups so far and opens the trie nodes that hold several.
    """
    prefix = prefix_depth(THRESHOLD[0] / THRESHOLD[1])
    trie = _trie(nodes, prefix)
    found = None
    for length in range(DEPTH, prefix - 1, -1):
        rooted = trie.withColumn("root", F.col("node"))
        if found is not None:
            rooted = trie.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        cell = F.xxhash64("bucket", F.expr(f"substring(path, 1, {length - prefix})"))
        placed = materialize(rooted.select(cell.alias("cell"), "node", "root"), "jaccard-cells")
        several = (
            placed.groupBy("cell")
            .agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("least"), F.max("root").alias("most"))
            .filter("least < most")
            .select("cell", "count")
        )
        opened = placed.join(several, "cell").join(nodes.select("node", "labels"), "node")
        near = _blocks(opened, "cell", "count", "node", BUCKET_BLOCK).mapInArrow(_near, "a long, b long")
        known = near if found is None else near.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = materialize(components(known, "jaccard-candidates"), "jaccard-groups")
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, n_copies, check (a hash of the text).

    ``class_id`` is the least doc_id of all documents that links connect;
    ``n_links`` counts the other shingle sets at the threshold or above,
    ``n_copies`` the documents with the same shingle set. A text of fewer than
    five words has one shingle, all its words; texts without words (null, empty)
    have one set, the empty one, and no links. A null doc_id is stood in for by
    its set's hash. Repeated rows are copies; a doc_id with several texts has a
    row for each, and each set its own links. Texts of any length are read whole.
    Extra columns are ignored, whatever their names. An empty table gives no rows.
    """
    # A stand-in is above all ids, so that a class is named by an id where it has one.
    stand_in = F.col("high").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    drawn = materialize(sketches(docs), "jaccard-sketches")
    # A node is a set of shingles. Its number stays, since the sets are written; its name is its least doc_id.
    sets = materialize(
        drawn.groupBy("high", "low")
        .agg(F.min(F.coalesce("doc_id", stand_in)).alias("name"), F.count(F.lit(1)).alias("n_copies"))
        .withColumn("node", F.monotonically_increasing_id()),
        "jaccard-sets",
    )
    one = drawn.filter("size > 0").join(sets, ["high", "low"]).filter(F.coalesce("doc_id", stand_in) == F.col("name"))
    nodes = materialize(one.select("node", "name", "high", "labels", "keys").dropDuplicates(["node"]), "jaccard-nodes")
    found = candidates(nodes)
    sized = found.join(found.groupBy("root").agg(F.count(F.lit(1)).alias("count")), "root")
    wanted = sized.join(nodes.select("node", "name", "high"), "node").select("root", "count", "node", "name", "high")
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    # A set named by a hash has no doc_id to find its text by; its rows are looked up by the hash.
    nameless = docs.filter("doc_id is null").select("doc_id", "text")
    with_text = wanted.join(texts, F.col("name") == F.col("doc_id")).select("root", "count", "node", "high", "text")
    if nameless.take(1):
        text_of = nameless.mapInArrow(_hashed, "high long, text string").dropDuplicates(["high"])
        with_text = with_text.unionByName(
            wanted.filter(F.col("name") == stand_in).join(text_of, "high").select("root", "count", "node", "high", "text")
        )
    shingled = with_text.mapInArrow(_shingles, "root long, count long, node long, shingles binary").dropDuplicates(
        ["root", "node"]
    )
    checked = materialize(
        _blocks(shingled, "root", "count", "node", EXACT_BLOCK).mapInArrow(_exact, "node long, links long, to long"),
        "jaccard-links",
    )
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("to").alias("b")), "jaccard-classes")
    told = materialize(
        sets.join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-told"
    )
    # One row per class: partial minima before the shuffle.
    named = told.groupBy("root").agg(F.min("name").alias("class_id"))
    verdicts = told.join(named, "root").select(
        "high", "low", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies"
    )
    return drawn.select("doc_id", "high", "low", "check").join(verdicts, ["high", "low"]).drop("high", "low")


def survivors(found: DataFrame) -> DataFrame:
    """(doc_id, check) of the document that stays of each class: the least id (null first), the least text hash."""
    least = found.groupBy("class_id").agg(F.min(F.struct("doc_id", "check")).alias("stays"))
    return least.select("stays.doc_id", "stays.check")


def _hashed(batches):
    for batch, texts in slices(batches, "text"):
        mixed = [H.mix(s * H._WEIGHTS[0]) for s in shingle_sets(texts)]
        high = np.array([np.bitwise_xor.reduce(m) if len(m) else 0 for m in mixed], np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(high), batch.column(batch.schema.get_field_index("text"))], ["high", "text"])


def op9_jaccard_join(spark, sf_dir):
    return near_duplicates(C.table(spark, sf_dir, "documents")).drop("check")
