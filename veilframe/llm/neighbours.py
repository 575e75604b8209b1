"""Near-duplicate vectors by NN-descent.

Neighbour lists start from the leaves of random hyperplane trees. Each round,
every vector introduces its neighbours (and those it is a neighbour of) to one
another, and lists keep the best. A list whose entries all reach the threshold is
saturated and gets longer. Pairs that reach the threshold in double precision are
the edges of the graph. Its recall is audited against brute force for all vectors
whose id is divisible by 100, and rounds go on until it is high; if it stays low,
all vectors are compared. Links that no list has room for are not lost: each block
compared gives a forest of all its links besides the entries. At last neighbours
over edges are introduced until no edge is new. A vector's links are its edges;
only in components with long lists of links are they counted block by block.

The search compares unit vectors in half precision, which are a quarter of what
the exact ones are when they are shuffled; these are fetched for pairs near the
threshold only.
"""

from __future__ import annotations

import itertools
import logging
import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import checkpointed, map_groups, name, written
from veilframe.llm.components import components

THRESHOLD = 0.95
LIST = 10  # entries of a list that is not saturated
TREES = 8
LEAF = 96  # vectors in a leaf, on average at most
LEAF_MOST = 384  # beyond this a leaf is dealt to several
CLOSEST = 5  # pairs that a leaf gives of each vector, besides those that reach the threshold
AUDIT = 100  # vectors with ids divisible by it are compared with all others to measure recall
RECALL = 0.98
ROUNDS = 6
BLOCK = 1024  # vectors of a block when links inside a component are counted
SLACK = 1.2e-3  # two roundings to half precision; edges are checked in double precision
_LOG = logging.getLogger(__name__)

PAIRS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("s", T.FloatType()), T.StructField("bond", T.BooleanType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
CHUNK = 4096  # vectors compared with all others at a time, in the audit and when it stays low


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite numbers."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one in single precision; scaled first, so that no length overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _halves(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, dims).astype(np.float32)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a @ b.T) / np.outer(np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1)))


def _batch(arrays: list, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, arrow, strict=True)], names=arrow.names)


def _nodes(vectors: DataFrame) -> DataFrame:
    """(node, first, copies, asked, mark, vec, unit): distinct vectors with the smallest id and the number of rows of each.

    ``asked`` tells whether the audit asks for one of its ids, ``vec`` holds
    doubles, ``unit`` the unit vector in half precision.
    """
    asked = F.max(F.coalesce(F.pmod(F.col("id"), F.lit(AUDIT)) == 0, F.lit(False))).alias("asked")
    each = vectors.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), asked)
    numbered = each.select(F.monotonically_increasing_id().alias("node"), "first", "copies", "asked", vector_mark(F.col("key")).alias("mark"), "key")
    kept = [f for f in numbered.schema.fields if f.name != "key"]
    schema = T.StructType([*kept, T.StructField("vec", T.BinaryType()), T.StructField("unit", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("key")
            if not len(lists):
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            halves = _unit(flat).astype(np.float16)
            arrays = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (flat, halves))], names=schema.names)

    return written(numbered.mapInArrow(pack, schema), "vectors")


def vector_mark(vector: Column) -> Column:
    """128 bits that stand for a vector in joins."""
    return F.struct(F.xxhash64(F.lit(1), vector).alias("h"), F.xxhash64(F.lit(2), vector).alias("g"))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): a spanning forest of a symmetric matrix of links."""
    i, j = [], []
    fresh = near.any(axis=1)
    while fresh.any():
        front = np.flatnonzero(fresh)[:1]
        fresh[front] = False
        while len(front):
            met = near[front] & fresh
            to = np.flatnonzero(met.any(axis=0))
            i.append(front[met[:, to].argmax(axis=0)])
            j.append(to)
            fresh[to] = False
            front = to
    return (np.concatenate(i), np.concatenate(j)) if i else (np.zeros(0, np.int64),) * 2


def _bonds(sim: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): what links the vectors of a block whatever their lists hold.

    A forest of the sure links, and all pairs that half precision leaves open
    between its trees.
    """
    i, j = _forest(sim >= threshold + SLACK)
    a, b = np.nonzero(np.triu(np.abs(sim - threshold) < SLACK, 1))
    if len(a) and len(i):
        tree = np.arange(len(sim))
        for x, y in zip(i.tolist(), j.tolist(), strict=True):  # in the order in which the trees grew
            tree[y] = tree[x]
        apart = tree[a] != tree[b]
        a, b = a[apart], b[apart]
    return np.concatenate([i, a]), np.concatenate([j, b])


# ---- first lists --------------------------------------------------------------
def _leaves(nodes: DataFrame, dims: int, n: int, trees: int, seed: int) -> DataFrame:
    """(tree, code, part, node, unit): every vector in one leaf of each tree."""
    bits = max(1, math.ceil(math.log2(max(2, n / LEAF))))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("unit", T.BinaryType()), T.StructField("codes", T.ArrayType(T.LongType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((dims, trees * bits)).astype(np.float32)
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            signs = (_halves(batch.column("unit"), dims) @ planes > 0).reshape(-1, trees, bits)
            yield _batch([batch.column("node"), batch.column("unit"), (signs * weights).sum(axis=2).tolist()], schema)

    coded = nodes.select("node", "unit").mapInArrow(code, schema)
    rows = coded.select("node", "unit", F.posexplode("codes").alias("tree", "code"))
    sizes = rows.groupBy("tree", "code").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / LEAF_MOST)).cast("int")
    return rows.join(sizes, ["tree", "code"]).select("tree", "code", part.alias("part"), "node", "unit")


def _leaf_pairs(leaves: DataFrame, dims: int, size: int, threshold: float) -> DataFrame:
    """The closest pairs of each leaf, up to ``size`` where they reach the threshold, and a forest of all its links."""

    def work(table: pa.Table, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        nodes = table.column("node").to_numpy()
        unit = _halves(table.column("unit"), dims)
        u, v, s, bond = [], [], [], []
        for lo, hi in groups:
            if hi - lo < 2:
                continue
            sim = unit[lo:hi] @ unit[lo:hi].T
            np.fill_diagonal(sim, -2)
            k = min(size, hi - lo - 1)
            best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(sim, best, 1), axis=1), 1)
            near = np.take_along_axis(sim, best, 1)
            i, place = np.nonzero((np.arange(k) < CLOSEST) | (near >= threshold - SLACK))
            more_i, more_j = _bonds(sim, threshold)
            u.append(nodes[lo + np.concatenate([i, more_i])])
            v.append(nodes[lo + np.concatenate([best[i, place], more_j])])
            s.append(np.concatenate([near[i, place], sim[more_i, more_j]]))
            bond.append(np.arange(len(i) + len(more_i)) >= len(i))
        if u:
            yield _batch([np.concatenate(x) for x in (u, v, s, bond)], PAIRS)

    return map_groups(leaves, ["tree", "code", "part"], work, PAIRS)


def _best(pairs: DataFrame, size: int, longer: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The lists, and the bonds: ``size`` best entries each, up to ``longer`` where all reach the threshold.

    Bonds are kept whether or not a list has room for them.
    """
    once = pairs.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("bond").alias("bond"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    listed = (F.col("rank") <= longer) & ((F.col("rank") <= size) | (F.col("s") >= threshold - SLACK))
    kept = once.withColumn("rank", rank).withColumn("listed", listed).where("listed or bond")
    kept = checkpointed(kept.drop("rank"))
    return kept.where("listed").select("u", "v", "s", F.lit(False).alias("bond")), kept.where("bond").select("u", "v", "s", "bond")


# ---- neighbours of neighbours ----------------------------------------------------
def _introduced(lists: DataFrame, nodes: DataFrame, dims: int, size: int, longer: int, threshold: float) -> DataFrame:
    """Pairs met through a common neighbour that are better than the worst entry of either list, and a forest of all links met."""
    near = Window.partitionBy("v").orderBy(F.xxhash64("u"))
    full = lists.groupBy("u").agg((F.min("s") >= threshold - SLACK).alias("full")).where("full").select(F.col("u").alias("v"), "full")
    back = lists.join(full, "v", "left").withColumn("k", F.row_number().over(near))
    back = back.where(F.col("k") <= F.when(F.col("full"), longer).otherwise(size)).select(F.col("v").alias("centre"), F.col("u").alias("node"))
    members = lists.select(F.col("u").alias("centre"), F.col("v").alias("node")).unionByName(back)
    members = members.unionByName(nodes.select(F.col("node").alias("centre"), "node")).distinct()
    worst = lists.groupBy("u").agg(F.min("s").alias("least"), F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("n") >= size, F.col("least")).otherwise(F.lit(-2.0).cast("float"))
    known = nodes.select("node", "unit").join(worst.withColumnRenamed("u", "node"), "node", "left").select("node", "unit", F.coalesce(least, F.lit(-2.0).cast("float")).alias("least"))
    rows = members.join(known, "node")

    def work(table: pa.Table, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        ids, least = table.column("node").to_numpy(), table.column("least").to_numpy()
        unit = _halves(table.column("unit"), dims)
        u, v, s, bond = [], [], [], []
        for lo, hi in groups:
            sim = unit[lo:hi] @ unit[lo:hi].T
            np.fill_diagonal(sim, -3)
            i, j = np.nonzero(sim > least[lo:hi, None])
            more_i, more_j = _bonds(sim, threshold)
            bond.append(np.arange(len(i) + len(more_i)) >= len(i))
            i, j = np.concatenate([i, more_i]), np.concatenate([j, more_j])
            u.append(ids[lo + i])
            v.append(ids[lo + j])
            s.append(sim[i, j])
        if u:
            yield _batch([np.concatenate(x) for x in (u, v, s, bond)], PAIRS)

    return map_groups(rows, ["centre"], work, PAIRS)


# ---- edges, audit, counts ----------------------------------------------------------
def _edges(pairs: DataFrame, nodes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b): those of the pairs (u, v) that reach the threshold in double precision."""
    close = pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("vec").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("vec").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("x"), dims), _matrix(batch.column("y"), dims)
                x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
                cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
                good = pa.array(np.flatnonzero(cosine >= threshold))
                yield _batch([batch.column("a").take(good), batch.column("b").take(good)], LINKS)

    return close.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, LINKS)


def _closed(edges: DataFrame, nodes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """The edges, and those between neighbours over edges, until none is new.

    Vectors with ``LIST`` edges and more introduce nobody here: their components
    are counted block by block.
    """
    new = edges
    while True:
        both = edges.select(F.col("a").alias("c"), F.col("b").alias("u")).unionAll(edges.select("b", "a"))
        few = both.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < LIST).select("c")
        touched = new.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        around = both.join(few, "c", "left_semi").join(touched, "c", "left_semi")
        met = around.join(around.withColumnRenamed("u", "v"), "c").where("u < v").select("u", "v").distinct()
        unknown = met.join(edges, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")), "left_anti")
        new = checkpointed(_edges(unknown, nodes, dims, threshold))
        if new.isEmpty():
            return edges
        edges = checkpointed(edges.unionByName(new))


def _asked(nodes: DataFrame) -> Iterator[tuple[np.ndarray, bytes]]:
    """The audited vectors, ``CHUNK`` at a time on the driver."""
    held = []
    for row in itertools.chain(nodes.where("asked").select("node", "vec").toLocalIterator(), [None]):
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) == CHUNK):
            yield np.array([r["node"] for r in held], np.int64), b"".join(bytes(r["vec"]) for r in held)
            held = []


def _truth(nodes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(q, node): all true links of the audited vectors, by comparison with every vector."""
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("node", T.LongType())])
    true = None

    def against(ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = batch.column("node").to_numpy()
                    i, j = np.nonzero(_cosines(_matrix(batch.column("vec"), dims), vectors) >= threshold)
                    apart = own[i] != ids[j]
                    yield _batch([ids[j][apart], own[i][apart]], schema)

        return checkpointed(nodes.select("node", "vec").mapInArrow(compare, schema))

    for ids, raw in _asked(nodes):
        found = against(ids, np.frombuffer(raw, np.float64).reshape(-1, dims))
        true = found if true is None else true.unionByName(found)
    return true if true is not None else nodes.limit(0).select(F.col("node").alias("q"), "node")


def _recall(true: DataFrame, roots: DataFrame) -> float | None:
    """The share of true links that lie within found components; none if there is nothing to find."""
    one = roots.select(F.col("node").alias("q"), F.col("root").alias("one"))
    both = true.join(one, "q", "left").join(roots, "node", "left")
    row = both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("one") == F.col("root"), 1)).alias("found")).first()
    _LOG.info("audit of near-duplicate vectors: %d of %d true links found", row["found"], row["n"])
    return row["found"] / row["n"] if row["n"] else None


def _across(nodes: DataFrame, roots: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b): exact links between components; all vectors are compared, ``CHUNK`` with all others at a time.

    A batch gives one link for each pair of components.
    """
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "vec")
    rooted = written(rooted, "rooted")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    links = None

    def against(ids: np.ndarray, own: np.ndarray, vectors: np.ndarray) -> DataFrame:
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    root = batch.column("root").to_numpy()
                    i, j = np.nonzero((_cosines(_matrix(batch.column("vec"), dims), vectors) >= threshold) & (root[:, None] != own))
                    one = np.unique(np.stack([root[i], own[j]]), axis=1, return_index=True)[1]
                    yield _batch([batch.column("node").to_numpy()[i[one]], ids[j[one]]], schema)

        return checkpointed(rooted.mapInArrow(compare, schema))

    held = []
    for row in itertools.chain(rooted.toLocalIterator(), [None]):
        if row is not None:
            held.append(row)
        if held and (row is None or len(held) == CHUNK):
            ids, own = (np.array([r[c] for r in held], np.int64) for c in ("node", "root"))
            found = against(ids, own, np.frombuffer(b"".join(bytes(r["vec"]) for r in held), np.float64).reshape(-1, dims))
            links = found if links is None else links.unionByName(found)
            held = []
    return links.distinct()


def _counts(nodes: DataFrame, roots: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(node, n): rows linked with each vector of a component, found by comparing its blocks pair by pair."""
    inside = roots.join(nodes.select("node", "vec", "copies"), "node")
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = inside.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "vec", "copies")
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])

    def work(table: pa.Table, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        own, first = table.column("own").to_numpy(), table.column("i").to_numpy()
        vectors = _matrix(table.column("vec"), dims)
        out_ids, out_n = [], []

        def add(a: np.ndarray, b: np.ndarray, same: bool) -> None:
            near = _cosines(vectors[a], vectors[b]) >= threshold
            if same:
                np.fill_diagonal(near, False)
            out_ids.append(ids[a])
            out_n.append(near @ copies[b])
            if not same:
                out_ids.append(ids[b])
                out_n.append(near.T @ copies[a])

        for lo, hi in groups:
            at = np.arange(lo, hi)
            left = at[own[lo:hi] == first[lo]]
            right = at[own[lo:hi] != first[lo]]
            if table.column("j")[lo].as_py() == first[lo]:
                add(left, left, True)
            elif len(left) and len(right):
                add(left, right, False)
        if out_ids:
            yield _batch([np.concatenate(out_ids), np.concatenate(out_n).astype(np.int64)], schema)

    parts = map_groups(rows, ["root", "i", "j"], work, schema, rows=2 * BLOCK)
    return parts.groupBy("node").agg(F.sum("n").alias("n"))


def _links_of(nodes: DataFrame, roots: DataFrame, edges: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(node, n): rows linked with each vector of a component.

    Where every vector of a component has fewer than ``LIST`` edges, no list had
    to leave one out, and edges are counted. The others are compared block by block.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select("b", "a"))
    copies = nodes.select(F.col("node").alias("other"), "copies")
    degrees = both.join(copies, "other").groupBy("node").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("edges"))
    rooted = checkpointed(roots.join(degrees, "node", "left"))
    long = rooted.groupBy("root").agg(F.max("edges").alias("most")).where(F.coalesce("most", F.lit(LIST)) >= LIST).select("root")
    counted = _counts(nodes, roots.join(long, "root", "left_semi"), dims, threshold)
    return rooted.join(long, "root", "left_anti").select("node", "n").unionByName(counted)


def _linked(vectors: DataFrame, dims: int, threshold: float, seed: int) -> DataFrame:
    nodes = _nodes(vectors)
    n = nodes.count()
    true = checkpointed(_truth(nodes, dims, threshold))
    near = F.col("s") >= threshold - SLACK
    lists, bonds = _best(_leaf_pairs(_leaves(nodes, dims, n, TREES, seed), dims, LIST, threshold), LIST, 2 * LIST, threshold)
    edges, recall = None, None
    for k in range(ROUNDS):
        longer = LIST << min(k + 1, 4)
        met = _introduced(lists, nodes, dims, LIST, longer, threshold)
        if k:
            met = met.unionByName(_leaf_pairs(_leaves(nodes, dims, n, TREES, seed + k), dims, LIST, threshold))
        lists, more = _best(lists.unionByName(met), LIST, longer, threshold)
        found = _edges((lists.unionByName(more) if k else lists.unionByName(more).unionByName(bonds)).where(near), nodes, dims, threshold)
        edges = checkpointed(found if edges is None else edges.unionByName(found).distinct())
        edges = _closed(edges, nodes, dims, threshold)
        roots = components(edges)
        recall = _recall(true, roots)
        if recall is None or recall >= RECALL:
            break
    if recall is not None and recall < RECALL:
        warnings.warn(f"the audited recall of near-duplicate vectors is {recall:.3f}; all vectors are compared", stacklevel=2)
        edges = checkpointed(edges.unionByName(_across(nodes, roots, dims, threshold)).distinct())
        edges = _closed(edges, nodes, dims, threshold)
        roots = components(edges)
        recall = _recall(true, roots)
    links = _links_of(nodes, roots, edges, dims, threshold)
    joined = nodes.select("node", "first", "copies", "mark").join(roots, "node", "left").join(links, "node", "left")
    joined = joined.withColumn("root", F.coalesce("root", "node"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(smallest, "root").select("mark", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    marked = vectors.select("id", vector_mark(F.col("key")).alias("mark"))
    return marked.join(classes, "mark").select("id", "n_links", "component_id", F.lit(recall).cast("double").alias("recall"))


def near_duplicates(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    seed: int = 42,
) -> DataFrame:
    """(id, n_links, component_id, recall) of every row, linked at a cosine of at least ``threshold``.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, nor do rows without an id. Vectors of different lengths
    are not compared; each length that several rows have is a search of its own.
    Equal vectors are one until results are given out, so repeated rows link with
    each other. An empty table gives no rows; columns other than the two named
    are not read. ``recall`` is the audited share of true links, the same in all
    rows of a search; null where the audited vectors have no link to find.
    """
    rows = embeddings.select(name(id_col).alias("id"), name(vector_col).alias("key"))
    good = F.coalesce(F.col("id").isNotNull() & usable(F.col("key")), F.lit(False))
    found = rows.where(good).groupBy(F.size("key").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect()  # one row a length
    lengths = sorted(r["d"] for r in found)
    single = good & F.size("key").isin(lengths) if lengths else F.lit(False)
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(None).cast("double").alias("recall")]
    out = rows.where(~single).select("id", *alone)
    for d in lengths:
        out = out.unionByName(_linked(rows.where(good & (F.size("key") == d)), d, threshold, seed))
    return out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`near_duplicates`, and the audited recall."""
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"), "recall")
