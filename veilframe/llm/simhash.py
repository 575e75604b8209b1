"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of equal bits meet at once. Different ones are joined in tries:
pairs of nodes are walked down together, differing bits add up, and a pair is
left as soon as they exceed the budget. With a budget of ``k`` bits, the bits are
dealt into ``k + 1`` blocks of which at least one has to agree, so there is one
trie for each block (its bits put on top), and the walk starts at nodes below
that block. Of ``k + 2`` blocks any two agree, and so on: with more fingerprints
there are more tries with longer tops. Node pairs with too many fingerprints for one task are
walked further by Spark itself: rows move to the pairs of child nodes still
within the budget, until every task is small.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.llm.common import append_columns, checkpointed, name, small_batches, written
from veilframe.llm.components import components

BITS = 64
TASK_ROWS = 20_000  # fingerprints under a pair of nodes that one task walks
MOST_AGREED = 4  # blocks that agree on top of a trie, at most
STEP_BITS = 6  # bits by which a larger pair of nodes is divided
LEAF = 16  # comparisons below which a pair of nodes is compared directly
FRONT = 400_000  # node pairs walked at a time


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of the XXH64 of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.encode().lower().split()  # both know ASCII only
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        spans = zip(starts[lo:hi].tolist(), ends[lo + shingle - 1 : hi + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], seed) for a, b in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``simhash``: the fingerprint as a signed 64-bit integer. Null texts have no words."""
    small_batches(docs.sparkSession)

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text_col))
            codes = np.array([fingerprint(t.as_py() or "", shingle, seed) for t in texts], np.uint64)
            return [pa.array(codes.view(np.int64))]

        return run

    return append_columns(docs, [T.StructField("simhash", T.LongType())], make, drop=() if keep_text else (text_col,))


def hex_of(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


# ---- the walk inside one task -------------------------------------------------
def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class _Labels:
    """Components among the rows of a task; the smallest row is the label."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.of[self.of]
                if (further == self.of).all():
                    break
                self.of = further


def walk(codes: np.ndarray, pairs: list[tuple[int, int, int, int]], depth: int, budget: int, labels: _Labels) -> None:
    """Link rows at most ``budget`` bits apart under the given pairs of nodes.

    A node is a range of rows, in ascending order, that agree in their first
    ``depth`` bits. A pair is (lo, hi, lo, hi), the same range twice for a node
    with itself.
    """
    front = np.array(pairs, np.int64).reshape(-1, 4)
    start = np.zeros(len(front), np.int64)
    if depth:  # nodes of a pair may differ in the bits above; count those first
        top = np.uint64(BITS - depth)
        start = _popcount((codes[front[:, 0]] ^ codes[front[:, 2]]) >> top).astype(np.int64)
    stack = [(depth, front[start <= budget], start[start <= budget])]
    ones: dict[int, np.ndarray] = {}
    while stack:
        at, front, bits = stack.pop()
        same = front[:, 0] == front[:, 2]
        work = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
        leaf = (work <= LEAF) | (at >= BITS)
        if leaf.any():
            _compare(codes, front[leaf], budget, labels)
            front, bits, same = front[~leaf], bits[~leaf], same[~leaf]
        if not len(front):
            continue
        if at not in ones:
            bit = (codes >> np.uint64(BITS - 1 - at)) & np.uint64(1)
            ones[at] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        count = ones[at]
        a, b, c, d = front.T
        m, k = b - (count[b] - count[a]), d - (count[d] - count[c])
        children = [
            (np.stack([a, m, c, k], 1), bits),
            (np.stack([m, b, k, d], 1), bits),
            (np.stack([a, m, k, d], 1), bits + 1),
            (np.stack([m, b, c, k], 1)[~same], (bits + 1)[~same]),
        ]
        front, bits = (np.concatenate(x) for x in zip(*children, strict=True))
        alive = (bits <= budget) & (front[:, 1] > front[:, 0]) & (front[:, 3] > front[:, 2])
        alive &= (front[:, 0] != front[:, 2]) | (front[:, 1] - front[:, 0] > 1)
        front, bits = front[alive], bits[alive]
        for lo in range(0, len(front), FRONT):
            stack.append((at + 1, front[lo : lo + FRONT], bits[lo : lo + FRONT]))


def _compare(codes: np.ndarray, front: np.ndarray, budget: int, labels: _Labels) -> None:
    """Compare all rows of small node pairs, a bounded number of comparisons at a time."""
    work = (front[:, 1] - front[:, 0]) * (front[:, 3] - front[:, 2])
    ends = np.cumsum(work)
    lo = 0
    while lo < len(front):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * FRONT)))
        part, n = front[lo:hi], work[lo:hi]
        which = np.repeat(np.arange(len(part)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width = (part[:, 3] - part[:, 2])[which]
        i, j = part[which, 0] + k // width, part[which, 2] + k % width
        near = _popcount(codes[i] ^ codes[j]) <= budget
        labels.link(i[near], j[near])
        lo = hi


# ---- the walk across tasks -------------------------------------------------------
def _blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``n`` nearly equal blocks."""
    edges = [i * BITS // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _tries(budget: int, n: int, task_rows: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bits on top, blocks in their order) of tries one of which holds any two of the fingerprints under one node.

    As few as leave a node of evenly spread fingerprints small for a task.
    """
    for more in range(MOST_AGREED):
        blocks = _blocks(budget + 1 + more)
        tops = list(itertools.combinations(range(len(blocks)), 1 + more))
        depth = min(sum(blocks[i][1] for i in top) for top in tops)
        if n <= task_rows // 4 << depth:
            break
    rest = lambda top: [i for i in range(len(blocks)) if i not in top]
    return [(sum(blocks[i][1] for i in top), [blocks[i] for i in (*top, *rest(top))]) for top in tops]


def _arranged(blocks: list[tuple[int, int]]) -> Column:
    """The fingerprint with its bits in the order of the blocks."""
    parts, at = [], BITS
    for first, width in blocks:
        at -= width
        mask = (1 << width) - 1 if width < BITS else -1
        parts.append(f"shiftleft(shiftrightunsigned(simhash, {BITS - first - width}) & {mask}L, {at})")
    return F.expr(" | ".join(parts))


def _masks(budget: int) -> list[int]:
    return [m for m in range(1 << STEP_BITS) if m.bit_count() <= budget]


def _divided(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of large node pairs, one level of ``STEP_BITS`` bits further down."""
    child = F.expr(f"shiftrightunsigned(code, {BITS - STEP_BITS} - depth) & {(1 << STEP_BITS) - 1}")
    masks = F.array(*[F.lit(m).cast("long") for m in _masks(budget)])
    far = F.filter(masks, lambda m: F.bit_count(m) + F.col("used") <= budget)
    moved = rows.withColumn("child", child).withColumn("mask", F.explode(far)).withColumn("mate", F.col("child").bitwiseXOR(F.col("mask")))
    left = F.when(F.col("side") == 0, F.least("child", "mate")).when(F.col("side") == 1, F.col("child")).otherwise(F.col("mate"))
    right = F.when(F.col("side") == 0, F.greatest("child", "mate")).when(F.col("side") == 1, F.col("mate")).otherwise(F.col("child"))
    side = F.when(F.col("side") > 0, F.col("side")).when(F.col("mask") == 0, 0).when(F.col("child") < F.col("mate"), 1).otherwise(2)
    return moved.select(
        "trie",
        F.concat_ws("/", "pair", F.concat_ws("-", left, right)).alias("pair"),
        side.cast("int").alias("side"),
        (F.col("depth") + STEP_BITS).alias("depth"),
        (F.col("used") + F.bit_count("mask")).cast("int").alias("used"),
        "code",
        "rep",
    )


def links(prints: DataFrame, budget: int = 2, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b): enough links between ``rep`` ids for the components of all pairs within ``budget`` bits.

    ``prints`` has distinct fingerprints (``simhash``) with one id each (``rep``);
    it is counted first, so it should be kept.
    A task links its rows to one of them per component found, so that a dense
    group of n fingerprints gives n links and not n squared.
    """
    tries = []
    for k, (depth, blocks) in enumerate(_tries(budget, prints.count(), task_rows)):
        tries.append(F.struct(F.lit(k).alias("trie"), F.lit(depth).alias("depth"), _arranged(blocks).alias("code")))
    rows = prints.select("rep", F.explode(F.array(*tries)).alias("t")).select(
        "t.trie",
        F.expr(f"shiftrightunsigned(t.code, {BITS} - t.depth)").cast("string").alias("pair"),
        F.lit(0).alias("side"),
        "t.depth",
        F.lit(0).alias("used"),
        "t.code",
        "rep",
    )
    ready = None
    while True:
        sizes = rows.groupBy("trie", "pair").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("side").alias("sides"), F.max("side").alias("last"))
        sizes = sizes.where("n > 1 and (last = 0 or sides = 2)").select("trie", "pair", "n")
        sized = checkpointed(rows.join(sizes, ["trie", "pair"]))
        small = sized.where((F.col("n") <= task_rows) | (F.col("depth") + STEP_BITS > BITS)).drop("n")
        ready = small if ready is None else ready.unionByName(small)
        rows = sized.where((F.col("n") > task_rows) & (F.col("depth") + STEP_BITS <= BITS)).drop("n")
        if rows.isEmpty():
            break
        rows = checkpointed(_divided(rows, budget))
    return _walked(ready, budget)


def _walked(rows: DataFrame, budget: int) -> DataFrame:
    rep = rows.schema["rep"].dataType
    schema = T.StructType([T.StructField("a", rep), T.StructField("b", rep)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * TASK_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = _last_start(table)
                if cut:
                    yield from _linked(table.slice(0, cut), budget, arrow)
                    table = table.slice(cut)
                held, size = table.to_batches(), table.num_rows
        if held:
            yield from _linked(pa.Table.from_batches(held).combine_chunks(), budget, arrow)

    ordered = rows.repartition("trie", "pair").sortWithinPartitions("trie", "pair", "side", "code")
    return ordered.select("trie", "pair", "side", "depth", "code", "rep").mapInArrow(run, schema)


def _keys(table: pa.Table) -> np.ndarray:
    """Where a new (trie, pair) begins."""
    pair = table.column("pair").combine_chunks().dictionary_encode()
    pair = (pair.chunk(0) if isinstance(pair, pa.ChunkedArray) else pair).indices.to_numpy(zero_copy_only=False)
    trie = table.column("trie").to_numpy()
    new = np.ones(len(trie), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (trie[1:] != trie[:-1])
    return np.flatnonzero(new)


def _last_start(table: pa.Table) -> int:
    return int(_keys(table)[-1])


def _linked(table: pa.Table, budget: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    codes = table.column("code").to_numpy().view(np.uint64)
    side, depth = table.column("side").to_numpy(), table.column("depth").to_numpy()
    starts = _keys(table)
    ends = np.append(starts[1:], len(codes))
    labels, by_depth = _Labels(len(codes)), {}
    for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
        if side[hi - 1] == 0:
            pair = (lo, hi, lo, hi)
        else:
            mid = lo + int(np.searchsorted(side[lo:hi], 2))
            pair = (lo, mid, mid, hi)
        by_depth.setdefault(int(depth[lo]), []).append(pair)
    for at, pairs in by_depth.items():
        walk(codes, pairs, at, budget, labels)
    moved = np.flatnonzero(labels.of != np.arange(len(codes)))
    if len(moved):
        reps = table.column("rep").combine_chunks()
        reps = reps.chunk(0) if isinstance(reps, pa.ChunkedArray) else reps
        yield pa.RecordBatch.from_arrays([reps.take(pa.array(moved)), reps.take(pa.array(labels.of[moved]))], names=arrow.names)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    budget: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(id, simhash, component_id) of every row: documents linked, directly or not, share the smallest id.

    Texts whose fingerprints differ in at most ``budget`` bits are linked. Null
    and empty texts have fingerprint zero and are linked like any other; texts of
    fewer than ``shingle`` words have one shingle. Texts are taken whole. Repeated
    rows and ids stay as they are. Rows without an id link like any other, too;
    a component has no id only if none of its rows has one. An empty table gives
    no rows. Columns other than the two named are not read.
    """
    marked = docs.select(name(id_col).alias("id"), name(text_col).cast("string").alias("text"))
    marked = written(with_fingerprints(marked, "text", shingle, seed, keep_text=False), "simhash")
    prints = checkpointed(marked.groupBy("simhash").agg(F.min("id").alias("first")))
    roots = components(links(prints.select("simhash", F.col("simhash").alias("rep")), budget))
    classes = prints.join(roots, prints["simhash"] == roots["node"], "left").select("simhash", "first", F.coalesce("root", "simhash").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(classes.join(least, "root").select("simhash", "component_id"), "simhash").select("id", "simhash", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`near_duplicates`."""
    return found.select(F.col("id").alias("doc_id"), hex_of(F.col("simhash")).alias("fingerprint"), "component_id")
