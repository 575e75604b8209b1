"""Near-duplicates by word-shingle similarity: proposed by fingerprints, verified exactly.

The trie self-join of SimHash and bands of MinHash values only propose pairs. A
pair is a link if the sets of word shingles themselves have a Jaccard similarity
of at least the threshold. In a bucket, all members are first compared with one
of them; what then still lies in several components is compared exhaustively in
a task, so that a dense group of n members gives n links and not n squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import append_columns, checkpointed, map_groups, name, narrow, small_batches, written
from veilframe.llm.components import components
from veilframe.llm.simhash import BITS, links

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5  # of a pair at 0.8, one in fourteen thousand agrees in no band
BLOCK = 512  # members of a bucket that a task compares with as many others
BLOCK_BYTES = 8 << 20  # and of their sets, as texts may be very long

_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(43).integers(0, 1 << 63, BANDS * ROWS, np.uint64)

FIELDS = [T.StructField("key", T.StringType()), T.StructField("simhash", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingles(text: str, shingle: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of all words if they are fewer."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    return np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)


def _fingerprint(hashes: np.ndarray) -> int:
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 16)], "<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def _bands(own: np.ndarray) -> np.ndarray:
    """One value for each band: of the smallest hashes under ``ROWS`` multiplications."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 512):
        x = own[lo : lo + 512, None] * _ODD + _ADD
        x ^= x >> np.uint64(31)
        least = np.minimum(least, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    value = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = (value ^ row) * np.uint64(0xC2B2AE3D27D4EB4F)
        value ^= value >> np.uint64(29)
    return value.view(np.int64)


def _key(own: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(own.tobytes())


def with_keys(docs: DataFrame, text_col: str, keep_text: bool = False) -> DataFrame:
    """``docs`` with key (of the set of shingles), simhash and bands. Texts without words have the same."""
    small_batches(docs.sparkSession)

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            keys, codes, bands = [], [], []
            for value in batch.column(batch.schema.get_field_index(text_col)):
                hashes = shingles(value.as_py() or "")
                own = np.unique(hashes)
                keys.append(_key(own))
                codes.append(_fingerprint(hashes))
                bands.append(_bands(own))
            return [pa.array(keys, pa.string()), pa.array(codes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]

        return run

    return append_columns(docs, FIELDS, make, drop=() if keep_text else (text_col,))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, own): the sets of shingles of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(t.as_py() or "")).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["node", "own"])

    made = texts.select("node", "text").mapInArrow(run, "node long, own binary")
    return written(made.dropDuplicates(["node"]), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(x), len(y)) >= similar * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= similar * (len(x) + len(y) - both):
                        good.append(i)
            good = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good)], names=["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("own").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, LINKS)


def _exhausted(rows: DataFrame, similar: float) -> DataFrame:
    """Links across components in the same bucket; ``rows`` has bucket, node, root and own.

    Members of a bucket are dealt to blocks, and each pair of blocks is a group
    of its own. A member is compared with a whole group in one sweep.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("own")) / BLOCK_BYTES))
    sizes = rows.groupBy("bucket").agg(blocks.cast("int").alias("blocks"))
    dealt = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "own")

    def work(table: pa.Table, groups: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        keys, roots = (table.column(c).to_numpy() for c in ("node", "root"))
        own = table.column("own").combine_chunks()
        own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
        _, places, data = own.buffers()
        ends = np.frombuffer(places, np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64) // 8
        every = np.frombuffer(data, np.uint64, count=int(ends[-1])) if data is not None else np.zeros(0, np.uint64)
        a, b = [], []
        for lo, hi in groups:
            label = np.unique(roots[lo:hi], return_inverse=True)[1]
            if hi - lo < 2 or label.max() == 0:
                continue
            at = ends[lo : hi + 1] - ends[lo]
            size = np.diff(at)
            terms, flat = np.unique(every[ends[lo] : ends[hi]], return_inverse=True)
            most = np.bincount(label).argmax()
            mark = np.zeros(len(terms), np.int32)
            for i in np.flatnonzero(label != most).tolist():  # of a pair across, one at least is not in the largest
                mark[:] = 0
                mark[flat[at[i] : at[i + 1]]] = 1
                both = np.add.reduceat(mark[flat], at[:-1]) if size.min() else np.array([mark[flat[x:y]].sum() for x, y in zip(at, at[1:], strict=False)])
                near = np.flatnonzero((both >= similar * (size + size[i] - both)) & (label != label[i]))
                for k in near.tolist():
                    if label[k] != label[i]:
                        a.append(int(keys[lo + i]))
                        b.append(int(keys[lo + k]))
                        label[label == label[i]] = label[k]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_groups(dealt, ["bucket", "i", "j"], work, LINKS, rows=2 * BLOCK)


def row_mark(row_id: Column, text: Column) -> Column:
    """The same for rows of equal id and text only (a null text is an empty one)."""
    return F.unhex(F.md5(F.concat(F.when(row_id.isNull(), "n").otherwise(F.concat(F.lit("i"), row_id.cast("string"), F.lit(":"))), F.coalesce(text, F.lit("")))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, similar: float = SIMILAR) -> DataFrame:
    """(id, mark, root, component_id) of every row: rows linked, directly or not, share root and smallest id.

    Texts are linked if their sets of word shingles have a Jaccard similarity of
    at least ``similar``. Null and empty texts are equal. Repeated rows and ids
    stay as they are; rows without an id link like any other, and have a null
    component if no row of it has an id. An empty table gives no rows. ``mark``
    is that of :func:`row_mark`.
    """
    text = name(text_col).cast("string")
    marked = docs.select(name(id_col).alias("id"), text.alias("text"), row_mark(name(id_col), text).alias("mark"))
    hashed = written(with_keys(marked, "text"), "near")
    # Distinct sets of shingles by number; one row of each stands for its text.
    nodes = hashed.groupBy("key").agg(F.min("id").alias("first"), F.min("mark").alias("mark"), F.min(F.struct("simhash", "bands")).alias("v"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "first", "mark", "v.*"), "near-keys")

    met = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(met.join(buckets, "bucket"))
    prints = checkpointed(nodes.groupBy("simhash").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")))
    pairs = members.select(F.col("centre").alias("a"), F.col("node").alias("b")).unionByName(links(prints.drop("n"), budget))
    pairs = pairs.unionByName(nodes.join(prints.where("n > 1"), "simhash").select(F.col("rep").alias("a"), F.col("node").alias("b")))
    pairs = checkpointed(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = checkpointed(nodes.join(wanted, "node", "left_semi").select("node", "mark"))
    sets = _sets(marked.join(narrow(chosen), "mark"))
    found = checkpointed(_verified(pairs, sets, similar))
    roots = components(found)

    # Buckets of three and more in several components; those with the same members count once.
    rooted = members.where("n > 2").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("n"))
    open_ = open_.where("lo <> hi").groupBy("sum", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    across = checkpointed(_exhausted(rooted.join(open_, "bucket", "left_semi").join(sets, "node"), similar))
    if not across.isEmpty():
        roots = components(found.unionByName(across))
    classes = nodes.join(roots, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return hashed.select("id", "mark", "key").join(classes.join(least, "root").select("key", "root", "component_id"), "key").drop("key")


def surplus(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks of rows that go, and marks of rows that stay once of several, by a result of :func:`near_duplicates`.

    Of each component the row with the smallest id stays (rows without one come
    last), then the one with the smallest mark.
    """
    place = F.struct(F.col("id").isNull().alias("lost"), "id", "mark")
    best = found.groupBy("root").agg(F.min(place).alias("best"))
    rows = found.groupBy("root", "mark").agg(F.count(F.lit(1)).alias("n"))
    judged = rows.join(best.select("root", F.col("best.mark").alias("stays")), "root").select("mark", "n", (F.col("mark") == F.col("stays")).alias("stays"))
    judged = checkpointed(judged.where("not stays or n > 1"))
    return judged.where("not stays").select("mark"), judged.where("stays").select("mark")
