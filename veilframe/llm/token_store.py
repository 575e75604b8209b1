"""Token ids on disk: one zstandard frame per document under a shared dictionary.

A store is a folder of Parquet tables that Spark writes and commits:

* ``dictionary``: one row (hash, bytes, width) - the dictionary trained on
  serialised id arrays, its SHA-256, and the bytes per id;
* ``blocks``: partitioned by shard, rows (block, dict_hash, payload, and arrays over the
  documents inside: doc_ids, offsets, lengths, starts, counts). ``payload`` holds
  the frames end to end, so a document is read without its neighbours;
* ``shards``: rows (shard, base) - ids before each shard;
* ``index``: rows (doc_id, shard, block, offset, length, start, n_tokens,
  dict_hash) for access to single documents.

Shards, blocks and documents ascend by id.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from veilframe.llm.common import name, shared_folder, small_batches
from veilframe.llm.tokens import encoder

DICTIONARY_BYTES = 64 << 10
SAMPLE_ROWS = 2000  # documents, on average, on which the dictionary is trained
SAMPLE_BYTES = 16 << 20  # serialised bytes of them that training may hold
BLOCK_BYTES = 1 << 20  # of frames in a block, unless one document has more


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def _wide(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if width == 2 else raw


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for such arrays; too few of them serve as they are, and none give none."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _zstd_dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def _sampled_dictionary(docs: DataFrame, text_col: str, path: str, end_id: int, width: int) -> bytes:
    """Trained in one task on a bounded sample; the driver gets the dictionary only."""
    n = docs.count()
    sample = docs.select(name(text_col).cast("string").alias("text")).sample(fraction=min(1.0, SAMPLE_ROWS / max(n, 1)), seed=42)
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = encoder(path)
        for batch in batches:
            raw = [_narrow(encode_one(t or "") + end, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], names=["raw"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, size = [], 0
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if size + len(raw) <= SAMPLE_BYTES:
                    samples.append(raw)
                    size += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array([trained(samples)], pa.binary())], names=["raw"])

    rows = sample.mapInArrow(encode, "raw binary").repartition(1).mapInArrow(train, "raw binary").collect()
    return bytes(rows[0]["raw"]) if rows else b""


def write_store(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    level: int = 3,
) -> str:
    """Encode whole texts, append ``end_id`` to each, write a store, and return its folder.

    Null texts are empty, so they have the end id alone. Rows with equal ids are
    kept side by side, by text; null ids come first. An empty table gives a store
    without blocks. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_folder(spark)}/veilframe/tokens-{uuid.uuid4().hex}"
    width = 2 if max(_vocabulary(tokenizer_path), end_id + 1) <= 1 << 16 else 4
    dictionary = _sampled_dictionary(docs, text_col, tokenizer_path, end_id, width)
    digest = hashlib.sha256(dictionary).hexdigest()
    row = [(digest, bytearray(dictionary), width)]
    spark.createDataFrame(row, "hash string, bytes binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")

    id_type = docs.schema[id_col].dataType
    schema = _schema(id_type)
    arrow, id_arrow, end = to_arrow_schema(schema), to_arrow_type(id_type), array("I", [end_id]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        encode_one = encoder(tokenizer_path)
        press = zstandard.ZstdCompressor(level=level, dict_data=_zstd_dictionary(dictionary))
        block, start = 0, 0
        frames, ids, offsets, lengths, starts, counts, size = [], [], [], [], [], [], 0

        def full() -> pa.RecordBatch:
            arrays = [
                pa.array([shard], pa.int64()),
                pa.array([block], pa.int64()),
                pa.array([digest], pa.string()),
                pa.array([b"".join(frames)], pa.binary()),
                pa.array([ids], pa.list_(id_arrow)),
                *[pa.array([x], pa.list_(pa.int64())) for x in (offsets, lengths, starts, counts)],
            ]
            return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], names=arrow.names)

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = encode_one(value.as_py() or "") + end
                frame = press.compress(_narrow(raw, width))
                if frames and size + len(frame) > BLOCK_BYTES:
                    yield full()
                    block += 1
                    frames, ids, offsets, lengths, starts, counts, size = [], [], [], [], [], [], 0
                for column, made in zip((frames, ids, offsets, lengths, starts, counts), (frame, doc, size, len(frame), start, len(raw) // 4), strict=True):
                    column.append(made)
                size += len(frame)
                start += len(raw) // 4
        if frames:
            yield full()

    rows = docs.select(name(id_col).alias("id"), name(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    encoded = ordered.mapInArrow(encode, schema)  # a task is a shard; a row group holds about one block
    encoded.write.option("parquet.block.size", 2 * BLOCK_BYTES).partitionBy("shard").parquet(f"{folder}/blocks")

    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks")
    totals = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{folder}/shards")
    _documents(spark, folder, blocks.drop("payload")).select(
        "doc_id", "shard", "block", "offset", "length", "start", "n_tokens", "dict_hash"
    ).write.parquet(f"{folder}/index")
    return folder


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("block", T.LongType()),
            T.StructField("dict_hash", T.StringType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("offsets", T.ArrayType(T.LongType())),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("starts", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0) + 1


def _documents(spark: SparkSession, folder: str, blocks: DataFrame) -> DataFrame:
    """One row per document of the given blocks, in place of their arrays."""
    shards = spark.read.schema("shard long, base long").parquet(f"{folder}/shards")
    cells = F.arrays_zip("doc_ids", "offsets", "lengths", "starts", "counts")
    rows = blocks.select("shard", "block", "dict_hash", F.explode(cells).alias("c")).join(shards, "shard")
    return rows.select(
        F.col("c.doc_ids").alias("doc_id"),
        "shard",
        "block",
        F.col("c.offsets").alias("offset"),
        F.col("c.lengths").alias("length"),
        (F.col("base") + F.col("c.starts")).alias("start"),
        F.col("c.counts").alias("n_tokens"),
        "dict_hash",
    )


def _dictionary(spark: SparkSession, folder: str) -> tuple[bytes, int, str]:
    row = spark.read.parquet(f"{folder}/dictionary").first()  # one row of at most DICTIONARY_BYTES
    return bytes(row["bytes"]), row["width"], row["hash"]


def _unpacker(dictionary: bytes, width: int, digest: str):
    import zstandard

    press = zstandard.ZstdDecompressor(dict_data=_zstd_dictionary(dictionary))

    def unpack(frame: bytes, under: str) -> bytes:
        if under != digest:
            raise ValueError("the block was written under another dictionary")
        return _wide(press.decompress(frame), width)

    return unpack


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of a store; the index tells the type of ids, also where there is no block."""
    id_type = spark.read.parquet(f"{folder}/index").schema["doc_id"].dataType
    return spark.read.schema(_schema(id_type)).parquet(f"{folder}/blocks")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a store: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit)."""
    dictionary, width, digest = _dictionary(spark, folder)
    blocks = _blocks(spark, folder)
    shards = spark.read.schema("shard long, base long").parquet(f"{folder}/shards")
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [T.StructField("shard", T.LongType()), T.StructField("doc_id", id_type), T.StructField("begin", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(dictionary, width, digest)
        for batch in batches:
            for row in batch.to_pylist():
                payload, n = row["payload"], len(row["doc_ids"])
                ids = [unpack(payload[o : o + k], row["dict_hash"]) for o, k in zip(row["offsets"], row["lengths"], strict=True)]
                arrays = [pa.array([row["shard"]] * n, pa.int64()), pa.array(row["doc_ids"]), pa.array(row["starts"]), pa.array(row["counts"]), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], names=arrow.names)

    decoded = blocks.mapInArrow(decode, schema)
    return decoded.join(shards, "shard").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, folder: str, doc_ids: Sequence) -> DataFrame:
    """Only these documents: the index names their blocks, only these are read, and only their frames decompressed."""
    dictionary, width, digest = _dictionary(spark, folder)
    wanted = spark.read.parquet(f"{folder}/index").filter(F.col("doc_id").isin(list(doc_ids)))
    places = wanted.select("shard", "block").distinct().collect()  # no more than ids were asked for, but for repeated ones
    held: dict[int, list[int]] = {}
    for place in places:
        held.setdefault(place["shard"], []).append(place["block"])
    near = F.lit(False)
    for shard, numbers in held.items():
        near = near | ((F.col("shard") == shard) & F.col("block").isin(numbers))
    blocks = _blocks(spark, folder).where(F.col("shard").isin(list(held)) & F.col("block").isin(sorted({b for n in held.values() for b in n})) & near)
    frames = wanted.join(blocks.select("shard", "block", "payload"), ["shard", "block"]).select(
        "doc_id", "start", "n_tokens", "dict_hash", F.expr("substring(payload, int(offset) + 1, int(length))").alias("frame")
    )

    @F.pandas_udf("binary")
    def ids(frame, under):
        unpack = _unpacker(dictionary, width, digest)
        return frame.combine(under, lambda f, h: unpack(bytes(f), h))

    return frames.select("doc_id", "start", "n_tokens", ids("frame", "dict_hash").alias("ids"))


def digest_of(store: DataFrame) -> DataFrame:
    """The contract's columns of what :func:`read_store` gives."""
    return store.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
