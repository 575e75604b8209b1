"""Sharding by extendible hashing, in DataFrame functions alone.

A directory is indexed by the leading bits of each row's hash. A bucket over the
byte limit is split on one more bit, and only it, until every bucket fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import checkpointed, estimated_bytes, name, written

HASH_BITS = 60  # of the MD5 of the key
LIMIT = 1 << 20
SPARE_BITS = 6  # finer than needed on average, for the first count
MORE_BITS = 8  # further bits for what is still too large
FINE_BITS = 9  # levels that are summed from single cells; those above are summed from sums of these


def key_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text; null keys hash as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("hash", HASH_BITS - bits)


def _first_fit(cells: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(cell, depth): the least depth from ``low`` to ``high`` at which the bucket of a ``high``-bit cell fits; null if none."""
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {high} - depth)"))
    fits = levels.groupBy("depth", "bucket").agg((F.sum("bytes") <= limit).alias("fits"))
    found = levels.join(fits.where("fits"), ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell", "bytes").join(found, "cell", "left")


def directory(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """(cell, depth): the depth at which the bucket of each ``high``-bit prefix first fits, null if not yet.

    ``rows`` have (hash, size). They are counted once by their ``high``-bit
    prefix; the buckets at all depths from ``low`` on are sums of these counts.
    The upper levels are decided on sums ``FINE_BITS`` further up, and only cells
    whose bucket there is too large take part in the lower ones, so that the
    work is a few times the number of cells at any depth.
    """
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("size").alias("bytes"))
    middle = high - FINE_BITS
    if middle <= low:
        return _first_fit(cells, limit, low, high).select("cell", "depth")
    cells = checkpointed(cells)
    upper = F.shiftright("cell", high - middle)
    above = cells.groupBy(upper.alias("upper")).agg(F.sum("bytes").alias("bytes")).withColumnRenamed("upper", "cell")
    top = checkpointed(_first_fit(above, limit, low, middle)).select(F.col("cell").alias("upper"), F.col("depth").alias("above"))
    placed = cells.withColumn("upper", upper).join(top, "upper")
    fine = _first_fit(placed.where("above is null").select("cell", "bytes"), limit, middle + 1, high).select("cell", "depth")
    return fine.unionByName(placed.where("above is not null").select("cell", F.col("above").alias("depth")))


def assign(docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, bytes, shard, depth, page, shard_bytes) of every row.

    ``shard`` is the hash prefix in binary digits. Rows that share a whole hash
    (equal keys) cannot be told apart by bits; where they are over the limit
    together, they are dealt to overflow pages of the bucket, each within the
    limit. Only a single row over the limit has a larger shard, alone. ``size``
    defaults to the UTF-8 bytes of ``text``; nulls have no bytes, null ids one key. All rows keep
    their own results, repeated ones too; an empty table gives none. Texts are
    measured and not moved, however long; other columns are not read.
    """
    if limit < 1:
        raise ValueError("the byte limit must be at least 1")
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) if size is None else size
    rows = docs.select(name(id_col).alias("id"), key_hash(name(id_col)).alias("hash"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    expected = max(1.0, 2.0 * estimated_bytes(docs) / limit)
    low, high = 0, min(HASH_BITS, max(8, math.ceil(math.log2(expected)) + SPARE_BITS))
    rows = written(rows, "shard-sizes")
    done = None
    while True:
        cells = directory(rows, limit, low, high)
        placed = checkpointed(rows.withColumn("cell", _prefix(high)).join(cells, "cell").drop("cell"))
        ready = placed.where("depth is not null").withColumn("page", F.lit(0).cast("long"))
        done = ready if done is None else done.unionByName(ready)
        rows = placed.where("depth is null").drop("depth")
        if rows.isEmpty():
            break
        if high == HASH_BITS:
            done = done.unionByName(_overflow(rows, limit))
            break
        low, high = high + 1, min(HASH_BITS, high + MORE_BITS)
    digits = f"right(lpad(bin(shiftright(hash, {HASH_BITS} - depth)), {HASH_BITS}, '0'), depth)"
    bits = F.expr(f"if(depth = 0, '', {digits})")
    named = done.select("id", F.col("size").alias("bytes"), bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "page")
    totals = named.groupBy("shard", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return named.join(totals, ["shard", "page"]).select("id", "bytes", "shard", "depth", "page", "shard_bytes")


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash on pages. They are dealt to lots first, so that no task ranks a whole group."""
    stats = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    sized = rows.join(stats, "hash").withColumn("lots", F.ceil(F.col("n") / 10_000))
    dealt = checkpointed(sized.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.col("lots"))))
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("most", F.lit(1))))
    rank = F.row_number().over(Window.partitionBy("hash", "lot").orderBy("size", "id")) - 1
    page = F.floor(rank / fit) * F.col("lots") + F.col("lot")
    return dealt.withColumn("page", page.cast("long")).select("id", "hash", "size", F.lit(HASH_BITS).alias("depth"), "page")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", limit: int = LIMIT) -> None:
    """``docs`` as one Parquet folder per shard (``__shard=b<bits>_<page>``); ids must be unique here.

    A task writes whole shards, so it holds no more than a shard at a time.
    """
    where = assign(docs, id_col, limit=limit)
    place = F.concat(F.lit("b"), "shard", F.lit("_"), F.col("page").cast("string")).alias("__shard")
    tagged = docs.join(where.select(F.col("id").alias("__id"), place), name(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    tagged.repartition("__shard").write.partitionBy("__shard").parquet(folder)


SQL = f"""WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HASH_BITS // 4}))::BIGINT AS hash FROM documents),
b AS (SELECT depth, hash >> ({HASH_BITS} - depth) AS bucket, sum(bytes)::BIGINT AS total FROM d, (SELECT unnest(range(0, 30)) AS depth) GROUP BY ALL),
f AS (SELECT doc_id, bytes, b.depth, bucket, total, row_number() OVER (PARTITION BY doc_id ORDER BY b.depth) AS k FROM d JOIN b ON b.bucket = d.hash >> ({HASH_BITS} - b.depth) WHERE total <= {LIMIT})
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(bucket), depth::INTEGER, '0') END AS shard, depth::INTEGER AS depth, 0::BIGINT AS page, total AS shard_bytes FROM f WHERE k = 1"""
