"""Raw documents to packed training sequences: filter, deduplicate, decontaminate, mask, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is
written as Parquet and read again as the documents of the next one. Null texts
count as empty everywhere; a stage over an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, packing, secrets, similar, toxicity
from veilframe.llm.common import discard, name, narrow, written, written_so_far
from veilframe.llm.queries import packed, table, toxicity_model

PIECES = 150_000  # encoded pieces that a worker remembers beside what earlier stages left
DEDUP_BITS = 4  # of fingerprints that only propose pairs; the five-word shingles decide


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], fields, keep) -> DataFrame:
    """The rows of ``docs`` that meet ``keep`` on what ``judge`` adds; own columns of the same names survive."""
    taken = [f.name for f in fields if f.name in docs.columns]
    aside = docs.withColumnsRenamed({c: f"__own_{c}" for c in taken})
    kept = judge(aside).where(keep).select(*[name(c) for c in aside.columns])
    return kept.withColumnsRenamed({f"__own_{c}": c for c in taken})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half.

    Each row is scored by itself, so repeated rows go or stay together; long
    texts are scored whole; texts without words score 0 and stay, as all do if
    there are no labels. An empty table gives an empty one.
    """
    model = toxicity_model(spark, docs, sf_dir)
    return _judged(docs, lambda d: toxicity.scored(d, model), toxicity.FIELDS, F.col("score") < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those linked by a similarity of 0.8 in five-word shingles.

    Rows are judged one by one and not by their ids: the row with the smallest id
    stays (rows without one come last), of several such texts the one with the smallest hash.
    Of rows that repeat an id and a text one stays, the first by its other
    columns. Null and empty texts are one group. Long texts are compared whole.
    An empty table gives an empty one.
    """
    lost, once = similar.surplus(similar.near_duplicates(docs, budget=DEDUP_BITS))
    mark = similar.row_mark(F.col("doc_id"), F.col("text"))
    marked = docs.withColumn("__mark", mark)
    stay = marked.join(narrow(lost.withColumnRenamed("mark", "__mark")), "__mark", "left_anti")
    once = narrow(once.withColumnRenamed("mark", "__mark"))
    repeated = stay.join(once, "__mark", "left_semi").groupBy("__mark").agg(F.min(F.struct(*[name(c) for c in docs.columns])).alias("__row"))
    columns = [name(c) for c in docs.columns]
    return stay.join(once, "__mark", "left_anti").select(*columns).unionByName(repeated.select("__row.*").select(*columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth belongs to benchmark passages.

    Each row is judged by itself and whole; exactly a twentieth is too much.
    Texts without words stay, all do if the benchmark is empty, and an empty
    table gives an empty one.
    """
    judge = lambda d: decontaminate.contamination(d, table(spark, sf_dir, "benchmark"))
    return _judged(docs, judge, decontaminate.FIELDS, ~decontaminate.is_contaminated())


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked that are not widely copied examples; n_chars follows the text.

    Of overlapping findings one mask stands. Repeated rows are masked alike and
    count once by owner; a null source is an owner without a name. Texts are
    searched whole; null ones stay null. An empty table gives an empty one.
    """
    marked = docs.withColumn("__before", F.xxhash64("text"))
    masked = secrets.redact(marked, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    length = F.when(F.xxhash64("text") == F.col("__before"), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))
    return masked.withColumn("n_chars", length).select(*[name(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, 128 segments and 4064 loss-bearing tokens.

    Long texts are cut into pieces, repeated rows packed as often as they come,
    null texts one end id. An empty table gives no piece.
    """
    return packing.digest(packed(docs, pieces=PIECES))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # trained scores, fingerprints and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's own tables, and the result of the one before, are deleted once its result is written.
    """
    docs, since = table(spark, sf_dir, "documents"), written_so_far()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
            discard(spark, since)
    return docs
