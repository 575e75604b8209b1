"""The queries ``opN_<name>``: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import chat, decontaminate, licenses, neighbours, packing, secrets, sharding, simhash, token_store, toxicity

PROMPT = 32  # tokens of a document that bear no loss

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the store of all documents and reads it back."""
    folder = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return token_store.digest_of(token_store.read_store(spark, folder))


def packed(docs: DataFrame, pieces: int | None = None) -> DataFrame:
    """Pieces of ``docs`` under limits that all can bind: the first 32 tokens of a document are its prompt and bear no loss."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), limits=packing.Limits(loss=4096 - PROMPT), loss_from=F.lit(PROMPT), pieces=pieces)


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, 128 segments and 4064 loss-bearing tokens at most."""
    return packing.digest(packed(table(spark, sf_dir, "documents")))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return decontaminate.digest(found)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, fingerprints of three words, at most two bits apart."""
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


@query
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages of ``conversations``."""
    return chat.format_chat(table(spark, sf_dir, "conversations"))


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; source, language and id stand for owner, folder and file."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.licences(table(spark, sf_dir, "documents"), path).withColumnRenamed("id", "doc_id")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; their source is the owner, source and language are the repository."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source")))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of at most 1 MiB of text."""
    return sharding.assign(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op10_sharding"] = sharding.SQL


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels"), allowed=~toxicity.held_out("id"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a model that has not seen the labels of the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.scored(docs, toxicity_model(spark, docs, sf_dir), keep_text=False))


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors at a cosine of 0.95."""
    return neighbours.digest(neighbours.near_duplicates(table(spark, sf_dir, "embeddings")))
ORACLES["op8_secrets"] = secrets.oracle()
ORACLES["op9_decontamination"] = decontaminate.oracle()
ORACLES["op5_licences"] = licenses.oracle()
