"""Toxicity by multiple-instance learning.

A document is toxic if any of its sentences is. Sentence probabilities are
logistic in the sentence's words and combined by noisy-or; the weights are
trained from document labels alone, and then locate the offending sentences.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import append_columns, forget, name, small_batches

TRAIN_ROWS = 12_000  # labelled documents on which the model is fitted, at most
TRAIN_BYTES = 48 << 20  # of UTF-8 text in them, at most
LEAST_DOCS = 4  # occurrences by word and training document without which a weight could not be told from chance
BEGINNINGS = range(4, 9)  # letters of the beginnings of a word that are features
REMEMBERED = 300_000  # words whose weight a worker remembers
FLIPPED = 0.03  # share of labels taken to be wrong
EPOCHS = 200
SENTENCES = 32_768  # whose words are summed at a time

_FOLD = {i: chr(i).lower() if chr(i).isalpha() else "\n" if chr(i) in ".!?;\n\r" else " " for i in range(128)}

FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("worst", T.DoubleType()),
    T.StructField("toxic_starts", T.ArrayType(T.IntegerType())),
    T.StructField("toxic_ends", T.ArrayType(T.IntegerType())),
    T.StructField("toxic_scores", T.ArrayType(T.DoubleType())),
]


def folded(text: str) -> str:
    """ASCII in lower case; sentence ends are line ends, other marks and digits spaces. The length stays."""
    out = text.translate(_FOLD)
    return out if out.isascii() else "".join(c if c.isascii() or len(c.lower()) != 1 else c.lower() for c in out)


def sentences(line: str) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [set(w) for s in line.split("\n") if (w := s.split())]


def features(word: str) -> list[str]:
    """A word and its beginnings: stems carry over to words not seen in training."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if k <= len(word)]]


class _Words(dict):
    """Summed weights by word, filled as words come."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self._weights = weights

    def __missing__(self, word: str) -> float:
        out = sum(self._weights.get(f, 0.0) for f in features(word))
        if len(self) < REMEMBERED:
            self[word] = out
        return out


@dataclass
class Model:
    """Weights of features and the bias of a sentence."""

    bias: float = -8.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._words = _Words(self.weights)

    def odds(self, words) -> float:
        return self.bias + sum(map(self._words.__getitem__, words))

    def score(self, text: str) -> tuple[float, list[float]]:
        """The noisy-or of all sentences, and the log odds of each with words."""
        odds = [self.odds(words) for words in sentences(folded(text))]
        clean = math.fsum(-_softplus(z) for z in odds)
        return -math.expm1(clean), odds

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the offending sentences, in code points."""
        found = []
        for m in re.finditer("[^\n]+", folded(text)):
            if words := m.group().split():
                p = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.odds(set(words))))))
                if p >= least:
                    found.append((m.start(), m.end(), p))
        return found


def _softplus(z: float) -> float:
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def fit(rows: Iterable[tuple[str, int]], epochs: int = EPOCHS) -> Model:
    """Maximise the likelihood of (partly wrong) labels of documents under the noisy-or, by Adam over all of them.

    Texts are read once and let go; only their words' numbers are kept.
    """
    words: dict[str, int] = {}
    labels = array("b")
    counts, columns, lengths, owners = array("i"), array("i"), array("i"), array("i")
    for doc, (text, label) in enumerate(rows):
        labels.append(int(label > 0))
        bag = sentences(folded(text))
        for word in set().union(*bag):
            if words.setdefault(word, len(words)) == len(counts):
                counts.append(0)
            counts[words[word]] += 1
        for sentence in bag:
            columns.extend(map(words.__getitem__, sentence))
            lengths.append(len(sentence))
            owners.append(doc)
    if not any(labels) or not owners:
        return Model()
    index: dict[str, int] = {}
    part_words, parts = array("i"), array("i")
    for word, i in words.items():
        if counts[i] >= LEAST_DOCS:
            part_words.append(i)
            parts.append(index.setdefault(word, len(index)))
    for k in BEGINNINGS:
        shares: dict[str, int] = {}  # of beginnings of one length at a time
        for word, i in words.items():
            if k <= len(word):
                shares[word[:k]] = shares.get(word[:k], 0) + counts[i]
        for word, i in words.items():
            if k <= len(word) and shares[word[:k]] >= LEAST_DOCS:
                part_words.append(i)
                parts.append(index.setdefault(word[:k] + "*", len(index)))
        del shares
    n_words = len(words)
    words.clear()
    column, length, owner, part_word, part = (np.frombuffer(c, np.int32) if c else np.zeros(0, np.int32) for c in (columns, lengths, owners, part_words, parts))
    first = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    starts = np.flatnonzero(np.diff(owner, prepend=-1))  # of documents among the sentences
    cuts = starts[np.unique(np.searchsorted(starts, np.arange(0, len(length), SENTENCES)).clip(max=len(starts) - 1))]
    blocks = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(length)], strict=True))  # of whole documents
    y = np.array(labels, np.float64)
    w, bias = np.zeros(len(index)), -6.0
    moments = [np.zeros(len(index) + 1), np.zeros(len(index) + 1)]
    share, strength = 1.0 - 2.0 * FLIPPED, 2e-5
    for step in range(1, epochs + 1):
        by_word, pull, pushed = _added(part_word, w, part, n_words), np.zeros(n_words), 0.0
        for i, j in blocks:
            tokens, doc = column[first[i] : first[j]], owner[i:j] - owner[i]
            z = np.clip(bias + np.add.reduceat(by_word[tokens], first[i:j] - first[i]), -40, 40)
            clean = np.exp(np.bincount(doc, -np.logaddexp(0, z)))
            observed = FLIPPED + share * (1.0 - clean)
            slope = np.where(y[owner[i] : owner[i] + len(clean)] > 0, share / observed, -share / (1.0 - observed)) * clean
            push = slope[doc] / (1.0 + np.exp(-z))
            pull += np.bincount(tokens, np.repeat(push, length[i:j]), n_words)
            pushed += push.sum()
        gradient = np.append(_added(part, pull, part_word, len(index)), pushed) / len(y)
        gradient[:-1] -= strength * np.sign(w) + strength * w
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        rate = 0.15 if step < 0.7 * epochs else 0.03
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-7)
        w, bias = w + move[:-1], bias + move[-1]
    return Model(float(bias), {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 0.02})


def _added(place: np.ndarray, values: np.ndarray, source: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values[source]`` by place, a bounded number at a time."""
    out = np.zeros(n)
    for lo in range(0, len(place), 1 << 18):
        part = slice(lo, lo + (1 << 18))
        out += np.bincount(place[part], values[source[part]], n)
    return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    allowed: Column | None = None,
    rows: int = TRAIN_ROWS,
    most_bytes: int = TRAIN_BYTES,
) -> Model:
    """Fit a model on at most ``rows`` labelled documents: those with the smallest hashes of their ids.

    ``allowed`` is a condition on the labels' id column. Rows without an id, a
    label or a document do not count; of repeated ids the largest label counts,
    and the text with the smallest hash. Documents are taken in the order of
    their hashes until the next one would exceed ``most_bytes`` of text, whatever
    the order of the table; only a text that exceeds it alone is passed over. The
    driver handles ids and sizes of the sample, one task its texts, and what comes back are
    the weights. Without toxic documents, or any, all scores are near 0.
    """
    known = labels.select(name(id_col).alias("id"), name(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if allowed is not None:
        known = known.where(allowed)
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(rows)
    texts = docs.select(name(id_col).alias("id"), F.coalesce(name(text_col).cast("string"), F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "id")  # at most ``rows`` small rows
    one = F.min(F.struct(F.xxhash64("text").alias("mark"), F.octet_length("text").cast("long").alias("size")))
    sizes = met.groupBy("id").agg(F.max("y").alias("y"), F.max("place").alias("place"), one.alias("one")).select("id", "y", "place", "one.*").collect()
    taken, size = [], 0
    for row in sorted((r for r in sizes if r["size"] <= most_bytes), key=lambda r: (r["place"], r["id"])):
        size += row["size"]
        if size > most_bytes:
            break
        taken.append((row["id"], row["mark"], row["y"], len(taken)))
    if not taken:
        return Model()
    spark = docs.sparkSession
    small_batches(spark)
    schema = T.StructType([known.schema["id"], T.StructField("mark", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("place", T.LongType())])
    sample = F.broadcast(spark.createDataFrame(taken, schema))
    rows_of = texts.withColumn("mark", F.xxhash64("text")).join(sample, ["id", "mark"]).dropDuplicates(["place"])
    one_task = rows_of.select("text", "y", "place").repartition(1).sortWithinPartitions("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = fit((t.as_py(), y) for b in batches for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True))
        features = [None, *model.weights]
        yield pa.RecordBatch.from_arrays([pa.array(features, pa.string()), pa.array([model.bias, *model.weights.values()], pa.float64())], names=["feature", "weight"])
        forget()

    weights = {r["feature"]: r["weight"] for r in one_task.mapInArrow(run, "feature string, weight double").collect()}
    return Model(weights.pop(None), weights)


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score, worst (sentence), toxic_starts, toxic_ends and toxic_scores.

    ``score`` lies in [0, 1]; null and empty texts have no sentence, so 0. The
    offending sentences are located in texts that score 0.5 or more, and are the
    worst one if none reaches one half by itself. Rows are neither joined nor
    grouped, so repeated ones keep their own results; texts of any length are
    scored whole, and an empty table gives no rows. Columns named like the new
    ones are replaced.
    """
    small_batches(docs.sparkSession)
    bias, weights = model.bias, dict(model.weights)

    def make():
        own = Model(bias, weights)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            out: list[list] = [[] for _ in FIELDS]
            for value in batch.column(batch.schema.get_field_index(text_col)):
                text = value.as_py() or ""
                score, odds = own.score(text)
                worst = 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, max(odds))))) if odds else 0.0
                spans = own.spans(text, min(0.5, worst)) if score >= 0.5 else []
                for cells, cell in zip(out, (score, worst, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]), strict=True):
                    cells.append(cell)
            kinds = (pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]

        return run

    return append_columns(docs, FIELDS, make, drop=() if keep_text else (text_col,))


def held_out(id_col: str) -> Column:
    """The fifth of ids, by CRC-32 of their text, whose labels are never learned from."""
    return F.crc32(F.coalesce(name(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of a result of :func:`scored`, and the offending sentences as code points of the text."""
    spans = F.zip_with("toxic_starts", "toxic_ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string")))
    return found.select(
        name(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.concat_ws(",", spans).alias("toxic_spans"),
    )
