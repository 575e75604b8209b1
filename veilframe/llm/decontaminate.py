"""Benchmark decontamination: which words of a document belong to passages of test items.

All items go into one Aho-Corasick automaton, and each text is scanned once.
Every window of 13 words holds one of the item's blocks of 5 words that begin at
its words 0, 9, 18, ...; the automaton's keys are these blocks and whole shorter
items, so an item is in it once and not once for each of its windows. A key that
occurs is extended word by word over text and item, and is a hit if 13 words agree. Normalising keeps
every character's place (letters are lower-cased, other ASCII becomes a space),
so that hits map back to the original text.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import append_columns, keeps, name, small_batches, written

BLOCK = 5  # words of a key
DIGIT = 1024  # a word's number is written in digits of this base, so that no node has too many children
LOT_BYTES = 32 << 20  # text of the items that are in the automaton at a time

_FOLD = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
_WORD = re.compile("[^ ]+")

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_starts", T.ArrayType(T.IntegerType())),
    T.StructField("hit_ends", T.ArrayType(T.IntegerType())),
]


def normalised(text: str) -> str:
    """The same length as ``text``: words in lower case, spaces between."""
    return text.translate(_FOLD)


def words_of(text: str) -> list[str]:
    return [w for w in normalised(text).split(" ") if w]


class _Codes(dict):
    """Words as short strings of digits, each place with an alphabet of its own; unknown words are one sign."""

    def __init__(self, words: list[str]):
        places = 2 if len(words) <= DIGIT**2 else 3
        self.places, self.unknown = places, "\uf000" * places
        super().__init__((w, "".join(chr(256 + DIGIT * j + (i // DIGIT**j) % DIGIT) for j in range(places))) for i, w in enumerate(words))

    def line(self, words: list[str]) -> str:
        return "".join(map(self.get, words, itertools.repeat(self.unknown)))

    def numbers(self, line: str) -> np.ndarray:
        """The words' numbers of a line of codes, -2 for unknown ones."""
        digits = np.frombuffer(line.encode("utf-16-le"), np.uint16).astype(np.int64).reshape(-1, self.places)
        value = ((digits - 256 - DIGIT * np.arange(self.places)) * DIGIT ** np.arange(self.places)).sum(axis=1)
        return np.where(digits[:, 0] == 0xF000, -2, value)


class Matcher:
    """Finds the words of texts that lie in windows of the items, and these items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self._window, block = window, min(BLOCK, window)
        self._ids = [item for item, _ in items]
        numbers: dict[str, int] = {}
        book, starts, at = [], [], 0
        for _, text in items:
            own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words_of(text or "")), np.int32)
            book += [own, np.array([-1], np.int32)]  # a sign that no word equals, so that nothing runs over an item's end
            starts.append(at)
            at += len(own) + 1
        side = np.full(window, -1, np.int32)
        self._edge = len(side)
        self._book = np.concatenate([side, *book, side])
        self._codes = _Codes(list(numbers))
        code = list(self._codes.values())
        del numbers
        keys: dict[str, int] = {}
        places: list[tuple[int, int, int]] = []  # (key, place in the book, item)
        for k, (start, own) in enumerate(zip(starts, book[::2], strict=True)):
            n = len(own)
            size = block if n >= window else n
            firsts = range(0, n - size + 1, window - block + 1) if n >= window else range(min(n, 1))
            for i in firsts:
                key = "".join([code[w] for w in own[i : i + size].tolist()])
                places.append((keys.setdefault(key, len(keys)), start + i, k))
        del book, code
        self._built = None
        if keys:
            self._built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for key, i in keys.items():
                self._built.add_word(key, i)
            self._sizes = np.array([len(key) // self._codes.places for key in keys], np.int32)
            keys.clear()
            self._built.make_automaton()
            order = np.array(sorted(places), np.int64).reshape(-1, 3)
            self._of = np.searchsorted(order[:, 0], np.arange(len(self._sizes) + 1))
            self._at, self._item = order[:, 1] + self._edge, order[:, 2]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of ``text``, merged runs of hit words (first, last), and the items that occur."""
        words = words_of(text)
        if self._built is None or not words:
            return len(words), [], set()
        line, places = self._codes.line(words), self._codes.places
        runs, found, own = [], set(), None
        for end, key in self._built.iter(line):
            if own is None:
                side = np.full(self._edge, -3, np.int64)
                own = np.concatenate([side, self._codes.numbers(line), side])
            first = (end + 1) // places - int(self._sizes[key])
            run, items = self._extended(own, first, key)
            runs += run
            found.update(items)
        return len(words), merged(runs), {self._ids[i] for i in found if self._ids[i] is not None}

    def _extended(self, own: np.ndarray, first: int, key: int) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs around a key's place in a text, and their items. A window that holds the key reaches ``window - size`` words beyond it."""
        size, window = int(self._sizes[key]), self._window
        lo, hi = self._of[key], self._of[key + 1]
        at, item, here = self._at[lo:hi], self._item[lo:hi], first + self._edge
        reach = np.arange(1, window - size + 1)
        before = np.logical_and.accumulate(self._book[at[:, None] - reach] == own[here - reach], axis=1).sum(axis=1)
        after = np.logical_and.accumulate(self._book[at[:, None] + size - 1 + reach] == own[here + size - 1 + reach], axis=1).sum(axis=1)
        # Whole short items begin and end at the book's signs and need nothing around them.
        short = (self._book[at - 1] == -1) & (self._book[at + size] == -1)
        full = before + size + after >= window
        runs = {(first - a, first + size + b - 1) for a, b in zip(before[full].tolist(), after[full].tolist(), strict=True)}
        if short.any():
            runs.add((first, first + size - 1))
        return list(runs), set(item[full | short].tolist())


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _lots(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lots of at most ``limit`` bytes of text (or one item)."""
    text = name(item_text).cast("string")
    rows = benchmark.select(name(item_id).cast("string").alias("item"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("size"))
    lot, size = [], 0
    for row in rows.toLocalIterator():
        if lot and size + row["size"] > limit:
            yield lot
            lot, size = [], 0
        lot.append((row["item"], row["text"]))
        size += row["size"]
    yield lot


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    lot_bytes: int = LOT_BYTES,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items and hit_starts / hit_ends (code points of the text).

    A word is hit if it lies in an occurrence of ``window`` consecutive words of
    an item, or of a whole shorter item. A benchmark of up to ``lot_bytes`` of
    text, which all known ones together do not reach, is one automaton and one
    scan without a shuffle. Larger ones are taken in lots of that size: after
    each, the rows are written, and the next one adds to their hits. The driver
    holds two lots at most, a Python worker one, built once per process.

    Null texts have no words; an empty benchmark hits nothing; repeated items
    count once by id, and items without an id hit words but are not listed.
    Rows are never joined or grouped, so repeated rows and repeated ids stay as
    they are; columns of ``docs`` named like the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    out = docs
    for k, items in enumerate(_lots(benchmark, item_id, item_text, lot_bytes)):
        if k:
            out = written(out, "contamination")
        out = append_columns(out, FIELDS, _worker(items, text_col, window, first=k == 0))
    return out if keep_text else out.drop(text_col)


_BUILT: dict[str, Matcher] = {}  # the last one of this Python process
keeps(__name__, _BUILT)


def _worker(items: list[tuple[str | None, str | None]], text_col: str, window: int, first: bool):
    mark = uuid.uuid4().hex

    def make():
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = Matcher(items, window)
        matcher = _BUILT[mark]

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            column = lambda n: batch.column(batch.schema.get_field_index(n))
            out: list[list] = [[], [], [], [], []]
            before = zip(column("hit_items").to_pylist(), column("hit_starts").to_pylist(), column("hit_ends").to_pylist(), strict=True) if not first else None
            for value in column(text_col):
                text = value.as_py() or ""
                n, runs, ids = matcher.scan(text)
                old_ids, old_starts, old_ends = next(before) if before else ([], [], [])
                starts, ends, hit = [], [], 0
                if runs or old_starts:
                    places = [m.span() for m in _WORD.finditer(normalised(text))]
                    index = {a: i for i, (a, _) in enumerate(places)} if old_starts else {}
                    ending = {b: i for i, (_, b) in enumerate(places)} if old_starts else {}
                    runs = merged(runs + [(index[a], ending[b]) for a, b in zip(old_starts, old_ends, strict=True)])
                    starts, ends = [places[a][0] for a, _ in runs], [places[b][1] for _, b in runs]
                    hit = sum(b - a + 1 for a, b in runs)
                for cell, made in zip(out, (n, hit, sorted(ids.union(old_ids)), starts, ends), strict=True):
                    cell.append(made)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]

        return run

    return make


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of a result of :func:`contamination`, and the merged hits as code points of the text."""
    return found.select(
        name(id_col).alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
        F.concat_ws(",", F.zip_with("hit_starts", "hit_ends", lambda a, b: F.concat_ws(":", a.cast("string"), b.cast("string")))).alias("hit_spans"),
    )


def is_contaminated() -> Column:
    """At least a twentieth of the words, and at least one, is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def oracle(window: int = 13) -> str:
    """DuckDB SQL for :func:`digest` of documents with distinct ids."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded, word = f"translate(coalesce(text, ''), '{upper}', '{lower}')", "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"
    words = f"regexp_extract_all({folded}, {word})"
    return f"""WITH d AS (SELECT doc_id, {words} AS w, regexp_split_to_array({folded}, {word}) AS gaps FROM documents),
    b AS (SELECT item_id, w, least({window}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    runs AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
    seen AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS run
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM runs) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, i, seen.k, item_id FROM seen JOIN runs USING (k, run)),
    places AS (SELECT DISTINCT doc_id, place FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM hits)),
    words AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
    isles AS (SELECT doc_id, min(place) AS a, max(place) AS b FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS isle FROM places) GROUP BY doc_id, isle),
    spans AS (SELECT doc_id, string_agg(s || ':' || e, ',' ORDER BY s) AS hit_spans FROM (SELECT doc_id,
      (list_sum(list_transform(list_slice(gaps, 1, a), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(w, 1, a - 1), lambda x: length(x))), 0))::BIGINT AS s,
      (list_sum(list_transform(list_slice(gaps, 1, b), lambda x: length(x))) + list_sum(list_transform(list_slice(w, 1, b), lambda x: length(x))))::BIGINT AS e
      FROM isles JOIN d USING (doc_id)) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(hit_spans, '') AS hit_spans
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)"""
