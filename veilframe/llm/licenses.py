"""Licence scans in DataFrame functions alone.

Licence-like sentences and comment blocks of a document, and the whole text of documents that have
one, are compared with templates by the cosine of sparse TF-IDF vectors. A text
that as a whole is a template is a licence file and covers its directory; other
documents take the licence of the nearest directory above them that has one.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import BROADCAST_ROWS, checkpointed, name, written

# Public licence notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
]
# Standard headers of source files, a paragraph each.
GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
HEADERS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", GNU.format("program", "", "3")),
    ("GPL-2.0", GNU.format("program", "", "2")),
    ("LGPL-3.0", GNU.format("library", "Lesser ", "3")),
    ("LGPL-2.1", GNU.format("library", "Lesser ", "2.1")),
    ("AGPL-3.0", GNU.format("program", "Affero ", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
]
LEADER = r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|;+|--+|%+|dnl\b|<!--)(.*)$"
MARK = "\x01"
PARAGRAPH = r"\n[\x01\s]*\n|\x01\n(?!\x01)|(?<!\x01)\n\x01"
HINT = r"(?i)licen[sc]e|copyright|spdx|public domain|permission is hereby|redistribution and use"
WRAPPED = r"(?i)free software|source code form"  # begins a header whose licence words may be wrapped
SENTENCE = r"\n+|(?<=[.!?;])\s+"
WORD = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"  # possessive: Java does not recurse for each part of a long dotted word
SIMILAR = 0.8
SALTS = 32


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of whole licence files. The Affero text is the GNU one under its own name."""
    folder = Path(__file__).parent / "licence_texts"
    texts = [(path.stem, path.read_text()) for path in sorted(folder.glob("*.txt"))]
    named = [("AGPL-3.0", re.sub("(?i)GNU (?=General)", "GNU Affero ", text)) for lic, text in texts if lic == "GPL-3.0"]
    two = [("BSD-2-Clause", re.sub(r"(?s)3\. Neither.*?permission\.\s", "", text)) for lic, text in texts if lic == "BSD-3-Clause"]
    return texts + named + two


def templates(spark: SparkSession) -> DataFrame:
    """(template, license, words); a table of fixed size."""
    rows = spark.createDataFrame([(i, lic, text) for i, (lic, text) in enumerate(TEMPLATES + HEADERS + full_texts())], "template int, license string, text string")
    return rows.select("template", "license", _words(F.col("text")).alias("words"))


def directory_of(path: Column) -> Column:
    """All but the last part of a path; the top directory is the empty text."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """(directory, parts) of a directory and all above it, the top one last."""
    parts = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("folder"), n.alias("parts")))


def passages(docs: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """(id, path, sentences, blocks, whole, key) of every row, written; words stay only where there is a hint.

    ``key`` is the MD5 of ``whole``: what follows carries keys and not texts.
    """
    text = F.coalesce(name(text_col).cast("string"), F.lit(""))
    hint = text.rlike(HINT)
    sentences = F.filter(F.split(text, SENTENCE), lambda s: s.rlike(HINT))
    marked = F.regexp_replace(F.regexp_replace(text, "\r", ""), LEADER, f"{MARK}$1{MARK}")
    blocks = F.filter(F.split(marked, PARAGRAPH), lambda s: s.rlike(HINT) | s.rlike(WRAPPED))
    rows = docs.select(
        name(id_col).alias("id"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.when(hint, F.array_distinct(F.transform(sentences, lambda s: F.array_join(_words(s), " ")))).alias("sentences"),
        F.when(hint, F.array_distinct(F.transform(blocks, lambda s: F.array_join(_words(s), " ")))).alias("blocks"),
        F.when(hint, F.array_join(_words(text), " ")).alias("whole"),
    )
    return written(rows.withColumn("key", F.md5("whole")), "licences")


def frequencies(docs: DataFrame, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """(term, df): in how many of all documents each term of the vocabulary occurs. Counts are combined before they are shuffled."""
    words = F.array_distinct(_words(F.coalesce(name(text_col).cast("string"), F.lit(""))))
    counted = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(vocabulary, "term", "left_semi")


def _scores(docs: DataFrame, text_col: str, total: int, texts: DataFrame, similar: float) -> DataFrame:
    """(passage, header, template, license, cosine): the best template of each distinct passage, headers apart.

    ``texts`` has (passage, words): the keys of distinct passages and their
    words. Document frequencies count all ``total`` documents, for the terms of
    passages and templates. Passages are numbered, so that long keys are not
    repeated for each word.
    """
    known = templates(docs.sparkSession)
    numbered = written(texts.select(F.monotonically_increasing_id().alias("no"), "passage", "words"), "licence-passages")
    keys = numbered.select("no", "passage")
    terms = numbered.select(F.col("no").alias("passage"), F.explode(F.split("words", " ")).alias("term")).groupBy("passage", "term").agg(F.count(F.lit(1)).alias("tf"))
    wanted = known.select("template", "license", F.explode("words").alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = numbered.select(F.explode(F.array_distinct(F.split("words", " "))).alias("term")).unionByName(wanted.select("term")).distinct()
    df = checkpointed(frequencies(docs, text_col, vocabulary))
    weight = F.col("tf") * (F.log((F.lit(1.0) + F.lit(total)) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0)
    x = terms.join(df, "term").select("passage", "term", weight.alias("x"))
    y = wanted.join(df, "term", "left").select("template", "license", "term", weight.alias("y"))
    y_norm = y.groupBy("template").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("y_norm"))
    y = F.broadcast(y.join(y_norm, "template"))  # as many rows as the templates have words
    x_norm = x.groupBy("passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("x_norm"))
    dots = x.join(y, "term").groupBy("passage", "template", "license", "y_norm").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("x_norm") * F.col("y_norm")), 9)
    scored = dots.join(x_norm, "passage").select("passage", F.struct(cosine.alias("cosine"), (-F.col("template")).alias("order"), "template", "license").alias("best"))
    header = F.col("best.template").between(len(TEMPLATES), len(TEMPLATES) + len(HEADERS) - 1)
    best = scored.groupBy("passage", header.alias("header")).agg(F.max("best").alias("best"))
    best = best.select(F.col("passage").alias("no"), "header", "best.template", "best.license", "best.cosine").where(F.col("cosine") >= similar)
    return best.join(keys, "no").drop("no")


def licences(
    docs: DataFrame,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    similar: float = SIMILAR,
) -> DataFrame:
    """(id, path, license, origin, cosine) of every row.

    ``origin`` is ``file`` (the whole text is like a template), ``header`` (a
    sentence or a paragraph of a comment is), ``inherited`` (from the nearest directory above with a licence
    file) or ``none``. Of several sentences the most similar counts, then the
    earlier template. Of several licence files in a directory the most similar
    counts, then the licence first by name.

    Null texts have no licence of their own, null paths lie in the top
    directory. Repeated rows keep their own results; an empty table gives no
    rows; texts are read whole, and columns other than those named are not read.
    Only rows with licence-like words are cut into words; distinct passages are
    compared once, and only distinct directories are joined with their ancestors.
    The licences of directories are broadcast while they are few; beyond, each is
    dealt to ``SALTS`` places, so that a directory with very many files is not in one.
    """
    rows = passages(docs, id_col, text_col, path)
    hinted = rows.where("whole is not null and whole <> ''")
    files = hinted.select(F.col("key").alias("passage"), F.col("whole").alias("words"))
    heads = hinted.select(F.explode("sentences").alias("words")).where("words <> ''").select(F.md5("words").alias("passage"), "words")
    blocks = hinted.select(F.explode("blocks").alias("words")).where("words <> ''").select(F.md5("words").alias("passage"), "words")
    texts = files.unionByName(heads).unionByName(blocks).groupBy("passage").agg(F.min("words").alias("words"))
    scores = written(_scores(docs, text_col, rows.count(), texts, similar), "licence-scores")

    whole = scores.where("not header").select(F.col("passage").alias("key"), F.struct(F.col("cosine"), F.col("license")).alias("file"))
    sentence = scores.select("passage", F.struct(F.col("cosine"), (-F.col("template")).alias("order"), F.col("license")).alias("head"))
    pairs = hinted.select("key", F.explode(F.array_union("sentences", "blocks")).alias("words")).select("key", F.md5("words").alias("passage")).distinct()
    heads_of = pairs.join(sentence, "passage").groupBy("key").agg(F.max("head").alias("head"))
    own = whole.join(heads_of, "key", "full").select("key", "file", "head")
    # Rows without a hint have no key; in the join they would all meet in one task.
    placed = rows.select("id", "path", directory_of(F.col("path")).alias("folder"), "key")
    plain = placed.where("key is null").withColumns({c: F.lit(None).cast(own.schema[c].dataType) for c in ("file", "head")})
    found = placed.where("key is not null").join(own, "key", "left").unionByName(plain)

    # Directories with a licence file; ties by cosine, then name.
    covers = found.where("file is not null").groupBy("folder").agg(F.min(F.struct((-F.col("file.cosine")).alias("order"), F.col("file.license").alias("license"))).alias("m"))
    covers = covers.select(F.col("folder").alias("above"), F.col("m.license").alias("license"), (-F.col("m.order")).alias("cosine"))
    folders = rows.select(directory_of(F.col("path")).alias("folder")).distinct()
    up = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", F.col("a.folder").alias("above"), F.col("a.parts").alias("parts"))
    nearest = up.join(covers, "above").groupBy("folder").agg(F.max(F.struct("parts", "license", "cosine")).alias("near")).select("folder", "near")
    out = _by_folder(found, checkpointed(nearest))
    origin = F.when(F.col("file").isNotNull(), "file").when(F.col("head").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "id",
        "path",
        F.coalesce("file.license", "head.license", "near.license").alias("license"),
        origin.alias("origin"),
        F.coalesce("file.cosine", "head.cosine", "near.cosine", F.lit(0.0)).alias("cosine"),
    )


def _by_folder(found: DataFrame, nearest: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of ``found`` with what is known of its folder."""
    if nearest.count() <= most:
        return found.join(F.broadcast(nearest), "folder", "left")
    dealt = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(dealt, ["folder", "salt"], "left").drop("salt")


def oracle(similar: float = SIMILAR) -> str:
    """DuckDB SQL for :func:`licences` of documents with distinct ids under source/language/id."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    words = lambda x: f"regexp_extract_all(lower({x}), {quoted(WORD.replace('++', '+').replace('*+', '*'))})"
    known = ", ".join(f"({i}, {quoted(lic)}, {quoted(text)})" for i, (lic, text) in enumerate(TEMPLATES))
    cut = r"regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '\n+')"
    weight = "tf * (ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0)"
    return f"""WITH known AS (SELECT template, license, term, count(*) AS tf FROM (SELECT template, license, unnest({words("txt")}) AS term FROM (VALUES {known}) t(template, license, txt)) GROUP BY ALL),
    hinted AS (SELECT doc_id, text, array_to_string({words("text")}, ' ') AS whole FROM documents WHERE regexp_matches(text, {quoted(HINT)})),
    heads AS (SELECT DISTINCT doc_id, array_to_string({words("x")}, ' ') AS passage FROM (SELECT doc_id, unnest({cut}) AS x FROM hinted) WHERE regexp_matches(x, {quoted(HINT)})),
    texts AS (SELECT DISTINCT passage FROM (SELECT whole AS passage FROM hinted UNION ALL SELECT passage FROM heads) WHERE passage <> ''),
    terms AS (SELECT passage, term, count(*) AS tf FROM (SELECT passage, unnest(string_split(passage, ' ')) AS term FROM texts) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({words("coalesce(text, '')")})) AS term FROM documents) GROUP BY term), total AS (SELECT count(*) AS total FROM documents),
    x AS (SELECT passage, term, {weight} AS x FROM terms JOIN df USING (term), total),
    y AS (SELECT template, license, term, {weight} AS y FROM known LEFT JOIN df USING (term), total),
    xn AS (SELECT passage, sqrt(sum(x * x)) AS xn FROM x GROUP BY passage), yn AS (SELECT template, sqrt(sum(y * y)) AS yn FROM y GROUP BY template),
    scores AS (SELECT * FROM (SELECT passage, template, license, round(sum(x * y) / (any_value(xn) * any_value(yn)), 9) AS cosine
      FROM x JOIN y USING (term) JOIN xn USING (passage) JOIN yn USING (template) GROUP BY passage, template, license)
      WHERE cosine >= {similar} QUALIFY row_number() OVER (PARTITION BY passage ORDER BY cosine DESC, template) = 1),
    file AS (SELECT doc_id, license, cosine FROM hinted JOIN scores ON whole = passage),
    head AS (SELECT doc_id, license, cosine FROM heads JOIN scores USING (passage) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, template) = 1),
    d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, concat_ws('/', source, lang) AS folder FROM documents),
    covers AS (SELECT folder AS above, license, cosine FROM d JOIN file USING (doc_id) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, license) = 1),
    up AS (SELECT folder, parts, array_to_string(list_slice(string_split(folder, '/'), 1, parts), '/') AS above FROM (SELECT DISTINCT folder FROM d), (SELECT unnest(range(0, 3)) AS parts)),
    near AS (SELECT folder, license, cosine FROM up JOIN covers USING (above) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY parts DESC) = 1)
    SELECT d.doc_id, path, coalesce(file.license, head.license, near.license) AS license,
      CASE WHEN file.license IS NOT NULL THEN 'file' WHEN head.license IS NOT NULL THEN 'header' WHEN near.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
      coalesce(file.cosine, head.cosine, near.cosine, 0.0)::DOUBLE AS cosine
    FROM d LEFT JOIN file USING (doc_id) LEFT JOIN head USING (doc_id) LEFT JOIN near USING (folder)"""
