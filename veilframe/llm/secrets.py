"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found by pattern in every text. Their hashes are counted over the
whole corpus by distinct repository and owner: a value that many owners share is
a copied example, one that belongs to few owners and looks random is taken for a
live credential. Random-looking runs that no pattern announces become findings
only by that count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import name, written
from veilframe.llm.lists import between, chunks, let, running, running_sum

# The base pattern of assignments, and the least length of what is kept by kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST = {"assign": 8, "access": 16, "hex": 32}

# Maximal runs, so that asking for the least length at once finds the same matches as dropping short ones.
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"
HEX_LONG = r"[0-9a-f]{32,}"
BARE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")
TURN = "[0-9][A-Za-z]|[A-Za-z][0-9]"
TURNS = 4  # pairs of a letter and a digit in an unannounced run of one case
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|x{4,}|\*{3,}|0{6,}|123456"

MAX_OWNERS = 2  # owners up to which a value counts as theirs and not as an example
WIDE_OWNERS = 4  # owners from which a value counts as a copied example


SPAN = "struct<start:int,rank:int,end:int,kind:string,hash:string,live:boolean>"


def _matches(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Non-overlapping matches from the left: array of (start, rank, end, kind, hash, live).

    What lies between matches and the matches themselves alternate, so that
    starts are sums of lengths before. Positions are code points, ends exclusive.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    cells = F.zip_with(gaps, F.arrays_zip(found.alias("m"), values.alias("v")), lambda g, c: F.struct(g.alias("gap"), F.char_length(c["m"]).alias("n"), c["v"].alias("value")))

    def placed(cells: Column) -> Column:
        """The gap after the last match has no match beside it and falls away."""
        steps = F.transform(cells, lambda c: F.coalesce(c["gap"] + c["n"], F.lit(0)))
        starts = F.zip_with(running_sum(steps), cells, lambda before, c: F.struct((before + c["gap"]).alias("start"), c["n"].alias("n"), c["value"].alias("value")))
        long = F.filter(starts, lambda c: F.coalesce(F.char_length(c["value"]) >= LEAST.get(kind, 0), F.lit(False)))
        if kind == "bare":
            long = F.filter(long, lambda c: looks_live(c["value"]) & unannounced(c["value"]))
        return F.transform(
            long,
            lambda c: F.struct(
                c["start"].alias("start"),
                F.lit(KINDS.index(kind)).alias("rank"),
                (c["start"] + c["n"]).alias("end"),
                F.lit(kind).alias("kind"),
                F.sha2(c["value"], 256).alias("hash"),
                looks_live(c["value"]).alias("live"),
            ),
        )

    return F.when(text.rlike(pattern), let(cells, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _varied(value: Column) -> Column:
    """Ten different characters: something is left when nine have been taken out, one after the other."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(9)), value, lambda s, _: F.replace(s, F.substring(s, 1, 1), F.lit(""))) != ""


def looks_live(value: Column) -> Column:
    """Random-looking: letters and digits mixed, many different characters, no placeholder words."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & _varied(value)


def unannounced(value: Column) -> Column:
    """More is asked of a run that nothing announces: both cases, or letters and digits that take turns."""
    turns = F.char_length(value) - F.char_length(F.regexp_replace(value, TURN, ""))
    return (value.rlike("[a-z]") & value.rlike("[A-Z]")) | (turns >= 2 * TURNS)


def _apart(base: Column, bare: Column) -> Column:
    """The bare runs that overlap no base match. Both are sorted by start, and bare runs do not overlap each other.

    In the order of starts, a run is overlapped by what begins before it if the
    furthest end so far lies behind its start, and by what begins inside it if the
    next one is such a match.
    """

    def kept(every: Column) -> Column:
        ends = F.transform(every, lambda c: F.when(c["kind"] == "bare", F.lit(0)).otherwise(c["end"]))
        furthest = running(ends, F.lit(0), lambda s, x: F.greatest(s, x))
        following = F.concat(F.slice(every, F.lit(2), F.size(every)), F.array(F.lit(None).cast(SPAN)))
        cells = F.zip_with(F.zip_with(every, furthest, lambda c, far: F.struct(c.alias("c"), far.alias("far"))), following, lambda c, n: F.struct(c["c"].alias("c"), c["far"].alias("far"), n.alias("n")))
        free = lambda x: (x["far"] <= x["c"]["start"]) & F.coalesce((x["n"]["kind"] == "bare") | (x["n"]["start"] >= x["c"]["end"]), F.lit(True))
        return F.transform(F.filter(cells, lambda x: (x["c"]["kind"] == "bare") & free(x)), lambda x: x["c"])

    return F.when((F.size(base) > 0) & (F.size(bare) > 0), let(F.array_sort(F.concat(base, bare)), kept)).otherwise(bare)


def scanned(docs: DataFrame, id_col: str, text_col: str, repo: Column, owner: Column) -> DataFrame:
    """(id, key, repo, owner, base, bare) of every row, without its text, written to the shared folder.

    ``key`` is the same for rows of equal id and text only, so it may be joined on.
    """
    text = F.coalesce(name(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        name(id_col).alias("id"),
        row_key(id_col, text_col).alias("key"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.array_sort(F.concat(_matches(text, "assign", ASSIGN, 2), _matches(text, "access", ACCESS_LONG), _matches(text, "hex", HEX_LONG))).alias("base"),
        _matches(text, "bare", BARE).alias("bare"),
    )
    return written(rows.withColumn("bare", let(F.struct("base", "bare"), lambda r: _apart(r["base"], r["bare"]))), "secrets")


def row_key(id_col: str, text_col: str) -> Column:
    return F.concat_ws(":", F.coalesce(name(id_col).cast("string"), F.lit("")), F.hex(F.xxhash64(name(text_col))))


def ownership(rows: DataFrame) -> DataFrame:
    """(hash, n_rows, n_repos, n_owners) of every candidate value of the corpus.

    Rows are first reduced to one per value, repository and owner, before they
    are shuffled, so that a value in a third of all documents is counted in many tasks.
    """
    each = rows.select("repo", "owner", F.explode(F.concat("base", "bare")).alias("c")).select("repo", "owner", F.col("c.hash").alias("hash"))
    pairs = each.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def verdict(max_owners: int = MAX_OWNERS, wide_owners: int = WIDE_OWNERS) -> Column:
    """``example`` (widely copied), ``live`` (few owners, random-looking) or ``unclear``."""
    return F.when(F.col("n_owners") >= wide_owners, "example").when((F.col("n_owners") <= max_owners) & F.col("live"), "live").otherwise("unclear")


def findings(rows: DataFrame, max_owners: int = MAX_OWNERS, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """One row per finding: id, key, kind, start, end, hash, n_rows, n_repos, n_owners, verdict.

    Base matches are all findings; bare runs are only if they are live.
    """
    each = rows.select("id", "key", F.explode(F.concat("base", "bare")).alias("c")).select("id", "key", "c.*")
    judged = each.join(ownership(rows), "hash").withColumn("verdict", verdict(max_owners, wide_owners))
    return judged.where("kind <> 'bare' or verdict = 'live'")


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    max_owners: int = MAX_OWNERS,
    wide_owners: int = WIDE_OWNERS,
) -> DataFrame:
    """(id, key, base, added, findings) of every row: its base matches, the bare runs that are live, and both with their verdicts.

    Arrays hold (start, rank, end, kind, hash, live), ``findings`` (n_owners,
    verdict) as well; they are sorted. Texts are searched whole. Null texts have no
    findings; null repositories and owners are one unnamed one. Repeated rows
    count once by owner and keep their own results. Only ``id_col``, ``text_col``
    and what ``repo`` and ``owner`` name (without them: nobody's) are read.
    """
    rows = scanned(docs, id_col, text_col, repo if repo is not None else F.lit(""), owner if owner is not None else F.lit(""))
    return _judged(rows, max_owners, wide_owners)


def _judged(rows: DataFrame, max_owners: int, wide_owners: int) -> DataFrame:
    """Rows without candidates are never shuffled; the others meet the verdicts on theirs by key."""
    every, n = F.concat("base", "bare"), F.size("base") + F.size("bare")
    some = rows.where(n > 0)
    each = some.select("key", F.explode(every).alias("c")).distinct().select("key", "c.*")
    judged = each.join(ownership(rows), "hash").withColumn("verdict", verdict(max_owners, wide_owners))
    judged = judged.where("kind <> 'bare' or verdict = 'live'")
    found = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "hash", "live", "n_owners", "verdict"))).alias("findings"))
    none = F.array().cast(found.schema["findings"].dataType)
    added = F.transform(F.filter("findings", lambda c: c["kind"] == "bare"), lambda c: F.struct(*[c[f].alias(f) for f in ("start", "rank", "end", "kind", "hash", "live")]))
    joined = some.join(found, "key", "left").withColumn("findings", F.coalesce("findings", none)).select("id", "key", "base", added.alias("added"), "findings")
    return joined.unionByName(rows.where(n == 0).select("id", "key", "base", F.array().cast(f"array<{SPAN}>").alias("added"), none.alias("findings")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _judged_as(kind: str) -> Column:
    return F.size(F.filter("findings", lambda c: c["verdict"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a result of :func:`secrets`, and how many findings are live and widely copied."""
    every = F.array_sort(F.concat("base", "added"))
    return found.select(
        F.col("id").alias("doc_id"),
        _count("assign"),
        _count("access"),
        _count("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        _judged_as("live"),
        _judged_as("example"),
    )


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each of the sorted spans (start, end) replaced; overlapping ones become one.

    A span that begins before the furthest end so far belongs to the one before.
    """

    def pieces(spans: Column, parts: Column) -> Column:
        ends = F.transform(spans, lambda c: c["end"])
        cells = F.zip_with(spans, running(ends, F.lit(0), lambda s, x: F.greatest(s, x)), lambda c, at: F.struct(c["start"].alias("start"), at.alias("at")))
        kept = F.transform(F.filter(cells, lambda c: c["start"] >= c["at"]), lambda c: F.concat(between(parts, c["at"], c["start"]), F.lit(mask)))
        rest = between(parts, F.array_max(ends), F.char_length(text))
        return F.concat(F.array_join(kept, ""), rest)

    return F.when(F.size(spans) > 0, let(chunks(text), lambda parts: let(spans, lambda own: pieces(own, parts)))).otherwise(text)


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    wide_owners: int = WIDE_OWNERS,
) -> DataFrame:
    """``docs`` with every finding masked that is not a widely copied example; no row goes.

    Rows without any candidate pass by untouched and are never shuffled.
    """
    rows = scanned(docs, id_col, text_col, repo if repo is not None else F.lit(""), owner if owner is not None else F.lit(""))
    bad = findings(rows, wide_owners=wide_owners).where("verdict <> 'example'").select("key", F.struct("start", "end").alias("span")).distinct()
    spans = bad.groupBy(F.col("key").alias("__marked")).agg(F.array_sort(F.collect_list("span")).alias("__spans"))
    text = F.coalesce(name(text_col).cast("string"), F.lit(""))
    hit = text.rlike(ASSIGN) | text.rlike(ACCESS_LONG) | text.rlike(HEX_LONG) | text.rlike(BARE)
    dirty = docs.where(hit).withColumn("__key", row_key(id_col, text_col)).join(spans, F.col("__key") == F.col("__marked"), "left")
    fixed = F.when(F.col("__spans").isNull(), name(text_col)).otherwise(masked(text, F.col("__spans")))
    dirty = dirty.withColumn(text_col, fixed).select(*[name(c) for c in docs.columns])
    return docs.where(~hit).unionByName(dirty)


def oracle(max_owners: int = MAX_OWNERS) -> str:
    """DuckDB SQL for :func:`digest` of documents with distinct ids, owned by their source."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    live = f"""(regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10 AND NOT regexp_matches(v, {quoted(PLACEHOLDER)}))"""
    unannounced = f"(regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')) OR length(v) - length(regexp_replace(v, '{TURN}', '', 'g')) >= {2 * TURNS}"
    size = "list_sum(list_transform(list_slice({}, 1, {}), lambda x: length(x)))"

    def found(kind: str, pattern: str, group: int) -> str:
        start = f"({size.format('gaps', 'i')} + coalesce({size.format('found', 'i - 1')}, 0))::BIGINT"
        return f"""SELECT doc_id, source, '{kind}' AS kind, {KINDS.index(kind)} AS rank, {start} AS s, {start} + length(found[i]) AS e, v[i] AS v
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, source, regexp_split_to_array(text, {quoted(pattern)}) AS gaps,
          regexp_extract_all(text, {quoted(pattern)}) AS found, regexp_extract_all(text, {quoted(pattern)}, {group}) AS v FROM documents WHERE regexp_matches(text, {quoted(pattern)})))"""

    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e)"
    return f"""WITH base AS (SELECT * FROM ({found("assign", ASSIGN, 2)}) WHERE length(v) >= {LEAST["assign"]}
      UNION ALL {found("access", ACCESS_LONG, 0)} UNION ALL {found("hex", HEX_LONG, 0)}),
    bare AS (SELECT * FROM ({found("bare", BARE, 0)}) r WHERE {live} AND ({unannounced})
      AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = r.doc_id AND base.s < r.e AND r.s < base.e)),
    owners AS (SELECT v, count(DISTINCT coalesce(source, '')) AS n FROM (SELECT * FROM base UNION ALL SELECT * FROM bare) GROUP BY v),
    every AS (SELECT base.*, n FROM base JOIN owners USING (v) UNION ALL SELECT bare.*, n FROM bare JOIN owners USING (v) WHERE n <= {max_owners}),
    b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, {listed} AS l FROM base GROUP BY doc_id),
    x AS (SELECT doc_id, {listed} AS spans, count(*) FILTER (n <= {max_owners} AND {live}) AS live, count(*) FILTER (n >= {WIDE_OWNERS}) AS wide FROM every GROUP BY doc_id)
    SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(l, '')) AS base_sha256, coalesce(spans, '') AS spans,
      coalesce(live, 0) AS n_live, coalesce(wide, 0) AS n_example FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)"""
