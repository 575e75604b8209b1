"""Components, NN-descent, toxicity, the pipeline and the registered queries."""

import glob
import math
import os
import random
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import common, neighbours, queries, toxicity
from veilframe.llm.components import components

SF = "/root/testdata/sf0.001"


def brute_roots(edges):
    at = {}

    def root(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {x: root(x) for x in at}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape):
    rng = random.Random(shape)
    edges = {
        "chain": [(i, i + 1) for i in range(70)],
        "star": [(500, i) for i in range(60)],
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)],
        "loops": [(3, 3), (1, 2), (2, 1), (1, 2)],
    }[shape]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges + [(None, 4)], "a long, b long")).collect()}
    assert got == brute_roots([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n, dims, groups):
    rows = [rng.standard_normal(dims) for _ in range(n)]
    for size, spread in groups:
        centre = rng.standard_normal(dims)
        rows += [centre + spread * rng.standard_normal(dims) for _ in range(size)]
    return [r.astype(np.float32).astype(float).tolist() for r in rows]


def check_links(got, ids, data, threshold=0.95):
    x = np.array(data)
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(n, n) >= threshold
    np.fill_diagonal(near, False)
    edges = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)]
    roots = brute_roots(edges)
    for k, i in enumerate(ids):
        assert got[i].n_links == near[k].sum() and got[i].component_id == roots.get(i, i) and got[i].kept == (roots.get(i, i) == i)


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = vectors(rng, 150, 16, [(2, 0.05), (3, 0.05), (60, 0.1), (40, 0.2)])
    data += [data[3], data[3], [3 * v for v in data[4]]]
    ids = [int(i) for i in rng.permutation(len(data))]
    odd = [(900, None), (901, [0.0] * 16), (902, [1.0] * 15 + [None]), (903, [1.0] * 15 + [float("nan")]), (904, []), (905, [float("inf")] + [0.0] * 15), (None, data[0]), (906, [1.0, 2.0]), (907, [2.0, 4.0])]
    frame = spark.createDataFrame([*zip(ids, data, strict=True), *odd], "vec_id long, embedding array<float>").withColumn("node", F.lit("x"))
    rows = neighbours.digest(neighbours.near_duplicates(frame)).collect()
    got = {r.vec_id: r for r in rows}
    assert len(rows) == len(data) + len(odd)
    check_links(got, ids, data)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 906))
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert (got[906].n_links, got[907].component_id) == (1, 906)


def test_counts_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(2)
    data = vectors(rng, 30, 8, [(70, 0.05)])
    frame = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    check_links({r.vec_id: r for r in neighbours.digest(neighbours.near_duplicates(frame)).collect()}, list(range(100)), data)


def two_groups(rng, size, dims=64):
    """Tight groups whose cross pairs all reach the threshold, among other vectors."""
    a, b = rng.standard_normal(dims), rng.standard_normal(dims)
    a /= np.linalg.norm(a)
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    centres = [a, 0.957 * a + np.sqrt(1 - 0.957**2) * b]
    rows = [c + 0.0002 * rng.standard_normal(dims) for c in centres for _ in range(size)]
    return [r.tolist() for r in rows] + [rng.standard_normal(dims).tolist() for _ in range(400)]


def test_full_lists_do_not_part_groups(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    monkeypatch.setattr(neighbours, "_across", lambda nodes, *_: nodes.selectExpr("node as a", "node as b").limit(0), raising=False)
    data = two_groups(np.random.default_rng(3), 60)
    frame = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    check_links({r.vec_id: r for r in neighbours.digest(neighbours.near_duplicates(frame)).collect()}, list(range(len(data))), data)


def test_a_low_audit_is_made_up_exactly(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_recall", lambda *_: 0.0)
    monkeypatch.setattr(neighbours, "_closed", lambda edges, *_: edges)
    monkeypatch.setattr(neighbours, "ROUNDS", 1)
    monkeypatch.setattr(neighbours, "CHUNK", 150)
    monkeypatch.setattr(neighbours, "_bonds", lambda *_: (np.zeros(0, np.int64),) * 2)
    data = two_groups(np.random.default_rng(4), 60)
    frame = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>")
    with pytest.warns(UserWarning, match="all vectors are compared"):
        check_links({r.vec_id: r for r in neighbours.digest(neighbours.near_duplicates(frame)).collect()}, list(range(len(data))), data)


def test_recall_is_audited_on_planted_links(spark):
    rng = np.random.default_rng(5)
    data = vectors(rng, 500, 64, [(2, 0.02)] * 60 + [(30, 0.1)] * 3 + [(7, 0.2)] * 6)
    order = rng.permutation(len(data))
    frame = spark.createDataFrame([(int(i), data[k]) for i, k in enumerate(order)], "vec_id long, embedding array<float>")
    rows = neighbours.digest(neighbours.near_duplicates(frame)).collect()
    check_links({r.vec_id: r for r in rows}, list(range(len(data))), [data[k] for k in order])
    asked = [r for r in rows if r.vec_id % 100 == 0 and r.n_links]
    assert asked and {r.recall for r in rows} == {1.0}
    lone = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(rng, 50, 64, []))], "vec_id long, embedding array<float>")
    assert {r.recall for r in neighbours.near_duplicates(lone).collect()} == {None}


def test_half_precision_stays_within_its_slack():
    rng = np.random.default_rng(6)
    for dims in (3, 64, 1024):
        x = rng.standard_normal((200, dims)) * np.exp(rng.standard_normal((200, 1)) * 8)
        x[100:] = x[:100] * (1 + 0.2 * rng.standard_normal((100, dims)))
        x[0, 1:] = 1e-9
        half = neighbours._unit(x).astype(np.float16).astype(np.float32)
        assert np.abs(half @ half.T - neighbours._cosines(x, x)).max() < neighbours.SLACK


def test_neighbours_of_nothing(spark):
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- toxicity -------------------------------------------------------------------------------
def corpus(rng, n):
    plain = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua", "ut", "enim", "minim"]
    texts, labels = [], []
    for _ in range(n):
        sentences = [" ".join(rng.choice(plain) + rng.choice(["", "x", "yz"]) for _ in range(6)) for _ in range(rng.randint(1, 9))]
        bad = rng.random() < 0.25
        if bad:
            sentences.insert(rng.randint(0, len(sentences)), "you are a " + rng.choice(["vilefoo", "vilebar", "vilequx"]) + " thing")
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad != (rng.random() < 0.02)))
    return texts, labels


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    rng = random.Random(1)
    texts, labels = corpus(rng, 600)
    model = toxicity.fit(zip(texts[:400], labels[:400], strict=True))
    scores = [model.score(t)[0] for t in texts[400:]]
    right = sum((s >= 0.5) == ("vile" in t) for s, t in zip(scores, texts[400:], strict=True))
    assert right >= 196
    unseen = "Amet magna. You VILEZZZ thing!\nLorem ipsum."
    assert model.score(unseen)[0] > 0.5
    spans = model.spans(unseen)
    assert [unseen[a:b].strip() for a, b, _ in spans] == ["You VILEZZZ thing"]
    rows = [(1, unseen, "keep", "s"), (2, None, "keep", "s"), (3, "", "keep", "s"), (3, "...", "keep", "s"), (None, "lorem " * 20000, "keep", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, score string")
    out = toxicity.scored(docs, model).collect()
    assert len(out) == 5 and {r.extra for r in out} == {"keep"} and [r.score for r in out if r.doc_id in (2, 3)] == [0.0] * 3
    assert [unseen[a:b].strip() for r in out if r.doc_id == 1 for a, b in zip(r.toxic_starts, r.toxic_ends, strict=True)] == ["You VILEZZZ thing"]


def brute_odds(text, weights, bias):
    """Log odds of each sentence, from the rules."""
    text = "".join(c.lower() if "A" <= c <= "Z" or ord(c) > 127 else "\n" if c in ".!?;\n\r" else c if "a" <= c <= "z" else " " for c in text)
    named = lambda w: [w, *[w[:k] + "*" for k in range(4, 9) if k <= len(w)]]
    return [bias + sum(weights.get(f, 0.0) for w in set(s.split()) for f in named(w)) for s in text.split("\n") if s.split()]


def brute_score(text, weights, bias):
    clean = 1.0
    for z in brute_odds(text, weights, bias):
        clean *= 1.0 - 1.0 / (1.0 + math.exp(-z))
    return 1.0 - clean


def test_toxicity_scores_are_the_noisy_or_of_sentences(spark):
    rng = random.Random(8)
    weights = {"vile*": 5.0, "vilefoo": 2.0, "thing": 0.5, "lorem": -1.0, "über": 3.0, "ipsu*": 0.25}
    texts = [corpus(rng, 1)[0][0] for _ in range(60)] + [None, "", "...", "Über vilefoo; thing 7\rthing thing", "vilefoo lorem " * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string")
    out = toxicity.scored(docs, toxicity.Model(-3.0, weights)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        odds = brute_odds(texts[r.doc_id] or "", weights, -3.0)
        assert r.score == pytest.approx(brute_score(texts[r.doc_id] or "", weights, -3.0), abs=1e-9)
        found = [s for s in r.toxic_scores]
        assert found == pytest.approx([p for z in odds if (p := 1 / (1 + math.exp(-z))) >= min(0.5, 1 / (1 + math.exp(-max(odds))))] if r.score >= 0.5 else [])


def test_toxicity_fit_follows_the_gradient_of_the_noisy_or():
    rows = [("good day. bad word", 1), ("good day", 0), ("bad day! good word", 1), ("word word good", 0), ("", 0), ("day", 1)] * 2
    names = ["good", "good*", "day", "bad", "word", "word*"]
    state, share = [0.0] * len(names) + [-6.0], 1.0 - 2.0 * toxicity.FLIPPED

    def gain(x):
        total = 0.0
        for text, y in rows:
            q = toxicity.FLIPPED + share * brute_score(text, dict(zip(names, x, strict=False)), x[-1])
            total += math.log(q if y else 1.0 - q)
        return total / len(rows)

    one, two = [0.0] * len(state), [0.0] * len(state)
    for step in range(1, 6):
        slopes = [(gain([v + 1e-5 * (i == k) for i, v in enumerate(state)]) - gain([v - 1e-5 * (i == k) for i, v in enumerate(state)])) / 2e-5 for k in range(len(state))]
        for k in range(len(names)):
            slopes[k] -= 2e-5 * ((state[k] > 0) - (state[k] < 0)) + 2e-5 * state[k]
        for k, g in enumerate(slopes):
            one[k], two[k] = 0.9 * one[k] + 0.1 * g, 0.99 * two[k] + 0.01 * g * g
            state[k] += (0.15 if step < 3.5 else 0.03) * (one[k] / (1 - 0.9**step)) / (math.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)
    model = toxicity.fit(rows, epochs=5)
    assert model.bias == pytest.approx(state[-1], abs=2e-3)
    for k, f in enumerate(names):
        assert model.weights.get(f, 0.0) == pytest.approx(state[k] if abs(state[k]) > 0.02 else 0.0, abs=4e-3)


def test_toxicity_sample_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(9)
    texts, labels = corpus(rng, 200)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    rows = list(enumerate(texts)) + [(7, "another text of an id"), (8, "vile " * 5000)]
    models = []
    for _ in range(2):
        rng.shuffle(rows)
        models.append(toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), marks, most_bytes=9000))
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias and models[0].weights
    assert models[0].weights != toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), marks).weights


def test_toxicity_training_is_bounded_and_honours_the_held_out_part(spark):
    rng = random.Random(2)
    texts, labels = corpus(rng, 300)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(5, "twice"), (None, "x")], "doc_id long, text string")
    marks = spark.createDataFrame(list(enumerate(labels)) + [(5, None), (None, 1), (999, 1)], "doc_id long, toxic int")
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = toxicity.train(docs, marks, allowed=~toxicity.held_out("id"))
    two = toxicity.train(docs, flipped, allowed=~toxicity.held_out("id"))
    assert one.weights == two.weights and one.weights
    assert toxicity.train(docs, marks, rows=0).weights == {} and toxicity.train(docs.limit(0), marks.limit(0)).score("a b")[0] < 0.5
    digest = toxicity.digest(toxicity.scored(docs, one)).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in digest)


# ---- pipeline and queries -----------------------------------------------------------------------
def test_pipeline_on_planted_documents(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    texts, labels = corpus(rng, 300)
    texts = [t + " " + " ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(999)) for _ in range(40)) for t in texts]
    item = "what is the very long question that nobody could ever answer in one single short line of text"
    token = "0123456789abcdef" * 3
    rows = [(i, t, "en", f"s{i % 7}", len(t)) for i, t in enumerate(texts)]
    clean = " ".join(f"clean{i}" for i in range(60))
    extra = [(1000, clean), (1001, clean), (1001, clean), (1002, "short " + item), (1003, clean + f' {" ".join(f"w{i}" for i in range(50))} token = "{token}"'), (1004, None), (1005, ""), (None, "no id at all here")]
    rows += [(i, t, "en", "s0", len(t or "")) for i, t in extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumn("score", F.lit("own"))
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = spark.createDataFrame(stage(spark, state, str(tmp_path)).collect(), schema + ", score string")
        counts[name] = sorted(r.doc_id if r.doc_id is not None else -1 for r in state.collect())
    bad = {i for i, t in enumerate(texts) if "vile" in t}
    assert len(bad & set(counts["toxicity"])) <= 2 and len(set(range(300)) - bad - set(counts["toxicity"])) <= 2
    after = counts["simhash near-dedup"]
    assert 1000 in after and 1001 not in after and 1004 in after and 1005 not in after and -1 in after and len(after) == len(set(after))
    assert 1002 not in counts["benchmark decontamination"] and 1003 in counts["benchmark decontamination"]
    kept = {r.doc_id: r for r in state.collect()}
    assert token not in kept[1003].text and "[SECRET]" in kept[1003].text and kept[1003].n_chars == len(kept[1003].text) and kept[1003].score == "own"
    before = set(glob.glob(f"{common.shared_folder(spark)}/veilframe/*"))
    whole = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert [p.rpartition("/")[2].split("-")[0] for p in set(glob.glob(f"{common.shared_folder(spark)}/veilframe/*")) - before] == ["stage3"]
    assert whole == {None if i == -1 else i for i in counts["secret scans"]}


def test_stages_on_empty_tables_and_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, mark string"
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = " ".join(f"w{i}" for i in range(50))
    text = [own, own + " and more", "another text of few words", None, "", "long " * 40_000]
    rows = [(1, text[0]), (1, text[2]), (1, text[2]), (2, text[0]), (None, text[1]), (None, text[1]), (None, "no other has this"), (None, "no other has this"), (3, None), (4, ""), (None, None), (5, text[5]), (5, text[5])]
    docs = spark.createDataFrame([(i, t, None, None, None, "own", "k", "m") for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, None}
            continue
        assert out.columns == empty.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert {r.score + r.key + r.mark for r in out.collect()} == {"ownkm"}
        if name == "simhash near-dedup":
            assert got == sorted([(1, text[0]), (1, text[2]), (None, "no other has this"), (3, None), (5, text[5])], key=repr)
        else:
            assert got == sorted(rows, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    source = {"op2": "conversations", "op7": "embeddings"}.get(name.split("_")[0], "documents")
    key = {"documents": "doc_id", "embeddings": "vec_id", "conversations": "conv_id"}[source]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        got = {r[0] for r in queries.QUERIES[name](spark, SF).select(key).collect()}
    assert got == {r[0] for r in queries.table(spark, SF, source).select(key).collect()}
