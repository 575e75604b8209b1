"""The near-dedup stage against exact similarity of five-word shingles."""

import random

import pytest

from veilframe.llm import similar, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def kept(spark, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()}


def test_pairs_of_the_threshold_are_found_and_others_kept(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(200)] for _ in range(30)]
    near = [" ".join([*b[:180], *[f"x{rng.randrange(10**6)}" for _ in range(20)]]) for b in base]
    base = [" ".join(b) for b in base]
    assert all(0.8 <= jaccard(a, b) < 0.85 for a, b in zip(base, near, strict=True))
    far = sum((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 4 for a, b in zip(base, near, strict=True))
    assert far > 15
    refrain = "over and over the same old song is sung " * 60
    alike = [refrain + " ".join(f"{c}{i}" for i in range(12)) for c in "pqr"]
    assert jaccard(alike[0], alike[1]) < 0.5 and (simhash.fingerprint(alike[0]) ^ simhash.fingerprint(alike[1])).bit_count() <= 4
    assert kept(spark, base + near + alike) == set(range(30)) | {60, 61, 62}


@pytest.mark.parametrize("block", [8, 512])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(12)
    centre = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(60):  # a cloud around 0.8: many pairs just miss, many just reach
        w = list(centre)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone here"), (70, None), (71, "")]
    got = similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = {r.id: r.component_id for r in got if r.id is not None}
    assert [named[i] for i in range(60)] == root and named[70] == named[71] == 70 and len(got) == len(rows)
    assert sorted(str(r.component_id) for r in got if r.id is None) == ["0", "None"]
    assert similar.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
