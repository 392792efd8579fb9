"""Toxicity scores: features by hand, the learner by its definition, held-out accuracy, odd rows."""

import math
import random

import numpy as np
import pytest
from conftest import SF

from loomlog.llm import quality, toxicity
from loomlog.llm.quality import held_out

BAD = ["idiot", "scum", "dummkopf"]


def text(rng, bad):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 60))]
    if bad:
        for _ in range(2):
            words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "", "s", "en", "!"]))
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "x", 1.0, "y") for i, t, _ in rows], "doc_id long, text string, score string, y double, predicted string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_features_are_words_stems_pairs_and_skips():
    """Equal features have equal slots wherever they stand, others differ."""
    a, b, c = (set(x.tolist()) for x in toxicity.rows_of(["Some words, here", "x some WORDS HERE", "words some"]))
    n = 1 + 3 + 1 + 2 + 1  # bias, words, stem of "words", neighbours, one between
    assert len(a) == n and a < b and len(b) == n + 4
    assert len(a & c) == 1 + 2 + 1  # bias, both words, the stem; pairs have an order
    assert [len(x) for x in toxicity.rows_of(["", "  ,. "])] == [1, 1]


def test_features_of_batches_are_those_of_single_texts(monkeypatch):
    rng = random.Random(5)
    texts = [text(rng, i % 2) for i in range(40)] + ["", "é" * 50, "日本語 テキスト"]
    whole = [x.tolist() for x in toxicity.rows_of(texts)]
    assert whole == [toxicity.rows_of([t])[0].tolist() for t in texts]


def test_learner_is_ftrl_by_hand(monkeypatch):
    """State.learn and weights against the update rule, one coordinate at a time."""
    rng = random.Random(8)
    state, z, n = toxicity.State(), {}, {}

    def weight(i):
        over = toxicity.L1 if i else 0.0
        if abs(z.get(i, 0.0)) <= over:
            return 0.0
        return -(z[i] - math.copysign(over, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(200):
        at = sorted({0, *[rng.randrange(1, 30) for _ in range(6)]})
        y = int(3 in at)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            before = n.get(i, 0.0)
            n[i] = before + g * g
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / toxicity.ALPHA * w[i]
        state.learn(np.array(at), y)
    assert np.allclose(state.weights(np.arange(30)), [weight(i) for i in range(30)], atol=1e-3)
    assert weight(3) > 0.5


def test_held_out_toxic_texts_are_found(spark, corpus):
    rows, docs, labels = corpus
    model = toxicity.fit(docs, labels)
    assert len(model.slots) < 2000
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if held_out(i)]
    assert all(got[i].held_out == held_out(i) for i in got)
    assert all(got[i].predicted == (got[i].score >= 0.7) for i in got)
    assert sum(got[i].predicted for i, y in held if not y) == 0
    caught = [got[i].predicted for i, y in held if y]
    assert sum(caught) > 0.9 * len(caught)


def test_labels_of_held_out_rows_are_never_read(spark, corpus):
    _, docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 1 - toxic, toxic) AS toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert np.array_equal(a.slots, b.slots) and np.array_equal(a.weights, b.weights)


def test_repeated_ids_keep_the_sample_bounded(spark, corpus):
    _, docs, labels = corpus
    many = docs.limit(40).crossJoin(spark.range(30)).drop("id")
    got = quality.sample(many, labels.union(labels), "toxic", 10).collect()
    assert len(got) <= 10 and len({r.doc_id for r in got}) == len(got)


def test_odd_rows_have_defined_scores(spark, corpus):
    _, docs, labels = corpus
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "idiot", "b"), (2, "word " * 400_000 + "idiot", "c"), (2, "word " * 400_000 + "idiot", "c"), (3, "IDIOT!", None)], "doc_id long, text string, held_out string")
    got = sorted([(r.doc_id is None, r.doc_id or 0, round(r.score, 6), r.held_out) for r in toxicity.score(odd, model).collect()])
    assert len(got) == 6 and got[0][2] == got[1][2] < 0.5 and got[2][2] == got[3][2] and got[-1][3] is False and got[-1][2] > 0.7
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_no_model_without_both_classes(spark, corpus):
    _, docs, labels = corpus
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.fit(docs, labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")) is None
    assert toxicity.fit(docs.limit(0), labels) is None
    assert {r.score for r in toxicity.score(docs.limit(5), None).collect()} == {0.0}


def test_query_gives_every_document_a_row(spark):
    got = toxicity.op11_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.where("score < 0 OR score > 1").count() == 0
