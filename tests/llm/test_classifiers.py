"""Toxicity and quality models: held-out accuracy on the given rows, and defined results."""

import random

import numpy as np
import pytest

from treeline.llm import quality_model, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def accuracy(spark, rows, label):
    joined = rows.join(table(spark, "labels"), "doc_id").filter("held_out").collect()
    truth = np.array([r[label] for r in joined])
    return (np.array([r.predicted for r in joined]) == truth).mean(), max(truth.mean(), 1 - truth.mean())


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op2_toxicity(spark, FOLDER)
    assert rows.count() == table(spark, "documents").count()
    right, base = accuracy(spark, rows, "toxic")
    assert right > base


def test_quality_on_held_out_rows(spark):
    rows = queries.op9_quality_model(spark, FOLDER)
    right, base = accuracy(spark, rows, "quality")
    assert right > base


def planted(rng):
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(40)), 0) for i in range(300)]
    for i, text, _ in docs[:100]:
        docs[i] = (i, text + " " + rng.choice(["wazzock", "Numpty!", "pillock"]), 1)
    return docs


def test_gapped_and_padded_insults_score_like_the_plain_ones(spark):
    docs = planted(random.Random(4))
    rows = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(rows, labels)
    texts = ["lo ra wazzock mi", "you w.a.z.z.o.c.k", "such a p i l l o c k", "num-pty", "pil1ock", "wazxzock", "x" * 5000 + "pillock"]
    texts += ["lora mi sela", "", None, "ta " * 3000, "ta.ta"]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    got = [r.score for r in scored.orderBy("doc_id").collect()]
    assert min(got[:7]) > max(got[7:])
    assert all(0 <= s <= 1 for s in got)


def test_insults_in_pieces_score_like_the_plain_ones(spark):
    docs = planted(random.Random(4))
    rows = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    model = toxicity.fit(rows, spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int"))
    texts = ["lo ra p  i  l  l  o  c  k mi", "lora w\na\nz\nz\no\nc\nk", "lora p\u00a0i\u00a0l\u00a0l\u00a0o\u00a0c\u00a0k", "such n u m p t y.",
             "lora pill ock mi", "(w azzock)", "lora pi l l ock mi", "mi nu-mp-ty", "p - i - l - l - o - c - k", "a pil, lo, ck!"]
    clean = [" ".join(d[1].split()[:40]) for d in docs[100:]] + ["l o r a mi", "a b c d e f g", "mi\nta\nlo"]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string"), model)
    got = [r.score for r in scored.orderBy("doc_id").collect()]
    assert min(got[: len(texts)]) > max(0.5, max(got[len(texts) :])), (got[: len(texts)], max(got[len(texts) :]))


def test_units_keep_every_piece_and_join_neighbours():
    units = toxicity.units_of("such i d i o t. and st u p id, S  T\nU\u00a0P I D! st upid")
    assert {"idiot", "stupid", "such", "t.", "and", "upid"} <= units
    assert toxicity.units_of(None) == toxicity.units_of(" . ") - {"."} == set()


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [want] * 3
    rows = quality_model.measured(docs)
    model = quality_model.fit(rows, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality_model.score(rows, model).collect()] == [0.0] * 3
    model = quality_model.fit(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    assert len(quality_model.score(rows, model).collect()) == 3
    assert quality_model.score(quality_model.measured(docs.limit(0)), model).count() == 0


def mixture():
    """Good rows, bad rows, an unlabelled mixture of both, and bins."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (1200, 2))
    web = np.concatenate([good[1500:], bad])
    everything = np.concatenate([good[:1500], web])
    return good, bad, web, np.quantile(everything, np.linspace(0, 1, 7)[1:-1], axis=0).T


def test_positive_unlabelled_risk_separates_a_known_mixture():
    good, bad, web, edges = mixture()
    margins = quality_model.fit_plain(good[:1500], web, edges).margin
    limits = quality_model.thresholds(margins(good[:1500]))
    above = [(margins(web) >= limit).sum() for limit in limits]
    prior = quality_model.class_prior(margins(good[:1500]), above, len(web))
    assert abs(prior - 1500 / 2700) < 0.1
    model = quality_model.fit_rows(good[:1500], web, edges, prior)
    assert (model.score(good) > 0.5).mean() > 0.95
    assert (model.score(bad) < 0.5).mean() > 0.95


@pytest.mark.parametrize("prior", [0.3, 0.99])
def test_gradient_of_the_risk_against_finite_differences(prior):
    good, _, web, edges = mixture()
    p, u = quality_model.design(good[:200], edges).astype(float), quality_model.design(web, edges).astype(float)
    w = np.random.default_rng(5).normal(0, 0.7, p.shape[1]) + (2.0 if prior > 0.9 else 0.0)
    _, negative, gradient = quality_model.risk(w, p, u, prior)

    def followed(w):
        good_part, bad_part, _ = quality_model.risk(w, p, u, prior)
        return good_part + bad_part if negative >= 0 else -bad_part

    steps = np.eye(len(w)) * 1e-6
    numeric = np.array([(followed(w + s) - followed(w - s)) / 2e-6 for s in steps])
    assert np.allclose(numeric, gradient, atol=1e-6)


def test_prior_and_bins_come_from_all_documents(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 90 + 1)) for i in range(900)], "doc_id long, text string")
    rows = quality_model.measured(docs)
    data = np.array([quality_model.measures("word " * (i % 90 + 1)) for i in range(900)])
    edges = quality_model.bin_edges(rows)
    assert edges.shape == (quality_model.MEASURES, quality_model.BINS - 1)
    for i, row in enumerate(edges):
        shares = [(data[:, i] <= e).mean() for e in row]
        assert all(s >= k / quality_model.BINS - 1e-3 for k, s in enumerate(shares, 1))
    model = quality_model.Model(edges, np.random.default_rng(1).normal(size=(quality_model.MEASURES, quality_model.BINS)), 0.1)
    limits = np.quantile(model.margin(data), [0.1, 0.5, 0.9])
    above, n = quality_model.count_above(rows, model, limits)
    assert n == 900 and above.tolist() == [(model.margin(data) >= e).sum() for e in limits]
