import random
import zlib

import numpy as np
import pytest

from loomgraph.llm import langid, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["eau", "oui", "ç", "tre"]}


def held_out(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(2)
    rows = [(k, prose(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.choice([3, 20, 200])), lang, "x") for k in range(400)]
    rows += [(1000, None, "aa", "x"), (1001, "", None, "x"), (1002, "123 !! $", "bb", "x"), (5, *rows[5][1:]), (1003, prose(rnd, "cc", 9000), None, "x")]
    return rows


@pytest.fixture(scope="module")
def languages(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, score string")
    return docs, langid.fit(docs)


def test_gradients_are_those_of_the_loss():
    net, rnd = langid.Network(["a", "b", "c"], hidden=3), np.random.default_rng(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    spans, label, weight = rnd.integers(97, 101, (4, 6)).astype(np.uint8), np.array([0, 1, 2, 1]), (rnd.random((4, 6)) > 0.2).astype(np.float32)
    _, g = net.gradients(spans, label, weight)
    for k, x in net.p.items():
        for at in [tuple(i[:1][0]) for i in [np.argwhere(np.abs(g[k]) > np.abs(g[k]).max() * 0.5)]]:
            keep, out = x[at], []
            for e in (1e-3, -1e-3):
                x[at] = keep + e
                out.append(net.gradients(spans, label, weight)[0])
            x[at] = keep
            assert (out[0] - out[1]) / 2e-3 == pytest.approx(float(g[k][at]), rel=0.02, abs=1e-5), k


def test_languages_of_held_out_documents(languages, texts):
    docs, net = languages
    got = langid.predict(docs, net)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(texts) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    of = {d: lang for d, _, lang, _ in texts}
    test = [r.lang_pred == of[r.doc_id] for r in got if r.held_out and r.doc_id < 400]
    assert len(test) > 60 and np.mean(test) > 0.95
    by = {r.doc_id: r for r in got}
    assert all((by[d].lang_pred, by[d].score) == ("und", 0.0) for d in (1000, 1001, 1002)) and by[1003].lang_pred == "cc"


def test_reruns_agree_and_every_position_is_labelled(languages):
    docs, net = languages
    again = langid.fit(docs.repartition(5))
    assert all((net.p[k] == again.p[k]).all() for k in net.p)
    p = net.probabilities(np.full((3, langid.SPAN), 107, np.uint8))
    assert p.shape == (langid.SPAN, 3, 3) and np.allclose(p.sum(axis=2), 1, atol=1e-5)


def test_accepted(languages, texts):
    docs, net = languages
    left = langid.accepted(docs, net)
    assert left.columns == docs.columns
    got = sorted(r.doc_id for r in left.collect())
    assert not {1000, 1001, 1002} & set(got) and len(got) >= len(texts) - 6


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(docs, langid.fit(docs)).first().lang_pred == "und"
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    one = spark.createDataFrame([(k, "abc", "aa") for k in range(9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(one, langid.fit(one)).collect()} == {"aa"}


@pytest.fixture(scope="module")
def rated(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for k in range(1200):
        words = [f"w{''.join(rnd.choice('abcdefg') for _ in range(3))}" for _ in range(rnd.randint(5, 120))]
        bad = rnd.random() < 0.2
        for _ in range(rnd.randint(1, 5) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "Zornig" + rnd.choice(["a", "em", "er", "ung"]), "verflixt!"]))
        rows.append((k, " ".join(words), "x"))
        if k % 3:
            labels.append((k, 1, int(bad) if rnd.random() > 0.02 else 1 - int(bad)))
    truth = {k: any(w in t.lower() for w in ("idiot", "zornig", "verflixt")) for k, t, _ in rows}
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "clean " * 30000 + "idiot zornigung verflixt", "x"), (4, *rows[4][1:])]
    labels += [(1, 1, None), (None, 1, 1), (5000, 0, 1), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_toxicity_of_held_out_documents(rated):
    docs, labels, truth = rated
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == docs.count() and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [r for r in got if r.held_out and r.doc_id < 1200]
    assert np.mean([r.predicted == 1 for r in test if truth[r.doc_id]]) > 0.95 and np.mean([r.predicted == 0 for r in test if not truth[r.doc_id]]) > 0.98
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score < 0.3 and by[2002].predicted == 1
    again = toxicity.score(docs.repartition(5), toxicity.fit(docs.repartition(5), labels.repartition(3))).collect()
    assert sorted((r.doc_id, r.score) for r in got) == sorted((r.doc_id, r.score) for r in again)


def test_a_repeated_document_counts_once(rated):
    docs, labels, _ = rated
    repeats = docs.where("doc_id in (1, 4, 7)").crossJoin(docs.sparkSession.range(300)).drop("id")
    a, b = toxicity.fit(docs, labels, per_class=10**6), toxicity.fit(docs.unionByName(repeats), labels, per_class=10**6)
    assert a.voters.names == b.voters.names and np.allclose(a.w, b.w) and np.isclose(a.b, b.b)


def test_without_labels(rated):
    docs, labels, _ = rated
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0}
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 1"))).collect()} == {1}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_label_model_beats_the_majority_of_its_voters():
    """Voters about as precise as mined ones; labels of few and noisy rows say where to begin; all rows' votes decide. Copied voters do not count twice."""
    rnd = np.random.default_rng(3)
    n = 6000
    y = (rnd.random(n) < 0.2).astype(int)
    fire = lambda on, off: rnd.random(n) < np.where(y == 1, on, off)
    good, weak = fire(0.5, 0.005), fire(0.3, 0.1)
    votes = np.stack([good, weak, weak, weak, weak, fire(0.4, 0.01), fire(0.5, 0.02), fire(0.4, 0.01), fire(0.3, 0.15)], axis=1).astype(float)
    label = np.where(rnd.random(n) < 0.1, 1 - y, y).astype(float)
    label[rnd.random(n) < 0.8] = np.nan
    q, right, together = toxicity.label_model(votes, label, np.ones(n))
    correct = ((q > 0.5) == (y == 1)).mean()
    fired = votes.sum(axis=1)
    assert correct > max(((fired >= k) == (y == 1)).mean() for k in range(1, 6)) and correct > 0.93
    assert right[0] > 0.8 > 0.6 > right[1]
    assert together[1, 2] > 0.9 and together[0, 5] < 0.2 and (np.diag(together) == 0).all()


def test_given_labels_are_no_evidence():
    """Rows with the same votes get the same posterior, whatever their labels."""
    rnd = np.random.default_rng(4)
    votes = (rnd.random((500, 4)) < 0.4).astype(float)
    label = np.where(rnd.random(500) < 0.5, np.nan, rnd.integers(0, 2, 500))
    q, _, _ = toxicity.label_model(votes, label, np.ones(500))
    for pattern in np.unique(votes, axis=0):
        assert np.ptp(q[(votes == pattern).all(axis=1)]) < 1e-12
