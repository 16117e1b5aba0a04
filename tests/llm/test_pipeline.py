import os
import sys

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from loomgraph.llm import decontam, langid, mixing, tokens
from loomgraph.session import read, staged
from test_simhash import similar

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read(spark, SMALL, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        found = staged(stage(spark, docs, SMALL), "step")
        out.append((docs, found))
        docs = found
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_return_documents(spark, steps):
    columns = read(spark, SMALL, "documents").columns
    assert all(found.columns == columns for _, found in steps[:-1]) and len(steps) == 5


def test_language_stage(steps):
    docs, found = steps[0]
    net = langid.fit(docs)
    want = [r.doc_id for r in docs.collect() for lang, p in net.documents([r.text]) if lang != "und" and p >= langid.LEAST_SCORE]
    assert sorted(d for d, _ in texts(found)) == sorted(want) and len(want) >= 0.97 * docs.count()


def test_near_duplicates_stage(steps):
    docs, found = steps[1]
    want = {d for d, c in similar(texts(docs)) if d == c}
    assert {d for d, _ in texts(found)} == want and len(want) < docs.count()


def test_decontamination_stage(spark, steps):
    docs, found = steps[2]
    items = decontam.Items([(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()])
    assert sorted(d for d, _ in texts(found)) == sorted(d for d, t in texts(docs) if not items.search(t))


def test_mixing_stage(steps):
    docs, found = steps[3]
    size = lambda t: len((t or "").encode().split())
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(docs).collect()}
    copies = {}
    for d, t in texts(found):
        copies[d] = copies.get(d, 0) + 1
    assert all(abs(copies.get(d, 0) * n - k) <= n / 2 for d, (k, n) in taken.items())
    words = {s: sum(size(r.text) for r in found.collect() if r.source == s) for s in {r.source for r in docs.collect()}}
    targets = {r.source: r.target for r in mixing.schedule(docs)[1].collect()}
    longest = max(n for _, n in taken.values())
    assert all(abs(words[s] - targets[s]) <= longest for s in words)


def test_token_stage(steps):
    docs, found = steps[4]
    e = tokens.WordEncoder(tokens.default_path())
    want = sorted((d, e.encode(pa.array([t]), 1).to_pylist()[0]) for d, t in texts(docs))
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == want and all(r.n_tokens == len(r.ids) for r in found.collect())


def test_run_is_the_stages_one_after_the_other(spark, steps):
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, steps[-1][1].collect()))
