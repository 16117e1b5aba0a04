import random
import re

import pytest

from loomgraph.llm import mixing


def target_of(sizes):
    """sizes by source, in order -> targets, by sharing the excess again and again."""
    total, weight = sum(sizes), [float(k % 3 + 1) for k in range(len(sizes))]
    full = [False] * len(sizes)
    while True:
        left = total - sum(3 * s for s, f in zip(sizes, full) if f)
        open_weight = sum(w for w, f in zip(weight, full) if not f)
        now = [3.0 * s if f else w * left / open_weight for s, w, f in zip(sizes, weight, full)]
        over = [k for k, (n, s, f) in enumerate(zip(now, sizes, full)) if not f and n > 3 * s]
        if not over:
            return now
        for k in over:
            full[k] = True


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for k in range(900):
        source = rnd.choice(["a"] * 6 + ["b", "B", "é", "z", None, "tiny" if k % 40 == 0 else "c"])
        out.append((k, " \t".join("w" * rnd.randint(1, 3) for _ in range(rnd.choice([0, 1, 5, 60, 400]))), source, "x"))
    return out + [(901, None, "a", "x"), (902, "", "empty", "x"), (3, *out[3][1:]), (903, "w " * 9000, "z", "x"), (None, "a b", "a", "x")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string").repartition(3)


def test_mix(docs, rows):
    got = mixing.mix(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = got.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, _, _ in rows)
    names = sorted({s for *_, s, _ in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None]
    sizes = [sum(size(t) for _, t, s, _ in rows if s == n) for n in names]
    targets = dict(zip(names, target_of(sizes)))
    source_of = {d: s for d, _, s, _ in rows}
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[names.index(s)] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert sum(targets.values()) == pytest.approx(sum(sizes))
    for n in names:
        assert abs(taken[n] - targets[n]) <= 0.005 * targets[n] + 30, n
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_slots_are_spread_and_pieces_are_their_blocks(docs):
    rows, shares, pieces = mixing.schedule(docs)
    by_slot = {}
    for r in pieces.collect():
        by_slot.setdefault(r.slot, []).append(r)
    assert all(len({r.source for r in p}) == 1 for p in by_slot.values())
    widths = [sum(r.n_words for r in by_slot[k]) for k in sorted(by_slot)]
    assert sum(w == max(widths) for w in widths) > 0.98 * len(widths)
    share = {r.source: r.hi - r.lo for r in shares.collect() if r.source == "a"}["a"]
    slots = sorted(by_slot)
    for lo in range(0, len(slots) - 400, 400):
        part = slots[lo : lo + 400]
        assert abs(sum(by_slot[k][0].source == "a" for k in part) / 400 - share) < 0.02


def test_documents_as_often_as_they_are_taken(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    copies = {}
    for r in got.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in mixing.mix(docs).collect():
        if r.doc_id not in (3, None):
            assert abs(copies.get(r.doc_id, 0) * r.size - r.taken) <= r.size / 2


def test_sources_of_less_than_a_block_are_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1)  # blocks as of a corpus of any size
    rows = [(k, "w " * 500, "big") for k in range(400)] + [(1000 + k, "w " * (60 + k), f"s{k:02d}") for k in range(40)] + [(2000, "w " * 1500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    source_of, taken, target = {d: s for d, _, s in rows}, {}, {}
    for r in mixing.mix(df).collect():
        s = source_of[r.doc_id]
        assert r.taken <= 3 * r.size
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    assert len(taken) == 42 and all(abs(taken[s] - target[s]) <= 0.5 for s in taken)
    pieces = mixing.schedule(df)[2].collect()
    assert all(len({p.source for p in pieces if p.slot == k}) == 1 for k in {p.slot for p in pieces})
    assert {r.source for r in mixing.mixed_documents(df).select("source").distinct().collect()} == set(taken)


def test_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(df).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df).count() == 0


def test_the_plan_has_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
