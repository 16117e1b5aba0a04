import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from loomgraph.llm import simhash
from loomgraph.llm.components import connected


def plain(text, width=4):
    words = [w.encode().lower() for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    if not words:
        return 0
    runs = [words] if len(words) < width else [words[i : i + width] for i in range(len(words) - width + 1)]
    h = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows, width=4, radius=4):
    fps = [plain(t, width) for _, t in rows]
    cls = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = cls[i], cls[j]
                cls = [b if c == a else c for c in cls]
    least = {}
    for (d, _), c in zip(rows, cls):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    return sorted((d, f, least.get(c)) for (d, _), f, c in zip(rows, fps, cls) if d is not None)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 4) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 160):
        words = rnd.choice(base).split()
        if words:
            words[rnd.randrange(len(words))] = rnd.choice(["x", "Y", "é"])
        out.append((i, "\t".join(words)))
    return out + [(200, None), (201, ""), (202, " \n"), (3, base[3]), (203, "One two"), (204, "a " * 70000), (205, "a " * 70001)]


@pytest.mark.parametrize("width", [4, 5])
def test_brute_force(spark, rows, width):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = simhash.classes(df, width=width).collect()
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == brute(rows, width)


def test_dense_group_is_linked_without_its_pairs():
    rnd = np.random.default_rng(1)
    centre = np.uint64(0x0123456789ABCDEF)
    fps = np.unique(centre ^ (np.uint64(1) << rnd.integers(0, 64, 3000).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 3000).astype(np.uint64)))
    assert len(simhash.groups_within(fps)) == len(fps) - 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_masks_cover_every_pair_in_reach():
    rnd = random.Random(2)
    m = simhash.masks()
    for _ in range(300):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & k == y & k for k in m)


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(400)] + [(1000, i) for i in range(1001, 1400)] + [(7, None), (9, 9)]
    found = connected(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()
    assert len({r.root for r in found}) == 2 and len(found) == 401 + 400


def similar(rows, similarity=0.8):
    def cut(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i : i + min(5, len(w))]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, cls = [cut(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = cls[i], cls[j]
                cls = [b if c == a else c for c in cls]
    least = {}
    for (d, _), c in zip(rows, cls):
        least[c] = min(d, least.get(c, d))
    return sorted((d, least[c]) for (d, _), c in zip(rows, cls))


def test_similar_classes(spark, rows):
    rnd = random.Random(8)
    more = list(rows)
    for k in range(300, 330):
        words = [f"w{rnd.randrange(3000)}" for _ in range(150)]
        for j in (0, 1, 2, 9):
            edited = list(words)
            for _ in range(j):
                edited[rnd.randrange(150)] = "changed"
            more.append((k * 10 + j, " ".join(edited)))
    df = spark.createDataFrame([(d, t, 1) for d, t in more], "doc_id long, text string, uid int")
    assert sorted(tuple(r) for r in simhash.similar_classes(df).collect()) == similar(more)


def test_false_neighbours_hide_no_pair(spark):
    """Variants of one template, near by fingerprint and mostly under the similarity: the few real pairs are all linked."""
    rnd, rows = random.Random(9), []
    template = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    for k in range(80):
        words = list(template)
        for at in rnd.sample(range(150), 6):
            words[at] = f"v{k}x{at}"
        rows.append((2 * k, " ".join(words)))
        words[149 if words[149] == template[149] else 147] = "changed"
        if k % 4 == 0:
            rows.append((2 * k + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = similar(rows)
    got = sorted(tuple(r) for r in simhash.similar_classes(df).collect())
    assert len({c for _, c in want}) > 60 and got == want


def test_proposed_pairs_connect_what_is_near():
    rnd = random.Random(12)
    for _ in range(20):
        base = [rnd.getrandbits(64) for _ in range(3)]
        fps = sorted({x ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(14))) for x in rnd.choices(base, k=rnd.randint(2, 60))})
        fps = np.array(fps, np.uint64)
        columns = [np.full(len(fps), 7, np.int64), np.arange(len(fps)), fps.view(np.int64)]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "uid", "f0"])
        parts = [batch.slice(0, 5), batch.slice(5, 1), batch.slice(6)]
        got = [(r["a"], r["b"]) for out in simhash._candidates(iter(parts)) for r in out.to_pylist()]
        near = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= simhash.NEAR]
        assert set(got) <= {(j, i) for i, j in near} and len(got) < len(fps)
        assert joined(range(len(fps)), got) == joined(range(len(fps)), near)


def test_what_is_far_in_all_bits_stands_for_no_pair():
    """b is near a and c in the first 64 bits, and a and c are near in all: b, which is far in the others, is in no pair."""
    rnd, ones = random.Random(15), (1 << 64) - 1
    for n in (1, 30):  # buckets of few rows and of many
        first, rest = rnd.getrandbits(64), [rnd.getrandbits(64) for _ in range(3)]
        ends = [(first, *rest)] * n + [(first ^ 0b1111, *rest)] * n
        rows = ends + [(first ^ 0b11, *(x ^ ones for x in rest))] * n
        columns = [np.full(len(rows), 7, np.int64), np.arange(len(rows)), *np.array(rows, np.uint64).view(np.int64).T]
        batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "uid", "f0", "f1", "f2", "f3"])
        got = [(r["a"], r["b"]) for out in simhash._candidates(iter([batch])) for r in out.to_pylist()]
        of = joined(range(len(rows)), got)
        assert {of[k] for k in range(2 * n)} == {0} and {of[k] for k in range(2 * n, 3 * n)} == {2 * n}


def test_fewest_pairs_connect_what_all_tasks_proposed(spark, monkeypatch):
    """Near copies meet under every key, and each task connects them by pairs of its own: what is compared is no multiple of them."""
    rnd, counts, real = random.Random(16), {}, simhash.staged

    def counted(df, name):
        out = real(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    words, rows = [f"w{rnd.randrange(5000)}" for _ in range(150)], []
    for k in range(300):
        copy = list(words)
        copy[rnd.randrange(150)] = f"v{k}"
        rows.append((k, " ".join(copy)))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # as many tasks as partitions
    try:
        got = simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r.component_id for r in got.collect()} == {0}
    finally:
        spark.conf.unset(setting)
    assert counts["pairs"] <= 2 * len(rows) < counts["proposed"]


def joined(nodes, pairs):
    of = {x: x for x in nodes}
    for a, b in pairs:
        a, b = sorted((of[a], of[b]))
        of = {x: a if c == b else c for x, c in of.items()}
    return of


def sets_and_classes(rnd, n):
    """Variants of a few sets, empty ones too, some already of one class."""
    base = [rnd.sample(range(400), 30) for _ in range(3)]
    sets = [np.array(sorted({y if rnd.random() < 0.93 else rnd.randrange(400) for y in rnd.choice(base)} if rnd.random() < 0.9 else ()), np.uint32) for _ in range(n)]
    return sets, np.array([rnd.randrange(max(1, n)) for _ in range(n)])


def links_by_brute_force(sets, cls, similarity=0.8):
    return [(int(cls[i]), int(cls[j])) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= similarity * len(np.union1d(sets[i], sets[j]))]


def test_linked_sets():
    rnd = random.Random(13)
    for n in [1, 2, *rnd.choices(range(3, 40), k=40)]:
        sets, cls = sets_and_classes(rnd, n)
        got = simhash.linked_sets(sets, np.zeros(n, np.int64), cls, 0.8)
        want = joined(range(n), links_by_brute_force(sets, cls))
        assert joined(range(n), [(int(cls[i]), int(cls[j])) for i, j in got]) == want and len(got) < n
        if n > 1:
            side = np.arange(n) >= n // 2
            across = [(int(cls[i]), int(cls[j])) for i in range(n // 2) for j in range(n // 2, n) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
            got = simhash.linked_sets(sets, side.astype(np.int64), cls, 0.8)
            assert joined(range(n), [(int(cls[i]), int(cls[j])) for i, j in got]) == joined(range(n), across)


@pytest.mark.parametrize("rows, size", [(512, 1 << 23), (4, 1 << 23), (512, 600)])
def test_crossing_does_not_depend_on_chunks(spark, monkeypatch, rows, size):
    """Large and small classes in chunks of any size: the classes are joined as by brute force."""
    monkeypatch.setattr(simhash, "CROSS_ROWS", rows)
    monkeypatch.setattr(simhash, "CROSS_BYTES", size)
    rnd, data, want = random.Random(14), [], {}
    for group in range(3):
        sets, cls = sets_and_classes(rnd, 40)
        cls[:15] = 0  # a class larger than a chunk
        cls += 100 * group
        data += [(group, int(c), 1000 * group + k, x.tobytes()) for k, (x, c) in enumerate(zip(sets, cls, strict=True))]
        want |= joined(range(100 * group, 100 * group + 100), links_by_brute_force(sets, cls))
    got = simhash.crossing(spark.createDataFrame(data, "group long, class long, uid long, shingles binary"), 0.8).collect()
    of = {uid: c for _, c, uid, _ in data}
    assert joined(want, [(of[r.a], of[r.b]) for r in got]) == want and got


def test_keep_one(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows] + [(None, "null id", "x")], "doc_id long, text string, component_id string")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    want = {d for d, c in similar(rows) if d == c} | {None}
    assert {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("texts", [50_000, 250_000, 10**9])
def test_keys_find_nearly_all_pairs_at_the_similarity(texts):
    rnd, hit = random.Random(4), []
    masks = np.zeros((len(keys := simhash.key_bits(texts)), 64 * simhash.WIDE), bool)
    for k, bits in enumerate(keys):
        masks[k, bits] = True
    for _ in range(400):
        words = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        edited = list(words)
        for at in (20, 70, 120):
            edited[at] = "changed"
        a, b = (simhash.shingle_set(" ".join(w), 5) for w in (words, edited))
        assert 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.83
        x = simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)
        bits = np.unpackbits(x.view(np.uint8), bitorder="little").astype(bool)
        hit.append(int(np.bitwise_count(x[0])) <= simhash.NEAR and not (masks & bits).any(axis=1).all())
    assert np.mean(hit) >= 0.97


def test_links_do_not_depend_on_chunks(spark):
    """A key of hundreds of fingerprints, cut into chunks of a few: the same classes as brute force."""
    rnd = random.Random(21)
    base = rnd.getrandbits(64)
    fps = set()
    for _ in range(40):
        x = base ^ (rnd.getrandbits(36) << 28)  # one block is the same in all
        for _ in range(8):
            y = x
            for b in rnd.sample(range(64), rnd.choice((2, 4, 6))):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)

    def classes(pairs):
        up = {x: x for x in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return [root(x) for x in fps]

    want = classes([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for chunk in (4096, 16):
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, chunk=chunk).collect()]
        assert classes(got) == want and len(set(want)) < len(fps)


def test_whole_buckets():
    rnd = random.Random(1)
    for _ in range(50):
        keys = sorted(rnd.choices(range(rnd.randint(1, 12)), k=rnd.randint(0, 40)))
        batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(len(keys)), pa.int64())], names=["key", "x"])
        cuts = sorted(rnd.choices(range(len(keys) + 1), k=4))
        parts = [batch.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        got = [c[0].to_pylist() for c in simhash.whole_buckets(iter(parts))]
        assert sum(got, []) == keys and sum(len(set(g)) for g in got) == len(set(keys))
