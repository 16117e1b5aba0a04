import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import substrings
from loomgraph.llm.substrings import compact_windows, passages, sliding_minima, starts_of


def test_compact_windows_are_the_wide_nodes_of_the_tree():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        v, t = rnd.integers(0, 50, rnd.integers(1, 60)).astype(np.uint64) << np.uint64(20), int(rnd.integers(1, 9))
        tree = []

        def cut(a, b):
            if a <= b:
                c = a + int(np.argmin(v[a : b + 1]))
                if b - a + 1 >= t:
                    tree.append((a, c, b))
                cut(a, c - 1)
                cut(c + 1, b)

        cut(0, len(v) - 1)
        assert sorted(compact_windows(v, t)) == sorted(tree)
        bits = max(8, len(v).bit_length())
        starts = starts_of(v, t, bits)
        of = {s: c for a, c, b in tree for s in range(max(a, c - t + 1), min(c, b - t + 1) + 1)}
        assert of == dict(enumerate(starts.tolist()))


def test_sliding_minima():
    rnd = np.random.default_rng(2)
    for n in range(1, 40):
        x = rnd.integers(0, 9, n).astype(np.uint64)
        for t in range(1, 12):
            assert sliding_minima(x, t).tolist() == [x[i : i + t].min() for i in range(n - t + 1)]


def text(rnd, n):
    return [f"w{rnd.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(3)
    shared, near, line = text(rnd, 60), text(rnd, 120), text(rnd, 30)
    changed = list(near)
    changed[60] = "other"
    rows = [(k, " ".join(text(rnd, 200)), "x") for k in range(40)]
    for k in (3, 9, 21):
        rows[k] = (k, " ".join(text(rnd, 50 + k) + shared + text(rnd, 70)), "x")
    rows[5] = (5, " ".join(text(rnd, 33) + near + text(rnd, 20)), "x")
    rows[7] = (7, "\n".join(text(rnd, 11) + changed + text(rnd, 90)), "x")
    for k in range(25, 35):
        rows[k] = (k, " ".join(text(rnd, 80) + line + text(rnd, 80)), "x")
    own = text(rnd, 70)
    rows += [(50, None, "x"), (51, "", "x"), (52, " ".join(text(rnd, 10)), "x"), (53, rows[0][1], "x"), (54, rows[0][1], "x"), (54, rows[0][1], "x"), (55, " ".join(own + text(rnd, 20) + own), "x"), (56, " ".join(text(rnd, 60000) + shared), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string").repartition(4)
    out = passages(df)
    assert out.columns == ["doc_id", "start_word", "end_word", "class_doc_id", "class_start"]
    return sorted(tuple(r) for r in out.collect())


def test_documents_with_repeats_are_found_and_no_others(found):
    assert {r[0] for r in found} == {0, 3, 5, 7, 9, 21, 53, 54, 56}


def test_spans(found):
    by = {r[0]: r for r in found}
    for k in (3, 9, 21):
        assert by[k][1] <= 50 + k + 3 and by[k][2] >= 50 + k + 57
    assert by[5][1] <= 36 and by[5][2] >= 33 + 117 and by[7][1] <= 14 and by[7][2] >= 11 + 117
    assert by[56][1] >= 59990 and by[56][2] <= 60060 + 3
    assert len({by[k][3] for k in (3, 9, 21, 56)}) == 1 and by[5][3] == by[7][3]
    assert by[53] == (53, 0, 200, 0, 0) and sum(r[0] == 54 for r in found) == 2


@pytest.fixture(scope="module")
def repeated(spark):
    rnd = random.Random(6)
    rows, line = [], text(rnd, 10)
    for k in range(6):
        own = text(rnd, 60)
        rows.append((2 * k, " ".join(text(rnd, 40) + own + text(rnd, 70) + own + text(rnd, 30))))
        rows.append((2 * k + 1, " ".join(text(rnd, 55) + own + text(rnd, 45))))
    rows += [(20 + k, " ".join(text(rnd, 30 + k) + line * 1000 + text(rnd, 40))) for k in range(2)]
    return sorted(tuple(r) for r in passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())


def test_each_place_of_a_passage_that_another_text_has(repeated):
    for k in range(6):
        once, twice = [r for r in repeated if r[0] == 2 * k + 1], [r for r in repeated if r[0] == 2 * k]
        assert len(once) == 1 and len(twice) == 2
        for r, at in zip(once + twice, (55, 40, 170)):
            assert abs(r[1] - at) <= 8 and abs(r[2] - at - 60) <= 8


def test_a_long_run_of_a_line_is_found_to_its_end(repeated):
    for k in range(2):
        r = [r for r in repeated if r[0] == 20 + k]
        assert min(x[1] for x in r) <= 30 + k + 12 and max(x[2] for x in r) >= 30 + k + 10_000 - 12
        assert sum(x[2] - x[1] for x in r) >= 9_900


def test_near_all_copies_of_a_least_passage_with_one_edit_share_a_key():
    rnd, t = random.Random(7), substrings.LEAST_WORDS - substrings.WIDTH + 1
    for n in (50, 60):
        hit = []
        for _ in range(400):
            words = text(rnd, n)
            edited = [*words[: n // 2], "edited", *words[n // 2 + 1 :]]
            key, who, *_ = substrings.signatures([substrings.shingles(substrings.word_hashes(" ".join(w))) for w in (words, edited)], t)
            hit.append(bool(set(key[who == 0].tolist()) & set(key[who == 1].tolist())))
        assert sum(hit) >= 0.98 * len(hit), n


def test_a_long_stretch_is_in_consecutive_rows():
    line = substrings.shingles(substrings.word_hashes("one two three four five six seven eight nine ten " * 1000))
    t = substrings.LEAST_WORDS - substrings.WIDTH + 1
    key, _, place, low, high = substrings.signatures([line], t)
    cuts = [0, *(np.flatnonzero(np.diff(low) < 0) + 1).tolist(), len(low)]  # a band after the other
    assert len(cuts) == len(substrings.BANDS) + 1
    for x, y in zip(cuts, cuts[1:]):
        assert (high[x:y] - low[x:y] < 4096).all() and (low[x + 1 : y] == high[x : y - 1] + 1).all()  # each start in one row
        assert low[x] == 0 and high[y - 1] == len(line) - t and y - x >= 3
    pairs = cuts[-2]
    for k in set(key[:pairs].tolist()):  # a line's minima repeat with it: one stretch, of a few rows
        at = low[:pairs][key[:pairs] == k]
        assert 2 < len(at) < 5 and high[:pairs][key[:pairs] == k][-1] - at[0] >= 9900
    assert ((place >= low) & (place < low + t) & (high < len(line) - t + 1)).all()


def test_empty(spark):
    assert passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_words_limit(spark):
    with pytest.raises(ValueError):
        passages(spark.createDataFrame([], "doc_id long, text string"), least_words=substrings.WIDTH)


def test_bitmap_keeps_what_a_join_would_keep(spark):
    rows = spark.range(40000).selectExpr("id", "xxhash64(id) AS uid", "'t' AS part_2")
    some = rows.where("id % 97 = 0").select("uid")
    left = substrings.perhaps_in(rows, "uid", some)
    assert left.columns == rows.columns
    assert left.join(some, "uid", "left_semi").count() == some.count() and left.count() < 2 * some.count()
    assert substrings.perhaps_in(rows, "uid", some.limit(0)).count() == 0


def test_a_frequent_line_hides_no_equal_passage(spark):
    """300 texts have a line of 45 words; pairs of them share a passage around it, and few keys have only their two texts."""
    rnd = random.Random(11)
    line = text(rnd, 45)
    rows = [(k, " ".join(text(rnd, 40) + line + text(rnd, 40))) for k in range(300)]
    for k in range(30):
        before, after = text(rnd, 6), text(rnd, 6)
        for j in (0, 1):
            rows.append((1000 + 2 * k + j, " ".join(text(rnd, 50 + 7 * j) + before + line + after + text(rnd, 30))))
    short = text(rnd, 30)
    rows += [(2000 + k, " ".join(text(rnd, 40) + short + text(rnd, 40))) for k in range(300)]
    for k in range(30):
        before, after = text(rnd, 15), text(rnd, 15)
        rows += [(3000 + 2 * k + j, " ".join(text(rnd, 50 + 7 * j) + before + short + after + text(rnd, 30))) for j in (0, 1)]
    found = passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    by = {r.doc_id: r for r in found if r.doc_id >= 3000}
    assert set(by) == set(range(3000, 3060)) and all(abs(r.start_word - (50 if d % 2 == 0 else 57)) <= 8 and r.end_word - r.start_word >= 50 for d, r in by.items())
    assert {r.doc_id for r in found} >= set(range(1000, 1060)) and not any(2000 <= r.doc_id < 3000 for r in found)


def test_variants_of_a_frequent_template_find_each_other(spark):
    """Copies with 3 words of 60 changed, beside 300 texts that have 45 words of the template's."""
    rnd = random.Random(12)
    line = text(rnd, 30)
    rows = [(k, " ".join(text(rnd, 40) + line + text(rnd, 40))) for k in range(300)]
    for k in range(100):
        passage = text(rnd, 20) + line + text(rnd, 20)
        other = list(passage)
        other[rnd.randrange(5, 65)] = "changed"
        rows += [(1000 + 2 * k, " ".join(text(rnd, 50) + passage + text(rnd, 30))), (1001 + 2 * k, " ".join(text(rnd, 57) + other + text(rnd, 30)))]
    found = {r.doc_id for r in passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len([d for d in found if d >= 1000]) >= 190 and not any(d < 1000 for d in found)


def test_linked_windows():
    """Classes are joined as by brute force over all pairs, whatever the places at which members are aligned."""
    rnd, t = random.Random(13), 20
    for n in [2, *rnd.choices(range(3, 30), k=40)]:
        base = [[rnd.randrange(10**6) for _ in range(60)] for _ in range(3)]
        shown, before = [], []
        for _ in range(n):
            x, a = list(rnd.choice(base)), rnd.randrange(30)
            for _ in range(rnd.randrange(8)):
                x[rnd.randrange(60)] = rnd.randrange(10**6)
            if rnd.random() < 0.3:
                x.insert(rnd.randrange(60), rnd.randrange(10**6))
            shown.append(np.array(x[a : a + t + rnd.randrange(30)], np.uint32))
            before.append(30 - a)
        cls, before = np.array([rnd.randrange(n) for _ in range(n)]), np.array(before)

        def joins(pairs):
            of = {int(c): int(c) for c in cls}
            for i, j in pairs:
                a, b = sorted((of[int(cls[i])], of[int(cls[j])]))
                of = {c: a if x == b else x for c, x in of.items()}
            return of

        def like(i, j):
            starts = np.arange(max(len(shown[j]) - t + 1, 0))
            return substrings.alike(shown[j], shown[i], int(before[i] - before[j]), starts, t, 0.8).any()

        for side in (np.zeros(n, np.int64), (np.arange(n) >= n // 2).astype(np.int64)):
            pairs = [(i, j) for j in range(n) for i in range(j) if (side[i] < side[j] or not side.any()) and like(i, j)]
            got = substrings.linked_windows(shown, before, side, cls, t, 0.8)
            assert set(got) <= set(pairs) and joins(got) == joins(pairs) and len(got) < n


def test_what_the_first_is_not_alike_to_is_compared_with_all(spark):
    """Copies with one word changed, all around a line of 36 words that 400 texts have: a key's first is seldom one of the two."""
    rnd = random.Random(17)
    line = text(rnd, 36)
    rows = [(k, " ".join(text(rnd, 40) + line + text(rnd, 40))) for k in range(400)]
    for k in range(200):
        passage = text(rnd, 9) + line + text(rnd, 9)
        other = [*passage[:6], "changed", *passage[7:]]
        rows += [(1000 + 2 * k, " ".join(text(rnd, 50) + passage + text(rnd, 30))), (1001 + 2 * k, " ".join(text(rnd, 57) + other + text(rnd, 30)))]
    found = {r.doc_id for r in passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len([d for d in found if d >= 1000]) >= 394 and not any(d < 1000 for d in found)


def test_keys_are_dealt_out_by_the_bucket():
    """A row for each bucket, not for each key; groups and their first members are those of brute force."""
    rnd, t = random.Random(19), substrings.LEAST_WORDS - substrings.WIDTH + 1
    line = text(rnd, 80)
    raw = [" ".join(text(rnd, 60 + 9 * k) + line * (1 + k % 2) + text(rnd, 40)).encode() for k in range(60)] + [b"", b"short"]
    raw[7] = raw[3]
    key, who, place, low, high = substrings.signatures([substrings.shingles(substrings.word_hashes(x)) for x in raw], t)
    uids = rnd.sample(range(-(10**9), 10**9), len(raw))
    groups = {}
    for k, w, p, a, b in zip(key.view(np.int64).tolist(), who.tolist(), place.tolist(), low.tolist(), high.tolist()):
        groups.setdefault(k, []).append((uids[w], p - a << 52 | b - a << 40 | a))
    expected = {(k, u, min(rows)[0], p, min(rows)[1]) for k, rows in groups.items() for u, p in rows if (u, p) != min(rows)}
    given = pa.RecordBatch.from_arrays([pa.array(uids), pa.array(raw, pa.binary())], names=["uid", "raw"])
    dealt = pa.Table.from_batches(substrings._emit(t, 8)(iter([given])))
    assert dealt.num_rows <= 2 * 8 < len(key) / 100 and set(dealt["bucket"].to_pylist()) == set(range(8))
    aligned = pa.Table.from_batches(substrings._align(iter(dealt.sort_by("bucket").to_batches(max_chunksize=3))))
    got = [tuple(r.values()) for r in aligned.to_pylist()]
    assert set(got) == expected and len(got) == len(expected)
    # the same of two tasks: firsts of each meet in their bucket
    halves = [pa.Table.from_batches(substrings._emit(t, 8)(iter([given.slice(k, 31)]))) for k in (0, 31)]
    aligned = pa.Table.from_batches(substrings._align(iter(pa.concat_tables(halves).sort_by("bucket").to_batches(max_chunksize=3))))
    joined = {}
    for k, u, r, p, q in (tuple(r.values()) for r in aligned.to_pylist()):
        joined.setdefault(k, set()).update({(u, p), (r, q)})
    assert joined == {k: set(rows) for k, rows in groups.items() if len(set(rows)) > 1}


def test_packed_rows():
    rnd = np.random.default_rng(20)
    for n in (1, 2, 100):
        rows = rnd.integers(-(2**63), 2**63 - 1, (3, n))
        assert (substrings.unpacked_rows(substrings.packed_rows(rows), 3) == rows).all()
    assert [substrings.buckets_of(n) for n in (0, 10**6, 2 * 10**8, 4 * 10**9, 10**10)] == [1024, 1024, 2000, 4096, 10_000]


def test_members_are_compared_many_at_a_time(monkeypatch):
    """Fewer passes than members; links are the same however many members a pass takes."""
    rnd, t = random.Random(21), 20
    base = [[rnd.randrange(10**6) for _ in range(40)] for _ in range(4)]
    shown = []
    for k in range(120):
        x = list(base[k % 4])
        for _ in range(k % 5):
            x[rnd.randrange(40)] = rnd.randrange(10**6)
        if k % 3 == 0:
            x.insert(rnd.randrange(40), rnd.randrange(10**6))
        shown.append(np.array(x, np.uint32))
    before, side, cls = np.zeros(120, np.int64), np.zeros(120, np.int64), np.arange(120)
    passes, cumsum = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **b: passes.append(1) or cumsum(*a, **b))
    links = substrings.linked_windows(shown, before, side, cls, t, 0.8)
    assert len(links) >= 100 and len(passes) < 60
    monkeypatch.setattr(substrings, "ACROSS", 1)
    assert substrings.linked_windows(shown, before, side, cls, t, 0.8) == links


def test_cover_and_verify_are_as_one_by_one():
    rnd, t = random.Random(22), 20
    rows = sorted((rnd.randrange(3), rnd.randrange(2), rnd.randrange(-2, 2), rnd.randrange(3000)) for _ in range(900))
    rows = [(*r, r[3] + rnd.randrange(300)) for r in rows]
    starts = {}
    for u, r, s, a, b in rows:
        starts.setdefault((u, r, s), []).append((a, b))
    expected = set()
    for (u, r, s), spans in starts.items():
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1] + t:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        expected |= {(u, k, min(k + substrings.PIECE - 1, b), r, s) for a, b in merged for k in range(a, b + 1, substrings.PIECE)}
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["uid", "rep", "shift", "lo", "hi"])
    for size in (1, 7, 1000):
        got = [tuple(r.values()) for x in substrings._cover(t)(iter(table.to_batches(max_chunksize=size))) for r in x.to_pylist()]
        assert set(got) == expected and len(got) == len(expected)

    asked, expected = [], []
    for k in range(400):
        own = [rnd.randrange(10**6) for _ in range(rnd.randrange(60, 140))]
        other = list(own)
        for _ in range(rnd.randrange(12)):
            other[rnd.randrange(len(own))] = rnd.randrange(10**6)
        if k % 3 == 0:
            other.insert(rnd.randrange(len(own)), 7)
        drop, a, shift = rnd.randrange(12), rnd.randrange(16, 24), rnd.randrange(-5, 5)
        b, at, other = a + rnd.randrange(100), 16, other[drop:]
        rep_at = at - shift + drop if k % 5 else at
        own, other = np.array(own, np.uint32), np.array(other, np.uint32)
        asked.append((k, a, b, -k, shift, at, rep_at, own.tobytes(), other.tobytes()))
        good = np.flatnonzero(substrings.alike(own, other, at - shift - rep_at, np.arange(a, b + 1) - at, t, 0.8))
        for run in np.split(good, np.flatnonzero(np.diff(good) > t) + 1) if len(good) else []:
            lo, hi = a + int(run[0]), a + int(run[-1]) + t + substrings.WIDTH - 1
            expected.append((k, lo, hi, -k, max(lo - shift, 0), max(hi - shift, 0)))
    table = pa.table([pa.array(c) for c in zip(*asked)], names=["uid", "a", "b", "rep", "shift", "at", "rep_at", "shingles", "rep_shingles"])
    for size in (1, 90, 400):
        got = [tuple(r.values()) for x in substrings._verify(t, 0.8)(iter(table.to_batches(max_chunksize=size))) for r in x.to_pylist()]
        assert sorted(got) == sorted(expected) and 200 < len(got)


def test_stretches_and_regions_of_many_texts_come_together():
    from loomgraph.llm import substrings as s

    raw = [b" ".join(b"w%d" % (k * 31 + n) for n in range(60 + k % 7)) for k in range(90)] + [b"", None, b"one two"]
    ids = pa.array([*range(len(raw))], pa.int64())
    starts = pa.array([[0, 16]] * len(raw), pa.list_(pa.int32()))
    regions = pa.array([[{"low": 2, "high": 5}]] * len(raw), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
    want = [(s.shingles(s.word_hashes(x)) >> np.uint64(32)).astype(np.uint32) for x in raw]
    assert all((x == s.shingles(s.word_hashes(r))).all() and len(x) == max(0, len(s.word_hashes(r)) - 4) for x, r in zip(s.shingles_of(raw), raw, strict=True))
    for made, asked, parts in ((s._stretches(46), starts, [(k, k + s.PIECE + 46 + 2 * s.GRID) for k in (0, 16)]), (s._regions(46), regions, [(2, 51)])):
        batch = pa.RecordBatch.from_arrays([ids, asked, pa.array(raw, pa.binary())], names=["uid", "asked", "raw"])
        out = list(made(iter([batch, batch])))
        assert len(out) == 1 and out[0].column(0).to_pylist() == [k for k in range(len(raw)) for _ in parts]
        assert out[0].column("shingles").to_pylist() == [x[a:b].tobytes() for x in want for a, b in parts]
