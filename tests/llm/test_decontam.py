import random

import numpy as np
import pytest

from loomgraph.llm import decontam
from loomgraph.llm.decontam import Items, best_match, clean, matches, walks


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        kind, at = rnd.random(), rnd.randrange(len(out))
        if kind < 0.34:
            out[at] = rnd.choice(vocabulary)
        elif kind < 0.67:
            out.insert(at, rnd.choice(vocabulary))
        else:
            del out[at]
    return out


VOCABULARY = [f"w{k}" for k in range(400)] + ["the", "of"] * 40


def test_best_match_is_exact():
    rnd = random.Random(1)
    for _ in range(150):
        item = [rnd.randrange(5) for _ in range(rnd.randint(1, 7))]
        text = [rnd.randrange(5) for _ in range(rnd.randint(0, 9))]
        d, a, b = best_match(np.array(item), np.array(text))
        want = min(edit(item, text[x:y]) for x in range(len(text) + 1) for y in range(x, len(text) + 1))
        assert d == want and edit(item, text[a:b]) == d


@pytest.mark.parametrize("size", [8, 20, 45, 60])
def test_recall_at_the_full_distance(size):
    rnd = random.Random(size)
    items = [(k, " ".join(rnd.choice(VOCABULARY) for _ in range(size))) for k in range(40)]
    index, hit, of = Items(items), 0, 0
    for k, text in items:
        for _ in range(5):
            words = edited(rnd, text.split(), size // 5, VOCABULARY)
            around = [[rnd.choice(VOCABULARY) for _ in range(60)] for _ in range(2)]
            if edit(text.split(), words) <= size // 5:
                of += 1
                hit += any(f[0] == k for f in index.search(" ".join(around[0] + words + around[1])))
    assert of > 150 and hit / of >= 0.99


def test_clean_texts_stay():
    rnd = random.Random(9)
    index = Items([(k, " ".join(rnd.choice(VOCABULARY) for _ in range(30))) for k in range(40)])
    assert not any(index.search(" ".join(rnd.choice(VOCABULARY) for _ in range(300))) for _ in range(60))


def test_walks_of_equal_windows_are_equal_and_shifts_rejoin():
    rnd = np.random.default_rng(3)
    a = rnd.integers(1, 500, (50, 40))
    assert (walks(a) == walks(a.copy())).all()
    moved = np.concatenate((a[:, :5], rnd.integers(1, 500, (50, 1)), a[:, 5:-1]), axis=1)
    apart = rnd.integers(1, 500, (50, 40))
    assert (walks(a) == walks(moved)).mean() > 0.4 > 0.05 > (walks(a) == walks(apart)).mean()


def test_two_copies_one_after_the_other():
    text = " ".join(f"w{k}" for k in range(20))
    assert [(f[1], f[2], f[3]) for f in Items([(1, text)]).search(f"x {text} {text} y")] == [(1, 21, 0), (21, 41, 0)]


def test_tables(spark):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (2, None), (None, item + " x"), (3, "short one"), (4, ""), (1, item)], "item_id long, text string")
    rows = [(1, f"before {item.upper()}, after", "a"), (2, None, "a"), (3, "", None), (4, "nothing here", "b"), (5, item.replace("four", "4"), "b"), (None, item, "c"), (1, f"before {item.upper()}, after", "a"), (6, "a " * 30000 + item, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted((tuple(r) for r in matches(docs, bench).collect()), key=str)
    assert got == sorted([(1, 1, 1, 11, 0, 10)] * 2 + [(5, 1, 0, 10, 1, 10), (None, 1, 0, 10, 0, 10), (6, 1, 30000, 30010, 0, 10)], key=str)
    left = clean(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 4]
    assert matches(docs, bench.limit(0)).count() == 0 and clean(docs.limit(0), bench).count() == 0
    assert clean(docs, bench.limit(0)).count() == len(rows)


def test_blocks_cover_all_items(spark):
    bench = spark.createDataFrame([(k, f"word{k} " * 9) for k in range(50)], "item_id long, text string")
    parts = list(decontam.blocks(bench, 700))
    assert len(parts) > 1 and sorted(i for p in parts for i, _ in p) == list(range(50))


def test_recall_of_the_keys_alone():
    """All windows are looked up, without the test of pieces: the walks' keys find what brute force finds."""
    rnd = random.Random(31)
    items = [(k, " ".join(rnd.choice(VOCABULARY) for _ in range(size))) for k, size in enumerate([10, 20, 30, 45] * 5)]
    index, hit, of, extra = Items(items), 0, 0, 0
    for k, text in items:
        for _ in range(4):
            words = [*(rnd.choice(VOCABULARY) for _ in range(40)), *edited(rnd, text.split(), len(text.split()) // 5, VOCABULARY), *(rnd.choice(VOCABULARY) for _ in range(40))]
            numbers = {w: n for n, w in enumerate(set(words + [w for _, t in items for w in t.split()]))}
            near = {i for i, t in items if best_match(np.array([numbers[w] for w in t.split()]), np.array([numbers[w] for w in words]))[0] <= len(t.split()) // 5}
            got = {f[0] for f in index.search(" ".join(words), everywhere=True)}
            hit, of, extra = hit + len(near & got), of + len(near), extra + len(got - near)
            assert {f[0] for f in index.search(" ".join(words))} <= got
    assert of >= 75 and hit / of >= 0.99 and extra == 0
