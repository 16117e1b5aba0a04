import hashlib
import math
import re
import zlib

import duckdb
import pytest

from loomgraph.llm import queries, resampling


def brute(docs, target, order=2, buckets=10_000, least=20, percent=25, seed=7):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, order + 1) for k in range(len(w) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for b in features(x)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log(((b + 1) * (sum(s) + buckets)) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for k, (d, x) in enumerate(docs):
        w, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, len(w), k])
    able = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for n, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CASES = [
    (1, "The cat sat on the mat. The CAT sat again!" * 3), (2, None), (3, ""), (4, "?!, ..."), (5, "É é ÉCOLE école Straße naïve 日本 語 x y K " * 4), (6, "one"), (7, "word " * 30_000),
    (-4, "a1b2 33 'tis x's \x00y\x7fz " * 9), (8, "the mat sat on the cat " * 6), (8, "the mat sat on the cat " * 6), (8, "other " * 25), (None, "the mat sat on " * 20), (None, None),
]


@pytest.mark.parametrize("order,buckets,percent", [(2, 10_000, 25), (1, 7, 60), (3, 997, 100)])
def test_against_brute_force(spark, order, buckets, percent):
    docs = CASES + [(100 + k, f"item {k % 7} has {k} parts, of which {k % 3} broke " * (1 + k % 5)) for k in range(120)]
    target = ["the cat sat", "Item 3 broke; item 3 HAS parts", None, ""]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, uid string, b1 int").repartition(5)
    aim = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id int, text string")
    got = resampling.resample(df, aim, order, buckets, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert rows(got) == brute(docs, target, order, buckets, percent=percent)


def test_whole_tables(spark):
    """The query, on the given documents."""
    got = rows(queries.op13_resampling(spark, "/root/testdata/sf0.001"))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    assert got == brute(docs, target) and sum(r[4] is not None for r in got) > 20
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    assert sorted(duck.sql(queries.OP13_SQL).fetchall(), key=str) == got


def test_empty_tables(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    aim = spark.createDataFrame([("the cat",)], "text string")
    assert resampling.resample(docs.limit(0), aim).count() == 0
    assert rows(resampling.resample(docs, aim.limit(0))) == brute(CASES, [])


def test_ranks_of_one_value(spark):
    """A third of the rows of one score and id, and more."""
    df = spark.range(3000).selectExpr("id AS uid", "if(id % 3 = 0, 5, id % 11) AS score")
    from pyspark.sql import functions as F

    got = {r.uid: r["rank"] for r in resampling.ranks(df, [-F.col("score"), F.col("uid")]).collect()}
    want = sorted(range(3000), key=lambda k: (-(5 if k % 3 == 0 else k % 11), k))
    assert [got[k] for k in want] == list(range(1, 3001))


def test_drawn_documents(spark):
    docs = spark.createDataFrame([(k, f"item {k} " * 20, k) for k in range(40)], "doc_id long, text string, rank int")
    aim = spark.createDataFrame([("item",)], "text string")
    ids = {r.doc_id for r in resampling.resample(docs, aim).where("rank is not null").collect()}
    kept = resampling.drawn_documents(docs, aim)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids and len(ids) == 10
