import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomgraph.llm import tokens
from loomgraph.session import fresh_path

TEXTS = [
    (5, "Hello, World! The end."), (1, None), (2, ""), (9, "it's DON'T we'll x's 12a3 a_b"), (-3, "café CAFÉ naïve Straße ẞ İstanbul ſ K é"),
    (4, "<|endoftext|> a<|startoftext|>b"), (7, "a\x1cb \x85 \xa0 　x"), (8, "日本語 テスト العربية"), (11, "x!!?? ,,a .b ΟΔΟΣ ﬁ ½ ² ①"), (6, "long words " * 20000), (12, "\r\n\t \x0b\x0c"),
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def test_words_and_texts_encode_alike(whole):
    e = tokens.WordEncoder(tokens.default_path())
    assert e.by_word
    for _ in range(2):  # new words, then kept ones
        for (_, text), ids in zip(TEXTS, e.encode(pa.array([t for _, t in TEXTS]), 1).to_pylist()):
            assert ids == whole(text)


def test_words_beyond_what_is_kept(whole, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 3)
    e = tokens.WordEncoder(tokens.default_path())
    for _, text in TEXTS:
        assert e.encode(pa.array([text], pa.string())).to_pylist()[0] + [1] == whole(text)


def test_round_trip(spark, whole):
    df = spark.createDataFrame([(*r, "x") for r in TEXTS], "doc_id long, text string, ids string").repartition(3)
    got = tokens.round_trip(df)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want, start = [], 0
    for d, t in sorted(TEXTS):
        ids = whole(t)
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c c"), (1, "b")], "doc_id long, text string")
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in tokens.round_trip(df).collect())
    assert got == [(0, 3, None), (3, 2, 1), (5, 2, 1), (7, 2, 1)]
    assert tokens.round_trip(df.limit(0)).count() == 0


def test_files(spark):
    folder = fresh_path(spark, "tokens-test")
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('word', id % 50, ' and ', id) AS text")
    tokens.write(df, folder, files=2)
    files = sorted(glob.glob(folder.removeprefix("file://") + "/*.parquet"))
    ranges = []
    for f in files:
        m = pq.ParquetFile(f).metadata
        c = m.row_group(0).column(2)
        assert m.row_group(0).column(0).has_column_index and c.has_offset_index and "RLE_DICTIONARY" in c.encodings or "DELTA_BINARY_PACKED" in c.encodings
        ids = pq.read_table(f, columns=["doc_id"]).column(0).to_pylist()
        assert ids == sorted(ids)
        ranges.append((ids[0], ids[-1]))
    assert all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:]))
    some = tokens.read(spark, folder, 100, 120)
    assert some.count() == 21 and "doc_id" in str(some._jdf.queryExecution().executedPlan()) and "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in str(some._jdf.queryExecution().executedPlan())
