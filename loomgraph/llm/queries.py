"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back by the index; later pages of equal payloads are revisits."""
    from loomgraph.llm import warc

    return warc.round_trip(read(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links of up to 4 bits lead to."""
    from loomgraph.llm import simhash

    found = simhash.classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that are not held out."""
    from loomgraph.llm import toxicity

    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that the mix of its source takes."""
    from loomgraph.llm import mixing

    return mixing.mix(read(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents share."""
    from loomgraph.llm import substrings

    return substrings.passages(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of benchmark items in documents."""
    from loomgraph.llm import decontam

    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, read back from the token table."""
    from loomgraph.llm import tokens

    return tokens.round_trip(read(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from those that are not held out."""
    from loomgraph.llm import langid

    docs = read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.93 and more within its label."""
    from loomgraph.llm import embeddings

    return embeddings.duplicates(read(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    from loomgraph.llm import pii

    return pii.scan(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every usable vector."""
    from loomgraph.llm import whitening

    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; a row for each piece, read from the sequences."""
    from loomgraph.llm import packing

    return packing.digests(packing.pack(read(spark, sf_dir, "documents")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words and more, drawn toward the benchmark's word pairs."""
    from loomgraph.llm import resampling

    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_simhash": op2_simhash,
        "op3_toxicity": op3_toxicity,
        "op4_mixing": op4_mixing,
        "op5_substrings": op5_substrings,
        "op6_decontamination": op6_decontamination,
        "op7_tokens": op7_tokens,
        "op8_langid": op8_langid,
        "op9_embeddings": op9_embeddings,
        "op10_pii": op10_pii,
        "op11_whitening": op11_whitening,
        "op12_packing": op12_packing,
        "op13_resampling": op13_resampling,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
o AS (SELECT h, max(page_id) AS owner FROM d GROUP BY h),
n AS (SELECT page_id, payload_bytes, owner, list_transform(range(0, 4), lambda k: ('0x' || substr(d.h, 1 + 10 * k, 10))::BIGINT) AS parts FROM d JOIN o ON d.h = o.h)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + k // 8] >> (5 * (7 - k % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
 CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM n"""

OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
 WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept FROM reach GROUP BY vec_id"""

#: DuckDB has no crc32: a table of its 256 steps is made, and each different run of words goes through it byte by byte.
OP13_SQL = r"""
WITH steps AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS uid, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, doc_id, uid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
f AS (SELECT side, uid, unnest(words) AS run FROM w UNION ALL SELECT side, uid, unnest(list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1])) FROM w),
r AS (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM f)),
b AS (SELECT run, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda k: ('0x' || substr(h, 1 + 2 * k, 2))::BIGINT)), lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM r, steps),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (run) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
m AS (SELECT uid, count(*) AS n_features, sum(gain)::BIGINT AS total FROM f JOIN b USING (run) JOIN g USING (bucket) WHERE side = 0 GROUP BY uid),
d AS (SELECT doc_id, uid, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
 ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (uid) WHERE side = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_words >= 20 AND doc_id IS NOT NULL AS able FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, uid) AS place, count(*) FILTER (able) OVER () AS able_n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * able_n // 100 THEN place END AS rank FROM o"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op9_embeddings": OP9_SQL, "op13_resampling": OP13_SQL}
