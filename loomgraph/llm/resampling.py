"""Importance resampling toward a target set by hashed n-grams, on a table of word positions.

Each text's words are laid out as rows (posexplode); a window over a document's rows leads the following words in, so a row
holds the runs of 1, 2, ... words that begin at its place. Runs are hashed into buckets; buckets are counted over all documents
and over all target texts, a bucket's gain is the logarithm of the ratio of its two smoothed shares, and gains are joined back to
the positions. A document's weight is the mean gain of its runs. Documents are drawn without replacement by the largest weight
plus Gumbel noise, which is a hash of the document's id: reruns draw alike.

Texts are shuffled once, by row; words and windows follow in the same tasks. The position table holds bucket numbers instead
of words and is written once. What is shuffled beyond it are counts of buckets and a row for each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import staged

ORDER, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: What parts words: ASCII signs, capitals included since case is folded first.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text whose words one task orders, about.
TASK_BYTES = 8 << 20


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, no other letter; words of ASCII alone take the short way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text, case kept: runs of characters that are no ASCII sign. A null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), APART), "")


def positions(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(uid, id, b1, ..., b<order>): a row for each word of each row of texts (id, text), as a written table.

    bk is the bucket of the k words from there on, null where the text ends before. A text without words has one row of
    nulls. uid tells rows apart that repeat an id.
    """
    if order < 1 or buckets < 1:
        raise ValueError("order and buckets are at least 1")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = texts.select(F.monotonically_increasing_id().alias("uid"), "id", "text").repartition(parts, "uid")
    rows = rows.select("uid", "id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word")).withColumn("word", lower_ascii(F.col("word")))
    following = Window.partitionBy("uid").orderBy("pos")
    for k in range(2, order + 1):
        rows = rows.withColumn(f"w{k}", F.lead("word", k - 1).over(following))
    run, out = F.col("word"), []
    for k in range(1, order + 1):
        run = run if k == 1 else F.concat(run, F.lit(" "), F.col(f"w{k}"))
        out.append((F.crc32(run) % buckets).cast("int").alias(f"b{k}"))
    return staged(rows.select("uid", "id", *out), "positions")


def _runs(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c.startswith("b")]


def bucket_counts(table: DataFrame) -> DataFrame:
    """(bucket, n) over all rows of a position table."""
    return table.select(F.explode(F.array(*_runs(table))).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), a row for each bucket, of the position tables of documents and of target texts; a written table.

    gain: thousandths of the logarithm of a bucket's share of the target's runs over its share of the documents', each
    count one more than seen, rounded down.
    """
    spark = source.sparkSession
    s, t = (staged(bucket_counts(x), "bucket-counts") for x in (source, target))
    all_s, all_t = ((x.agg(F.sum("n")).first()[0] or 0) for x in (s, t))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    every = every.join(s.withColumnRenamed("n", "s"), "bucket", "left").join(t.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    ratio = ((F.col("t") + 1).cast("double") * float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * float(all_t + buckets))
    return staged(every.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")), "gains")


def weights(table: DataFrame, gain: DataFrame) -> DataFrame:
    """(uid, id, n_words, n_features, weight): a row for each text of a position table; weight is the mean gain, rounded down."""
    rows, total, n = table, F.lit(0).cast("long"), F.lit(0).cast("long")
    for b in _runs(table):
        own = gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}"))
        rows = rows.join(own, b, "left")
        total, n = total + F.coalesce(F.col(f"g_{b}"), F.lit(0)), n + F.col(b).isNotNull().cast("long")
    out = rows.groupBy("uid", "id").agg(F.count("b1").alias("n_words"), F.sum(n).alias("n_features"), F.sum(total).alias("total"))
    # whole numbers: a quotient in doubles could round up to the next one
    mean = F.expr("(total - pmod(total, n_features)) div n_features")
    return out.select("uid", "id", "n_words", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long").alias("weight"))


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranks(rows: DataFrame, first: list[Column]) -> DataFrame:
    """rows with rank: 1, 2, 3, ... in the order of first, which must tell all rows apart.

    Rows are dealt out by ranges of that order; a range's rank begins behind those before it.
    """
    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(first)])
    dealt = staged(rows.repartitionByRange(*first).withColumn("part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"))
    earlier = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*first)))
    return inside.join(parts, "part").select(*rows.columns, (F.col("base") + F.col("nth")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of docs (doc_id, text); target has text.

    Of the N documents with at least least_words words, the floor(percent * N / 100) of the highest scores are drawn; their
    rank is 1, 2, 3, ..., that of all others null. Ties go to the smaller doc_id; rows that repeat a doc_id with equal
    scores are rows of their own, in any order. Null and empty texts, and texts of signs alone, have no features and weight
    0. A row without doc_id has no score, is not drawn and not counted in N, but its words count in the buckets. Without
    target texts all of its shares are equal; without documents there are no rows. Other columns are not read.
    """
    table = positions(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), order, buckets)
    aim = positions(target.select(F.lit(0).alias("id"), F.col("text").cast("string").alias("text")), order, buckets)
    scored = weights(table, gains(table, aim, buckets)).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = staged(scored, "scored")
    able = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    take = percent * scored.where(able).count() // 100
    drawn = ranks(scored.where(able), [(-F.col("score")), F.col("id"), F.col("uid")])
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    others = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(others).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """docs, all columns, of the drawn doc_ids: the resampled corpus. Rows that repeat a drawn doc_id are all kept."""
    ids = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("drawn_")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["drawn_"], "left_semi")
