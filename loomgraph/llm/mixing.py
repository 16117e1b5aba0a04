"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame operations only.

Slot n of the mix draws the golden-ratio point frac((n + 1/2) * 0.618...) and maps it through the cumulative target
shares to a source. Slots are ranked within their source. Each source's documents, in an order shuffled by hash and
repeated at most `MAX_REPEATS` times, form one run of words that is cut into blocks of equal size; the slot of rank k takes
block k, and the last block ends at the target. Words, not documents, are dealt out. What the points leave out of a source,
as all of a source far smaller than a block, follows in slots of its own at the end: each source gives its target to the word.

Ranks and running sums never gather a source: rows are cut into shards by their shuffled order, shard totals are
summed per source, and rows are ordered within a shard alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import staged

MAX_REPEATS = 3
#: Rows of a shard, on average; a shard is what one window orders.
SHARD_ROWS = 2048
#: Words of a block, at most: it is 1 / LEAST_SLOTS of all words where that is less, so that a mix has LEAST_SLOTS slots or more.
BLOCK_WORDS, LEAST_SLOTS = 1024, 1 << 15
#: Cells of the unit interval through which points meet the cumulative shares.
CELLS = 4096
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, pattern: tuple[float, ...] = (1.0, 2.0, 3.0), repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes (source, total) with weight, target, lo and hi: one row for each source, null included.

    Sources by code point, null last, weigh as the pattern says, repeating. All words are shared by weight; no target is
    over `repeats` times its source's words, the excess goes to the others by weight, again and again: so every
    source below its bound has weight * level for one common level, and those at their bound are the ones with the
    least words for their weight. lo and hi bound the source's part of the unit interval. Its windows run over one row
    for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in pattern])
    s = sizes.withColumn("weight", F.get(weights, (F.row_number().over(by_name) - 1) % len(pattern)))
    s = s.withColumn("bound", (F.col("total") * repeats).cast("double"))
    every = Window.partitionBy()
    by_need = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    left = F.sum("total").over(every) - F.coalesce(F.sum("bound").over(before), zero)
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    s = s.withColumn("level", left / weight_left)  # if all of less need are at their bounds
    s = s.withColumn("open", F.col("weight") * F.col("level") <= F.col("bound"))
    s = s.withColumn("level", F.min(F.struct(F.when(F.col("open"), F.col("bound") / F.col("weight")).otherwise(float("inf")).alias("at"), F.col("level").alias("level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("bound"), F.col("weight") * F.col("level")))
    share = F.col("target") / F.greatest(F.sum("target").over(every), F.lit(1e-300))
    s = s.withColumn("hi", F.sum(share).over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), zero))
    s = s.withColumn("nth", F.row_number().over(by_name))
    last = F.col("nth") == F.max(F.when(F.col("target") > 0, F.col("nth"))).over(every)
    return s.select("source", "total", "weight", "target", "lo", F.when(last, F.lit(2.0)).otherwise(F.col("hi")).alias("hi"))


def running(rows: DataFrame, key: str, shard: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all earlier rows of the same key: by shard, then by order within a shard."""
    totals = rows.groupBy(key, shard).agg(F.sum(value).alias("shard_total"))
    earlier = Window.partitionBy(key).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("k_"), F.col(shard).alias("s_"), F.coalesce(F.sum("shard_total").over(earlier), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(key, shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    on = out[key].eqNullSafe(totals["k_"]) & (out[shard] == totals["s_"])
    return out.join(totals, on).withColumn(name, F.col(name) + F.col("base_")).drop("k_", "s_", "base_")


def _order(doc_id: Column, text: Column) -> Column:
    """The shuffled order, of id and text: rows that repeat an id, or have none, lie apart unless their texts are equal too."""
    return F.xxhash64(doc_id, text, F.lit("mix"))


def _sizes(docs: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return staged(d.select("doc_id", "source", word_count(F.col("text")).alias("size"), _order(F.col("doc_id"), F.col("text")).alias("at")), "sizes")


def schedule(docs: DataFrame, block_words: int = BLOCK_WORDS, pattern: tuple[float, ...] = (1.0, 2.0, 3.0), least_slots: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, shares, pieces).

    rows: doc_id, source, size, pos (its place within source: unique), start (words of its source before it).
    shares: as targets(). pieces: the mix itself, slot by slot: slot, source, pos, doc_id, from_word, n_words; slots in
    order, and below a slot by place, are the mixed text. Null sources are a source; repeated rows are rows of their own;
    wordless documents are in rows only.
    """
    sized = _sizes(docs)
    shares = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("total")), pattern), "shares")
    seen = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    block_words = max(1, min(block_words, seen[1] // (least_slots or LEAST_SLOTS)))
    n_shards, n_slots = max(1, -(-seen[0] // SHARD_ROWS)), -(-seen[1] // block_words)
    rows = sized.withColumn("shard", F.expr(f"pmod(at, {n_shards})"))
    order = [F.col("at"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    within = Window.partitionBy("source", "shard").orderBy(*order)
    rows = running(rows.withColumn("place", F.row_number().over(within)), "source", "shard", [F.col("place")], F.col("size"), "start")
    rows = staged(rows.select("doc_id", "source", "size", "at", "shard", "place", "start"), "rows")

    # slot -> source: points and shares meet in a cell of the unit interval
    point = (F.col("id") + 0.5) * GOLDEN
    slots = docs.sparkSession.range(n_slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS).cast("int"))
    cells = shares.where("lo < hi and target > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))))
    drawn = slots.join(cells.select("cell", "source", "lo", "hi", "total"), "cell").where("u >= lo and u < hi")
    drawn = drawn.select("slot", "source", "total", F.expr(f"slot div {SHARD_ROWS}").alias("shard"))
    ranked = running(drawn, "source", "shard", [F.col("slot")], F.lit(1), "block").select("slot", "source", "block")

    # what the points drew too seldom, at the end: a few blocks a source
    whole_target = F.floor(F.col("target") + 0.5)
    got = drawn.groupBy(F.col("source").alias("s_")).agg(F.count(F.lit(1)).alias("got"))
    short = shares.join(got, F.col("source").eqNullSafe(F.col("s_")), "left").select("source", F.coalesce("got", F.lit(0)).alias("got"), F.ceil(whole_target / block_words).alias("need"))
    short = short.where("got < need").withColumn("more", F.col("need") - F.col("got"))
    earlier = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("at", n_slots + F.coalesce(F.sum("more").over(earlier), F.lit(0)) - F.col("got"))
    short = short.withColumn("block", F.explode(F.sequence(F.col("got"), F.col("need") - 1)))
    ranked = ranked.unionByName(short.select((F.col("at") + F.col("block")).alias("slot"), "source", "block"))

    # documents -> blocks, pass by pass over the source's run of words
    ends = shares.select(F.col("source").alias("s_"), "total", whole_target.alias("until")).where("until > 0")
    whole = rows.where("size > 0").join(ends, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    passes = F.explode(F.sequence(F.lit(0), F.least(F.lit(MAX_REPEATS), F.ceil(F.col("until") / F.col("total"))).cast("int") - 1))
    whole = whole.withColumn("pass", passes).withColumn("begin", F.col("pass") * F.col("total") + F.col("start"))
    whole = whole.where("begin < until").withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("until")))
    cut = whole.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    lo = F.greatest(F.col("begin"), F.col("block") * block_words)
    hi = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    cut = cut.select("doc_id", F.col("source").alias("s_"), "shard", "place", F.col("block").alias("b_"), (lo - F.col("begin")).alias("from_word"), (hi - lo).alias("n_words"))
    pieces = ranked.join(cut, ranked["source"].eqNullSafe(cut["s_"]) & (ranked["block"] == cut["b_"])).drop("s_", "b_")
    return rows, shares, pieces


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, pattern: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs.

    taken counts the words that the mix takes of the document, repeats counted: at most three times its size. Null texts
    and texts without words have size 0 and are never taken. If no document has a word, all targets are 0. Ties in the
    shuffled order are of equal documents, so reruns agree. Other columns are not read.
    """
    rows, shares, pieces = schedule(docs, block_words, pattern)
    taken = pieces.groupBy(F.col("source").alias("s_"), F.col("shard").alias("h_"), F.col("place").alias("p_")).agg(F.sum("n_words").alias("taken"))
    on = rows["source"].eqNullSafe(F.col("s_")) & (rows["shard"] == F.col("h_")) & (rows["place"] == F.col("p_"))
    out = rows.join(taken, on, "left").drop("s_", "h_", "p_")
    sh = shares.select(F.col("source").alias("s_"), F.col("total").alias("source_size"), "target")
    out = out.join(sh, F.col("source").eqNullSafe(F.col("s_")))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, pattern: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """docs, all columns, as the mix takes them: each row as often as its words are taken, to the nearest whole number.

    The mix takes the first words of a source's run, so in its shuffled order all rows are taken `passes` times and those
    up to one last row once more: a row for each source says so, and texts need no shuffle. A run ends within one document,
    so rounding costs half a document a source. Rows that repeat doc_id and text are taken alike. Documents without words
    are not taken.
    """
    rows, shares, pieces = schedule(docs, block_words, pattern)
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    none = F.lit((1 << 63) - 1)
    took = pieces.groupBy(F.col("source").alias("s_")).agg(F.sum("n_words").alias("words_"))
    took = shares.select("source", "total").join(took, F.col("source").eqNullSafe(F.col("s_"))).select("s_", F.expr("words_ div total").cast("int").alias("passes_"), F.expr("words_ % total").alias("left_"))
    took = staged(took, "took")
    at = lambda prefix: F.struct(F.col(f"{prefix}shard").cast("long").alias("h"), F.col(f"{prefix}at").alias("at"), F.coalesce(F.col(f"{prefix}doc_id"), none).alias("d"), F.col(f"{prefix}size").alias("n"))
    once_more = rows.where("size > 0").join(took, F.col("source").eqNullSafe(F.col("s_"))).where("start + size / 2 <= left_")
    last = once_more.groupBy("s_").agg(F.max(at("")).alias("last_"))
    ends = took.join(last.withColumnRenamed("s_", "e_"), F.col("s_").eqNullSafe(F.col("e_")), "left").select("s_", "passes_", "last_")
    ends = staged(ends, "ends")
    keyed = docs.select(F.struct("*").alias("row_"))
    keyed = keyed.withColumn("k_doc_id", F.col("row_.doc_id").cast("long")).withColumn("k_size", word_count(F.col("row_.text")))
    keyed = keyed.withColumn("k_at", _order(F.col("k_doc_id"), F.col("row_.text").cast("string")))
    keyed = keyed.withColumn("k_shard", F.pmod("k_at", F.lit(n_shards)))
    out = keyed.join(ends, F.col("row_.source").cast("string").eqNullSafe(F.col("s_")))
    copies = F.col("passes_") + F.coalesce((at("k_") <= F.col("last_")).cast("int"), F.lit(0))
    out = out.where("k_size > 0").withColumn("copies_", copies).where("copies_ > 0")
    return out.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select("row_.*")
