"""Token ids as Parquet list columns, in ascending order of documents.

The table has a row for each document: doc_id, n_tokens and ids (a list of 32-bit integers). Ids are dictionary-encoded
while a row group's dictionary fits, else delta-encoded (format version 2); row groups are of a set size and column and
offset indexes of each page are written, so that readers skip to the pages of a doc_id range and never touch ids for
metadata. Files hold ascending, disjoint ranges of doc_id. Spark's own writer commits them, so lost tasks are repeated.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import fresh_path, ship, staged, tidy

TOKENIZER, END_ID = "word_bpe_49k.json", 1
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 1000
#: Words whose ids a worker keeps at most; beyond, a word is encoded again each time it comes. No effect on results.
KEPT_WORDS = 600_000
SCHEMA = "doc_id long, n_tokens int, ids array<int>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Letters, then signs that are neither an apostrophe (contractions) nor "<" (special tokens): one pre-token each.
_plain = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:;=-@[-`{-~]*)")
#: A stop behind a word is a pre-token of its own, so a space before it changes nothing and leaves fewer different words.
_STOPS, _APART = r"([a-z])([.,;:!?]+)([ \t\n\r\v\f]|$)", r"\1 \2\3"
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(_printable))}


class WordEncoder:
    """Encodes texts with a tokenizer whose pre-tokens never span white space, so that a word's ids are its own.

    The file must say so: its normaliser and pre-tokenizer are those of word_bpe_49k, or the text is encoded as a whole.
    Words of plain letters and stops go to the file's model by themselves, many at a time, cut as its pre-tokenizer
    cuts them; their ids are parted by the word-end suffix. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.by_word = split.get("behavior") == "Removed" and bool(split.get("invert")) and r"[^\s\p{L}\p{N}]+" in (split.get("pattern") or {}).get("Regex", "") and not spec.get("post_processor") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
        self.kept: dict[bytes, bytes] = {}
        if self.by_word:
            suffix = spec["model"]["end_of_word_suffix"]
            self.model = Tokenizer(self.tokenizer.model)
            self.model.model._resize_cache(0)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.ends[k] = token.endswith(suffix)

    def _whole(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words, each as bytes of unsigned 32-bit numbers."""
        plain, other, parts, counts = [], [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # ASCII letters
                plain.append(w)
                parts.append(w)
                counts.append(1)
                continue
            m = _plain.fullmatch(t := w.decode().lower())
            if m is None or not t:
                other.append(w)
                continue
            plain.append(w)
            if m[1]:
                parts.append(m[1].encode() if m[1].isascii() else m[1].encode().decode("latin-1").translate(_BYTES).encode())
            if m[2]:
                parts.append(m[2].encode())
            counts.append((m[1] != "") + (m[2] != ""))
        out = self._whole(other) if other else {}
        if plain:
            pieces = self.model.encode_batch_fast([b" ".join(parts[k : k + 4000]).decode() for k in range(0, len(parts), 4000)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in pieces])
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(parts):
                return out | self._whole(plain)
            stops = (ends[np.cumsum(counts) - 1] * 4).tolist()
            data, at = ids.tobytes(), 0
            for w, stop in zip(plain, stops, strict=True):
                out[w] = data[at:stop]
                at = stop
        return out

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; what is new is kept, while there is room."""
        kept = self.kept
        found = list(map(kept.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if new:
            extra = self._new(new)
            if len(kept) < KEPT_WORDS:
                kept.update(extra)
            found = [extra[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return found

    def encode(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """The ids of each text (null: none), each followed by end_id.

        Texts split at ASCII white space and at no other; the words of all texts are numbered once, and only their
        different ones are looked up.
        """
        texts = texts.cast(pa.string()).fill_null("")
        if not self.by_word:
            found = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            counts, ids = np.array([len(x) for x in found], np.int64), np.concatenate([np.empty(0, "<u4"), *found])
        else:
            if not pc.any(pc.match_substring(texts, "<|")).as_py():
                texts = pc.replace_substring_regex(pc.ascii_lower(texts), _STOPS, _APART)  # the normaliser's case folding, early
            lists = pc.ascii_split_whitespace(texts)
            numbered = lists.flatten().dictionary_encode()
            blobs = self.ids_of(numbered.dictionary.cast(pa.binary()).to_pylist())
            size = np.fromiter(map(len, blobs), np.int32, len(blobs)) // 4
            flat, start = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(size, dtype=np.int32) - size
            at = numbered.indices.to_numpy()
            each = size[at]
            done = np.zeros(len(at) + 1, np.int32)
            np.cumsum(each, out=done[1:])
            ids = flat[np.arange(done[-1], dtype=np.int32) + np.repeat(start[at] - done[:-1], each)]
            offsets = lists.offsets.to_numpy()
            counts = np.diff(done[offsets - offsets[0]])
        if end_id is not None:
            out = np.full(len(ids) + len(counts), end_id, "<u4")
            out[np.arange(len(ids), dtype=np.int32) + np.repeat(np.arange(len(counts), dtype=np.int32), counts)] = ids
            ids, counts = out, counts + 1
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))


_encoders: dict[str, WordEncoder] = {}


#: Characters of text that are encoded together, about.
TOGETHER = 4_000_000


def _encode(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder, held, size = _encoders[path], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                part = pa.concat_batches(held)
                held.clear()
                ids = encoder.encode(part.column(1), end_id)
                yield pa.RecordBatch.from_arrays([part.column(0), ids.value_lengths().cast(pa.int32()), ids], names=["doc_id", "n_tokens", "ids"])

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + TOGETHER - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(sizes[to - 1]) - before
                at = to
                if size >= TOGETHER or at < batch.num_rows:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int | None = END_ID, files: int | None = None) -> None:
    """The token table of docs (doc_id, text) below folder.

    A null text has the end id alone. Repeated doc_ids stay as rows of their own, side by side; null doc_ids
    come first. Other columns are not read; an empty table gives a table without rows.
    """
    spark = docs.sparkSession
    ship(spark)
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    encoded = rows.mapInArrow(tidy(_encode(tokenizer or default_path(), end_id)), SCHEMA)
    (
        encoded.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.dictionary.page.size", 1 << 20).option("parquet.enable.dictionary", "true").option("parquet.writer.version", "PARQUET_2_0")
        .parquet(folder)
    )


def read(spark, folder: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The token table, of doc_ids from low to high (both may be None): row groups and pages out of range are skipped."""
    rows = spark.read.schema(SCHEMA).parquet(folder)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "file"])


def digests(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the files.

    start counts the ids of all rows before it: of earlier files, summed over one row for each file, and of earlier rows
    of its own file. Rows that repeat a doc_id are ordered by their ids' checksum and number.
    """
    ship(spark)
    rows = read(spark, folder).withColumn("file", F.col("_metadata.file_name")).select("doc_id", "n_tokens", "ids", "file")
    rows = staged(rows.mapInArrow(tidy(_checksums), "doc_id long, n_tokens long, ids_crc32 long, file string"), "checksums")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = fresh_path(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer)
    return digests(docs.sparkSession, folder)
