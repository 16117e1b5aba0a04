"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

The lower-cased text's UTF-8 bytes are cut into sequences of `SPAN` bytes. A network of two directions of gated
recurrent units labels every position; a document's probabilities are the mean over the positions of its letters. The
weights come from backpropagation through time on a bounded sample of labelled documents (`PER_LANGUAGE` for each
language, `SPANS` sequences of each, dealt evenly over the whole text), and are a few kilobytes on every executor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import ship, tidy

SPAN, HIDDEN, PER_LANGUAGE, SPANS, EPOCHS, BATCH = 64, 8, 800, 5, 4, 128
UNDETERMINED = "und"
_letter = re.compile(r"[^\W\d_]")
#: Bytes that can be part of a letter.
LETTER_BYTES = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Weights: for each direction x (256, 3H) by byte, u (H, 3H), and v (H, K); bias c (K). Gates: update, reset, new."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        self.classes, self.hidden = list(classes), hidden
        make = lambda *shape, scale: rnd.normal(0, scale, shape).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = make(256, 3 * hidden, scale=0.3)
            self.p["u" + d] = make(hidden, 3 * hidden, scale=hidden**-0.5)
            self.p["v" + d] = make(hidden, len(classes), scale=hidden**-0.5)
            self.p["x" + d][:, :hidden] -= 1.0  # a slow update gate to begin with: state is kept over many bytes
        self.p["c"] = np.zeros(len(classes), np.float32)

    def _run(self, d: str, steps: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; steps: (T, B) bytes in this direction's order."""
        x, u, n = self.p["x" + d], self.p["u" + d], self.hidden
        t, b = steps.shape
        out = np.empty((t, b, n), np.float32)
        h = np.zeros((b, n), np.float32)
        half = np.float32(0.5)
        for k in range(t):
            a = x[steps[k]]
            hu = h @ u
            g = a[:, : 2 * n] + hu[:, : 2 * n]
            g *= half
            np.tanh(g, out=g)
            g *= half
            g += half
            z, r = g[:, :n], g[:, n:]
            new = r * hu[:, 2 * n :]
            new += a[:, 2 * n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((h, z, r, new, hu[:, 2 * n :].copy()))
            h = h + z * (new - h)
            out[k] = h
        return out

    def probabilities(self, spans: np.ndarray) -> np.ndarray:
        """(T, B, K): for each position of each row of spans (B, T)."""
        steps = np.ascontiguousarray(spans.T)
        f = self._run("f", steps)
        b = self._run("b", steps[::-1])[::-1]
        logits = f @ self.p["vf"] + b @ self.p["vb"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, spans: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean cross-entropy over positions of weight 1) and gradients by backpropagation through time."""
        steps = np.ascontiguousarray(spans.T)
        t, b = steps.shape
        n, g = self.hidden, {}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {"f": self._run("f", steps, kept["f"]), "b": self._run("b", steps[::-1], kept["b"])[::-1]}
        logits = states["f"] @ self.p["vf"] + states["b"] @ self.p["vb"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        w = np.ascontiguousarray(weight.T)[:, :, None].astype(np.float32)
        total = max(float(w.sum()), 1.0)
        picked = prob[:, np.arange(b), label]
        loss = float(-(np.log(np.maximum(picked, 1e-12)) * w[:, :, 0]).sum() / total)
        prob[:, np.arange(b), label] -= 1
        prob *= w / np.float32(total)
        g["c"] = prob.sum(axis=(0, 1))
        for d in "fb":
            u = self.p["u" + d]
            g["v" + d] = states[d].reshape(-1, n).T @ prob.reshape(-1, prob.shape[2])
            from_top = prob @ self.p["v" + d].T
            order = steps if d == "f" else steps[::-1]
            from_top = from_top if d == "f" else from_top[::-1]
            gu, da = np.zeros_like(u), np.empty((t, b, 3 * n), np.float32)
            dh = np.zeros((b, n), np.float32)
            for k in range(t - 1, -1, -1):
                h, z, r, new, hn = kept[d][k]
                dh = dh + from_top[k]
                dz, dnew = dh * (new - h), dh * z
                dpre = dnew * (1 - new * new)
                da[k, :, :n] = dz * z * (1 - z)
                da[k, :, n : 2 * n] = dpre * hn * r * (1 - r)
                da[k, :, 2 * n :] = dpre
                du = da[k].copy()
                du[:, 2 * n :] *= r
                gu += h.T @ du
                dh = dh * (1 - z) + du @ u.T
            g["u" + d] = gu
            flat, gx = order.reshape(-1), np.zeros_like(self.p["x" + d])
            by = np.argsort(flat, kind="stable")
            seen, first = np.unique(flat[by], return_index=True)
            gx[seen] = np.add.reduceat(da.reshape(-1, 3 * n)[by], first, axis=0)
            g["x" + d] = gx
        return loss, g

    def train(self, spans: np.ndarray, weight: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> float:
        """Adam on shuffled batches, the rate falling to a tenth; the last batch's loss."""
        rnd, loss, step = np.random.default_rng(seed), 0.0, 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = epochs * -(-len(label) // batch)
        for _ in range(epochs):
            order = rnd.permutation(len(label))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                loss, g = self.gradients(spans[part], label[part], weight[part])
                size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                step += 1
                now = rate * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, x in g.items():
                    x = x * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
                    m[k] += 0.1 * (x - m[k])
                    s[k] += 0.001 * (x * x - s[k])
                    self.p[k] -= (now * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)
        return loss

    def documents(self, texts: list[str | None], block: int = 2048) -> list[tuple[str, float]]:
        """(language, probability) of each whole text; texts that are null or have no letter are undetermined."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.classes:
            return out
        rows = [k for k, t in enumerate(texts) if t and _letter.search(t)]
        data = [np.frombuffer(texts[k].lower().encode("utf-8", "surrogatepass"), np.uint8) for k in rows]
        counts = [-(-len(x) // SPAN) for x in data]
        owner = np.repeat(np.arange(len(rows)), counts)
        total = np.zeros((len(rows), len(self.classes)))
        mass = np.zeros(len(rows))
        spans = np.zeros((len(owner), SPAN), np.uint8)
        at = 0
        for x, n in zip(data, counts, strict=True):
            spans[at : at + n].reshape(-1)[: len(x)] = x
            at += n
        for lo in range(0, len(owner), block):
            part, who = spans[lo : lo + block], owner[lo : lo + block]
            prob = self.probabilities(part)
            w = LETTER_BYTES[part.T].astype(np.float32)
            first = np.r_[0, np.flatnonzero(np.diff(who)) + 1]  # a document's sequences are side by side
            total[who[first]] += np.add.reduceat(np.einsum("tbk,tb->bk", prob, w), first, axis=0)
            mass[who[first]] += np.add.reduceat(w.sum(axis=0), first)
        total /= np.maximum(mass, 1)[:, None]
        for k, p in zip(rows, total, strict=True):
            best = int(np.argmax(p))
            out[k] = (self.classes[best], float(min(1.0, max(0.0, p[best]))))
        return out


def _sample(spans: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, ids, data = [], [], []
            for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = (text or "").lower().encode("utf-8", "surrogatepass")
                n = min(spans, -(-len(raw) // SPAN))
                for k in range(n):
                    at = 0 if n == 1 else (len(raw) - SPAN) * k // (n - 1)
                    piece = raw[max(at, 0) : max(at, 0) + SPAN]
                    langs.append(lang)
                    ids.append(doc)
                    data.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids, pa.int64()), pa.array(data, pa.binary())], names=["lang", "doc_id", "piece"])

    return run


def is_held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text leaves 2 modulo 4; a null id counts as held out, so that nothing is learnt from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


#: Languages that a network tells apart: those with most documents.
MOST_LANGUAGES = 64


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> Network:
    """A network trained on documents (doc_id, text, lang) that are not held out and have one of the `most` frequent languages.

    The sample is every document whose hashed id is below a bound that gives per_language documents for each language
    on average (one row of each id and language, that of the smallest text): at most about per_language * SPANS * SPAN
    bytes of each reach the driver, SPANS pieces of each text that lie evenly over it.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return Network([])
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.where(place < share[F.col("lang")]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sample.select("doc_id", "lang", "text").mapInArrow(tidy(_sample(SPANS)), "lang string, doc_id long, piece binary").collect()
    rows = sorted((r["lang"], r["doc_id"], bytes(r["piece"])) for r in rows)
    classes = sorted(counts)
    net = Network(classes)
    spans = np.zeros((len(rows), SPAN), np.uint8)
    for k, (_, _, piece) in enumerate(rows):
        spans[k, : len(piece)] = np.frombuffer(piece, np.uint8)
    label = np.array([classes.index(r[0]) for r in rows], np.int64)
    keep = LETTER_BYTES[spans].astype(np.float32) * (len(rows) / (len(classes) * np.maximum(np.bincount(label, minlength=len(classes)), 1)))[label][:, None].astype(np.float32)
    if len(rows) and len(classes) > 1:
        net.train(spans, keep, label)
    return net


def _label(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = net.documents(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs.

    Null texts and texts without letters are `und` with score 0. Repeated rows give repeated rows, other columns are not
    read, an empty table gives no row. A network without languages finds every text undetermined.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(tidy(_label(net)), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Below this mean probability a document counts as of no known language.
LEAST_SCORE = 0.3


def accepted(docs: DataFrame, net: Network, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs, all columns, without the rows whose text is undetermined or whose best language is not likely enough.

    The verdict on a row is made from its own text, so rows that share a doc_id are judged apart; column names of docs
    are kept whatever they are.
    """
    ship(docs.sparkSession)
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = net.documents(part.column(at).to_pylist())
                yield part.filter(pa.array([x[0] != UNDETERMINED and x[1] >= least_score for x in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)
