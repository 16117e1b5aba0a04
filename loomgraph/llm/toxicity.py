"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Signals are words and word beginnings that go with toxic labels (mined from labelled rows), a short list of common insults,
and patterns of the whole text. A lexicon is all signals of the same first letters; each lexicon, and each pattern that
is precise enough, is a voter that says toxic or abstains.

The label model is generative: a text of either class gets a number of independent votes, and voters share in the votes
of a class each at its rate. Expectation maximisation over labelled and unlabelled texts alike estimates both, how often
each voter is right, and how far voters are correlated within a class, so that those that fire together do not count
twice. A row's given label is no evidence there: labels only say where the estimates begin, which is also what they
are held to in proportion to the votes on labelled rows. It runs for few rounds: toxic texts of one language have other voters
than those of another, and a longer run leaves all but the largest such group to the clean class. A logistic
regression learns the posterior labels from the signals, and its score is the result.

All that is learnt comes from bounded samples of what is not held out: labelled rows whose hashed id is below a bound that
gives `PER_CLASS` of each class on average, and as many unlabelled ones of all documents. At most `SIGNALS` signals are
mined, the most precise. Scores are made from whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.langid import is_held_out
from loomgraph.session import ship, staged, tidy

PER_CLASS, SIGNALS, BEGINNINGS, THRESHOLD = 5000, 600, (4, 5, 6), 0.3
#: A signal is mined if the log odds of its being right are over LEAST_ODDS (right in four of five cases) by SURE standard errors.
LEAST_ODDS, SURE, LEAST_ROWS = float(np.log(4)), 1.5, 5
_word = re.compile(r"[^\W\d_]+")
#: Common insults; voters whether or not the labelled rows have them.
INSULTS = ("bastard", "clown", "cretin", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "imbecile", "kill", "loser", "moron", "pathetic", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless")


def _shouts(text: str) -> bool:
    letters = sum(map(str.isalpha, text))
    return letters > 20 and sum(map(str.isupper, text)) > 0.6 * letters


PATTERNS = {
    "!shouts": _shouts,
    "!exclaims": lambda t: t.count("!") > 3,
    "!signs": lambda t: sum(map(t.count, "#$%&*")) > 0.02 * len(t),
    "!you": lambda t: re.search(r"\byou(?:'re| are)\b", t, re.I) is not None,
    "!repeats": lambda t: re.search(r"(\w)\1{4}", t) is not None,
}


def features(text: str | None) -> set[str]:
    """Words of letters, lower-cased, and the beginnings of longer ones (marked by a hyphen)."""
    words = set(_word.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each feature, by class; a worker's table is handed on when it gets large."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)]
        for c in seen:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["feature", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            seen[toxic].update(features(text))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield flush()
    yield flush()


class Voters:
    """Which signals fire in a text."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.at = list(names), {x: k for k, x in enumerate(names)}
        self.n = len(names) + len(PATTERNS)

    def fire(self, text: str | None) -> list[int]:
        at, text, out = self.at, text or "", set()
        words = set(_word.findall(text.lower()))
        out.update(at[w] for w in words if w in at)
        for n in BEGINNINGS:
            for b in {w[:n] for w in words if len(w) > n}:
                k = at.get(b + "-")
                if k is not None:
                    out.add(k)
        out.update(len(self.names) + k for k, test in enumerate(PATTERNS.values()) if test(text))
        return sorted(out)


def certainty(toxic, clean, log, sqrt):
    """The log odds of toxic against clean rows with a signal, less their standard errors; rows count by weight of class."""
    (t, wt), (c, wc) = toxic, clean
    return log((t + 0.5) * wt / ((c + 0.5) * wc)) - SURE * sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def lexicons(names: list[str]) -> list[list[int]]:
    """The places of names, by their first letters: nested signals are of one lexicon."""
    groups: dict[str, list[int]] = {}
    for k, x in enumerate(names):
        groups.setdefault(x.rstrip("-")[: BEGINNINGS[0]], []).append(k)
    return [groups[k] for k in sorted(groups)]


def label_model(votes: np.ndarray, start: np.ndarray, weight: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of the toxic class, how often each voter is right, correlation of voters that fire together).

    votes: 1 where a voter votes, a row for each text; start: 1 or 0 for texts whose label says where to begin, NaN for others.
    """
    known = ~np.isnan(start)
    q, m, held = np.where(known, np.clip(start, 0.001, 0.999), 0.0), weight * known, None
    together = np.zeros((votes.shape[1], votes.shape[1]))
    for _ in range(rounds):
        share = votes / (1 + votes @ together)  # of independent evidence, beside what else votes on the text
        size = share.sum(axis=1)
        number = np.eye(4)[np.where(size > 0, np.clip(np.rint(size), 1, 3), 0).astype(int)]  # none, one, two or more
        seen = [((m * r) @ share + 0.05, (m * r) @ number + 1.0) for r in (1 - q, q)]
        held = held or seen
        seen = seen if held is seen else [(a + c, b + d) for (a, b), (c, d) in zip(seen, held, strict=True)]
        (which_clean, many_clean), (which_toxic, many_toxic) = [(a / a.sum(), b / b.sum()) for a, b in seen]
        prior = np.log(seen[1][1].sum() / seen[0][1].sum())
        rates = [((m * r) @ votes + 0.1) / ((m * r).sum() + 20.0) for r in (1 - q, q)]
        residual = (votes - np.outer(1 - q, rates[0]) - np.outer(q, rates[1])) * np.sqrt(m / m.sum())[:, None]
        cov = residual.T @ residual
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        together = np.clip(cov / np.outer(sd, sd), 0, 1)
        together = together * (together > 0.1)
        np.fill_diagonal(together, 0)
        q = 1 / (1 + np.exp(-np.clip(prior + number @ np.log(many_toxic / many_clean) + share @ np.log(which_toxic / which_clean), -30, 30)))
        m = weight
    return q, ((weight * q) @ votes + 0.1) / (weight @ votes + 1), together


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Coefficients and intercept for soft labels y, by Adam over all rows."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, s, share = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), weight / weight.sum()
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = (p - y) * share
        g = np.append(d @ x + decay * w, d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def thinned(x: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: float = 0.5, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, and the likely toxic ones again with few of their signals: one signal must do where a text is short."""
    rnd, at = np.random.default_rng(seed), np.flatnonzero((y > 0.5) & (x.sum(axis=1) > 1))
    few = x[at] * (rnd.random((len(at), x.shape[1])) < keep)
    left = few.sum(axis=1) > 0
    return np.concatenate((x, few[left])), np.concatenate((y, y[at][left])), np.concatenate((weight, weight[at][left]))


class Classifier:
    def __init__(self, names: list[str], w: np.ndarray, b: float) -> None:
        self.voters, self.w, self.b = Voters(names), np.asarray(w, float), b

    def score(self, text: str | None) -> float:
        z = self.b + float(self.w[self.voters.fire(text)].sum())
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _place(salt: str) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, signals: int = SIGNALS) -> Classifier:
    """A classifier from the rows of docs (doc_id, text) that are not held out, and their toxic labels.

    Labels that repeat count once; of documents that repeat an id the smallest text counts; null texts have no signal.
    Without labelled rows of both classes every score is the rate of toxic labels (0 without labels).
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return Classifier([], np.zeros(len(PATTERNS)), 30.0 if toxic else -30.0)
    bound = F.when(F.col("toxic") == 1, min(1.0, per_class / toxic)).otherwise(min(1.0, per_class / clean))
    chosen = known.where(_place("toxicity") < bound)
    # about 2 * per_class rows at most, whatever the input: small enough to go to where the texts are
    chosen = F.broadcast(staged(chosen.distinct(), "chosen"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = min(1.0, per_class / max(docs.count(), 1))
    others = texts.where(~is_held_out(F.col("doc_id")) & (_place("unlabelled") < some)).withColumn("toxic", F.lit(None).cast("int"))
    sample = texts.join(chosen, "doc_id").select("doc_id", "text", "toxic").unionByName(others)
    # one row for an id and label, so that a repeated id is no larger share of the sample
    sample = staged(sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), "sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Classifier([], np.zeros(len(PATTERNS)), float(np.log(toxic / clean)))
    heavy = {1: toxic / size[1], 0: clean / size[0]}
    counted = sample.where("toxic is not null").mapInArrow(tidy(_counts), "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sure = certainty((F.col("toxic"), heavy[1]), (F.col("clean"), heavy[0]), F.ln, F.sqrt)
    best = counted.where(F.col("toxic") >= LEAST_ROWS).withColumn("sure", F.round(sure, 9)).where(F.col("sure") > LEAST_ODDS)
    names = sorted({r["feature"] for r in best.orderBy(F.desc("sure"), "feature").limit(signals).collect()} | set(INSULTS))
    voters = Voters(names)

    def fired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = pa.array([voters.fire(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hits, batch.column(2)], names=["doc_id", "hits", "toxic"])

    rows = sorted(((r["doc_id"], -1 if r["toxic"] is None else r["toxic"], r["hits"]) for r in sample.mapInArrow(tidy(fired), "doc_id long, hits array<int>, toxic int").collect()), key=lambda r: r[:2])
    x, y = np.zeros((len(rows), voters.n), np.float32), np.array([r[1] for r in rows], np.int64)
    for k, (_, _, hits) in enumerate(rows):
        x[k, hits] = 1
    weight = np.where(y == 1, heavy[1], np.where(y == 0, heavy[0], (toxic + clean) / max(size.get(None, 0), 1)))
    q, _, _ = label_model(ballot(names, x, y, heavy), np.where(y < 0, np.nan, y), weight)
    w, b = logistic(*thinned(x, q, weight))
    return Classifier(names, w, b)


def ballot(names: list[str], x: np.ndarray, y: np.ndarray, heavy: dict[int, float]) -> np.ndarray:
    """What the label model's voters vote: lexicons, and patterns that are as precise as mined signals."""
    t, c = x[y == 1].sum(axis=0), x[y == 0].sum(axis=0)
    sure = certainty((t, heavy[1]), (c, heavy[0]), np.log, np.sqrt)
    patterns = [x[:, k] for k in range(len(names), x.shape[1]) if t[k] >= LEAST_ROWS and sure[k] > LEAST_ODDS]
    return np.stack([x[:, g].max(axis=1) for g in lexicons(names)] + patterns, axis=1).astype(float)


def score(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs; empty and null texts get the intercept's score.

    Repeated rows give repeated rows, other columns are not read, an empty table gives no row.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(tidy(run), "doc_id long, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
