"""What a walk did: rows, pairs and matches of each hop by observe(), seconds in the kernel by accumulators."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTS = ("asked", "pairs", "found", "matched")


class HopMetrics:
    """One hop's: asked, paths that come to it; pairs, the different ones with both series that are joined; found, those of
    them that match; matched, paths that go on. A join that serves several hops has a place of its own, hop -1."""

    def __init__(self, spark: SparkSession, hop: int) -> None:
        self.hop, self._seen, self._rows_of = hop, {}, {}
        self._seconds, self._rows = spark.sparkContext.accumulator(0.0), spark.sparkContext.accumulator(0)

    def watch(self, df: DataFrame, what: str) -> DataFrame:
        """df, whose rows are counted when it is run; it must be used in one place of a query only."""
        self._seen[what], self._rows_of[what] = Observation(), df
        return df.observe(self._seen[what], F.count(F.lit(1)).alias("n"))

    def timed(self, run: Callable) -> Callable:
        """A kernel of batches, or of the two tables of a cogroup, whose time and pairs are added up."""
        seconds, rows = self._seconds, self._rows

        def of_tables(pairs: pa.Table, series: pa.Table) -> pa.Table:
            began = time.perf_counter()
            out = run(pairs, series)
            seconds.add(time.perf_counter() - began)
            rows.add(pairs.num_rows)
            return out

        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                began = time.perf_counter()
                out = list(run(iter([batch])))
                seconds.add(time.perf_counter() - began)
                rows.add(batch.num_rows)
                yield from out

        return of_tables if run.__code__.co_argcount == 2 else of_batches

    def _count(self, what: str) -> int | None:
        if what not in self._seen:
            return None
        try:
            return int(self._seen[what].get["n"])
        except (Py4JError, KeyError):  # left out of the plan: the other side of its join was empty
            return self._rows_of[what].count() if what == "asked" else 0

    def row(self) -> dict:
        counts = {c: self._count(c) for c in COUNTS}
        n = self._rows.value
        return {"hop": self.hop, **counts, "seconds": float(self._seconds.value), "seconds_of_pair": float(self._seconds.value) / n if n else None}


class WalkMetrics:
    """Give it to temporal_walk() or td_join(), run their result (once), then ask.

    Tasks that are repeated after a loss add their seconds again; counts are of the attempt that stands.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._hops = spark, {}

    def at(self, hop: int) -> HopMetrics:
        return self._hops.setdefault(hop, HopMetrics(self._spark, hop))

    def hops(self) -> DataFrame:
        """hop, asked, pairs, found, matched, seconds, seconds_of_pair: a row for each hop, null what it does not count."""
        kinds = "hop int, " + ", ".join(f"{c} long" for c in COUNTS) + ", seconds double, seconds_of_pair double"
        rows = [h.row() for _, h in sorted(self._hops.items())]
        for before, row in zip(rows, rows[1:], strict=False):
            if before["hop"] >= 0:  # what a hop lets through is what the next is asked
                row["asked"] = before["matched"]
        return self._spark.createDataFrame([tuple(r.values()) for r in rows], kinds)

    def times(self) -> DataFrame:
        """hops, seconds, mean_seconds: sum and mean of the hops' kernel seconds."""
        return self.hops().agg(F.count(F.lit(1)).alias("hops"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))
