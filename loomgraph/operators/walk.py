"""The temporal join along paths.

Independent ("2cont"): every hop is joined by itself and all must match. Continuous ("cont"): the target window of a hop is
the source window of the next; only the best window goes on. A path keeps its columns and gets hops; paths that do not
match wholly are dropped.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.metrics import WalkMetrics
from loomgraph.operators.pattern import Edge, Node
from loomgraph.operators.tdjoin import td_join
from loomgraph.plans.model import HybridGraph
from loomgraph.session import staged

_HOP = ["src", "dst", "i", "j", "dist"]


def temporal_walk(paths: DataFrame, series: DataFrame, ts_type: str, relation: str | None, w: int, threshold: float = 0.0, semantics: str = "2cont", method: str = "td", n_hops: int | None = None, metrics: WalkMetrics | None = None) -> DataFrame:
    """paths (nodes and any other columns) with hops: array of (src, dst, i, j, dist), for paths that match.

    n_hops is the hops of every path; without it paths may differ, and the longest is looked up first. Each hop works on
    the distinct (source, target, pinned window) of all paths and is joined back, so parallel paths cost once and count
    each. Continuous hops write the frontier to the shared folder, so lineage does not grow with the path. metrics counts what
    each hop does.
    """
    if semantics not in ("2cont", "cont"):
        raise ValueError("semantics is 2cont or cont")
    if n_hops is None:
        n_hops = (paths.agg(F.max(F.size("nodes"))).first()[0] or 1) - 1
        mixed = True
    else:
        mixed = False
    kind = dict(paths.dtypes)["nodes"].removeprefix("array<").removesuffix(">")
    empty = F.array().cast(f"array<struct<src:{kind},dst:{kind},i:int,j:int,dist:double>>")
    now = paths.withColumn("hops", empty).withColumn("pin", F.lit(None).cast("int"))
    done = None
    hits = None
    if semantics == "2cont" and n_hops > 0:
        pair = F.explode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes") - 1)))
        pairs = paths.where(F.size("nodes") > 1).select(pair.alias("p")).select(F.col("p")["0"].alias("src"), F.col("p")["1"].alias("dst"))
        hits = td_join(pairs, series, ts_type, relation, w, threshold, method, metrics=metrics and metrics.at(-1))
        hits = hits if n_hops == 1 else staged(hits, "hops")
    for k in range(n_hops):
        if mixed:
            over = now.where(F.size("nodes") == k + 1)
            done = over if done is None else done.unionByName(over)
            now = now.where(F.size("nodes") > k + 1)
        here = now.withColumn("src", F.get("nodes", F.lit(k))).withColumn("dst", F.get("nodes", F.lit(k + 1)))
        if semantics == "2cont":
            found = hits.select(*_HOP)
            here = here if metrics is None or k else metrics.at(k).watch(here, "asked")
            here = here.drop("pin").join(found, ["src", "dst"])
        else:
            asked = here.select("src", "dst", "pin") if k else here.select("src", "dst")
            found = td_join(asked, series, ts_type, relation, w, threshold, method, metrics=metrics and metrics.at(k))
            here = here if metrics is None or k else metrics.at(k).watch(here, "asked")
            found = found.select("src", "dst", *([F.col("pin")] if k else []), "i", "j", "dist")
            here = here.join(found, ["src", "dst", "pin"]) if k else here.drop("pin").join(found, ["src", "dst"])
        now = here.select(*paths.columns, F.concat("hops", F.array(F.struct(*_HOP))).alias("hops"), F.col("j").alias("pin"))
        now = now if metrics is None else metrics.at(k).watch(now, "matched")
        if semantics == "cont" and k + 1 < n_hops:
            now = staged(now, "frontier")
    out = now if not mixed or done is None else now.unionByName(done.where(F.size("hops") > 0))
    return out.drop("pin")


def both_walks(paths: DataFrame, series: DataFrame, ts_type: str, relation: str | None, w: int, threshold: float, n_hops: int, method: str = "td") -> DataFrame:
    """paths with hops_2cont and hops_cont, for those that match under either semantics: what path costs are compared on."""
    free = temporal_walk(paths, series, ts_type, relation, w, threshold, "2cont", method, n_hops).withColumnRenamed("hops", "hops_2cont")
    return temporal_walk(free, series, ts_type, relation, w, threshold, "cont", method, n_hops).withColumnRenamed("hops", "hops_cont")


def matching(pairs: DataFrame, series: DataFrame, ts_type: str, relation: str | None, w: int, threshold: float = 0.0, method: str = "td", blocks: int | None = None) -> DataFrame:
    """Rows of pairs (src, dst and any other columns) whose series match, repeats included. blocks as of td_join()."""
    hits = td_join(pairs, series, ts_type, relation, w, threshold, method, blocks).select("src", "dst")
    return pairs.join(hits, ["src", "dst"], "left_semi").select(pairs.columns)


def virtual_edges(walked: DataFrame, series: DataFrame, ts_type: str, w: int, threshold: float) -> DataFrame:
    """A row for each hop of each path: src, dst, both windows' points (ts, v), ts_type, sub_length, threshold."""
    hop = walked.select("nodes", F.posexplode("hops").alias("hop", "h")).select("nodes", "hop", "h.*")
    s = series.where(F.col("ts_type") == ts_type)
    for side, at in (("src", "i"), ("dst", "j")):
        own = s.select(F.col("node_id").alias(side), F.col("ts").alias(f"{side}_ts"), F.col("v").alias(f"{side}_v"))
        cut = lambda c: F.slice(c, F.col(at) + 1, F.lit(w))  # noqa: B023, E731
        hop = hop.join(own, side).withColumn(f"{side}_sub", F.arrays_zip(cut(f"{side}_ts").alias("ts"), cut(f"{side}_v").alias("v"))).drop(f"{side}_ts", f"{side}_v")
    return hop.select("nodes", "hop", "src", "dst", F.col("src_sub").alias("source_sub"), F.col("dst_sub").alias("target_sub"), "dist", F.lit(ts_type).alias("ts_type"), F.lit(w).cast("long").alias("sub_length"), F.lit(float(threshold)).alias("threshold"))


def count_matches(paths: DataFrame, series: DataFrame, ts_type: str, relation: str | None, w: int, threshold: float = 0.0, method: str = "td") -> DataFrame:
    """n: paths of one hop that match; a semi-join of the pairs, no windows are kept."""
    ends = paths.select(F.col("nodes")[0].alias("src"), F.col("nodes")[1].alias("dst"))
    return matching(ends, series, ts_type, relation, w, threshold, method).agg(F.count(F.lit(1)).alias("n"))


def _partitions(n: int) -> list[list[int]]:
    """All ways to put n places into groups: the group of each place, groups numbered by their first place."""
    out = [[0]] if n else [[]]
    for _ in range(n - 1):
        out = [[*p, g] for p in out for g in range(max(p) + 2)]
    return out


def _walks_with(hops: list[DataFrame], groups: list[int]) -> DataFrame:
    """(n): walks over the hops whose edges are the same within each group of places, counted state by state.

    A state is the node reached, the pinned window, and the edges of groups that come up again; the frontier has a row for
    each state, with the number of walks that lead there.
    """
    state = ["at", "pin"]
    now = None
    for k, g in enumerate(groups):
        step = hops[k].select("edge_id", F.col("src").alias("at"), "pin", F.col("dst").alias("to"), F.col("j").alias("next"))
        carried = [f"e{x}" for x in sorted(set(groups[:k]) & set(groups[k:]))]
        again = g in groups[:k]
        if now is None:
            here = step.withColumn("n", F.lit(1).cast("long"))
        else:
            mine = step.withColumnRenamed("pin", "p_")
            on = (now["at"] == mine["at"]) & now["pin"].eqNullSafe(mine["p_"])
            if again:
                on = on & (now[f"e{g}"] == mine["edge_id"])
            here = now.join(mine, on).select(*[now[c] for c in carried], mine["edge_id"], mine["to"], mine["next"], now["n"])
        kept = [f"e{x}" for x in sorted(set(groups[: k + 1]) & set(groups[k + 1 :]))]
        if f"e{g}" in kept and not again:
            here = here.withColumn(f"e{g}", F.col("edge_id"))
        now = here.select(*kept, F.col("to").alias("at"), F.col("next").alias("pin"), "n").groupBy(*kept, *state).agg(F.sum("n").alias("n"))
    return now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


#: Hops of walks that are counted: the ways in which edges can repeat grow as 1, 2, 5, 15, 52.
MOST_COUNTED = 5


def count_walks(graph: HybridGraph, start: Node, edge: Edge, n_hops: int, through: Node, ts_type: str, relation: str | None, w: int, threshold: float = 0.0, semantics: str = "2cont", method: str = "td") -> DataFrame:
    """(n): how many paths of n_hops match, as temporal_walk() over pattern.hops() finds them, without listing paths.

    Hops are joined level by level from the states (node, pinned window) that are reached; a hop that does not match is gone
    before the next level. Walks are counted state by state. Those that take an edge twice are taken out by inclusion
    and exclusion over the ways in which places of a path can share an edge.
    """
    if semantics not in ("2cont", "cont"):
        raise ValueError("semantics is 2cont or cont")
    if not 1 <= n_hops <= MOST_COUNTED:
        raise ValueError(f"paths of 1 to {MOST_COUNTED} hops are counted")
    rows = edge.rows(graph).select("edge_id", F.col("a").alias("src"), F.col("b").alias("dst"))
    if (ids := through.ids(graph)) is not None:
        rows = rows.join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    rows = staged(rows.select("edge_id", "src", "dst"), "walk-edges")
    first = rows
    if (ids := start.ids(graph)) is not None:
        first = rows.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
    none = F.lit(None).cast("int")
    hops = []
    for k in range(n_hops):
        if k == 0:
            asked = first.withColumn("pin", none)
        else:
            reached = hops[-1].select(F.col("dst").alias("src"), F.col("j").alias("pin")).distinct()
            asked = rows.join(reached, "src").select("edge_id", "src", "dst", "pin")
        found = td_join(asked if semantics == "cont" and k else asked.drop("pin"), graph.series, ts_type, relation, w, threshold, method)
        on = ["src", "dst"] if semantics == "2cont" or not k else ["src", "dst", "pin"]
        hop = asked.join(found.select(*on, "j"), on).select("edge_id", "src", "dst", "pin", F.col("j") if semantics == "cont" else none.alias("j"))
        hops.append(staged(hop, "hop-states"))
    total = None
    for groups in _partitions(n_hops):
        weight = 1
        for g in set(groups):
            size = groups.count(g)
            weight *= (-1) ** (size - 1) * factorial(size - 1)
        part = _walks_with(hops, groups).select((F.col("n") * weight).alias("n"))
        total = part if total is None else total.unionByName(part)
    return total.agg(F.sum("n").alias("n"))
