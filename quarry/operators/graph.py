"""Graph measures over dependency edges(src, dst, weight).

Every measure has two ways. A graph of at most SMALL_EDGES edges, which is checked first, is worked
out in one task by plain algorithms; a larger one by rounds of joins and aggregations, cut by
checkpoints. Both give the same rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .checkpoints import pinned

SMALL_EDGES = 500_000
DAMPING, STEPS = 0.85, 20
WEIGHT_SHARE, COCHANGE_SHARE = 0.7, 0.3


def nodes_of(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    ends = edges.select(F.col("src").alias("path")).union(edges.select(F.col("dst").alias("path")))
    return (ends.union(files.select("path")) if files is not None else ends).distinct()


def is_small(edges: DataFrame, small: int | None = None) -> bool:
    most = SMALL_EDGES if small is None else small
    return edges.limit(most + 1).count() <= most


def _in_one_task(edges: DataFrame, nodes: DataFrame, run, schema: str) -> DataFrame:
    """run(edges, nodes) as pandas frames in one task; nodes come as edges without a weight."""
    ship(edges.sparkSession)
    rows = edges.select("src", "dst", F.col("weight").cast("double")).unionByName(nodes.select(F.col("path").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight")))

    def one(parts):
        held = [p for p in parts if len(p)]
        df = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"src": [], "dst": [], "weight": []}, dtype=object)
        out = run(df[df.dst.notna()].reset_index(drop=True), sorted(df[df.dst.isna()].src))
        if len(out):
            yield out

    return rows.coalesce(1).mapInPandas(one, schema)


def pagerank(edges: DataFrame, damping: float = DAMPING, steps: int = STEPS, small: int | None = None) -> DataFrame:
    """(path, rank) of the edges' ends: weighted, a fixed number of steps, the rank of dead ends spread evenly."""
    edges = pinned(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("weight")))
    nodes = nodes_of(edges)
    if is_small(edges, small):

        def run(e, names):
            import numpy as np

            n = len(names)
            at = {p: i for i, p in enumerate(names)}
            s, d, w = e.src.map(at).to_numpy(int), e.dst.map(at).to_numpy(int), e.weight.to_numpy()
            out = np.bincount(s, weights=w, minlength=n) if n else np.zeros(0)
            share = w / out[s] if n else w
            r = np.full(n, 1.0 / n) if n else np.zeros(0)
            for _ in range(steps if n else 0):
                r = (1 - damping) / n + damping * (np.bincount(d, weights=r[s] * share, minlength=n) + r[out == 0].sum() / n)
            return pd.DataFrame({"path": names, "rank": r})

        return _in_one_task(edges, nodes, run, "path string, rank double")
    shares = pinned(edges.join(edges.groupBy("src").agg(F.sum("weight").alias("total")), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = pinned(nodes.join(shares.select(F.col("src").alias("path")).distinct().withColumn("out", F.lit(True)), "path", "left"))
    n = nodes.count()
    ranks = nodes.select("path", "out", F.lit(1.0 / n).alias("rank"))
    for k in range(steps):
        dead = ranks.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("dead"))
        got = shares.join(ranks.select(F.col("path").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        ranks = nodes.join(got, "path", "left").crossJoin(F.broadcast(dead)).select("path", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("dead") / n)).alias("rank"))  # dead is one row
        if k % 5 == 4:
            ranks = pinned(ranks)
    return ranks.select("path", "rank")


def _label_rounds(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(path, label) after each takes the least label that reaches it along links(src, dst)."""
    changed = None
    while changed != 0:
        sent = links.join(labels.select(F.col("path").alias("src"), "label"), "src").groupBy(F.col("dst").alias("path")).agg(F.min("label").alias("sent"))
        new = pinned(labels.join(sent, "path", "left").select("path", F.least("label", "sent").alias("label"), (F.col("sent") < F.col("label")).alias("moved")))
        changed = new.where("moved").count()
        labels = new.drop("moved")
    return labels


def components(edges: DataFrame, files: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(path, component): the least path that can be reached over undirected edges; files without edges stand alone."""
    edges = pinned(edges.select("src", "dst", F.lit(1.0).alias("weight")).distinct())
    nodes = nodes_of(edges, files)
    if is_small(edges, small):

        def run(e, names):
            up = {p: p for p in names}

            def root(p):
                while up[p] != p:
                    up[p] = up[up[p]]
                    p = up[p]
                return p

            for a, b in zip(e.src, e.dst, strict=True):
                a, b = sorted((root(a), root(b)))
                up[b] = a
            return pd.DataFrame({"path": names, "component": [root(p) for p in names]})

        return _in_one_task(edges, nodes, run, "path string, component string")
    both = pinned(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    return _label_rounds(both, nodes.select("path", F.col("path").alias("label"))).withColumnRenamed("label", "component")


def strong_components(edges: DataFrame, files: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """(path, scc): the least path of those that reach this one and are reached from it."""
    edges = pinned(edges.select("src", "dst", F.lit(1.0).alias("weight")).distinct())
    nodes = nodes_of(edges, files)
    if is_small(edges, small):

        def run(e, names):
            out: dict[str, list[str]] = {p: [] for p in names}
            back: dict[str, list[str]] = {p: [] for p in names}
            for a, b in zip(e.src, e.dst, strict=True):
                out[a].append(b)
                back[b].append(a)
            seen, order = set(), []
            for start in names:
                todo = [(start, iter(out[start]))] if start not in seen else []
                seen.add(start)
                while todo:
                    at, rest = todo[-1]
                    step = next((x for x in rest if x not in seen), None)
                    if step is None:
                        order.append(at)
                        todo.pop()
                    else:
                        seen.add(step)
                        todo.append((step, iter(out[step])))
            of: dict[str, str] = {}
            for start in reversed(order):
                if start in of:
                    continue
                group, todo = [start], [start]
                of[start] = start
                while todo:
                    for x in back[todo.pop()]:
                        if x not in of:
                            of[x] = start
                            group.append(x)
                            todo.append(x)
                least = min(group)
                for x in group:
                    of[x] = least
            return pd.DataFrame({"path": names, "scc": [of[p] for p in names]})

        return _in_one_task(edges, nodes, run, "path string, scc string")
    # colours flow forward; what flows back to a colour's root within the colour is its component
    left, links, done = pinned(nodes), edges.select("src", "dst"), None
    while left.limit(1).count():
        colours = pinned(_label_rounds(links, left.select("path", F.col("path").alias("label"))))
        within = links.join(colours.select(F.col("path").alias("src"), F.col("label").alias("ls")), "src").join(colours.select(F.col("path").alias("dst"), F.col("label").alias("ld")), "dst").where("ls = ld").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        within = pinned(within)
        marks = colours.select("path", F.when(F.col("path") == F.col("label"), F.col("label")).alias("label"), F.col("label").alias("colour"))
        count = -1
        while True:
            sent = within.join(marks.where("label is not null").select(F.col("path").alias("src"), "label"), "src").groupBy(F.col("dst").alias("path")).agg(F.min("label").alias("sent"))
            marks = pinned(marks.join(sent, "path", "left").select("path", F.coalesce("label", "sent").alias("label"), "colour"))
            now = marks.where("label is not null").count()
            if now == count:
                break
            count = now
        found = marks.where("label is not null").select("path", F.col("label").alias("scc"))
        done = found if done is None else done.unionByName(found)
        left = pinned(marks.where("label is null").select("path"))
        links = pinned(links.join(left.withColumnRenamed("path", "src"), "src", "left_semi").join(left.withColumnRenamed("path", "dst"), "dst", "left_semi"))
    return done if done is not None else nodes.select("path", F.col("path").alias("scc"))


def inner_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(scc, src, dst, weight) with both ends in one component."""
    a, b = scc.select(F.col("path").alias("src"), F.col("scc").alias("sa")), scc.select(F.col("path").alias("dst"), F.col("scc").alias("sb"))
    return edges.join(a, "src").join(b, "dst").where("sa = sb").select(F.col("sa").alias("scc"), "src", "dst", "weight")


def cycles(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """(scc, n_nodes, n_edges, cycle_rank, total_weight, max_weight, min_weight) of the components with a cycle."""
    sizes = scc.groupBy("scc").agg(F.count("*").alias("n_nodes"))
    inner = inner_edges(edges, scc).groupBy("scc").agg(F.count("*").alias("n_edges"), F.sum("weight").cast("double").alias("total_weight"), F.max("weight").cast("double").alias("max_weight"), F.min("weight").cast("double").alias("min_weight"))
    zero = F.lit(0.0)
    # a single node has inner edges only if it links to itself
    return inner.join(sizes, "scc").select("scc", "n_nodes", "n_edges", F.greatest(F.col("n_edges") - F.col("n_nodes") + 1, F.lit(0)).cast("long").alias("cycle_rank"), *[F.coalesce(c, zero).alias(c) for c in ("total_weight", "max_weight", "min_weight")])


def edge_scores(edges: DataFrame, scc: DataFrame, cochange: DataFrame) -> DataFrame:
    """(scc, src, dst, weight, cochange, persistence, cut_score) of the edges on cycles. cochange(a, b, weight) is undirected."""
    inner = inner_edges(edges, scc)
    top = inner.groupBy("scc").agg(F.max("weight").cast("double").alias("top"))
    most = cochange.agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("most"))
    rows = inner.join(top, "scc").withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(cochange.select("a", "b", F.col("weight").alias("co")), ["a", "b"], "left").crossJoin(F.broadcast(most))  # most is one row
    part = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    co = F.coalesce("co", F.lit(0.0))
    persistence = WEIGHT_SHARE * part(F.col("weight"), F.col("top")) + COCHANGE_SHARE * part(co, F.col("most"))
    return rows.select("scc", "src", "dst", F.col("weight").cast("double").alias("weight"), co.alias("cochange"), persistence.alias("persistence"), (1 - persistence).alias("cut_score"))


def stats(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, undirected edges, betti_0, betti_1, cyclic nodes, solidity, average out degree, density."""
    nodes, undirected = nodes_of(edges, files), edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    scc = strong_components(edges, files)
    cyclic = cycles(edges, scc).agg(F.coalesce(F.sum("n_nodes"), F.lit(0)).alias("cyclic_nodes"), F.count("*").alias("n_cycles"))
    one = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(undirected.agg(F.count("*").alias("n_undirected"))).crossJoin(components(edges, files).agg(F.countDistinct("component").alias("betti_0"))).crossJoin(cyclic)  # each is one row
    v, e, u, c = (F.col(x) for x in ("n_nodes", "n_edges", "n_undirected", "betti_0"))
    one = one.withColumn("betti_1", F.greatest(u - v + c, F.lit(0)))
    b = F.col("betti_1")
    return one.select("n_nodes", "n_edges", "n_undirected", "betti_0", "betti_1", "cyclic_nodes", "n_cycles", F.when(e > 0, 1.0 / (1.0 + b / e)).otherwise(F.lit(1.0)).alias("solidity"), F.when(v > 0, e / v).otherwise(F.lit(0.0)).alias("avg_out_degree"), F.when(v > 1, e / (v * (v - 1))).otherwise(F.lit(0.0)).alias("density"))


def distances(edges: DataFrame, seeds: DataFrame, depth: int, small: int | None = None) -> DataFrame:
    """(seed, path, distance) of all within depth of each of seeds(path), over undirected edges; a round widens all seeds by one step."""
    both = pinned(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    reached = seeds.select(F.col("path").alias("seed"), "path", F.lit(0).alias("distance"))
    front = reached
    for d in range(1, depth + 1):
        front = front.select("seed", F.col("path").alias("src")).join(both, "src").select("seed", F.col("dst").alias("path")).distinct().join(reached.select("seed", "path"), ["seed", "path"], "left_anti").withColumn("distance", F.lit(d))
        front = pinned(front) if d < depth else front
        reached = reached.unionByName(front)
    return reached


def star(edges: DataFrame, centre: str, depth: int, files: DataFrame | None = None) -> DataFrame:
    """(path, distance, in_weight, out_weight, total_weight) around centre, without it; weights count edges whose other end is within depth too.

    A centre that is neither an edge's end nor among files(path) is an error; one of files without edges has no neighbours.
    """
    seeds = edges.sparkSession.createDataFrame([(centre,)], "path string")
    known = edges.where((F.col("src") == centre) | (F.col("dst") == centre)).limit(1).count() or (files is not None and files.where(F.col("path") == centre).limit(1).count())
    if depth > 0 and not known:
        raise ValueError(f"no such node: {centre}")
    near = pinned(distances(edges, seeds, depth).select("path", "distance"))
    inside = edges.join(near.select(F.col("path").alias("src")), "src", "left_semi").join(near.select(F.col("path").alias("dst")), "dst", "left_semi")
    out = inside.groupBy(F.col("src").alias("path")).agg(F.sum("weight").cast("double").alias("out_weight"))
    into = inside.groupBy(F.col("dst").alias("path")).agg(F.sum("weight").cast("double").alias("in_weight"))
    zero = F.lit(0.0)
    rows = near.where("distance > 0").join(out, "path", "left").join(into, "path", "left").select("path", "distance", F.coalesce("in_weight", zero).alias("in_weight"), F.coalesce("out_weight", zero).alias("out_weight"))
    return rows.withColumn("total_weight", F.col("in_weight") + F.col("out_weight")).orderBy("distance", F.desc("total_weight"), "path")


def _acyclic(edges: list[tuple[str, str]]) -> bool:
    """No cycle is left once every node without incoming edges has gone, again and again."""
    out: dict[str, list[str]] = {}
    incoming: dict[str, int] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        incoming[b] = incoming.get(b, 0) + 1
        incoming.setdefault(a, 0)
    free = [x for x, n in incoming.items() if not n]
    gone = 0
    while free:
        gone += 1
        for y in out.get(free.pop(), []):
            incoming[y] -= 1
            if not incoming[y]:
                free.append(y)
    return gone == len(incoming)


def refactor_plan(scores: DataFrame, per_cycle: int = 3, total: int = 20, least: float = 0.2) -> DataFrame:
    """Cuts and warnings: (scc, place, src, dst, weight, persistence, cut_score, warning).

    Within each cyclic component, one task cuts the edge of the best score (ties: lighter, then by
    name) until no cycle is left; components follow one another by name until there are as many cuts
    as the total. Warnings are no cuts; if components are left then, a last warning says so.
    """
    schema = "scc string, place int, src string, dst string, weight double, persistence double, cut_score double, warning string"
    ship(scores.sparkSession)

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        rest = group.sort_values(["cut_score", "weight", "src", "dst"], ascending=[False, True, True, True], kind="stable").to_dict("records")
        rows, scc = [], group.scc.iloc[0]
        while not _acyclic([(e["src"], e["dst"]) for e in rest]):
            best = rest[0] if rest and rest[0]["cut_score"] >= least else None
            if len(rows) >= per_cycle or best is None:
                why = f"cycle {scc} still has cycles after {per_cycle} cuts" if len(rows) >= per_cycle else f"cycle {scc} has no edges above min_cut_score {least:.2f}"
                rows.append({"scc": scc, "place": len(rows) + 1, "src": None, "dst": None, "weight": None, "persistence": None, "cut_score": None, "warning": why})
                break
            rest.remove(best)
            rows.append({"scc": scc, "place": len(rows) + 1, **{k: best[k] for k in ("src", "dst", "weight", "persistence", "cut_score")}, "warning": None})
        return pd.DataFrame(rows, columns=["scc", "place", "src", "dst", "weight", "persistence", "cut_score", "warning"])

    cuts = scores.select("scc", "src", "dst", "weight", "persistence", "cut_score").groupBy("scc").applyInPandas(cut, schema)
    cuts = pinned(cuts)
    # one row for each cyclic component, and how many cuts stand before it
    before = F.coalesce(F.sum("n").over(Window.orderBy("scc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = cuts.groupBy("scc").agg(F.count("src").alias("n")).withColumn("before", before)
    rows = cuts.join(per.select("scc", "before"), "scc").where((F.col("before") < total) & (F.col("src").isNull() | (F.col("before") + F.col("place") <= total))).drop("before")
    late = per.where(F.col("before") >= total).limit(1)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("src", "string"), ("dst", "string"), ("weight", "double"), ("persistence", "double"), ("cut_score", "double"))]
    stopped = late.select(F.lit(None).cast("string").alias("scc"), F.lit(total + 1).alias("place"), *none, F.lit("cut limit reached before all cycles were handled").alias("warning"))
    return rows.select(*stopped.columns).unionByName(stopped).orderBy(F.asc_nulls_last("scc"), "place")
