"""Queries of the dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.checkpoints import pinned
from ..sources.catalog import Roles
from .registry import CYCLES, DEPS, NATION_COCHANGE, REACH, SCORES, pagerank_sql, query

_UND = DEPS + ", nodes AS (SELECT src AS path FROM deps UNION SELECT dst FROM deps), und AS (SELECT src, dst FROM deps UNION SELECT dst, src FROM deps), conn(s, d) AS (SELECT path, path FROM nodes UNION SELECT c.s, u.dst FROM conn c JOIN und u ON c.d = u.src)"


def _edges(spark, sf_dir):
    return pinned(Roles(spark, sf_dir).dependencies())


def _six(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {pagerank_sql()} SELECT path, round(rank, 6) AS rank FROM p20")
def pagerank(spark, sf_dir):
    return _six(G.pagerank(_edges(spark, sf_dir)), "rank")


@query(f"WITH RECURSIVE {_UND} SELECT s AS path, MIN(d) AS component FROM conn GROUP BY s")
def connected_components(spark, sf_dir):
    return G.components(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {REACH} SELECT path, scc FROM scc")
def scc(spark, sf_dir):
    return G.strong_components(_edges(spark, sf_dir))


def _with_scc(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return edges, pinned(G.strong_components(edges))


@query(f"WITH RECURSIVE {CYCLES} SELECT scc, src, dst, weight FROM inner_e")
def scc_internal_edges(spark, sf_dir):
    return G.inner_edges(*_with_scc(spark, sf_dir))


@query(f"WITH RECURSIVE {CYCLES} SELECT scc, n_nodes, n_edges, cycle_rank FROM cyc")
def cyclic_components(spark, sf_dir):
    return G.cycles(*_with_scc(spark, sf_dir)).select("scc", "n_nodes", "n_edges", "cycle_rank")


@query(f"WITH RECURSIVE {CYCLES} SELECT scc, total_weight, max_weight, min_weight FROM cyc")
def scc_weight_stats(spark, sf_dir):
    return G.cycles(*_with_scc(spark, sf_dir)).select("scc", "total_weight", "max_weight", "min_weight")


@query(f"WITH RECURSIVE {CYCLES} SELECT scc, n_nodes, cycle_rank, total_weight FROM cyc WHERE n_nodes >= 2 ORDER BY n_nodes DESC, cycle_rank DESC, total_weight DESC, scc LIMIT 10")
def cycles_ranked(spark, sf_dir):
    return G.cycles(*_with_scc(spark, sf_dir)).where("n_nodes >= 2").orderBy(F.desc("n_nodes"), F.desc("cycle_rank"), F.desc("total_weight"), "scc").limit(10).select("scc", "n_nodes", "cycle_rank", "total_weight")


def _scores(spark, sf_dir):
    return G.edge_scores(*_with_scc(spark, sf_dir), Roles(spark, sf_dir).nation_cochange())


@query(f"WITH RECURSIVE {SCORES} SELECT scc, src, dst, weight, round(cochange, 6) AS cochange, round(persistence, 6) AS persistence, round(1 - persistence, 6) AS cut_score FROM scores")
def cycle_edge_scores(spark, sf_dir):
    return _six(_scores(spark, sf_dir), "cochange", "persistence", "cut_score")


# after k cuts a component is open if a node still reaches itself; the cuts are its best edges as long as it is open
@query(f"""WITH RECURSIVE {SCORES}, c AS (SELECT *, 1 - persistence AS cut_score, row_number() OVER (PARTITION BY scc ORDER BY round(1 - persistence, 12) DESC, weight, src, dst) AS place FROM scores),
walk(k, scc, s, d) AS (SELECT k, scc, src, dst FROM c, (SELECT unnest(range(0, 4)) AS k) WHERE place > k UNION SELECT w.k, w.scc, w.s, c.dst FROM walk w JOIN c ON c.scc = w.scc AND c.src = w.d AND c.place > w.k), still AS (SELECT DISTINCT scc, k FROM walk WHERE s = d),
able AS (SELECT scc, least(3, COUNT(*) FILTER (WHERE cut_score >= 0.2)) AS able FROM c GROUP BY scc), parts AS (SELECT c.scc, place, src, dst, weight, persistence, cut_score, CAST(NULL AS VARCHAR) AS warning FROM c JOIN still o ON o.scc = c.scc AND o.k = place - 1 WHERE place <= 3 AND cut_score >= 0.2
UNION ALL SELECT a.scc, able + 1, NULL, NULL, NULL, NULL, NULL, CASE WHEN able = 3 THEN 'cycle ' || a.scc || ' still has cycles after 3 cuts' ELSE 'cycle ' || a.scc || ' has no edges above min_cut_score 0.20' END FROM able a JOIN still o ON o.scc = a.scc AND o.k = able),
per AS (SELECT scc, COALESCE(SUM(COUNT(src)) OVER (ORDER BY scc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM parts GROUP BY scc)
SELECT scc, CAST(place AS INTEGER) AS place, src, dst, weight, round(persistence, 6) AS persistence, round(cut_score, 6) AS cut_score, warning FROM parts JOIN per USING (scc) WHERE before < 20 AND (src IS NULL OR before + place <= 20)
UNION ALL SELECT NULL, 21, NULL, NULL, NULL, NULL, NULL, 'cut limit reached before all cycles were handled' WHERE EXISTS (SELECT 1 FROM per WHERE before >= 20)""")
def refactor_plan(spark, sf_dir):
    return _six(G.refactor_plan(_scores(spark, sf_dir)), "persistence", "cut_score")


@query(f"""WITH RECURSIVE {_UND}, {CYCLES.split(', nodes AS (SELECT src AS path FROM deps UNION SELECT dst FROM deps), ', 1)[1]}, comp AS (SELECT s, MIN(d) AS c FROM conn GROUP BY s), x AS (SELECT (SELECT COUNT(*) FROM nodes) AS v, (SELECT COUNT(*) FROM deps) AS e, (SELECT COUNT(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM deps)) AS u, (SELECT COUNT(DISTINCT c) FROM comp) AS c)
SELECT v AS n_nodes, e AS n_edges, u AS n_undirected, c AS betti_0, CAST(greatest(u - v + c, 0) AS BIGINT) AS betti_1, CAST((SELECT COALESCE(SUM(n_nodes), 0) FROM cyc) AS BIGINT) AS cyclic_nodes, (SELECT COUNT(*) FROM cyc) AS n_cycles,
round(CASE WHEN e > 0 THEN 1 / (1 + greatest(u - v + c, 0) / CAST(e AS DOUBLE)) ELSE 1 END, 6) AS solidity, round(CASE WHEN v > 0 THEN e / CAST(v AS DOUBLE) ELSE 0 END, 6) AS avg_out_degree, round(CASE WHEN v > 1 THEN e / CAST(v * (v - 1) AS DOUBLE) ELSE 0 END, 6) AS density FROM x""")
def topology_stats(spark, sf_dir):
    return _six(G.stats(_edges(spark, sf_dir)), "solidity", "avg_out_degree", "density")


@query(f"WITH {DEPS} SELECT src AS path FROM deps UNION SELECT dst FROM deps UNION SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') FROM nation")
def graph_nodes(spark, sf_dir):
    r = Roles(spark, sf_dir)
    return G.nodes_of(r.dependencies(), r.read("nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("path")))


CENTRE = "(SELECT MIN(src) FROM deps)"
_STAR = DEPS + f", und AS (SELECT src, dst FROM deps UNION SELECT dst, src FROM deps), bfs(path, dist) AS (SELECT {CENTRE}, 0 UNION SELECT u.dst, b.dist + 1 FROM bfs b JOIN und u ON u.src = b.path WHERE b.dist < 2), near AS (SELECT path, MIN(dist) AS distance FROM bfs GROUP BY path)"


@query(f"""WITH RECURSIVE {_STAR}, ins AS (SELECT * FROM deps WHERE src IN (SELECT path FROM near) AND dst IN (SELECT path FROM near))
SELECT path, distance, CAST(COALESCE((SELECT SUM(weight) FROM ins WHERE dst = path), 0) AS DOUBLE) AS in_weight, CAST(COALESCE((SELECT SUM(weight) FROM ins WHERE src = path), 0) AS DOUBLE) AS out_weight, CAST(COALESCE((SELECT SUM(weight) FROM ins WHERE src = path), 0) + COALESCE((SELECT SUM(weight) FROM ins WHERE dst = path), 0) AS DOUBLE) AS total_weight
FROM near WHERE distance > 0 ORDER BY distance, total_weight DESC, path LIMIT 25""")
def star_neighborhood(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    centre = edges.agg(F.min("src")).first()[0]
    # without edges there is no centre, and nothing around it
    return G.star(edges, centre or "", 2 if centre else 0).limit(25)


_SEEDS = "seeds AS (SELECT DISTINCT src AS path FROM deps ORDER BY path LIMIT 2)"


@query(f"""WITH RECURSIVE {DEPS}, {_SEEDS}, und AS (SELECT src, dst FROM deps UNION SELECT dst, src FROM deps), bfs(seed, path, dist) AS (SELECT path, path, 0 FROM seeds UNION SELECT b.seed, u.dst, b.dist + 1 FROM bfs b JOIN und u ON u.src = b.path WHERE b.dist < 1),
near AS (SELECT seed, path, MIN(dist) AS distance FROM bfs GROUP BY seed, path), w AS (SELECT n.seed, n.path, n.distance, (SELECT COALESCE(SUM(weight), 0) FROM deps e WHERE (e.src = n.path AND e.dst IN (SELECT path FROM near x WHERE x.seed = n.seed)) OR (e.dst = n.path AND e.src IN (SELECT path FROM near x WHERE x.seed = n.seed))) AS total FROM near n WHERE distance > 0),
nb AS (SELECT path, CAST(SUM(total) AS DOUBLE) AS weight, MIN(distance) AS distance FROM w WHERE path NOT IN (SELECT path FROM seeds) GROUP BY path ORDER BY MIN(distance), SUM(total) DESC, path LIMIT 6)
SELECT path, 1.0e0 AS weight, 0 AS distance FROM seeds UNION ALL SELECT path, weight, distance FROM nb""")
def topology_select_files(spark, sf_dir):
    from ..operators.topology import select_files

    edges = _edges(spark, sf_dir)
    seeds = edges.select(F.col("src").alias("path")).distinct().orderBy("path").limit(2)
    return select_files(edges, seeds, 1, 8)
