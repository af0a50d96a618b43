"""The named queries and the SQL that says the same; common pieces of that SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


FILES = "files AS (SELECT doc_id, source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR) || '.' || CASE lang WHEN 'en' THEN 'rs' WHEN 'fr' THEN 'py' WHEN 'de' THEN 'go' ELSE 'ts' END AS path, text, lang AS language FROM documents)"
COMMITS = "commits AS (SELECT DISTINCT l_orderkey AS commit_id, 'f' || CAST(l_partkey AS VARCHAR) AS path FROM lineitem)"
NAMED = "named AS (SELECT 'n' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS src, 'n' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS dst, CAST(l_partkey AS VARCHAR) AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"
DEPS = NAMED + ", deps AS (SELECT src, dst, COUNT(*) AS weight FROM named WHERE src <> dst GROUP BY src, dst HAVING COUNT(*) >= 150)"
CHUNKS = "chunks AS (SELECT 'c' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS path, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ordinal, CAST(SUM(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(text) AS BIGINT) AS start_byte, CAST(SUM(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS end_byte, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, text, role AS kind, sha256(text) AS chunk_hash FROM conversations)"
COCHANGE = COMMITS + ", sized AS (SELECT commit_id, path, COUNT(*) OVER (PARTITION BY commit_id) AS n FROM commits), pairs AS (SELECT a.path AS src, b.path AS dst, COUNT(*) AS commit_count, SUM(1.0e0 / a.n) AS weight FROM sized a JOIN sized b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY 1, 2)"
REACH = DEPS + ", nodes AS (SELECT src AS path FROM deps UNION SELECT dst FROM deps), reach(s, d) AS (SELECT path, path FROM nodes UNION SELECT r.s, e.dst FROM reach r JOIN deps e ON r.d = e.src), scc AS (SELECT a.s AS path, MIN(a.d) AS scc FROM reach a JOIN reach b ON a.s = b.d AND a.d = b.s GROUP BY a.s)"
CYCLES = REACH + ", inner_e AS (SELECT a.scc, e.src, e.dst, e.weight FROM deps e JOIN scc a ON e.src = a.path JOIN scc b ON e.dst = b.path WHERE a.scc = b.scc), sizes AS (SELECT scc, COUNT(*) AS n_nodes FROM scc GROUP BY scc), cyc AS (SELECT i.scc, n_nodes, COUNT(*) AS n_edges, CAST(greatest(COUNT(*) - n_nodes + 1, 0) AS BIGINT) AS cycle_rank, CAST(SUM(weight) AS DOUBLE) AS total_weight, CAST(MAX(weight) AS DOUBLE) AS max_weight, CAST(MIN(weight) AS DOUBLE) AS min_weight FROM inner_e i JOIN sizes s ON i.scc = s.scc GROUP BY i.scc, n_nodes)"
NATION_COCHANGE = "nn AS (SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS path, n_regionkey, n_nationkey FROM nation), co AS (SELECT a.path AS a, b.path AS b, ((a.n_nationkey + b.n_nationkey) % 7) / 7.0e0 AS weight FROM nn a JOIN nn b ON a.n_regionkey = b.n_regionkey AND a.path < b.path)"
SCORES = CYCLES + ", " + NATION_COCHANGE + ", scores AS (SELECT i.scc, i.src, i.dst, CAST(i.weight AS DOUBLE) AS weight, COALESCE(co.weight, 0) AS cochange, 0.7e0 * i.weight / c.max_weight + 0.3e0 * COALESCE(co.weight, 0) / (SELECT MAX(weight) FROM co) AS persistence FROM inner_e i JOIN cyc c ON i.scc = c.scc LEFT JOIN co ON co.a = least(i.src, i.dst) AND co.b = greatest(i.src, i.dst))"


def pagerank_sql(steps: int = 20) -> str:
    """CTEs up to p{steps}(path, rank): one for each step."""
    parts = [DEPS, "nodes AS MATERIALIZED (SELECT src AS path FROM deps UNION SELECT dst FROM deps)", "share AS MATERIALIZED (SELECT src, dst, weight * 1.0e0 / SUM(weight) OVER (PARTITION BY src) AS s FROM deps)", "p0 AS MATERIALIZED (SELECT path, 1.0e0 / (SELECT COUNT(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(steps):
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT n.path, 0.15e0 / (SELECT COUNT(*) FROM nodes) + 0.85e0 * (COALESCE((SELECT SUM(q.rank * s.s) FROM share s JOIN p{k} q ON q.path = s.src WHERE s.dst = n.path), 0) + COALESCE((SELECT SUM(q.rank) FROM p{k} q WHERE q.path NOT IN (SELECT src FROM share)), 0) / (SELECT COUNT(*) FROM nodes)) AS rank FROM nodes n)")
    return ", ".join(parts)
