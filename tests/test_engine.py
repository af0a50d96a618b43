"""Storage rules, ingest, graphs, budgets and providers on small data."""

import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import paths, providers, text
from quarry.operators import assembly, deps, graph, history, ingest, render, search
from quarry.sources.catalog import SCHEMAS, Catalog

EDGE = "src string, dst string, weight long"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_identifier_parts(spark):
    for token, want in {"HTTPServer": ["httpserver"], "parseHTTP2x": ["parse", "http", "2", "x"], "snake_case-Name9": ["snake", "case", "name", "9"], "__": []}.items():
        assert one(spark, text.identifier_parts, token) == want


def test_paths(spark):
    assert one(spark, paths.fence, "Rust") == "rust" and one(spark, paths.fence, "") == "text" and one(spark, paths.fence, "klingon") == "text"
    assert one(spark, lambda c: paths.display(c, "/r"), "/r/a\\b") == "a/b" and one(spark, paths.extension, ".bashrc") == ""
    assert one(spark, lambda c: paths.seed(c, "/r"), "././x") == "x" and one(spark, paths.technologies, "x/setup.py") == ["Python", "Python"]
    assert one(spark, lambda c: paths.allowed(c, ["src"], []), "src2/x") and not one(spark, lambda c: paths.allowed(c, ["src"], ["src2"]), "src2/x")


def test_catalog_rules(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), 2).open()
    with pytest.raises(ValueError):
        Catalog(spark, str(tmp_path), 3).open()
    with pytest.raises(ValueError):
        Catalog(spark, str(tmp_path / "new")).open()
    assert Catalog(spark, str(tmp_path)).open().dimension == 2
    c.replace("files", spark.createDataFrame([("a.rs", None, 10, None, None)], SCHEMAS["files"]))
    c.replace("symbols", spark.createDataFrame([("s1", "a.rs", "X", "definition", 5, 1, "rust"), ("s2", "b.rs", "X", "definition", 0, 1, "rust")], SCHEMAS["symbols"]))
    c.replace("reference_symbol_edges", spark.createDataFrame([("r1", "s1")], SCHEMAS["reference_symbol_edges"]))
    assert sorted((r["table"], r["id"], r["problem"]) for r in c.problems().collect()) == [("reference_symbol_edges", "r1", "no such row"), ("symbols", "s1", "ends before it begins"), ("symbols", "s2", "no such file")]


def test_upserts(spark):
    cols = "path string, content_hash string, size long, primary_language string"
    known = spark.createDataFrame([("a", "h", 1, None), ("b", "h", 1, "rust"), ("c", None, 1, None)], cols)
    found = spark.createDataFrame([("a", "h", 1, ""), ("b", "h", 2, "rust"), ("c", "h", 1, None), ("d", "h", 1, None)], cols)
    assert {r["path"]: r["updated"] for r in ingest.upsert_files(known, found).collect()} == {"a": False, "b": True, "c": True, "d": True}
    edges = "src string, dst string, commit_count long, weight double"
    out = history.upsert_edges(spark.createDataFrame([("a", "b", 1, 0.5), ("a", "c", 1, 0.5)], edges), spark.createDataFrame([("a", "b", 3, 1.0)], edges))
    assert sorted(tuple(r) for r in out.collect()) == [("a", "b", 3, 1.0), ("a", "c", 1, 0.5)]


def test_chunks(spark):
    files = spark.createDataFrame([("f", "\n".join(f"é{i}" for i in range(12))), ("g", ""), ("h", "x\n")], "path string, text string")
    rows = ingest.chunk_lines(files, 5, 0.2).collect()
    body = "\n".join(f"é{i}" for i in range(12)).encode()
    f = sorted((r for r in rows if r["path"] == "f"), key=lambda r: r["ordinal"])
    assert [(r["start_line"], r["end_line"]) for r in f] == [(1, 5), (5, 9), (9, 12)] and all(body[r["start_byte"] : r["end_byte"]].decode() == r["text"] for r in f)
    with pytest.raises(ValueError):
        ingest.chunk_lines(files, 5, 1.5)


def test_dependencies(spark):
    refs = spark.createDataFrame([("c", "X"), ("c", "X"), ("a", "Y")], "path string, name string")
    defs = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", "X"), ("a", "Y")], "path string, name string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(deps.edges(refs, defs)) == [("c", "a", 4), ("c", "b", 2)] and rows(deps.edges(refs, defs, distinct=True)) == [("c", "a", 2), ("c", "b", 2)]
    known = spark.createDataFrame([("c", "a", 9), ("q", "z", 1)], "src string, dst string, reference_count long")
    assert rows(deps.refreshed(known, refs, defs, "a")) == [("c", "a", 2), ("q", "z", 1)]
    assert rows(deps.refreshed(known, refs, defs, "nothing")) == rows(known)


def test_cochange_counts_unknown_files_in_the_weight(spark):
    commits = spark.createDataFrame([("1", "a"), ("1", "b"), ("1", "b"), ("2", "a"), ("2", "b"), ("2", "c"), ("3", "a")], "commit_id string, path string")
    edges = history.file_commit_edges(commits)
    out = history.cochange_edges(edges.where("path <> 'c'"), history.small_commits(edges, 3, 1.0)).collect()
    assert [(r["src"], r["dst"], r["commit_count"], round(r["weight"], 6)) for r in out] == [("a", "b", 2, round(1 / 2 + 1 / 3, 6))]
    assert {r["commit_id"] for r in history.small_commits(edges, 3, 0.5).collect()} == {"1", "3"}


def test_triangle(spark):
    even = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1)], EDGE)
    s = graph.stats(even).first()
    assert (s["betti_0"], s["betti_1"], s["n_cycles"]) == (1, 1, 1)
    odd = spark.createDataFrame([("a", "b", 5), ("b", "c", 2), ("c", "a", 9)], EDGE)
    none = spark.createDataFrame([], "a string, b string, weight double")
    cut = graph.refactor_plan(graph.edge_scores(odd, graph.strong_components(odd), none), per_cycle=1, least=0.0).where("src is not null").collect()
    assert [(r["src"], r["dst"]) for r in cut] == [("b", "c")]


def test_both_ways_of_graph_measures_agree(spark):
    pairs = [(f"n{a % 13}", f"n{(a * a + 5) % 17}", a % 4 + 1) for a in range(40)] + [("x", "y", 1), ("y", "x", 1), ("z", "z", 1)]
    edges = spark.createDataFrame(pairs, EDGE).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    rows = lambda d: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.collect())
    for f in (graph.components, graph.strong_components, graph.pagerank):
        assert rows(f(edges)) == rows(f(edges, small=0))
    assert abs(sum(r["rank"] for r in graph.pagerank(edges).collect()) - 1) < 1e-9
    with pytest.raises(ValueError):
        graph.star(edges, "nowhere", 1)
    assert graph.star(edges, "x", 0).count() == 0
    alone = spark.createDataFrame([("alone",)], "path string")
    assert graph.star(edges, "alone", 2, alone).count() == 0


def test_cut_limit(spark):
    pairs = [(f"{c}{i}", f"{c}{(i + 1) % 3}", i + 1) for c in "abc" for i in range(3)]
    edges = spark.createDataFrame(pairs, EDGE)
    scores = graph.edge_scores(edges, graph.strong_components(edges), spark.createDataFrame([], "a string, b string, weight double"))
    rows = lambda **k: [(r["scc"], r["src"], r["warning"]) for r in graph.refactor_plan(scores, least=0.0, **k).collect()]
    assert [(s is not None, w) for _, s, w in rows(total=3)] == [(True, None)] * 3
    assert [(s is not None, w) for _, s, w in rows(total=2)] == [(True, None)] * 2 + [(False, "cut limit reached before all cycles were handled")]
    # a warning is no cut
    assert [s is not None for _, s, _ in rows(total=2, per_cycle=0)] == [False] * 3


def test_swap_that_broke_off(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), 2).open()
    row = lambda n: spark.createDataFrame([(f"{n}.rs", None, n, None, None)], SCHEMAS["files"])
    c.replace("files", row(1))
    (tmp_path / "files").rename(tmp_path / "files__old")
    assert [r["size"] for r in c.table("files").collect()] == [1]
    (tmp_path / "files").rename(tmp_path / "files__old")
    row(2).write.parquet(str(tmp_path / "files__new"))
    assert [r["size"] for r in c.table("files").collect()] == [2]


def test_fts_scores_and_blend(spark):
    docs = spark.createDataFrame([(i, "apple " * (i % 3) + "pear plum " * 4) for i in range(9)], "id long, text string")
    top = search.fts_topk(docs, ["apple"], 9).collect()
    assert len(top) == 6 and all(0 <= r["fts_score"] < 1 for r in top)
    v = spark.createDataFrame([(1, 0.2), (2, 1.0)], "id long, distance double")
    t = spark.createDataFrame([(1, 0.5), (3, 0.25)], "id long, fts_score double")
    got = {r["id"]: round(r["score"], 6) for r in search.hybrid(v, t, 0.6, 10).collect()}
    assert got == {1: round(0.6 * 0.9 + 0.4 * 1.0, 6), 2: 0.5, 3: 0.5}


BLOCK = "id string, path string, source string, score double, start_line int, end_line int, start_byte long, end_byte long, text string"


def test_budget(spark):
    blocks = spark.createDataFrame([("e", "e", "explicit", 1.0, 1, 2, 0, 9, "aaaa\nbbbb"), ("e", "e", "primary", 0.9, 1, 2, 0, 9, "aaaa\nbbbb"), ("p", "p", "primary", 0.5, 1, 3, 0, 14, "cccc\ndddd\nee"), ("x", "x", "expanded", 0.0, 1, 1, 0, 20, "f" * 20), ("y", "y", "expanded", 0.0, 1, 1, 0, 1, "g")], BLOCK)
    got = [(r["id"], r["text"], r["end_line"], r["end_byte"]) for r in assembly.budget(blocks, 15, None, 9).orderBy("place").collect()]
    assert got == [("e", "aaaa\nbbbb", 2, 9), ("p", "cccc", 1, 4), ("y", "g", 1, 1)]
    assert assembly.budget(blocks, None, None, 0).count() == 1
    assert [r["warning"] for r in assembly.budget(blocks, 2, None, 9).where("warning is not null").collect()] == ["explicit dropped due to token budget: e"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=6), max_size=6), st.integers(0, 30))
def test_trim_is_a_head_of_lines(lines, most):
    whole = "\n".join(lines)
    got = assembly.trim_text(whole, most, lambda t: len(t.encode()))
    if got:
        assert len(got[0].encode()) <= most and got[0].replace("\n", "") == "".join(lines[: got[1]])


def test_overlapping_symbols_over_buckets(spark):
    blocks = spark.createDataFrame([("b", "f", 10, 300)], "id string, path string, start_byte long, end_byte long")
    symbols = spark.createDataFrame([("f", "in", 0, 11), ("f", "before", 0, 10), ("f", "long", 0, 900), ("f", "after", 300, 310), ("g", "other", 10, 20)], "path string, name string, start_byte long, end_byte long")
    assert sorted(r["name"] for r in assembly.symbols_in(blocks, symbols, bucket=64).collect()) == ["in", "long"]


def test_tree_and_prompt():
    rows = [{"path": p, "rank": r, "badges": b, "partners": w} for p, r, b, w in [("src/a.rs", 0.5, "[core]", "b.rs (0.50)"), ("src/sub/x.rs", None, "", ""), ("readme", None, "", "")]]
    assert render.tree_lines(rows) == ["├── src/", "│   ├── sub/", "│   │   └── x.rs", "│   └── a.rs [core] (rank 0.5000)", "│       ↔ changes with: b.rs (0.50)", "└── readme"]
    assert render.tree_lines(rows, most=2) == ["├── src/", "│   ├── sub/"]
    out = render.prompt(["<BLOCK>"], {"name": "r", "tech_stack": ["Rust"], "summary": []}, ["w"], "task")
    assert out.startswith("## Repository: r\nTech stack: Rust\n") and out.endswith("<USER_QUERY>\ntask\n</USER_QUERY>\n") and "- w\n" in out


def test_providers(spark):
    now = [0.0]
    bucket = providers.Bucket(60, lambda: now[0])
    assert bucket.wait_for(10) == 0 and bucket.wait_for(4) == pytest.approx(4)
    now[0] = 4.0
    assert bucket.wait_for(4) == 0
    answers, waits = [(503, None), (429, None), (200, "ok")], []
    assert providers.with_retries(lambda: answers.pop(0), waits.append) == "ok" and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        providers.with_retries(lambda: (401, None), waits.append)
    assert list(providers.batches([5, 5, 50, 1], 15, 10)) == [(0, 2), (2, 3), (3, 4)]
    chunks = spark.createDataFrame([("a", "one two"), ("b", None)], "id string, text string")
    got = {r["id"]: r["embedding"] for r in providers.embedded(chunks, lambda: providers.hashed_embedder(8), 2).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and set(got["b"]) == {0.0}
    assert one(spark, lambda c: providers.overlap("one three", c), "ONE two") == 0.5 and one(spark, providers.token_count, "é x") == 3


def test_git_history(spark, tmp_path):
    from quarry.sources.git import GitSource

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.com", *a], check=True, capture_output=True)
    run("init", "-q")
    for i, name in enumerate(["a.rs", "b.rs"]):
        (tmp_path / name).write_text("x")
        run("add", ".")
        run("commit", "-q", "-m", f"message {i}")
    spark.dataSource.register(GitSource)
    rows = spark.read.format("quarry_git").option("path", str(tmp_path)).load().collect()
    assert sorted((r["message"], r["path"]) for r in rows) == [("message 0", "a.rs"), ("message 1", "b.rs")]
    assert spark.read.format("quarry_git").option("path", "/nowhere").load().count() == 0


def test_files_of_a_folder(spark, tmp_path):
    from quarry.sources.files import read_files

    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_text("é = 1\n")
    (tmp_path / "big").write_text("x" * 50)
    (tmp_path / "raw").write_bytes(b"\xff\xfe")
    rows = read_files(spark, str(tmp_path), 40).collect()
    assert [(r["path"], r["size"], r["text"]) for r in rows] == [("sub/a.py", 7, "é = 1\n")]


def test_stream_of_files(spark, tmp_path):
    from quarry.streaming import ingest as stream

    put = lambda n, rows: spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / n))
    put("1", [("a", "content", 0, "one"), ("b", "content", 0, "lost")])
    got = []
    events = spark.readStream.schema(stream.EVENTS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream.run(events, str(tmp_path / "cp"), lambda df, n: got.extend(df.select("path", "text").collect()))
    q.processAllAvailable()
    assert got == []
    put("2", [("a", "content", 1, "two"), ("a", "end", 2, None), ("b", "delete", 0, None)])
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in got] == [("a", "one\ntwo")]
