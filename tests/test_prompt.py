"""From a task to its prompt, remote clients, postings and their upkeep."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.engine import Engine
from quarry.functions import paths, providers, remote
from quarry.operators import assembly, history, ingest, postings, search
from quarry.prompt import Selection, prompt

FILES = {
    "src/lib.rs": "fn add(a: i32) -> i32 { a }\nfn run() { add(1); }\n", "src/app.py": "def add(a):\n    return a\n\ndef run():\n    add(1)\n", "src/other.go": "func unused() {}\n",
    "docs/notes.py": "def remember():\n    pass\n",
}
SETTINGS = {"embedding.workers": "1", "search.min_score": "0.0", "search.limit": "4"}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("prompt")
    for name, text in FILES.items():
        to = at / "tree" / name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(text)
    e = Engine(spark, str(at / "data"), config.load(overrides=SETTINGS, environ={}))
    e.index(str(at / "tree"))
    e.index_history(spark.createDataFrame([("1", "src/other.go"), ("1", "docs/notes.py"), ("2", "src/other.go"), ("2", "docs/notes.py")], "commit_id string, path string"))
    return e


def test_prompt_of_a_search(engine):
    out = prompt(engine, "unused func", Selection(includes=["./src/other.go", "gone.rs"], excludes=["src/lib.rs", "src/app.py", "docs/"], pins=["nowhere"]))
    assert out.startswith("## Repository: tree\nTech stack: ") and out.endswith("\n## User Query\n<USER_QUERY>\nunused func\n</USER_QUERY>\n")
    assert "- explicit include not found: gone.rs\n- pinned item not found: nowhere\n" in out
    assert "## Retrieved Context (1 blocks)\n\n### Primary Results\n\n<BLOCK>\npath: src/other.go\nLines: 1-" in out and "source: explicit\nreason: explicit_include\nlanguage: go\nsymbols: unused\n```go\n" in out
    out = prompt(engine, "unused func", Selection(scopes=["src/other.go", "docs/"], includes=["src/other.go"]), {"context"}, tokenizer="characters")
    primary, around = out.split("### Expanded Context\n")
    assert "src/other.go" in primary and "## Repository" not in out and "USER_QUERY" not in out
    assert "docs/notes.py" in out and "source: expanded" not in primary and "src/app.py" not in around
    with pytest.raises(ValueError):
        prompt(engine, "x", sections={"weather"})
    assert "explicit dropped due to token budget: src/lib.rs" in prompt(engine, "add", Selection(scopes=["none"], includes=["src/lib.rs"]), max_tokens=5)


def test_prompt_of_the_topology(engine):
    out = prompt(engine, "task", Selection(includes=["src/lib.rs", "missing"], pins=["src/lib.rs"]), by_topology=True)
    primary, around = out.split("### Expanded Context\n")
    assert "- seed not found in index: missing\n" in out and "path: src/lib.rs" in primary and "source: explicit" in primary and "path: src/app.py" in around and "other.go" not in around
    out = prompt(engine, "task", Selection(includes=["src/lib.rs"], excludes=["./src/app"]), by_topology=True)
    assert "path: src/app.py" not in out
    out = prompt(engine, "task", Selection(pins=["src/lib.rs", "src/other.go"]), by_topology=True, files=1)
    assert "- seed count 2 exceeds limit 1; neighbors omitted\n" in out and "path: src/app.py" not in out
    assert "path: src/app.py" not in prompt(engine, "task", Selection(pins=["src/lib.rs"]), by_topology=True, depth=0)
    for bad in ({"selection": Selection(includes=["missing"])}, {"selection": Selection(includes=["src/lib.rs"], scopes=["docs"])}, {"selection": Selection(includes=["src/lib.rs"]), "files": 0}):
        with pytest.raises(ValueError):
            prompt(engine, "task", by_topology=True, **bad)


def test_prompt_on_the_command_line(spark, engine, capsys):
    from quarry.__main__ import main

    main(["--data", engine.catalog.root, "--set", "search.min_score=0", "prompt", "add", "--section", "query", "--include", "src/lib.rs"], spark)
    assert capsys.readouterr().out == "\n## User Query\n<USER_QUERY>\nadd\n</USER_QUERY>\n"


def test_postings_of_the_index(spark, engine, tmp_path):
    chunks = engine.catalog.table("chunks").select("id", F.col("fts_text").alias("text"))
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(engine.catalog.table("postings")) == rows(postings.postings(chunks).select("term", "id", "tf"))
    for terms in (["add", "run"], ["run", "add", "add"], ["absent"], []):
        a, b = postings.fts_topk(engine.catalog.table("postings"), engine.catalog.table("chunk_lengths"), terms, 9), search.fts_topk(chunks, terms, 9)
        assert [(r["id"], round(r["fts_score"], 12)) for r in a.collect()] == [(r["id"], round(r["fts_score"], 12)) for r in b.collect()]
    assert engine.catalog.problems().count() == 0 and engine.catalog.table("reference_symbol_edges").count() > 0
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.py").write_text("def first():\n    pass\n")
    (tree / "b.py").write_text("def second():\n    pass\n")
    with pytest.raises(ValueError):
        Engine(spark, str(tree / "data"), config.load(overrides=SETTINGS, environ={})).index(str(tree))
    (tree / "data").rename(tmp_path / "elsewhere")
    e = Engine(spark, str(tree / ".data"), config.load(overrides=SETTINGS, environ={}))
    e.index(str(tree))
    (tree / "a.py").write_text("def third():\n    pass\n")
    (tree / "b.py").unlink()
    e.index(str(tree))
    words = {r["term"] for r in e.catalog.table("postings").collect()}
    assert "third" in words and not words & {"first", "second"} and e.catalog.table("chunk_lengths").count() == e.catalog.table("chunks").count()


def test_postings_of_odd_documents(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "One one, two"), ("d", "!!!")], "id string, text string")
    assert sorted(tuple(r) for r in postings.postings(docs).collect()) == [("one", "c", 2), ("two", "c", 1)]
    assert sorted(tuple(r) for r in postings.lengths(docs).collect()) == [("a", 0), ("b", 0), ("c", 3), ("d", 0)]
    empty = docs.where("false")
    assert postings.bm25(postings.postings(empty), postings.lengths(empty), ["one"]).count() == 0


def test_words_that_cannot_be_read(spark, engine, monkeypatch):
    monkeypatch.setattr(engine.catalog, "table", (lambda real: lambda name: real(name) if name != "postings" else real(name).where("no_such_column > 0"))(engine.catalog.table))
    with pytest.warns(UserWarning, match="full-text search unavailable"):
        rows = engine.search("unused func", min_score=0.0).collect()
    assert rows and all(r["fts_score"] is None for r in rows)


def test_columns_added_later(spark, tmp_path):
    from quarry.sources.catalog import Catalog

    spark.createDataFrame([("a.rs", 1)], "path string, size long").write.parquet(str(tmp_path / "files"))
    assert [tuple(r) for r in Catalog(spark, str(tmp_path), 2).open().table("files").collect()] == [("a.rs", None, 1, None, None)]


@pytest.fixture
def service():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            if self.path == "/embeddings":
                code, out = 200, {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path == "/short/embeddings":
                code, out = 200, {"data": []}
            elif self.path.endswith("/bad"):
                code, out = 400, {}
            else:
                code, out = 200, {"scores": [2.0 if "unused" in d else -1.0 for d in body["documents"]]}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_remote_clients(service):
    url, seen = service
    assert remote.Embeddings(url, "m", 2, "k")(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]]
    assert seen[-1] == ("/embeddings", "Bearer k", {"input": ["a", "bbb"], "model": "m", "encoding_format": "float", "dimensions": 2})
    with pytest.raises(ValueError):
        remote.Embeddings(f"{url}/short", "m", 2)(["a"])
    with pytest.raises(ValueError):
        remote.Embeddings(url, "m", 2, "bad\nkey")
    r = remote.Reranker(url, "m", instruction="i")
    assert r("q", ["unused", "x"]) == [1.0, 0.0] and seen[-1] == ("/inference/m", None, {"queries": ["q", "q"], "documents": ["unused", "x"], "instruction": "i"})
    assert r("q", []) == []
    for call, kind in ((lambda: r(" ", ["x"]), ValueError), (lambda: remote.Reranker(url, "bad")("q", ["x"]), RuntimeError)):
        with pytest.raises(kind):
            call()


def test_search_with_a_reranker(engine, service, monkeypatch):
    url, _ = service
    monkeypatch.setattr(engine.config.reranker, "url", url)
    monkeypatch.setattr(engine.config.reranker, "model", "m")
    rows = engine.search("add unused", min_score=0.5).collect()
    assert [(r["path"], r["score"]) for r in rows] == [("src/other.go", 1.0)]
    monkeypatch.setattr(remote.Reranker, "__call__", lambda *_: [0.5])
    with pytest.raises(ValueError):
        engine.search("add unused")


def test_counters():
    assert providers.counter("characters")("añb") == 3
    for bad in ("hf:", "words", "tiktoken:"):
        with pytest.raises(ValueError):
            providers.counter(bad)


def test_pairs_of_seeds_are_those_of_all_pairs(spark):
    rows = [(str(c), f"f{(c * k + k) % 9}") for c in range(30) for k in range(1, 2 + c % 5)]
    edges = history.file_commit_edges(spark.createDataFrame(rows, "commit_id string, path string"))
    whole = history.cochange_edges(edges, history.small_commits(edges, 9, 1.0))
    for names in (["f1"], ["f1", "f4", "f8"], ["none"]):
        seeds = spark.createDataFrame([(n,) for n in names], "path string")
        part = history.of_seeds(edges, seeds)
        part = history.cochange_edges(part, history.small_commits(part, 9, 1.0))
        near = lambda e: [(r["path"], round(r["weight"], 9)) for r in history.neighbours(e.withColumn("weight", F.round("weight", 9)), seeds, 50).collect()]  # noqa: B023, E731
        assert near(part) == near(whole)


def test_chunks_and_heads_against_plain_code(spark):
    texts = ["", "\n", "é\n\nü", "a\nbb\n\n", "\n\nabc", "x" * 30, "\n".join("é" * (i % 7) for i in range(40)), "ab\r\ncd\r\n"]
    docs = spark.createDataFrame([(str(i), t, 3, 100) for i, t in enumerate(texts)], "path string, text string, start_line int, start_byte long")
    for size, overlap in ((1, 0.0), (3, 0.4), (5, 0.2), (50, 0.9)):
        for r in ingest.chunk_lines(docs, size, overlap).collect():
            assert texts[int(r["path"])].encode()[r["start_byte"] : r["end_byte"]].decode() == r["text"]
    for most in (-1, 0, 1, 2, 3, 5, 8, 29, 30, 200):
        want = {}
        for i, t in enumerate(texts):
            lines = t.split("\n")
            n = max((k for k in range(1, len(lines) + 1) if len("\n".join(lines[:k]).encode()) <= most), default=0)
            if head := "\n".join(lines[:n]):
                want[str(i)] = (head, 3 + n - 1, 100 + len(head.encode()))
        assert {r["path"]: (r["text"], r["end_line"], r["end_byte"]) for r in assembly.trimmed_bytes(docs, most).collect()} == want


def test_scopes(spark):
    row = spark.createDataFrame([("src2/x",)], "p string")
    ask = lambda scope, out: row.select(paths.allowed(F.col("p"), scope, out).alias("x")).first()["x"]
    assert ask(["src2/"], []) and ask(["src"], [" "]) and not ask([" "], []) and not ask([], ["src2/"])


def test_cut_tree_is_the_head_of_the_whole_tree(spark):
    from quarry.operators import render

    names = [f"{'/'.join(f'd{(i * k) % 4}' for k in range(1, 1 + i % 8))}/f{i}".lstrip("/") for i in range(90)] + ["top"]
    rows = spark.createDataFrame([(n, None, "", "") for n in names] + [(None, None, "", "")], "path string, rank double, badges string, partners string")
    whole = render.tree_lines([{"path": n, "rank": None, "badges": "", "partners": ""} for n in names], most=10_000)
    for most in (1, 2, 7, 20, 33, 60, 400):
        assert [r["line"] for r in render.repo_tree(rows, most).orderBy("line_no").collect()] == whole[:most]
