"""A small source tree from files to search and topology; settings."""

import pytest

from quarry import config
from quarry.engine import Engine

FILES = {
    "src/lib.rs": "fn add(a: i32) -> i32 { a }\nfn run() { add(1); }\n", "src/app.py": "def add(a):\n    return a\n\ndef run():\n    add(1)\n", "src/other.go": "func unused() {}\n",
}


def test_index_search_and_topology(spark, tmp_path):
    for name, text in FILES.items():
        to = tmp_path / "tree" / name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(text)
    e = Engine(spark, str(tmp_path / "data"), config.load(overrides={"embedding.workers": "1", "chunking.lines": "3"}, environ={}))
    e.index(str(tmp_path / "tree"))
    assert {r["path"] for r in e.catalog.table("files").collect()} == set(FILES)
    edges = {(r["src"], r["dst"]) for r in e.edges().collect()}
    assert edges == {("src/lib.rs", "src/app.py"), ("src/app.py", "src/lib.rs")}
    assert e.topology().first()["n_cycles"] == 1 and e.catalog.problems().count() == 0
    assert "src/other.go" in [r["path"] for r in e.search("unused func", min_score=0.0).collect()]
    assert {r["path"] for r in e.search("add", extensions=["py"], min_score=0.0).collect()} <= {"src/app.py"}
    before = {r["id"]: r["embedding"] for r in e.catalog.table("chunks").collect()}
    e.index(str(tmp_path / "tree"))
    assert before == {r["id"]: r["embedding"] for r in e.catalog.table("chunks").collect()}
    commits = spark.createDataFrame([("1", "src/lib.rs"), ("1", "src/app.py"), ("1", "gone.c")], "commit_id string, path string")
    e.index_history(commits)
    assert [(r["src"], r["dst"], round(r["weight"], 6)) for r in e.catalog.table("file_cochange_edges").collect()] == [("src/app.py", "src/lib.rs", 0.333333)]


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text(FILES["src/app.py"])
    go = lambda *a: main(["--data", str(tmp_path / "data"), *a], spark)
    go("index", str(tmp_path / "tree"))
    go("search", "add", "--min-score", "0")
    go("topology")
    go("--set", "search.limit=3", "config")
    out = capsys.readouterr().out
    assert "a.py:0-" in out and '"betti_0": 1' in out and '"limit": 3' in out


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[search]\nlimit = 5\n[history]\nmerges = true\n")
    c = config.load(str(tmp_path / "c.toml"), {"search.min_score": "0.5"}, {"QUARRY_CHUNKING__OVERLAP": "0.1", "OTHER": "1"})
    assert (c.search.limit, c.search.min_score, c.chunking.overlap, c.history.merges) == (5, 0.5, 0.1, True)
    for bad in ({"chunking.overlap": "1.5"}, {"chunking.overlap": "1.0"}, {"search.limit": "0"}, {"no.such": "1"}, {"embedding.tokenizer": " "}):
        with pytest.raises(ValueError):
            config.load(overrides=bad, environ={})
