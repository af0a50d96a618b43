import collections
import random

import corpus_pipeline
from quarry.llm import mixing

from .conftest import rows


def test_stages_take_effect(spark, docs, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("the of ing tion er and".split(), k=rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(60, 200))) for _ in range(60)]
    texts[3] = texts[2] + " tail"
    texts[5] += " password=Own3rOnly9x"
    texts += ["too short", None, texts[7]]
    data = [r[:5] for r in rows(*texts, sources=["a", "b"])]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    start = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.quality_rules(spark, start, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(60), 62] and kept.columns == start.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= set(range(60)) - {3} and all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert all("Own3rOnly9x" not in r["text"] for r in out) and (5 not in ids or any("[SECRET]" in r["text"] for r in out))
    # what the mix takes of what the stages before it kept
    before = start.where("doc_id not in (3, 60, 61, 62)")
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.report(corpus_pipeline.secret_scans(spark, before, "")).collect()}
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter({k: v for k, v in want.items() if v})


NAMES = "_key _id _text _marks _done _gone _again _draw _ids _decoded row key".split()
WIDE = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)


def test_odd_rows_and_columns_of_any_name(spark, odd, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("the of ing tion er and".split()) + str(rng.randrange(50)) for _ in range(n))
    data = [tuple(r)[:5] for r in odd.collect()] + [(None, text(90), None, None, None), (None, text(80), "en", None, None), (40, text(70), "en", "s0", 5), (40, text(70), "en", "s0", 5)]
    twin = text(100)
    data += [(50, twin, "en", "s1", 1), (51, twin, "en", "s1", 1), (51, twin, "en", "s1", 1)]
    spark.createDataFrame([(*r, *NAMES) for r in data], WIDE).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all([r[c] for c in NAMES] == NAMES for r in out)
    ids = collections.Counter(r["doc_id"] for r in out)
    assert set(ids) <= {None, 4, 40, 50} and all(ids[i] <= 3 for i in (4, 40, 50)) and all(len(r["text"].split()) >= 50 for r in out)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], WIDE).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"ids", "n_tokens", *NAMES} <= set(out.columns)
