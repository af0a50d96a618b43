import collections
import random

import numpy as np
import pytest

from quarry.llm import neardup
from quarry.llm.common import Words, components

from .conftest import rows


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.randint(8, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    chain = [word() for _ in range(300)]
    for i in range(12):  # each is near the one before, the ends are far apart
        chain[i * 8 : i * 8 + 4] = [word() for _ in range(4)]
        texts.append(" ".join(chain))
    return [*texts, *texts[:5], "a b c", "a b c", "a b", "", None]


def shingles(t):
    w = (t or "").lower().split()
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()


def jp(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def brute(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a.keys() & b.keys())
            if both and (both / len(a.keys() | b.keys()) >= 0.8 or max(*a.values(), *b.values()) > 1 and jp(a, b) >= 0.8):
                x, y = sorted((up[i], up[j]))
                up = [x if u == y else u for u in up]
    return up


def test_classes_are_those_of_brute_force(docs):
    texts = corpus()
    want = brute(texts)
    got = {r["doc_id"]: (r["class_id"], r["is_kept"]) for r in neardup.classes(docs(rows(*texts))).collect()}
    assert got == {i: (want[i], want[i] == i) for i in range(len(texts))}
    kept = neardup.deduplicated(docs(rows(*texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want)) and kept.columns == docs([]).columns


def test_probability_jaccard_and_its_estimate():
    a, b = "x y z w v " * 9 + "one two three four five six", "x y z w v " * 5 + "one two three four five seven eight"
    s, t, n = neardup.weighted(*Words([a, b]).shingles(5))
    sets = [(s[t == i], n[t == i].astype(float)) for i in (0, 1)]
    want = jp(shingles(a), shingles(b))
    assert neardup.probability_jaccard(*sets) == pytest.approx(want)
    sig = neardup.probminhash(s, t, n.astype(float), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_large_group_of_near_copies(docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:i], "odd", *base[i + 1 :]]) for i in [rng.randrange(120) for _ in range(150)]] + [" ".join(f"z{i}" for i in range(60))]
    got = collections.Counter(r["class_id"] for r in neardup.classes(docs(rows(*texts))).collect())
    assert got == {0: 150, 150: 1}


@pytest.mark.parametrize("block", [neardup.BLOCK, 24])
def test_large_group_with_two_edits_in_each_copy(docs, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)  # small blocks deal one bucket over many cells
    rng = random.Random(9)
    texts = []
    for i in range(400):
        copy = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), 2):
            copy[k] = f"odd{i}"
        texts.append(" ".join(copy))
    sets, want = [set(shingles(t)) for t in texts], list(range(len(texts)))  # no shingle stands twice in a text
    for i, a in enumerate(sets):
        for j in range(i):
            if want[i] != want[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = sorted((want[i], want[j]))
                want = [x if u == y else u for u in want]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(rows(*texts))).collect()}
    assert got == dict(enumerate(want))


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    up = {x: x for p in pairs for x in p}
    for a, b in pairs:
        x, y = sorted((up[a], up[b]))
        up = {k: x if v == y else v for k, v in up.items()}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in up.items() if k in got} and all(up[k] == k for k in up.keys() - got.keys())


def test_odd_rows(odd, empty):
    got = neardup.classes(odd).collect()
    assert len(got) == odd.count() and {r["class_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert sum(r["doc_id"] is None and r["class_id"] is None for r in got) == 2
    left = [r["doc_id"] for r in neardup.deduplicated(odd).collect()]
    assert sorted(x for x in left if x is not None) == [0, 1, 2, 3, 4, 5, 6] and left.count(None) == 2
    assert neardup.classes(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


def test_twins_among_many_texts_just_under_the_threshold(docs):
    """Texts of one template: a twin at 0.82, all others at 0.77 meet in the buckets without a link."""
    rng = random.Random(11)
    texts = []
    for i in range(150):
        base = [f"t{k}" for k in range(200)]
        base[60:82] = [f"own{i}x{k}" for k in range(22)]
        twin = list(base)
        for k in rng.sample(range(90, 200), 3):
            twin[k] = f"odd{i}"
        texts += [" ".join(base), " ".join(twin)]
    want = brute(texts)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(rows(*texts))).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) == 150


CLASHING = "_key _id _text _marks _done _gone _again _draw _ids _decoded gone again".split()


def test_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    data = [(i, t, None, None, *([f"v{i}"] * len(CLASHING))) for i, t in enumerate(["one two three four five six"] * 3 + ["other words"])]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    got = neardup.deduplicated(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [data[0], data[3]] and neardup.deduplicated(df.select(*df.columns, F.lit(1).alias("a.b"))).count() == 2
