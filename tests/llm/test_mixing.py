import collections

import numpy as np

from quarry.llm import mixing

from .conftest import rows


def water(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed, share = sum(sizes.values()), {}, {}
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def corpus(docs, n=900):
    texts = [" ".join(["w"] * (i * 7919 % 97 + 1)) for i in range(n)]
    data = [(i, texts[i], "en", [None, "a", "b", "ö", "c", "small"][0 if i % 50 == 0 else 5 if i % 90 == 1 else 1 + i % 4 if i % 3 else 1], 0, "x", 1, "y", "z") for i in range(n)]
    return data, docs(data)


def test_targets_and_words_taken(docs):
    data, df = corpus(docs)
    sizes = collections.Counter()
    for r in data:
        sizes[r[3]] += len(r[1].split())
    want, source = water(sizes), {r[0]: r[3] for r in data}
    got = mixing.report(df).collect()
    assert len(got) == len(data)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(data[r["doc_id"]][1].split()) and r["source_size"] == sizes[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * r["target"] + 1e-9
        assert r["taken"] <= 3 * r["size"] and r["taken"] % r["size"] == 0
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 100 for s in want)
    again = mixing.report(df.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_holds_each_document_as_often_as_drawn(docs):
    data, df = corpus(docs, 300)
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.report(df).collect()}
    got = collections.Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert got == collections.Counter({k: v for k, v in want.items() if v}) and mixing.mix(df).columns == df.columns


def test_taken_is_what_the_tree_dealt(docs):
    """The whole mix worked out plainly from the shards, with small blocks and shards."""
    data, df = corpus(docs)
    got = mixing.report(df, block_docs=20, shard_words=3000).collect()
    assert all(r["taken"] == r["size"] * len([x for x in r["shards"].split(",") if x]) for r in got)
    words = collections.Counter(int(x) for r in got for x in r["shards"].split(",") if x for _ in range(r["size"]))
    n = sum(words.values()) // 3000
    assert len(words) >= 0.9 * n and max(words) < n + 2 and max(words.values()) < 4 * 3000
    sizes = collections.Counter()
    for r in data:
        sizes[r[3]] += len(r[1].split())
    want, taken = water(sizes), collections.Counter()
    for r in got:
        taken[data[r["doc_id"]][3]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 100 for s in want)


def split(quotas, shards, seed):
    """Counts of draws, shard by shard, by plain recursion."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def down(lo, hi, left):
        if hi - lo == 1:
            out[lo] = left
            return
        drawn = mixing.halved(left, lo, hi, seed)
        assert (drawn >= 0).all() and (drawn <= left).all() and abs(drawn.sum() / max(1, left.sum()) - ((lo + hi) // 2 - lo) / (hi - lo)) <= 1 / max(1, left.sum())
        down(lo, (lo + hi) // 2, drawn)
        down((lo + hi) // 2, hi, left - drawn)

    down(0, shards, quotas)
    return out


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 3, 0, 57, 400])
    source, rank = np.repeat(np.arange(5), quotas), np.concatenate([np.arange(q) for q in quotas])
    want = split(quotas, 13, 5)
    order = np.random.default_rng(0).permutation(len(rank))
    got = mixing.shards_of(quotas, 13, 5, source[order], rank[order])
    assert (np.stack([np.bincount(got[source[order] == s], minlength=13) for s in range(5)], axis=1) == want).all()
    assert (want.sum(axis=0) == quotas).all() and np.ptp(want.sum(axis=1)) <= 13
    some = np.arange(0, len(rank), 7)
    whole = mixing.shards_of(quotas, 13, 5, source, rank)
    assert (mixing.shards_of(quotas, 13, 5, source[some], rank[some]) == whole[some]).all()
    assert all((np.diff(whole[source == s]) >= 0).all() for s in range(5))  # next draws go to next shards


def test_draws_beyond_the_librarys_range():
    rng = np.random.default_rng(2)
    good, bad, n = 3 * 10**9, 7 * 10**9, 10**5
    x = np.array([mixing.hypergeometric(rng, good, bad, n) for _ in range(300)])
    sd = (n * 0.3 * 0.7) ** 0.5
    assert abs(x.mean() - n * 0.3) < 4 * sd / 300**0.5 and 0.85 < x.std() / sd < 1.15
    assert mixing.hypergeometric(rng, 5 * 10**9, 10, 5 * 10**9 + 10) == 5 * 10**9


def test_rows_of_one_id_and_columns_of_any_name(spark):
    extra = "_key _id _text _marks _done _gone _again _draw _ids _decoded row draw size sk".split()
    data = [(i % 3, f"{i % 3} b c", "s", *([str(i % 3)] * len(extra))) for i in range(30)] + [(None, None, None, *([None] * len(extra)))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in extra))
    got = collections.Counter(tuple(r) for r in mixing.mix(df).collect())
    assert mixing.mix(df).columns == df.columns and got == collections.Counter(data[:30])


def test_odd_rows(odd, empty):
    got = mixing.report(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0 and mixing.mix(odd).count() > 0
