"""Language identification, quality rules and LM scoring."""

import collections
import functools
import math
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import gru, langid, lm, quality
from quarry.llm.ngrams import collected, grams, tallied

from .conftest import rows

PARTS = {"en": "the of ing tion er and th ou".split(), "de": "sch der ung keit ein zu ber ß".split(), "fr": "eau tre la é oi ment ou que".split()}


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = list(PARTS)[i % 3]
        out.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(60, 160))), lang, "s", 0, "x", 1, "y", "z"))
    return out


def crc(i, mod):
    return zlib.crc32(str(i).encode()) % mod


def test_languages_of_held_out_documents(docs):
    data = corpus()
    mixed = data[0][1] + " " + data[1][1]
    extra = [(1000, mixed, None, "s", 0, "x", 1, "y", "z"), (1001, None, "en", "s", 0, "x", 1, "y", "z"), (1002, "12 34 !!", "en", "s", 0, "x", 1, "y", "z"), (1003, "", None, "s", 0, "x", 1, "y", "z")]
    got = {r["doc_id"]: r for r in langid.identify(docs(data + extra)).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in data) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (crc(i, 4) == 2) for i in got)
    assert set(got[1000]["languages"].split(",")) == {"en", "de"} and got[1000]["score"] < 0.8
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1001, 1002, 1003))
    assert sum(len(r["languages"].split(",")) == 1 for r in got.values() if r["doc_id"] < 1000) > 200


def test_identification_of_odd_rows(odd, empty):
    assert langid.identify(odd).count() == odd.count() and langid.identify(empty).count() == 0


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen3 = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if seen3[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_quality_measures_and_verdicts(docs):
    data = corpus()
    texts = ["a b c a b c a\n\nx\n x\nx", "é#\x0b\x85 \xa0 $$ |", "", None, "one two"]
    noise = " ".join("".join(chr(33 + (i * j) % 90) for j in range(3, 9)) for i in range(1, 120))
    extra = [(2000 + i, t, "en", "s", 0, "x", 1, "y", "z") for i, t in enumerate(texts)] + [(3000, noise, "en", "s", 0, "x", 1, "y", "z")]
    rowset = docs(data + extra)
    got = {r["doc_id"]: r for r in quality.judge(rowset).collect()}
    for r in data + extra:
        g = got[r[0]]
        n = base(r[1] or "")
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == n
        assert g["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (g["base_failed"] and g["kept"])
    assert all(got[r[0]]["kept"] for r in data) and not got[3000]["kept"] and not got[3000]["base_failed"]
    assert sorted(r["doc_id"] for r in quality.keep(rowset).collect()) == sorted(i for i, g in got.items() if g["kept"])


def test_quality_of_odd_rows(odd, empty):
    assert quality.judge(odd).count() == odd.count() and quality.judge(empty).count() == 0 and quality.keep(empty).count() == 0
    assert quality.keep(odd).columns == odd.columns


def plain_kneser(texts):
    """Modified Kneser-Ney of order 4 by its definition: P(character | context) from dictionaries of strings."""
    high = collections.Counter()
    for t in texts:
        s = "   " + " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) + " "
        high.update(s[i : i + 4] for i in range(len(s) - 3))
    counts = {4: high}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    d = {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d[k] = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3] if min(n1, n2, n3, n4) else [0, 0.5, 1, 1.5]
    uniform = 1 / (len(counts[1]) + 1)

    def p(gram):
        if not gram:
            return uniform
        c, k = counts[len(gram)], len(gram)
        after = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return p(gram[1:])
        return max(0, c[gram] - d[k][min(c[gram], 3)]) / total + sum(d[k][min(n, 3)] for n in after.values()) / total * p(gram[1:])

    return p


def test_kneser_ney_is_that_of_the_definition():
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)) for _ in range(12)]
    got = collections.Counter()
    for label, keys, n in quality.characters(texts, np.array(["x"] * len(texts), object)):
        got.update(dict(zip(keys.tolist(), n.tolist())))
    keys = np.array(sorted(got), np.uint64)
    model, p = quality.Kneser(keys, np.array([got[int(k)] for k in keys])), plain_kneser(texts)
    packed = lambda g: sum(ord(c) << 16 * i for i, c in enumerate(reversed(g)))
    for g in ["   a", "ab c", "b cd", " cde", "cde ", " a b", "zzzz", "abcz", "z ab", *["".join(rng.choice("abcdeé ") for _ in range(4)) for _ in range(60)]]:
        assert model.logp(np.array([packed(g)], np.uint64))[0] == pytest.approx(math.log(p(g)), abs=2e-5), g
    for head in np.unique(keys >> np.uint64(16))[:30]:
        chars = np.unique(keys & np.uint64(0xFFFF))
        assert np.exp(model.logp((head << np.uint64(16)) | chars)).sum() + math.exp(model.logp(np.array([(head << np.uint64(16)) | np.uint64(0x7777)]))[0]) == pytest.approx(1, abs=1e-3)


def test_perplexity_and_bands_are_those_of_the_definition(docs):
    data = corpus(150)
    rng = random.Random(3)
    dull = " ".join("a" * k for k in range(30, 100))
    noise = " ".join("".join(chr(rng.randrange(0x4E00, 0x5000)) for _ in range(5)) for _ in range(80))
    data += [(i, t, "en", "s", 0, "x", 1, "y", "z") for i, t in ((900, dull), (901, noise), (902, "the of"))]
    got = {r["doc_id"]: r for r in quality.judge(docs(data)).collect()}
    p = functools.cache(plain_kneser([r[1] for r in data if r[2] == "en"]))
    for i in (0, 3, 900, 901):
        s = "   " + {r[0]: r[1] for r in data}[i] + " "
        assert got[i]["log_ppl"] == pytest.approx(-sum(math.log(p(s[k : k + 4])) for k in range(len(s) - 3)) / (len(s) - 3), abs=1e-4)
    lang = {r[0]: r[2] for r in data}
    for x in PARTS:
        held = sorted(r["log_ppl"] for i, r in got.items() if lang[i] == x and not r["base_failed"])
        q = [held[max(0, math.ceil(len(held) * f) - 1)] for f in (0.25, 0.75)]
        reach = quality.REACH * max(q[1] - q[0], quality.LEAST_RANGE)
        for i, r in got.items():
            if lang[i] == x:
                assert r["kept"] == (not r["base_failed"] and q[0] - reach <= r["log_ppl"] <= q[1] + reach)
    assert not any(got[i]["kept"] for i in (900, 901, 902))
    assert sum(r["kept"] for i, r in got.items() if i < 900) >= 147


CLASHING = "_key _id _text _marks _done _gone _again _draw _ids _decoded key label held".split()


def test_quality_with_columns_of_any_name(spark):
    data = [(*r[:4], *[f"{c}{r[0]}" for c in CLASHING]) for r in corpus(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    got = quality.keep(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(data)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("held", [10**6, 40])
def test_scores(docs, held):
    data = corpus(150) + [(500, None, "en", "s", 0, "x", 1, "y", "z"), (501, "The OF Éx unseenword", None, None, 0, "x", 1, "y", "z"), (502, "", "en", "s", 0, "x", 1, "y", "z")]
    tok = {r[0]: [*re.findall(r"[^\x20\x09-\x0D]+", lower(r[1] or "")), None] for r in data}
    c = collections.Counter()
    for i, t in tok.items():
        if crc(i, 7) != 2:
            c.update(t)
    total, kinds = sum(c.values()), len(c)
    got = lm.score(docs(data), held=held).collect()
    assert len(got) == len(data)
    for r in got:
        t = tok[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"], 7) == 2, len(t), sum(c[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in t))
        assert r["score"] < 0
    # with its words, the model knows which language it is in
    assert held < 10**6 or sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def plain_forward(p, tokens):
    """ln P of one document by the formulas, number by number."""
    sig = lambda x: 1 / (1 + np.exp(-2 * x))  # noqa: E731  gates take half their input's scale
    n, h, before, total = gru.UNITS, np.zeros(gru.UNITS), None, 0.0
    for t, word in enumerate(tokens):
        last = tokens[t - 1] if t else 0
        gate = sig(p["xg"][last] + p["bg"] + h @ p["u"][:, : 2 * n])
        z, r = gate[:n], gate[n:]
        c = np.tanh(p["xc"][last] + p["bc"] + r * (h @ p["u"][:, 2 * n :]))
        h = z * h + (1 - z) * c
        a = h @ p["c"] + p["cb"]
        cls = 0 if word == 0 else 1 + (word - 1) // gru.SIZE
        total += a[cls] - np.log(np.exp(a).sum())
        if word:
            b = h @ p["o"][cls - 1] + p["ob"][cls - 1]
            total += b[(word - 1) % gru.SIZE] - np.log(np.exp(b).sum())
    return total


def test_scores_are_those_of_a_plain_forward_pass(docs, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    data = [(i, " ".join(words[int(rng.expovariate(1 / 900)) % 5000] for _ in range(rng.randint(0, 250))), "en", "s", 0, "x", 1, "y", "z") for i in range(40)]
    seen = {}

    def fit(train, counts, rounds=3):
        p = {k: v + np.random.default_rng(1).normal(0, 0.3, v.shape).astype(np.float32) for k, v in gru.start(counts.common).items()}
        seen.update(p=p, counts=counts)
        return p

    monkeypatch.setattr(lm, "fit", fit)
    got = {r["doc_id"]: r for r in lm.score(docs(data)).collect()}
    c = collections.Counter(w for i, t, *_ in data if crc(i, 7) != 2 for w in t.split())
    number = lambda t: seen["counts"].numbers([t])[0].tolist()
    kind = {w: number(w)[0] for w in words}
    ranked = sorted(c, key=lambda w: -c[w])[: gru.WORDS - 1 - gru.RARE]
    least = min(c[w] for w in ranked)
    assert all(kind[w] > gru.RARE for w in c if c[w] > least) and all(0 < kind[w] <= gru.RARE for w in words if not c[w])
    rare = collections.defaultdict(list)
    for w in c:
        if kind[w] <= gru.RARE:
            rare[kind[w]].append(c[w])
    for i, t, *_ in data[:12]:
        tokens = number(t)
        assert tokens[-1] == 0 and len(tokens) == got[i]["n_tokens"]
        want = plain_forward({k: v.astype(float) for k, v in seen["p"].items()}, tokens) / math.log(10)
        want += sum(math.log10((c[w] + 1) / (sum(rare[kind[w]]) + len(rare[kind[w]]) + 1)) for w in t.split() if kind[w] <= gru.RARE)
        assert got[i]["score"] == pytest.approx(want, rel=1e-4)


def test_scoring_odd_rows(odd, empty):
    assert lm.score(odd).count() == odd.count() and lm.score(empty).count() == 0


def test_model_is_a_distribution_and_gradients_are_right():
    rng = np.random.default_rng(1)
    p = gru.start(np.arange(gru.WORDS, 0, -1.0))
    p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float64) for k, v in p.items()}
    h = rng.standard_normal((1, gru.UNITS))
    lp, _ = gru.loss(p, np.repeat(h, gru.WORDS, axis=0), np.arange(gru.WORDS), None)
    assert np.exp(lp).sum() == pytest.approx(1, abs=1e-5)
    before, fresh, words = rng.integers(0, gru.WORDS, (6, 5)), rng.random((6, 5)) < 0.2, rng.integers(0, gru.WORDS, (6, 5))
    start = np.zeros((5, gru.UNITS))
    loss = lambda q: -gru.loss(q, gru.recur(q, before, fresh, start, False)[0].reshape(-1, gru.UNITS), words.ravel(), None)[0].sum()
    g = {k: np.zeros_like(v) for k, v in p.items()}
    states, _, held = gru.recur(p, before, fresh, start, True)
    _, d = gru.loss(p, states.reshape(-1, gru.UNITS), words.ravel(), g)
    gru.back(p, before, fresh, held, d.reshape(states.shape), g)
    for k in p:
        at = tuple(int(rng.integers(0, n)) for n in p[k].shape)
        at = (int(before[2, 2]), at[1]) if k in ("xg", "xc") else at
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(float(g[k][at]), abs=2e-3)


def test_state_is_carried_across_windows():
    p = gru.start(np.ones(gru.WORDS), seed=3)
    tokens = np.random.default_rng(0).integers(0, gru.WORDS, 500).astype(np.int16)
    whole = gru.score(p, tokens, np.array([0, 200, 230, 500]), 0, lanes=2)
    alone = [gru.score(p, tokens[a:b], np.array([0, b - a]), 0)[0] for a, b in ((0, 200), (200, 230), (230, 500))]
    assert whole == pytest.approx(alone, rel=1e-4)


def test_counts_of_rare_grams_stay_beside_common_ones(spark):
    counts = spark.createDataFrame([("en", 9, 5_000_000), ("en", 4, 1), ("xx", 7, 2), ("xx", 5, 1)], "label string, gram long, n long")
    got = {k: (g.tolist(), n.tolist()) for k, (g, n) in collected(counts).items()}
    assert got == {"en": ([4, 9], [1, 5_000_000]), "xx": ([5, 7], [1, 2])}
    assert collected(counts.limit(0)) == {}
