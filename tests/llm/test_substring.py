import random

import numpy as np
import pytest

from quarry.llm import substring
from quarry.llm.common import Words

from .conftest import rows


def words(rng, n):
    return [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(n)]


def line(rng, n):
    return " ".join(words(rng, n))


def spans(df):
    by = {}
    for r in df.collect():
        by.setdefault(r["doc_id"], []).append(r)
    return by


def test_repeated_passages_are_found_and_others_left_alone(docs):
    rng = random.Random(1)
    passage, near, inner, short = line(rng, 60), words(rng, 80), line(rng, 51), line(rng, 45)
    changed = [*near[:40], "other", *near[41:]]
    own = [line(rng, 90) for _ in range(14)]
    texts = [
        f"{own[0]}\n{passage}\n{own[1]}", f"{passage}\n{own[2]}", f"{own[3]}\n{' '.join(near)}", f"{' '.join(changed)}\n{own[4]}",
        f"{own[5]} {inner} {own[6]}", f"{own[7]} and {inner}", f"{own[8]}\n{own[8]}", own[9], own[10], f"{own[11]}\n{short}", f"{short}\n{own[12]}",
    ]
    by = spans(substring.repeats(docs(rows(*texts))))
    assert sorted(by) == [0, 1, 2, 3, 4, 5] and all(r["removed"] == (i != r["first_id"]) for i in by for r in by[i])
    cut = lambda i: [(texts[i][r["start"] : r["end"]], r["n_words"]) for r in by[i]]
    assert cut(1) == [(passage, 60)] and by[1][0]["first_id"] == 0
    assert cut(3) == [(" ".join(changed), 80)] and by[3][0]["class_id"] == by[2][0]["class_id"]
    # inside paragraphs the span is the whole passage, without a sentence mark
    assert [(t.strip(), n) for t, n in cut(5)] == [(inner, 51)] == [(t.strip(), n) for t, n in cut(4)]


def runs(a, b, least):
    """Maximal runs of equal words of two texts, as word spans of the first."""
    out = []
    for d in range(-len(b) + 1, len(a)):
        n = 0
        for i in range(max(0, d), min(len(a), len(b) + d) + 1):
            if i < min(len(a), len(b) + d) and a[i] == b[i - d]:
                n += 1
                continue
            if n >= least:
                out.append((i - n, i))
            n = 0
    return out


@pytest.mark.parametrize("seed", range(3))
def test_all_that_brute_force_finds_is_covered(docs, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]  # few words: windows begin at words that stand often
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(rng.randint(51, 90)) for _ in range(5)]
    texts = []
    for _ in range(24):
        t = some(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            t += rng.choice(shared) + some(rng.randint(1, 40))
        texts.append(t)
    said = [" ".join(x if rng.random() < 0.95 else x + "\n" for x in t) for t in texts]
    by = spans(substring.repeats(docs(rows(*said))))
    marked = {}
    for i, t in enumerate(said):
        w = Words([t])
        marked[i] = [any(r["start"] <= s and e <= r["end"] for r in by.get(i, ())) for s, e in zip(w.start, w.end)]  # ASCII: bytes are code points
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            for s, e in runs(a, b, 51) if i != j else ():
                # the ends of a passage that several others hold in part are those that one of them confirms
                assert all(marked[i][s + 25 : e - 25]) and sum(marked[i][s:e]) >= 50, (i, j, s, e)
    lonely = [i for i, a in enumerate(texts) if not any(runs(a, b, 50) for j, b in enumerate(texts) if i != j)]
    assert lonely and not set(lonely) & set(by)


def test_classes_of_paragraphs_are_those_of_brute_force(docs):
    rng = random.Random(7)
    base = [words(rng, rng.randint(50, 120)) for _ in range(8)]
    paras = []
    for _ in range(40):
        p = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            p[rng.randrange(len(p))] = rng.choice("xyz") + "0"
        paras.append(p)
    sets = [{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in paras]
    up = list(range(len(paras)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = sorted((up[i], up[j]))
                up = [x if u == y else u for u in up]
    got = [r for r in substring.repeats(docs(rows(*map(" ".join, paras)))).collect() if r["kind"] == "paragraph"]
    classes = {}
    for r in got:
        classes.setdefault(r["class_id"], set()).add(r["doc_id"])
        assert r["n_words"] == len(paras[r["doc_id"]]) and r["first_id"] == up[r["doc_id"]]
    want = {u: {i for i, x in enumerate(up) if x == u} for u in up}
    assert sorted(map(sorted, classes.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_tuned_bands():
    assert substring.tuned(16, 0.8, 0.999) == (8, 2) and substring.tuned(16, 0.8, 0.9) == (5, 3) and substring.tuned(2, 0.1, 0.999) == (2, 1)


def test_windows_stand_among_all_neighbours():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (200, 49, 10, 0, 70)]
    w = Words(texts)
    at = substring.begins(w)
    for i, n in enumerate((200, 49, 10, 0, 70)):
        own = at[w.text_of[at] == i] - w.first[i] if len(at) else at
        assert all(any((own >= j) & (own < j + substring.RUN)) for j in range(n - 2 * substring.RUN + 2)) and all(own + substring.RUN <= n)


def test_shared_and_null_ids(docs):
    rng = random.Random(4)
    p, q = line(rng, 60), line(rng, 60)
    mine = [f"{line(rng, 30)} {p} {line(rng, 70)}", f"{line(rng, 90)} {p}", f"{line(rng, 20)} {q} {line(rng, 9)}", f"{q} {line(rng, 80)}"]
    extra = ("x", 7, "y", "z")
    data = [(None, mine[0], "en", "s", 1, *extra), (None, mine[1], "en", "s", 1, *extra), (5, mine[2], "en", "s", 1, *extra), (5, line(rng, 99), "en", "s", 1, *extra), (6, mine[3], "en", "s", 1, *extra), (8, p, "en", "s", 1, *extra), (8, p, "en", "s", 1, *extra)]
    got = substring.repeats(docs(data)).collect()
    held = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["removed"]) for r in got))
    assert held == [(False, 5, 60, False), (False, 6, 60, True), (False, 8, 60, False), (True, 0, 60, True), (True, 0, 60, True)]
    texts = {r["end"] - r["start"] for r in got if r["doc_id"] is None}
    assert all(len(p) <= x <= len(p) + 1 for x in texts)


def test_exact_copies_and_case(docs):
    rng = random.Random(2)
    t = "\n".join(line(rng, 60) for _ in range(3))
    got = substring.repeats(docs(rows(t, t, t.upper()))).collect()
    assert sum(r["kind"] == "paragraph" for r in got) == 9 and sum(r["removed"] for r in got if r["kind"] == "paragraph") == 6
    assert {r["doc_id"] for r in got if not r["removed"]} == {0}


def test_odd_rows(odd, empty, docs):
    assert {r["doc_id"] for r in substring.repeats(odd).collect()} == set() and substring.repeats(empty).count() == 0
    t = " ".join(f"w{i}" for i in range(60))
    got = substring.repeats(docs(rows(t, start=4) + [(None, t, "en", "s", 1, "x", 1, "y", "z")])).collect()
    assert [(r["doc_id"], r["removed"]) for r in sorted(got, key=lambda r: r["doc_id"] is None)] == [(4, False), (None, True)]
