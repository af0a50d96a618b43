import hashlib
import unicodedata

import xxhash
from pyspark.sql import functions as F

from quarry.llm import fingerprints

from .conftest import rows


def brute(data):
    """id -> (n_chars, edited sha, near_edited, near_next), in descending order of id; ids are distinct."""
    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    fold = lambda t: " ".join(nfkc(nfkc(t).casefold()).split())
    order = sorted(data, key=lambda r: -r[0])
    out = {}
    for i, r in enumerate(order):
        t, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        out[r[0]] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), float(fold(t) == fold(edited)), float(fold(t) == fold(after)))
    return out


def test_report_is_what_brute_force_gives(docs):
    texts = ["abc def ghi", "abc  DEF\nghi", "ａｂｃ def ghi", None, "", "x", "aaaaaa", "aaaaaa", "é", "é", "long text " * 50] + [f"text number {i}" for i in range(60)]
    data = rows(*texts)
    fingerprints.RUN_ROWS, old = 7, fingerprints.RUN_ROWS  # many runs
    try:
        got = fingerprints.edit_report(docs(data)).collect()
    finally:
        fingerprints.RUN_ROWS = old
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got} == brute(data)
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[0] == by[1] == by[2] and by[3] == by[4] and by[8] == by[9] and len({by[i] for i in (0, 3, 5, 6, 8)}) == 5
    assert by[6][:16] == f"{xxhash.xxh64_intdigest(b'aaaaaa', seed=42):016x}"


def test_colliding_buckets_are_told_apart(docs):
    weak = lambda canon: F.substring(F.sha2(canon, 256), 1, 1)
    texts = [f"text {i % 40}" for i in range(80)]
    got = fingerprints.fingerprint(docs(rows(*texts)), hashed=weak).collect()
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert len(set(by.values())) == 40 and all(by[i] == by[i + 40] for i in range(40))
    report = fingerprints.edit_report(docs(rows(*texts)), hashed=weak).collect()
    assert len({r["fingerprint"] for r in report}) == 40
    assert all(r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"]) for r in report)


def test_full_case_folding(docs):
    pairs = [("Straße", "STRASSE"), ("οδος", "ΟΔΟΣ"), ("οδοσ", "οδος"), ("ﬁn", "FIN"), ("Ǆ", "ǆ"), ("plain ASCII", "PLAIN ascii"), ("ŉa", "ʼna")]
    by = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs(rows(*[t for p in pairs for t in p]))).collect()}
    assert all(by[2 * i] == by[2 * i + 1] for i in range(len(pairs))) and len(set(by.values())) == len(pairs) - 1


def test_odd_rows(odd, empty):
    assert fingerprints.edit_report(odd).count() == odd.count()
    assert fingerprints.edit_report(empty).count() == 0
    assert fingerprints.fingerprint(odd).count() == odd.count()
