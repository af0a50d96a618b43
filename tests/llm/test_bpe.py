import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe

from .conftest import rows

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")
TEXTS = ["", "  a  b\n\n c\t<|endoftext|> x<|endoftext|>", "don't we'll I'M 123 4٣ \x1c\x1f a\x85b\xa0c d　e", "日本語 é é \U0001f600!!\x00\x00 ﬁ", "a" * 300 + "!" * 77 + " " * 9 + "\n" * 5 + "x   ", "a \x00 \x00b", "'S 's ''s 're'll", " ", "\n", "a b\n", None]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_digests_are_the_librarys(docs, library):
    for r in bpe.digests(docs(rows(*TEXTS)), PATH).collect():
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 'tsre\n0é", max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = test_any_text.library = getattr(test_any_text, "library", None) or Tokenizer.from_file(PATH)
    e = bpe.encoder(PATH)
    assert e.encode(text) == t.encode(text, add_special_tokens=False).ids and e.decode(e.encode(text)) == text


def test_store_of_words_may_overflow(library):
    e = bpe.Encoder(PATH)
    bpe.KEPT_WORDS, old = 5, bpe.KEPT_WORDS
    try:
        for t in ("one two three four five six", "seven one eight two nine ten", "a b c d e f g h"):
            assert e.encode(t) == library.encode(t, add_special_tokens=False).ids
    finally:
        bpe.KEPT_WORDS = old


def test_odd_rows(odd, empty, library):
    assert bpe.digests(odd, PATH).count() == odd.count() and bpe.digests(empty, PATH).count() == 0 and bpe.encoded(empty, PATH).count() == 0
    out = bpe.encoded(odd, PATH).collect()
    want = sorted((r["text"] or "", str(r["doc_id"])) for r in odd.collect())
    assert sorted((r["text"], str(r["doc_id"])) for r in out) == want
    assert all(r["ids"] == library.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in out if len(r["text"]) < 1000)


def test_columns_of_any_name(spark):
    names = "_key _id _text _marks _done _gone _again _draw _ids _decoded".split()
    df = spark.createDataFrame([(1, "a b", *names, [7])], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names) + ", ids array<int>")
    r = bpe.encoded(df, PATH).first()
    assert r["text"] == "a b" and r["n_tokens"] == len(r["ids"]) and r["ids"] != [7] and [r[c] for c in names] == names
