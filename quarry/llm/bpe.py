"""BPE encoding and decoding over a word trie.

The distinct words of a batch go through a trie depth first (in byte order, so that a word shares
its prefix's states with the one before). The state of a trie node is the last token of its prefix's
encoding: the one token that ends the prefix and that may follow the last token of what stands
before it. Two tokens may follow each other if the merges leave their joined bytes as these two.
So each shared prefix is encoded once, and a word's encoding is read back along its states.

Defined cases: a null or empty text has no tokens; a special token's string in a text is that token
(as the library does by default); a very long text is encoded whole; rows repeat as they come; an
empty table gives no rows; extra columns are ignored by digests() and kept by encoded().
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import pieces

#: Words whose encodings a worker keeps between batches; beyond it the store begins anew.
KEPT_WORDS = 900_000
#: Characters whose words go through the trie together; fewer where ids and texts go on, whose words are kept in a smaller store too.
TRIE_CHARS, CARRIED_CHARS, CARRIED_WORDS = 4_000_000, 1_000_000, 100_000
#: How byte-level vocabularies write bytes, and the pattern that cuts a text into words.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _byte_names() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(_PLAIN)]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Of a tokenizers file with a byte-level BPE model; encode and decode whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, names = file["model"], _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.rank = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((self.ids[raw(a)], self.ids[raw(b)]), i)
        self.special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.cut = regex.compile(WORDS)
        self.beside = re.compile(r" \s|\s ")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # each token's last merge: its rank (-1 for a byte) and its two parts; a token that the merges don't lead to has none
        self.made: dict[int, tuple[int, int, int]] = {}
        for t, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(t) == 1:
                self.made[i] = (-1, i, i)
        for (a, b), rank in self.rank.items():
            i = self.ids.get(self.bytes[a] + self.bytes[b])
            if i is not None and i not in self.made and a in self.made and b in self.made and self._apart(a, b, rank):
                self.made[i] = (rank, a, b)
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, tuple[str, bytes]] = {}
        self.names = {i: str(i) for i in self.bytes}

    def _apart(self, x: int, y: int, limit: int) -> bool:
        """No merge of a rank below limit joins anything across the boundary of x and y.

        Goes back in time, undoing the later of the two tokens' merges (of equal ranks the right one,
        which came later), and asks whether what then touched would have merged before.
        """
        rank, made = self.rank, self.made
        while True:
            r = rank.get((x, y))
            if r is not None and r < limit:
                return False
            left, right = made[x], made[y]
            if left[0] > right[0]:
                limit, x = min(limit, left[0]), left[2]
            elif right[0] >= 0:
                limit, y = min(limit, right[0] + 1), right[1]
            else:
                return True

    def may_follow(self, a: int, b: int) -> bool:
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        got = self.pairs[a << 32 | b] = self._apart(a, b, 1 << 60)
        return got

    def traverse(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Encodings of words, which must be distinct and in byte order."""
        ids, longest, pairs = {t: i for t, i in self.ids.items() if i in self.made}, self.longest, self.pairs
        get = ids.get
        begin: list[int] = []  # where the token of each state begins
        last: list[int] = []  # the state of each node on the path: last[i] ends the prefix of i + 1 bytes
        before = b""
        for word in words:
            n = len(commonprefix((before, word)))
            del last[n:], begin[n:]
            size = len(word)
            for end in range(n + 1, size + 1):
                # exactly one token fits; most often it extends the one before, or stands alone
                start = begin[-1] if end > 1 else 0
                token = get(word[start:end])
                if token is None or start and not (pairs.get(last[start - 1] << 32 | token) or self.may_follow(last[start - 1], token)):
                    for start in range(max(0, end - longest), end):
                        token = get(word[start:end])
                        if token is not None:
                            if not start:
                                break
                            fits = pairs.get(last[start - 1] << 32 | token)
                            if self.may_follow(last[start - 1], token) if fits is None else fits:
                                break
                    else:
                        raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")
                last.append(token)
                begin.append(start)
            out, end = [], size
            while end:
                out.append(last[end - 1])
                end = begin[end - 1]
            out.reverse()
            yield tuple(out)
            before = word

    def pieces(self, text: str) -> list[str]:
        """The text cut into words and special tokens."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.cut.findall(text)
        out = []
        for i, part in enumerate(self.at_special.split(text)):
            out += [part] if i % 2 else self.cut.findall(part)
        return out

    def chunks(self, text: str) -> list[str]:
        """The text cut at single spaces, each but the first chunk with the space before it left out and marked by what encode makes of it.

        Where white space stands beside a space a cut would change words, so such a text is one chunk for each word.
        """
        if self.beside.search(text) or text[:1] == " " or text[-1:] == " " or (self.special and any(s in text for s in self.special)):
            return [" " + w for w in self.pieces(text)]
        parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def learn(self, chunked: list[list[str]]) -> None:
        """Puts the words of chunks that are new through the trie."""
        known = self.known
        fresh = {c for chunks in chunked for c in chunks if c not in known}
        if len(known) + len(fresh) > KEPT_WORDS:
            self.known = {c: known[c] for chunks in chunked for c in chunks if c in known}
        special = self.special
        words = {c: [c[1:]] if c[1:] in special else self.cut.findall(c[1:] if c[:1] == " " else " " + c) for c in fresh}
        coded = sorted({w.encode("utf-8", "surrogatepass") for c, ws in words.items() for w in ws if w not in special})
        ids = dict(zip(coded, self.traverse(coded), strict=True))
        known, names, spelled = self.known, self.names, self.bytes
        for c, ws in words.items():
            got = tuple(i for w in ws for i in ((special[w],) if w in special else ids[w.encode("utf-8", "surrogatepass")]))
            known[c] = (",".join([names[i] for i in got]), b"".join([spelled[i] for i in got]))

    def coded(self, texts: list[str]) -> Iterator[list[tuple[str, bytes]]]:
        """For each text its chunks' ids, written with commas, and bytes."""
        chunked = [self.chunks(t) for t in texts]
        gc.disable()  # nothing here makes cycles, and the collector would walk all that is kept
        try:
            self.learn(chunked)
        finally:
            gc.enable()
        known = self.known
        for chunks in chunked:
            yield [known[c] for c in chunks if c != " "]

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in next(self.coded([text])) for i in c[0].split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with the text decoded from its tokens, n_tokens and ids (array<int>) behind the other columns; columns of these two names give way."""
    name, others = text_col, [c for c in docs.columns if c not in (text_col, "ids", "n_tokens")]
    ticked = lambda c: "`%s`" % c.replace("`", "``")

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            at = batch.schema.get_field_index(name)
            for part in pieces(batch, (at,), CARRIED_CHARS):
                if len(enc.known) > CARRIED_WORDS:
                    enc.known = {}
                ids, decoded = [], []
                for chunks in enc.coded([t or "" for t in part.column(at).to_pylist()]):
                    ids.append(np.fromstring(",".join([c[0] for c in chunks]), np.int32, sep=","))
                    decoded.append(b"".join([c[1] for c in chunks]).decode("utf-8", "replace"))
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                rest = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(decoded, pa.string()), pa.array(sizes), lists], names=[*[n for i, n in enumerate(part.schema.names) if i != at], name, "n_tokens", "ids"])
        enc.known = {}  # the worker may serve other operators next

    kinds = dict(docs.dtypes)
    return map_arrow(docs.select(*map(ticked, others), ticked(name)), run, ", ".join(f"{ticked(c)} {kinds[c]}" for c in others) + f", {ticked(name)} string, n_tokens long, ids array<int>")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row; ids and texts stay in the worker."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        enc = encoder(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in pieces(batch, (1,), TRIE_CHARS):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n, ids_sha, text_sha = [], [], []
                for chunks in enc.coded(texts):
                    ids = ",".join([c[0] for c in chunks])
                    n.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(sha(ids.encode()))
                    text_sha.append(sha(b"".join([c[1] for c in chunks]).decode("utf-8", "replace").encode()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(rows, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
