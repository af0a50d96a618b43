"""Language identification by mixture inference.

A document is a mixture of languages: each of its words was drawn from one of them, with the
likelihood of the word's character trigrams. Expectation-maximisation estimates the proportions;
languages leave the set one by one while the log-likelihood, less half the logarithm of the number
of words for each further language, grows. The prediction is the language of the largest
proportion, and the score that proportion times its share among the documents' word evidence.

Trigram counts come from all rows that are learned from; scoring sees text alone. Defined cases: a
null text or one without a letter is "und" with score 0, and so is every text if nothing could be
learned; rows without a label are not learned from; repeated rows give the same answer each; of tied
languages the first by name is predicted; a very long text is read whole; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Words, held_out, pieces
from .ngrams import collected, counted, distinct, grams, lookup, tallied, word_texts

ORDER, SMOOTHING = 3, 0.05
STEPS, PENALTY = 8, 0.5


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.keys = np.unique(np.concatenate([k for k, _ in counts.values()])) if counts else np.zeros(0, np.uint64)
        heads = self.keys >> np.uint64(16)
        contexts, head_at = np.unique(heads, return_inverse=True)
        n = np.zeros((len(self.keys), len(self.langs)))
        for j, l in enumerate(self.langs):
            n[np.searchsorted(self.keys, counts[l][0]), j] = counts[l][1]
        chars = max(2, len(np.unique(self.keys & np.uint64(0xFFFF))))
        sums = np.zeros((len(contexts), len(self.langs)))
        for j in range(len(self.langs)):
            sums[:, j] = np.bincount(head_at, weights=n[:, j], minlength=len(contexts))
        # log P(character | two before, language), smoothed over the characters seen
        self.logp = np.log((n + SMOOTHING) / (sums[head_at] + SMOOTHING * chars)).astype(np.float32)
        self.contexts, self.floor = contexts, np.log(SMOOTHING / (sums + SMOOTHING * chars)).astype(np.float32)
        self.unseen = np.float32(np.log(1 / chars))

    def words(self, texts: list[str]) -> np.ndarray:
        """log-likelihood of each word in each language."""
        keys, word = grams(texts, ORDER)
        at, seen = lookup(self.keys, keys)
        lp = self.logp[at] if len(self.keys) else np.zeros((len(keys), len(self.langs)), np.float32)
        miss = np.flatnonzero(~seen)
        if len(miss):
            hat, has = lookup(self.contexts, keys[miss] >> np.uint64(16))
            lp[miss] = np.where(has[:, None], self.floor[hat], self.unseen)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else []
        return np.add.reduceat(lp, starts, axis=0) if len(word) else np.zeros((0, len(self.langs)), np.float32)

    def mixtures(self, ll: np.ndarray, n: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Proportions (docs, languages) from words (doc-sorted) of log-likelihoods ll that occur n times."""
        k = len(self.langs)
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(ll - top) + 1e-12
        starts = np.searchsorted(doc, np.arange(docs))
        sums = lambda x: np.add.reduceat(x, starts, axis=0)  # noqa: E731  every doc here has words
        total = sums(n.astype(np.float64))
        best, best_score = np.zeros((docs, k)), np.full(docs, -np.inf)
        active = np.arange(docs)
        allowed = np.ones((docs, k), bool)
        while len(active):
            if len(active) == docs:
                lk, w, d, st = like, n, doc, starts
            else:
                pick = np.isin(doc, active)
                lk, w, d = like[pick], n[pick], np.searchsorted(active, doc[pick])
                st = np.searchsorted(d, np.arange(len(active)))
            ok = allowed[active]
            pi = ok / ok.sum(axis=1, keepdims=True)
            several = ok.sum(axis=1).max() > 1
            for _ in range(STEPS if several else 1):
                joint = lk * pi[d]
                norm = joint.sum(axis=1)
                pi = np.add.reduceat(joint * (w / norm)[:, None], st, axis=0)
                pi /= pi.sum(axis=1, keepdims=True)
            norm = (lk * pi[d]).sum(axis=1)
            score = np.add.reduceat(np.log(norm) * w, st) - PENALTY * (ok.sum(axis=1) - 1) * np.log(np.maximum(total[active], 2))
            better = score >= best_score[active] - 1e-9
            best[active[better]], best_score[active[better]] = pi[better], score[better]
            # go on without the smallest proportion, where that may still help
            more = better & (ok.sum(axis=1) > 1)
            active, ok, pi = active[more], ok[more], pi[more]
            if len(active):
                allowed[active, np.where(ok, pi, np.inf).argmin(axis=1)] = False
        return best


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    return Model({k: v for k, v in collected(counted(docs.where(F.col(label_col).isNotNull()), lambda t, l: tallied(t, l, ORDER), text_col, label_col)).items()})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held, lang_pred, score, languages) for every row of docs(id, held, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), "held", F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            for part in pieces(batch, (2,)):
                rows = part.num_rows
                pred, score, sets = ["und"] * rows, np.zeros(rows), [""] * rows
                w = Words([(t or "").lower() for t in part.column(2).to_pylist()])
                if len(w.hash) and m.langs:
                    first, at = distinct(w.hash)
                    words = word_texts(w, first)
                    letters = np.fromiter((any(map(str.isalpha, x)) for x in words), bool, len(words))
                    use = letters[at]
                    pair, n = np.unique(w.text_of[use] * len(words) + at[use], return_counts=True)
                    doc, word = pair // max(1, len(words)), pair % max(1, len(words))
                    if len(doc):
                        has, place = np.unique(doc, return_inverse=True)
                        pi = m.mixtures(m.words(words)[word], n, place, len(has))
                        for d, p in zip(has.tolist(), pi, strict=True):
                            j = int(p.argmax())
                            pred[d], score[d] = m.langs[j], min(1.0, float(p[j]))
                            sets[d] = ",".join(m.langs[i] for i in np.argsort(-p, kind="stable") if p[i] > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.string())], names=[id_col, "held_out", "lang_pred", "score", "languages"])

    return map_arrow(rows, run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, languages string")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", mod: int = 4, rest: int = 2) -> DataFrame:
    """Learns from the labelled rows that are not held out and predicts every row. Extra columns are ignored."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"), held_out(F.col(id_col), mod, rest).alias("held"))
    model = learn(rows.where(~F.col("held")))
    return predict(rows, model).withColumnRenamed("doc_id", id_col)
