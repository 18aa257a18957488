"""Toxic spans and document scores from a linear-chain conditional random field.

Two states per token: plain and toxic.  A token's features are its word and
its prefixes; the chain's transitions join neighbouring tokens.  Labelled
tokens come from the labelled documents: a token of a toxic document is marked
when one of its features is far more frequent in toxic documents than in clean
ones (``LIFT``, and a likelihood ratio that allows for the number of features
tried), tokens of clean documents never are.  The field is then fitted to these tokens by gradient ascent on the conditional likelihood, and
forward-backward marginals of every whole text give the offending offsets and,
through a two-feature logistic fit on the document labels, the document score.

Fitting uses a bounded sample of labelled documents (``TOXIC_ROWS`` and
``CLEAN_ROWS``, chosen by a hash, one of each group of copies); scoring covers every token of every document.

Defined results: null text is empty; texts without a token get the score of a
document without evidence; without both labels every score is the prior
(0.5 if there are no labels at all).  Repeated label rows: a document is toxic
if any of them says so.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import cut, id_remainder

TOXIC_ROWS = 1_500       # labelled toxic documents in the sample, at most about
CLEAN_ROWS = 6_000       # labelled clean documents in the sample, at most about
FIELD_ROWS = 700         # documents of each label that train the field
LIFT = 12.0              # toxic over clean document rate that marks a token
MIN_DOCS = 4             # toxic documents that must hold a marking feature
PREFIXES = (3, 4, 5, 6)
STEPS = 60
CACHE = 300_000
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, letter by letter: offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


def _forward(emit, starts, active, trans):
    """Log-odds of the toxic state given all tokens up to each one (without the
    token's own emission when ``emit`` is added later): alpha per token."""
    stay0, to1, to0, stay1 = trans
    alpha = np.empty(len(emit))
    a = emit[starts].copy()
    alpha[starts] = a
    for t in range(1, len(active)):
        k = active[t]
        pos = starts[:k] + t
        a = a[:k]
        a = emit[pos] + np.logaddexp(a + stay1, to1) - np.logaddexp(a + to0, stay0)
        alpha[pos] = a
    return alpha


def _backward(emit, starts, lengths, active, trans):
    stay0, to1, to0, stay1 = trans
    beta = np.zeros(len(emit))
    for t in range(len(active) - 1, 0, -1):
        k = active[t]
        pos = starts[:k] + t
        x = emit[pos] + beta[pos]
        beta[pos - 1] = np.logaddexp(x + stay1, to0) - np.logaddexp(x + to1, stay0)
    return beta


def marginals(emit, lengths, trans) -> np.ndarray:
    """Log-odds of the toxic state per token; documents lie one after another,
    longest first (``lengths`` falls)."""
    if not len(emit):
        return emit
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
    return _forward(emit, starts, active, trans) + _backward(emit, starts, lengths, active, trans)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _evidence(logit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: largest token log-odds, log of 1 + expected toxic tokens."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.stack([np.clip(np.maximum.reduceat(logit, starts), -12, 12),
                     np.log1p(np.add.reduceat(_sigmoid(logit), starts))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton fit with a small ridge; the first weight is the intercept."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return w


def marking(toxic: dict[str, int], clean: dict[str, int], n1: int, n0: int) -> set[str]:
    """Features that mark toxic tokens, from document counts in n1 toxic and
    n0 clean documents."""
    if not toxic or not n1 or not n0:
        return set()
    least = np.log(len(toxic)) + 1.0
    out = set()
    for f, n in toxic.items():
        c = clean.get(f, 0)
        ratio = n * np.log(n * (n1 + n0) / ((n + c) * n1)) + (c * np.log(c * (n1 + n0) / ((n + c) * n0)) if c else 0.0)
        if n / n1 >= LIFT * (c + 0.5) / n0 and ratio >= least:
            out.add(f)
    return out


def train(texts: list[str], labels: list[int], marks: set[str]) -> dict:
    """Fit the field and the document fit to labelled texts."""
    docs = [WORD.findall(fold(t)) for t in texts]
    y = np.array(labels)
    prior = float(y.mean()) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return {"weights": {}, "bias": -6.0, "trans": (0.0, 0.0, 0.0, 0.0), "doc": None, "prior": prior}
    held = Counter(f for words in docs for f in {f for w in set(words) for f in features(w)})
    # the tokens, longest document first
    order = sorted((i for i in range(len(docs)) if docs[i]), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    vocab: dict[str, int] = {}
    ids = np.array([vocab.setdefault(w, len(vocab)) for i in order for w in docs[i]], np.int64)
    words = list(vocab)
    marked = np.array([any(f in marks for f in features(w)) for w in words])
    token_y = (marked[ids] & np.repeat(y[order] == 1, lengths)).astype(float)
    # features that several documents share
    index: dict[str, int] = {}
    rows, cols = [], []
    for i, w in enumerate(words):
        for f in features(w):
            if f in marks or held[f] >= 20:
                rows.append(i)
                cols.append(index.setdefault(f, len(index)))
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    before = np.flatnonzero(inner) - 1
    pair_y = (token_y[before], token_y[before + 1])
    weight, bias, trans = np.zeros(len(index)), -4.0, np.zeros(4)
    square = np.full(len(index) + 5, 1e-8)
    n_tok = max(1.0, token_y.sum())
    for _ in range(STEPS):
        per_word = bias + np.bincount(rows, weight[cols], len(words))
        emit = per_word[ids]
        active = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        alpha = _forward(emit, starts, active, trans)
        beta = _backward(emit, starts, lengths, active, trans)
        rest = token_y - _sigmoid(alpha + beta)
        grad = np.bincount(cols, np.bincount(ids, rest, len(words))[rows], len(index)) - 0.02 * weight
        # expected transitions: joint of neighbouring states
        a, b = alpha[before], (emit + beta)[before + 1]
        joint = np.stack([np.zeros(len(a)) + trans[0], b + trans[1], a + trans[2], a + b + trans[3]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        p, q = pair_y
        grad_t = np.array([((1 - p) * (1 - q)).sum(), ((1 - p) * q).sum(), (p * (1 - q)).sum(), (p * q).sum()]) - joint.sum(axis=1)
        full = np.concatenate([grad, [rest.sum()], grad_t]) / n_tok
        square += full ** 2
        step = 0.5 * full / np.sqrt(square)
        weight, bias, trans = weight + step[:-5], bias + step[-5], np.clip(trans + step[-4:], -4, 4)
    logit = marginals((bias + np.bincount(rows, weight[cols], len(words)))[ids], lengths, trans)
    seen = _evidence(logit, lengths)
    x = np.tile([-12.0, 0.0], (len(docs), 1))
    x[order] = seen
    kept = {f: float(weight[i]) for f, i in index.items() if abs(weight[i]) > 1e-4}
    return {"weights": kept, "bias": float(bias), "trans": tuple(float(t) for t in trans),
            "doc": _logistic(x, y).tolist(), "prior": prior}


def _score(model):
    def run(batches):
        m = model.value
        weights, bias, trans, doc = m["weights"], m["bias"], m["trans"], m["doc"]
        cache: dict[str, float] = {}

        def emission(word):
            e = cache.get(word)
            if e is None:
                e = bias + sum(weights.get(f, 0.0) for f in features(word))
                if len(cache) < CACHE:
                    cache[word] = e
            return e

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            emits = [np.fromiter(map(emission, WORD.findall(fold(t))), float) for t in texts]
            lengths = np.array([len(e) for e in emits], np.int64)
            order = np.argsort(-lengths, kind="stable")
            live = order[:int((lengths > 0).sum())]
            x = np.tile([-12.0, 0.0], (len(texts), 1))
            spans = [""] * len(texts)
            if len(live):
                size = lengths[live]
                logit = marginals(np.concatenate([emits[i] for i in live]), size, trans)
                x[live] = _evidence(logit, size)
                starts = np.concatenate([[0], np.cumsum(size)[:-1]])
                hot = np.flatnonzero(logit > 0)
                owner = np.searchsorted(starts, hot, side="right") - 1
                for o in np.unique(owner):
                    i = live[o]
                    where = [mt.span() for mt in WORD.finditer(fold(texts[i]))]
                    spans[i] = ",".join(f"{where[k][0]}:{where[k][1]}" for k in hot[owner == o] - starts[o])
            score = _sigmoid(doc[0] + x @ np.array(doc[1:])) if doc else np.full(len(texts), m["prior"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(spans, pa.string())],
                                             ["doc_id", "score", "spans"])
    return run


def score(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, spans (start:end code points of toxic tokens)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score(shared), "doc_id long, score double, spans string")


def _signature(batches):
    """The rows with a signature that copies and most near copies share: the
    smallest hash of three words in a row."""
    for batch in batches:
        sign = []
        for text in batch.column("text").to_pylist():
            words = WORD.findall(fold(text))
            sign.append(min((zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sign, pa.int64())], [*batch.schema.names, "sign"])


def _document_counts(only):
    """(feature, n): documents that hold each feature (``only``: those asked for)."""
    def run(batches):
        for batch in batches:
            found = Counter()
            for text in batch.column("text").to_pylist():
                held = {f for w in set(WORD.findall(fold(text))) for f in features(w)}
                found.update(held if only is None else held & only.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                             ["feature", "n"])
    return run


def fit(documents: DataFrame, labels: DataFrame) -> dict:
    """Model from documents whose crc32 remainder of 5 is not 0 and that have a
    label; a bounded number of rows of each label, chosen by a hash of the id."""
    spark = documents.sparkSession
    known = (labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("toxic is not null and label_id is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
             .where(id_remainder("label_id", 5) != 0))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return train([], [], set()) | ({"prior": float(next(iter(counts)) > 0)} if counts else {})
    share = F.pmod(F.xxhash64("label_id"), F.lit(1_000_003))
    want = F.lit(False)
    for value, n in counts.items():
        rows = TOXIC_ROWS if value else CLEAN_ROWS
        want = want | ((F.col("toxic") == value) & (share < int(min(1.0, rows / n) * 1_000_003) + 1))
    # the sampled ids are few by construction; the limit is the proof
    ids = F.broadcast(known.where(want).limit(2 * (TOXIC_ROWS + CLEAN_ROWS)))
    sample = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .join(ids, F.col("doc_id") == F.col("label_id")).where("text is not null")
              .select("doc_id", "text", "toxic")
              .mapInArrow(_signature, "doc_id long, text string, toxic int, sign long"))
    sample = cut(sample.groupBy("sign", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("one"))
                 .select("one.doc_id", "one.text", "toxic"))
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sum(n for t, n in sizes.items() if t), sizes.get(0, 0)
    per = lambda rows, only: (rows.select("text").mapInArrow(_document_counts(only), "feature string, n long")
                              .groupBy("feature").agg(F.sum("n").alias("n")))
    toxic = {r.feature: r.n for r in per(sample.where("toxic <> 0"), None).where(F.col("n") >= MIN_DOCS)
             .collect()}   # of the sample
    tried = spark.sparkContext.broadcast(frozenset(toxic))
    clean = {r.feature: r.n for r in per(sample.where("toxic = 0"), tried).collect()}
    marks = marking(toxic, clean, n1, n0)
    picked = [r for t in ("toxic <> 0", "toxic = 0")
              for r in sample.where(t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIELD_ROWS).collect()]
    return train([r.text for r in picked], [1 if r.toxic else 0 for r in picked], marks)


def predict(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every document."""
    out = score(documents, fit(documents, labels))
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
