"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, character n-grams
score the word under each candidate, and Viterbi decoding with a switching
penalty turns the scores of a document's words into language spans.

Learning: n-gram counts per language over a bounded sample of labelled rows
(``SAMPLE_ROWS``, chosen by a hash of the row; equal rows count once).  Prediction reads the text alone, every word of it.

Defined results: null text, or text without a letter, gives ``und``, score 0
and no spans; words of scripts that no language was seen in keep every
language as candidate; ties go to the language that sorts first; with no
labelled row every text is ``und``.  Extra columns are passed over.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import cut, frugal, hash_share, id_remainder, release_stores, slices

SAMPLE_ROWS = 12_000     # labelled rows that fit the model, at most about
SWITCH = 12.0            # penalty, in nats, for a change of language
FLOOR = 0.02             # share of a language's words a script needs to count
CACHE = 250_000          # words whose scores a worker remembers
DECODE_WORDS = 1_000_000  # words decoded together

# First and last code point of the scripts told apart.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    point = ord(word[0])
    return next((name for name, first, last in SCRIPTS if first <= point <= last), "other")


def grams(word: str) -> list[str]:
    """Character n-grams of one to three letters with word ends marked."""
    w = f"^{word}$"
    return [*word, *(w[i:i + 2] for i in range(len(w) - 1)), *(w[i:i + 3] for i in range(len(w) - 2))]


def _count(batches):
    """(lang, kind, gram, n): n-gram and script counts of a batch."""
    for batch in batches:
        per: dict[str, Counter] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            per.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
        rows = []
        for lang, words in per.items():
            gram, script = Counter(), Counter()
            for word, n in words.items():
                script[script_of(word)] += n
                for g in grams(word):
                    gram[g] += n
            rows += [(lang, "s", k, n) for k, n in script.items()] + [(lang, "g", k, n) for k, n in gram.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))],
            ["lang", "kind", "gram", "n"])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from rows (text, lang).  Returns languages, n-grams, a row of
    log-probabilities each and the scripts of each language."""
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    sample = hash_share(rows, sample_rows, rows.select("lang").count(), "text", "lang").distinct()
    counts = cut(sample.mapInArrow(frugal(_count), "lang string, kind string, gram string, n long")
                 .groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")))
    scripts = counts.where("kind = 's'").orderBy(F.desc("n"), "lang", "gram").collect()
    kept = counts.where("kind = 'g'").orderBy(F.desc("n"), "gram", "lang").collect()   # of the sample
    langs = sorted({r.lang for r in scripts})
    at = {lang: i for i, lang in enumerate(langs)}
    table: dict[str, np.ndarray] = {}
    for r in kept:
        if r.lang in at:
            table.setdefault(r.gram, np.zeros(len(langs)))[at[r.lang]] = r.n
    total = np.maximum(1.0, sum(table.values(), np.zeros(len(langs))))
    size = len(table) + 1
    seen: dict[str, np.ndarray] = {}
    words = Counter()
    for r in scripts:
        words[r.lang] += r.n
    for r in scripts:
        if r.n >= FLOOR * words[r.lang]:
            seen.setdefault(r.gram, np.zeros(len(langs), bool))[at[r.lang]] = True
    # the last row scores n-grams that the sample does not hold
    counted = np.stack([*table.values(), np.zeros(len(langs))])
    logs = np.log((counted + 0.5) / (total + 0.5 * size)).astype(np.float32)
    return {"langs": langs, "grams": list(table), "logs": logs, "scripts": seen}


class WordScores(dict):
    """Numbers words (-1: no letter in it) and scores the new ones together:
    mean log-probability of a word's n-grams, weighed by its length; languages
    outside its script's candidates fall behind by a wide margin."""

    def __init__(self, model: dict):
        super().__init__()
        self.at = {g: i for i, g in enumerate(model["grams"])}
        self.table = model["logs"]
        n = len(model["langs"])
        self.allowed = {k: v for k, v in model["scripts"].items()}
        self.every = np.ones(n, bool)
        self.script: dict[str, np.ndarray] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.scores = np.zeros((0, self.table.shape[1]), np.float32)

    def __missing__(self, word: str) -> int:
        if word.isalpha() or any(c.isalpha() for c in word):
            n = len(self.scores) + len(self.new)
            self.new.append(word)
        else:
            n = -1
        self[word] = n
        return n

    def ids(self, text: str) -> np.ndarray:
        """Word numbers of a text; words without a letter are passed over."""
        words = WORD.findall(text.lower())
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        return out[out >= 0]

    def _candidates(self, word: str) -> np.ndarray:
        c = word[0]
        if c not in self.script:
            self.script[c] = self.allowed.get(script_of(word), self.every)
        return self.script[c]

    def matrix(self) -> np.ndarray:
        """Scores of all numbered words, a row each."""
        for first in range(0, len(self.new), 20_000):
            part = self.new[first:first + 20_000]
            rare, at = len(self.at), self.at
            found = [[at.get(g, rare) for g in grams(w)] for w in part]
            size = np.array([len(f) for f in found])
            flat = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
            out = np.add.reduceat(self.table[flat], np.concatenate([[0], np.cumsum(size)[:-1]]), axis=0)
            out *= (np.minimum([len(w) for w in part], 8) / size).astype(np.float32)[:, None]
            allowed = np.stack([self._candidates(w) for w in part])
            out = np.where(allowed, out, out.max(axis=1, keepdims=True) - 30)
            self.scores = np.concatenate([self.scores, out - out.max(axis=1, keepdims=True)])
        self.new = []
        return self.scores


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best state per word for many documents at once.  ``scores`` holds the
    words of all documents one after another; longest documents come first, so
    step t works on a prefix of them."""
    best = np.zeros(len(scores), np.int8 if scores.shape[1] < 128 else np.int16)
    if not len(scores):
        return best
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents longer than t
    value = scores[starts].astype(np.float64)
    stay = np.ones(scores.shape, bool)
    from_ = np.zeros(len(scores), best.dtype)
    ends = value.copy()
    for t in range(1, longest):
        k = active[t]
        pos, v = starts[:k] + t, value[:k]
        top = v.argmax(axis=1)
        high = v[np.arange(k), top][:, None] - penalty
        stay[pos], from_[pos] = v >= high, top
        value = np.maximum(v, high) + scores[pos]
        ends[:k] = value
    state = ends.argmax(axis=1).astype(best.dtype)
    best[starts + lengths - 1] = state
    for t in range(longest - 1, 0, -1):
        k = active[t]
        pos, s = starts[:k] + t, state[:k]
        state[:k] = np.where(stay[pos, s], s, from_[pos])
        best[pos - 1] = state[:k]
    return best


def _decode(words: WordScores, docs: list[np.ndarray], langs, penalty: float):
    """Prediction, score and spans of documents given as word numbers."""
    n_lang = len(langs) - 1
    lengths = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    live = order[:int((lengths > 0).sum())]
    pred, score, spans = np.full(len(docs), n_lang), np.zeros(len(docs)), [""] * len(docs)
    if len(live):
        size = lengths[live]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        best = viterbi(words.matrix()[np.concatenate([docs[i] for i in live])], starts, size, penalty)
        owner = np.repeat(np.arange(len(live)), size)
        share = np.bincount(owner * n_lang + best, minlength=len(live) * n_lang).reshape(-1, n_lang)
        pred[live] = share.argmax(axis=1)
        score[live] = share.max(axis=1) / size
        cuts = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])]))
        ends = np.append(cuts[1:], len(best))
        text: list[list[str]] = [[] for _ in live]
        for a, b in zip(cuts, ends, strict=True):
            o = owner[a]
            text[o].append(f"{langs[best[a]]}:{a - starts[o]}:{b - starts[o]}")
        for o, i in enumerate(live):
            spans[i] = ",".join(text[o])
    return langs[pred].tolist(), score.tolist(), spans


def _labeller(m: dict, penalty: float):
    """texts -> lists of languages, scores and spans, by the model ``m``."""
    langs, words = np.array([*m["langs"], "und"], object), WordScores(m) if m["langs"] else None

    def run(texts: list) -> tuple[list, list, list]:
        pred, score, spans, docs, held = [], [], [], [], 0

        def decode():
            for whole, part in zip((pred, score, spans), _decode(words, docs, langs, penalty), strict=True):
                whole.extend(part)
            docs.clear()
            if words is not None and len(words) > CACHE:
                words.reset()

        for text in texts:
            docs.append(words.ids(text) if text and words is not None else np.empty(0, np.int32))
            held += len(docs[-1])
            if held > DECODE_WORDS:
                decode()
                held = 0
        decode()
        return pred, score, spans
    return run


def _label(model, penalty: float):
    def run(batches):
        release_stores()
        labels = _labeller(model.value, penalty)
        for batch in slices(batches):
            pred, score, spans = labels(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())],
                ["doc_id", "lang_pred", "score", "spans"])
    return frugal(run)


def label(documents: DataFrame, model: dict, penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (language:first word:last word + 1)
    per document; score is the share of words in spans of lang_pred."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_label(shared, penalty), "doc_id long, lang_pred string, score double, spans string")


def predict(documents: DataFrame) -> DataFrame:
    """Fit on labelled rows with crc32 remainder 0, 1 or 3 of 4, label all.
    Rows with a null id teach nothing and count as not held out."""
    remainder = id_remainder("doc_id", 4)
    model = fit(documents.where(remainder != 2).select("text", "lang"))
    out = label(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
                      "lang_pred", "score", "spans")


def keep_known(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Documents whose language is known: those labelled ``und`` go.  Keeps the
    columns; the decision is the predicted language's, never the given one's."""
    train = documents if labelled is None else labelled
    model = fit(train.select("text", "lang"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        # whole rows pass through; only the verdict of the text counts
        release_stores()
        labels = _labeller(shared.value, SWITCH)
        for batch in slices(batches):
            pred, _, _ = labels(batch.column("text").cast(pa.string()).to_pylist())
            yield batch.filter(pa.array([x != "und" for x in pred], pa.bool_()))

    return documents.mapInArrow(frugal(run), documents.schema)
