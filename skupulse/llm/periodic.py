"""Periodic run detection by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), of max(``LEAST``, ``TIMES`` * q) words or more, that no
neighbouring word extends keeping the period.

Every word of a run occurs ``TIMES`` times in it.  So a word that occurs less
often in the current segment is in no run there and splits it; the parts are
counted anew until no segment changes, and parts shorter than ``LEAST`` go.  The
largest part takes over its parent's counts less those of the other parts, so
the splitting takes n log n steps whatever the text.

Surviving segments are scanned lag by lag, by classes of lags 2**j <= q <
2**(j+1): a run of such a period covers an anchor at a multiple of 2**j and two
periods after it.  Names of all stretches of 2**j words, by doubling, tell for
all anchors and lags of a class whether the two periods are equal; only lags
where they are, outside runs already found, are followed to the run's ends.

Each text is worked whole, on its own; nothing is shuffled.

Defined results: words are separated by the six ASCII white-space characters;
null, empty and short texts have no run and collapse to their words; equal rows
have equal results; a null doc_id keeps its row.  Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import SPACE, frugal, slices

LEAST = 24
TIMES = 3


def segments(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """The stretches (start, end) in which every word occurs ``times`` times or
    more, of ``least`` words or more; all runs lie inside one."""
    if len(words) < least:
        return []
    counts = Counter(words)
    if len(words) - sum(n for n in counts.values() if n < times) < least:
        return []
    places: dict = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    out = []
    todo = [(0, len(words), counts, [w for w, n in counts.items() if n < times])]
    while todo:
        low, high, counts, rare = todo.pop()
        if not rare:
            out.append((low, high))
            continue
        cuts = []
        for w in rare:
            own = places[w]
            k = bisect_left(own, low)
            while k < len(own) and own[k] < high:
                cuts.append(own[k])
                k += 1
        edges = [low - 1, *sorted(cuts), high]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
        largest = max(parts, key=lambda p: p[1] - p[0])
        if largest[1] - largest[0] < least:
            continue
        for part in parts:
            if part is not largest and part[1] - part[0] >= least:
                own = Counter(words[part[0]:part[1]])
                todo.append((*part, own, [w for w, n in own.items() if n < times]))
        # the largest part keeps the counts; all other words leave them
        rare = set()
        for w in words[low:largest[0]] + words[largest[1]:high]:
            left = counts[w] = counts[w] - 1
            if left < times:
                rare.add(w)
        todo.append((*largest, counts, [w for w in rare if counts[w]]))
    return sorted(out)


def _follow(words: np.ndarray, i: int, q: int, step: int) -> int:
    """How many places from i on, going by ``step`` (1 or -1), equal those q later."""
    n, reach = 0, 64
    limit = len(words) - q - i if step > 0 else i + 1
    while n < limit:
        size = min(reach, limit - n)
        if step > 0:
            same = words[i + n:i + n + size] == words[i + n + q:i + n + q + size]
        else:
            low = i - n - size + 1
            same = (words[low:low + size] == words[low + q:low + q + size])[::-1]
        stop = int(np.argmin(same))
        if not same[stop]:
            return n + stop
        n, reach = n + size, reach * 2
    return n


def scan(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by start and period."""
    n = len(words)
    names, width = words.astype(np.int64), 1
    covered: list[tuple[int, int, int]] = []     # runs found, with their period
    while times * width <= n:
        # names: one number per stretch of ``width`` words, equal if the words are
        anchors = np.arange(0, n - 2 * width + 1, width)
        lags = np.arange(width, min(2 * width, n // times + 1))
        here, lag = np.repeat(anchors, len(lags)), np.tile(lags, len(anchors))
        fits = here + 2 * lag <= n
        here, lag = here[fits], lag[fits]
        # words here .. here+lag-1 and the next lag words, by two overlapping names each
        square = (names[here] == names[here + lag]) & (names[here + lag - width] == names[here + 2 * lag - width])
        here, lag = here[square], lag[square]
        if len(here) and covered:
            starts = np.array([r[0] for r in covered])
            order = np.argsort(starts, kind="stable")
            starts, reach = starts[order], np.maximum.accumulate(np.array([r[0] + r[1] for r in covered])[order])
            k = np.searchsorted(starts, here, side="right") - 1
            # the run that reaches furthest of those that start before covers both
            # periods; its period divides the lag, which then gives the same run
            inside = (k >= 0) & (reach[np.maximum(k, 0)] >= here + 2 * lag)
            here, lag = here[~inside], lag[~inside]
        last: dict[int, int] = {}
        new = {}
        for a, q in zip(here.tolist(), lag.tolist(), strict=True):
            if a < last.get(q, -1):
                continue
            left, right = _follow(words, a - 1, q, -1) if a else 0, _follow(words, a, q, 1)
            last[q] = a + right
            start, length = a - left, left + right + q
            if length >= max(least, times * q):
                new[start, length] = min(q, new.get((start, length), q))
        # a stretch that is already a run has a smaller period
        known = {(s, m) for s, m, _ in covered}
        covered += [(s, m, q) for (s, m), q in new.items() if (s, m) not in known]
        if 2 * width * times > n:
            break
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        names = np.unique(pairs, return_inverse=True)[1]
        width *= 2
    return sorted(covered, key=lambda r: (r[0], r[2]))


def text_runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period."""
    out = []
    for low, high in segments(words, least, times):
        known: dict = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words[low:high]), np.int64, high - low)
        out += [(low + s, m, q) for s, m, q in scan(ids, least, times)]
    return out


RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(documents: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the words, by
    single spaces, without those that a run holds after its first period."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches):
            counts, runs, collapsed = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_numpy(zero_copy_only=False):
                words = text.split() if text else []     # bytes: the six ASCII characters
                own = text_runs(words, least, times)
                counts.append(len(words))
                runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                if own:
                    keep = np.ones(len(words), bool)
                    for s, m, q in own:
                        keep[s + q:s + m] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(_RUN)),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(frugal(run), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def best_run() -> Column:
    """The run of greatest length / period; ties: smallest start, then period."""
    def order(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1)
                .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort("runs", order), F.lit(0))


def digests(found: DataFrame) -> DataFrame:
    """The numbers of the greatest run, and checksums of all runs and of the
    collapsed text."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", best_run())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def repeat_some(documents: DataFrame) -> DataFrame:
    """doc_id and text, with words of every document whose h = crc32(doc_id as
    text) is divisible by 10 repeated: g = floor(h / 10), n words, from word
    a = g % n on every word is original word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)).  Texts without words stay."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(f"[^{SPACE}]")
    docs = docs.withColumn("g", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")).withColumn("chosen", chosen)
    docs = docs.withColumn("w", F.when(F.col("chosen"), F.array_remove(F.split("text", f"[{SPACE}]+"), "")))
    docs = docs.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("chosen"), F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return docs.select("doc_id", F.when(F.col("chosen"), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
