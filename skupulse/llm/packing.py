"""Packing token streams into fixed windows by best-fit decreasing.

Every document is tokenized once (its ids, then an end id) and overlong ones
are first cut into full windows; only (document, start, length, checksum) rows
go on.  Best fit depends on lengths alone, so it runs over the histogram of
piece lengths, at most ``WINDOW`` counts whatever the corpus: a segment tree
over the remaining capacities finds the tightest open window, and equal
windows are kept together as one range of numbers.  The result is a list of
runs "the next k pieces of length L go to windows b .. b+k-1 at offset o",
whose number depends on the window alone.  Pieces find their run by their rank
among pieces of equal length; ranks are counted in salted groups, so that a
length that holds a third of all pieces is no single task.

Sequences are padded to the window, except those whose fill is a power of two.

Defined results: null or empty text is the end id alone (one piece, length
1); rows with equal content and id are packed like any others; a null doc_id
keeps its row.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skupulse.llm.common import STORE, cut, frugal, release_stores

WINDOW = 4096
END_ID = 2
WORDS = 150_000          # words whose ids a worker remembers
GROUP_ROWS = 2_000       # pieces per salted rank group, about
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


# Chunks of these characters are their own NFC form, fold letter by letter and
# split like this; any other chunk goes to the tokenizer as it is.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


class _Words(dict):
    """Ids, as little-endian bytes, of words and other text without white space."""

    def __init__(self, path: str, most: int = WORDS):
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        # how the tokenizer hands the bytes of a letter to its model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(256) if LETTERS.fullmatch(chr(k))}

    def __missing__(self, word: str) -> bytes:
        if LETTERS.fullmatch(word):
            # its own normal form and one part: only the model has work to do
            ids = [t.id for t in self.model.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self.most:
            self[word] = ids
        return ids


def known_words(path: str, most: int = WORDS) -> _Words:
    """The worker process's own store, which outlives a task: functions that
    travel by value get fresh globals each time, the interpreter's stay."""
    stores = vars(sys).setdefault(STORE + "words", {})
    if (path, most) not in stores:
        release_stores()
        stores = vars(sys).setdefault(STORE + "words", {})
        stores[path, most] = _Words(path, most)
    return stores[path, most]


def _take(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` (their sizes given) at the places ``at``, in a
    row, and the size of each."""
    count = sizes[at]
    ends = np.cumsum(count)
    shift = (np.cumsum(sizes) - sizes)[at] - (ends - count)
    return flat[np.repeat(shift, count) + np.arange(ends[-1] if len(ends) else 0)], count


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All elements in a row, and the bounds of each list among them."""
    offsets = column.offsets.to_numpy()
    return column.flatten(), offsets - offsets[0]


def _sums(count: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(count)])[bounds])


def split_ids(texts: pa.Array, known, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the number of each text's ids.

    The tokenizer drops white space and never joins across it, so texts split
    there.  A chunk of plain characters folds letter by letter and splits into
    words by its own pattern; any other goes to the tokenizer as it is.  Each
    distinct chunk is split once, and each distinct word looked up once."""
    chunks, edges = _lists(pc.ascii_split_whitespace(pc.fill_null(texts, "")))
    chunks = chunks.dictionary_encode()
    distinct = chunks.dictionary
    plain = pc.and_(pc.match_substring_regex(distinct, f"^(?:{PLAIN.pattern})$"), pc.invert(pc.match_substring(distinct, "<|")))
    split = pc.replace_substring_regex(pc.utf8_lower(distinct), f"({SPLIT.pattern})", "\\1 ")
    words, bounds = _lists(pc.ascii_split_whitespace(pc.if_else(plain, split, distinct)))
    words = words.dictionary_encode()
    parts = [known[w] for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
    flat = np.frombuffer(b"".join(parts), "<u4").astype(width)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat, count = _take(flat, sizes, words.indices.to_numpy())
    ids, count = _take(flat, _sums(count, bounds), chunks.indices.to_numpy())
    return ids, _sums(count, edges)


def by_size(batches, size: int = 1 << 20):
    """Parts of the batches whose texts take about ``size`` bytes."""
    for batch in batches:
        bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(bytes_)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(low, high - low)


def _pieces(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        known = known_words(path)
        for batch in by_size(batches):
            out: list[list] = [[], [], [], [], []]
            ids, counts = split_ids(batch.column("text"), known, "<u4")
            ends = np.cumsum(counts).tolist()
            for doc, first, last in zip(batch.column("doc_id").to_pylist(), [0, *ends], ends, strict=False):
                own = ids[first:last].tobytes() + end
                total = len(own) // 4
                for start in range(0, total, window):
                    part = own[4 * start:4 * (start + window)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
            del ids
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


class _Capacities:
    """Segment tree over remaining capacities: which have an open window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = np.zeros(2 * self.size, bool)

    def put(self, capacity: int, open_: bool) -> None:
        i = self.size + capacity
        self.tree[i] = open_
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest capacity >= least with an open window."""
        i = self.size + least
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_runs(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first window, offset) runs that pack all
    pieces best-fit decreasing.  Best fit puts a piece into the tightest open
    window, which then is the tightest for the next piece of the same length
    until it can take no more; so windows of one capacity fill alike."""
    open_: dict[int, list[list[int]]] = {}
    tree, runs, windows = _Capacities(window), [], 0

    def store(capacity: int, first: int, count: int) -> None:
        if capacity and count:
            if not open_.get(capacity):
                open_[capacity] = []
                tree.put(capacity, True)
            open_[capacity].append([first, count])

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, fits = window, window // length
                first, count = windows, -(-left // fits)
                windows += count
            else:
                fits = capacity // length
                first, count = open_[capacity].pop()
                use = min(count, -(-left // fits))
                if use < count:
                    open_[capacity].append([first + use, count - use])
                elif not open_[capacity]:
                    tree.put(capacity, False)
                count = use
            full, rest = divmod(min(left, count * fits), fits)
            for k in range(fits):
                n = full + (k < rest)
                if n:
                    runs.append((length, rank, n, first, window - capacity + k * length))
                    rank += n
                    left -= n
            store(capacity - fits * length, first, full)
            if rest:
                store(capacity - rest * length, first + full, 1)
    return runs


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and
    padded_to for each piece."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(frugal(_pieces(path or tokenizer_path(), window, end_id)),
                                 "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"))
    # at most ``window`` rows
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = best_fit_runs(histogram, window)
    salts = max(1, sum(histogram.values()) // GROUP_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("length").alias("g_length"), F.col("salt").alias("g_salt"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (salted.withColumn("place", F.row_number().over(inside) - 1)
              .join(groups, (F.col("length") == F.col("g_length")) & (F.col("salt") == F.col("g_salt")))
              .withColumn("rank", F.col("base") + F.col("place"))
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"))
    if not runs:
        return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.lit(0).cast("long").alias("sequence_id"),
                             F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("padded_to")).limit(0)
    by_length: dict[int, np.ndarray] = {}
    for length in histogram:
        by_length[length] = np.array([r[1:] for r in runs if r[0] == length], np.int64) if len(histogram) < 8 else None
    if len(histogram) >= 8:
        table = np.array(runs, np.int64)
        edges = np.flatnonzero(np.concatenate([[True], table[1:, 0] != table[:-1, 0]]))
        for part in np.split(table, edges[1:]):
            by_length[int(part[0, 0])] = part[:, 1:]
    shared = spark.sparkContext.broadcast((by_length, _fills(runs)))

    def place(batches):
        table, (firsts, fills) = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = table[int(n)]
                k = np.searchsorted(own[:, 0], rank[at], side="right") - 1
                sequence[at] = own[k, 2] + rank[at] - own[k, 0]
                offset[at] = own[k, 3]
            fill = fills[np.searchsorted(firsts, sequence, side="right") - 1]
            padded = np.where(fill & (fill - 1), window, fill)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")),
                 pa.array(sequence), pa.array(offset), pa.array(padded)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_to"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                    "sequence_id long, offset long, padded_to long")


def _fills(runs) -> tuple[np.ndarray, np.ndarray]:
    """(first window, tokens in it and its followers) ranges, from the runs."""
    change: dict[int, int] = {}
    for length, _, n, first, _ in runs:
        change[first] = change.get(first, 0) + length
        change[first + n] = change.get(first + n, 0) - length
    firsts = np.array(sorted(change), np.int64)
    return firsts, np.cumsum([change[int(f)] for f in firsts])
