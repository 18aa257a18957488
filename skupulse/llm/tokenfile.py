"""Token ids in files: canonical length-limited Huffman codes.

``write`` tokenizes every document once (its ids, then an end id), counts all
ids of the corpus, derives canonical code lengths of at most ``MAX_BITS`` bits by
package-merge, and writes a folder of three Parquet tables:

* ``codes``: id, bits - code lengths; canonical codes follow from them alone
* ``blocks``: part, block, start (ids of the part before it), n_tokens, the
  doc_ids and lengths of its documents, their bits, and the bit offset of every
  ``STEP``-th id.  Blocks are independent, of about ``BLOCK_TOKENS`` ids, and
  hold whole documents in ascending doc_id order
* ``parts``: part, base (ids of all parts before it); one row per range of
  doc_ids, each of about ``PART_TOKENS`` ids, so the table stays a few millionths
  of the ids' size and may be broadcast

``read`` gives all documents back; ``read_range`` any stretch of ids, decoding
only from the bit offsets that it needs.  Decoding looks the next bits up in a
table of all prefixes, for all offsets of a block in step.

Documents are range-partitioned by (doc_id, hash of the ids, row place), so a
doc_id that many rows share is no single task.  The row place is frozen in the
staged table before anything depends on it.

Defined results: null or empty text is the end id alone; a null doc_id keeps its
row and comes first; rows of one doc_id follow each other by a hash of their ids,
equal rows in any order; an empty table gives files without blocks.  Extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skupulse.llm.common import frugal
from skupulse.llm.packing import END_ID, by_size, known_words, split_ids, tokenizer_path

MAX_BITS = 16            # code length; more only if there are over 2**16 ids
BLOCK_TOKENS = 65_536    # ids per block, about
STEP = 64                # ids per bit offset
PART_TOKENS = 32_000_000  # ids per range of documents, at most about
SLICE = 1 << 23          # bytes of text split together, about: the more, the fewer words are split and looked up again
WORDS = 400_000          # words whose ids a worker remembers


# ---- tokens

def _stage(path: str, end_id: int, width: str):
    def run(batches):
        known = known_words(path, WORDS)
        for batch in by_size(batches, SLICE):
            ids, n = split_ids(batch.column("text"), known, width)
            docs = batch.num_rows
            out = np.full(len(ids) + docs, end_id, width)
            ends = np.cumsum(n + 1)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            size = np.dtype(width).itemsize
            offsets = pa.array(np.concatenate([[0], ends * size]), pa.int64())
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs, [None, offsets.buffers()[1], pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n + 1), column.cast(pa.binary())],
                                             ["doc_id", "n_tokens", "ids"])
    return run


def token_ids(documents: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, str]:
    """doc_id, n_tokens and ids of every document, and the ids' numpy type."""
    from tokenizers import Tokenizer
    path = path or tokenizer_path()
    top = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    width = "<u2" if top <= 1 << 16 else "<u4"
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(frugal(_stage(path, end_id, width)), "doc_id long, n_tokens long, ids binary"), width


# ---- codes

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths, at most ``max_bits``, of an optimal prefix code: package-merge.
    Each level merges the symbols with the pairs of the level before; the first
    2n - 2 items of the last level are taken, and of each level before it the
    pairs that those hold.  A symbol's length is the number of levels that take it."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    max_bits = max(max_bits, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    weights = np.asarray(counts, np.float64)[order]   # exact below 2**53
    levels, pairs = [], np.empty(0)
    for _ in range(max_bits):
        items = np.concatenate([weights, pairs])
        place = np.argsort(items, kind="stable")
        levels.append(place < n)
        items = items[place]
        items = items[:len(items) // 2 * 2]
        pairs = items[::2] + items[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for symbols in reversed(levels):
        own = int(symbols[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Codes:
    """Canonical codes of ids, from their lengths alone."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        ids, bits = np.asarray(ids, np.int64)[order], np.asarray(bits, np.int64)[order]
        self.longest = int(bits[-1]) if len(bits) else 1
        if self.longest > 24:
            raise ValueError("codes are longer than 24 bits")
        room = np.int64(1) << (self.longest - bits)        # prefixes of each code
        top = int(ids.max()) + 1 if len(ids) else 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[ids] = (np.cumsum(room) - room) >> (self.longest - bits)
        self.bits[ids] = bits
        self.table_id = np.zeros(1 << self.longest, np.uint32)
        self.table_bits = np.ones(1 << self.longest, np.int64)
        used = int(room.sum())
        self.table_id[:used] = np.repeat(ids, room)
        self.table_bits[:used] = np.repeat(bits, room)

    def encode(self, ids: np.ndarray, step: int = STEP) -> tuple[bytes, np.ndarray]:
        """The ids' bits, and the bit offset of every ``step``-th id."""
        bits = self.bits[ids]
        ends = np.cumsum(bits)
        at = ends - bits
        word = at >> 5
        # each code in a 64-bit window that starts at its 32-bit word
        placed = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        edges = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        windows, word = np.bitwise_or.reduceat(placed, edges), word[edges]
        out = np.zeros(int(ends[-1]) // 32 + 2, np.uint32)
        out[word] |= (windows >> np.uint64(32)).astype(np.uint32)
        out[word + 1] |= (windows & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out.astype(">u4").tobytes()[:(int(ends[-1]) + 7) // 8], at[::step]

    def decode(self, bits: bytes, offsets: np.ndarray, n: int, first: int = 0, last: int | None = None,
               step: int = STEP) -> np.ndarray:
        """Ids first .. last - 1 of a block of n ids, from the bit offsets at or
        before them; the codes at all offsets are read in step."""
        last = n if last is None else min(last, n)
        if last <= first:
            return np.empty(0, np.uint32)
        low, high = first // step, -(-last // step)
        at = np.asarray(offsets[low:high], np.int64).copy()
        begin = int(at[0]) >> 3
        stop = int(offsets[high]) // 8 + 1 if high < len(offsets) else len(bits)
        # the last offset's steps may run on into zeros
        raw = np.frombuffer(bits[begin:stop] + bytes(step * self.longest // 8 + 8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at -= 8 * begin
        shift, mask = 32 - self.longest, (1 << self.longest) - 1
        out = np.empty((step, len(at)), np.uint32)
        for k in range(step):
            prefix = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & np.uint32(mask)
            out[k] = self.table_id[prefix]
            at += self.table_bits[prefix]
        return out.T.ravel()[first - low * step:last - low * step]


def count_ids(staged: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs: at most one row per id of the vocabulary."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            # the cells lie in a row: counted in stretches, not a vocabulary's counters per document
            column = batch.column("ids").cast(pa.large_binary())
            if not len(column):
                continue
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            ids = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]].view(width)
            for first in range(0, len(ids), 1 << 20):
                own = np.bincount(ids[first:first + (1 << 20)], minlength=len(total))
                own[:len(total)] += total
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


# ---- files

BLOCK = ("part int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, "
         "bits binary, offsets array<long>")


def _blocks(shared, width: str, block_tokens: int):
    def run(batches):
        codes = Codes(*shared.value)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                            ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("bits", pa.binary()),
                            ("offsets", pa.list_(pa.int64()))])
        docs, lengths, ids, held = [], [], [], 0

        def row():
            bits, offsets = codes.encode(np.frombuffer(b"".join(ids), width))
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "start": start, "n_tokens": held, "doc_ids": docs,
                                                "lengths": lengths, "bits": bits, "offsets": offsets}], schema)

        for batch in batches:
            for doc, n, own in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(),
                                   batch.column("ids"), strict=True):
                docs.append(doc)
                lengths.append(n)
                ids.append(own.as_py())
                held += n
                if held >= block_tokens:
                    yield row()
                    block, start = block + 1, start + held
                    docs, lengths, ids, held = [], [], [], 0
        if docs:
            yield row()
    return run


def write(documents: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, max_bits: int = MAX_BITS,
          block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all documents, in ascending doc_id order, to a new folder
    that the driver and all executors share."""
    spark = documents.sparkSession
    staged, width = token_ids(documents, path, end_id)
    (staged.withColumn("hash", F.xxhash64("ids")).withColumn("place", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(f"{folder}/staged"))
    staged = spark.read.parquet(f"{folder}/staged")
    counts = count_ids(staged, width)
    ids = np.array(sorted(counts), np.int64)
    numbers = np.array([counts[i] for i in ids.tolist()], np.int64)
    bits = code_lengths(numbers, max_bits)
    spark.createDataFrame(list(zip(ids.tolist(), bits.tolist(), strict=True)), "id long, bits long").coalesce(1).write.parquet(f"{folder}/codes")
    total = int(numbers.sum())
    parts = max(1, -(-total // PART_TOKENS), min(2 * spark.sparkContext.defaultParallelism, total // (4 * block_tokens)))
    shared = spark.sparkContext.broadcast((ids, bits))  # one entry per id of the vocabulary
    order = ["doc_id", "hash", "place"]
    blocks = (staged.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
              .mapInArrow(_blocks(shared, width, block_tokens), BLOCK))
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    sums = spark.read.schema(BLOCK).parquet(f"{folder}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    (sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).coalesce(1)
     .write.parquet(f"{folder}/parts"))


def _placed_blocks(spark: SparkSession, folder: str):
    """The blocks with their first id's number in the corpus, and the code table."""
    codes = spark.read.schema("id long, bits long").parquet(f"{folder}/codes").orderBy("id").collect()  # the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r.id for r in codes], np.int64), np.array([r.bits for r in codes], np.int64)))
    parts = spark.read.schema("part int, base long").parquet(f"{folder}/parts")
    blocks = (spark.read.schema(BLOCK).parquet(f"{folder}/blocks").join(F.broadcast(parts), "part")
              .withColumn("start", F.col("start") + F.col("base")))
    return blocks.select("start", "n_tokens", "doc_ids", "lengths", "bits", "offsets"), shared


def _numbers(column) -> np.ndarray:
    """A list cell as numbers."""
    return column.values.to_numpy()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary,
    little-endian unsigned 32-bit) of every document in the files."""
    blocks, shared = _placed_blocks(spark, folder)

    def run(batches):
        codes = Codes(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                n, lengths = batch.column("n_tokens")[i].as_py(), _numbers(batch.column("lengths")[i])
                ids = codes.decode(batch.column("bits")[i].as_py(), _numbers(batch.column("offsets")[i]), n).astype("<u4")
                ends = np.cumsum(lengths)
                edges = pa.array(np.concatenate([[0], 4 * ends]), pa.int64())
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, edges.buffers()[1], pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(batch.column("start")[i].as_py() + ends - lengths),
                     pa.array(lengths), column.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """start and ids (binary) of the stretches that make up ids first .. last - 1
    of the corpus; other blocks are not decoded, nor are the parts of these before
    the nearest bit offset."""
    blocks, shared = _placed_blocks(spark, folder)
    blocks = blocks.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))

    def run(batches):
        codes = Codes(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                start, n = batch.column("start")[i].as_py(), batch.column("n_tokens")[i].as_py()
                low, high = max(first - start, 0), min(last - start, n)
                ids = codes.decode(batch.column("bits")[i].as_py(), _numbers(batch.column("offsets")[i]), n, low, high)
                yield pa.RecordBatch.from_arrays([pa.array([start + low]), pa.array([ids.astype("<u4").tobytes()], pa.binary())],
                                                 ["start", "ids"])

    return blocks.select("start", "n_tokens", "bits", "offsets").mapInArrow(run, "start long, ids binary")
