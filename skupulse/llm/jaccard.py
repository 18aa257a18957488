"""N-gram Jaccard join in a metric space: pivots, regions, windows, recursion.

Points are the distinct word-shingle sets of the documents, the metric is the
Jaccard distance, the radius r = 1 - threshold.

* Pivots of the first level are the single shingles, ranked rarest first.  The
  nearest pivot of a set is its first-ranked member, so the pivots cut the
  corpus into Voronoi regions.  (Whole documents make useless first pivots:
  nearly all pairs of documents lie at distance 1.)
* Windows: a partner within r lacks at most floor(r * size) of a set's
  shingles.  Taking so many away can move the nearest pivot no further than
  the next floor(r * size) ranks, hence a set is replicated as a boundary
  document to its first floor(r * size) + 1 pivots, and two linked sets always
  meet in the region of their first common shingle.
* Inside a region the pivots are documents (hubs).  Two tests are exact
  consequences of the triangle inequality and need no shingles: sizes (the
  distance to the empty set) and the counts of shingles in ``CELLS`` hashed
  subspaces, whose differences sum to at most the symmetric difference (counts
  stop at 127, which can only bring two sets closer).
* Recursion: regions of at most ``SMALL`` members test their few pairs at once.
  In larger ones, after a hub has met its region, members already connected
  need not meet any more; regions that still hold several components get
  another hub, and what is left after ``HUB_ROUNDS`` is compared block by
  block, exactly.

Equal sets fall into one class first (a digest of the whole set), so groups of
exact copies cost one row each.  Work is spread by shingle, id or block; no
group is collected whole, and no pair of a region is emitted that its windows
exclude.  Bounded driver state: two counter tables of ``2**COUNTER_BITS``.

Defined results: null or wordless text has no shingles, size 0 and links with
nothing (component_id = doc_id); with fewer than ``n`` words the whole sequence
is one shingle; repeated rows are one document; rows with a null doc_id keep
their row, get the component of their class (null if no row of it has an id)
and link nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import cut, frugal, release_stores, slices, tidy

COUNTER_BITS = 20     # counters per table that rank shingles (two tables)
CELLS = 256           # hashed subspaces of the count windows
HUB_ROUNDS = 2        # rounds of hubs per large region before the blocks
HUBS = 4              # hubs per open region in a later round
SMALL = 8             # regions of so few members test all their pairs at once
BROADCAST_REGIONS = 200_000
BLOCK = 512           # members per block in the last, exhaustive step
MEMBER_BITS = 24      # bits of the filter that says whose sets are needed

_K = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashed shingle sets of UTF-8 texts, without a Python step per word.

    A word's hash is a polynomial over a random value per byte, taken from
    running sums; A-Z share the values of a-z, other bytes stay apart."""

    def __init__(self, n: int):
        self.n = n
        byte = np.arange(256, dtype=np.uint64)
        self.space = np.isin(byte, [9, 10, 11, 12, 13, 32])
        with np.errstate(over="ignore"):
            self.value = _mix((byte + np.uint64(1)) * _K)
        self.value[65:91] = self.value[97:123]
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, size: int) -> None:
        if size > len(self.powers):
            size = max(size, 2 * len(self.powers))
            base, back = int(_K), pow(int(_K), -1, 1 << 64)
            for name, k in (("powers", base), ("inverse", back)):
                steps = np.full(size, k, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, text: bytes) -> np.ndarray:
        """Hash of each word, in order."""
        raw = np.frombuffer(text, np.uint8)
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = self.space[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._reach(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.value[raw] * self.powers[:len(raw)], out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of the n-word shingles."""
        h = self.words(text) if text else np.empty(0, np.uint64)
        if not len(h):
            return h
        if len(h) < self.n:
            out = np.array([len(h)], np.uint64)
            for x in h:
                out = out * _K + x
        else:
            last = len(h) - self.n + 1
            out = np.zeros(last, np.uint64)
            for i in range(self.n):
                out = out * _K + h[i:i + last]
        out = _mix(out)
        out.sort()
        new = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=new[1:])
        return out[new]


def _step(df: DataFrame) -> DataFrame:
    """``cut``, after which the driver lets go of what the step has left: each of
    its stages leaves some megabytes on the heap (a broadcast is built in blocks
    of 4 MB), which otherwise grows with the number of stages, not with what is
    held, until it has its full size."""
    out = cut(df)
    tidy(df.sparkSession)
    return out


def _digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _describe(n: int):
    """doc_id, size and digest of each document, and one row per partition with
    its shingle counters (size null)."""
    def run(batches):
        release_stores()
        shingles, size = Shingler(n), 1 << COUNTER_BITS
        tables = np.zeros((2, size), np.int64)
        for batch in slices(batches):
            sizes, digests, parts = [], [], []
            for text in _texts(batch):
                members = shingles(text)
                sizes.append(len(members))
                digests.append(_digest(members))
                parts.append(members)
            every = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            for k, shift in enumerate((0, 32)):
                at = (every >> np.uint64(shift)) & np.uint64(size - 1)
                tables[k] += np.bincount(at.astype(np.int64), minlength=size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                ["doc_id", "size", "digest"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.int64()),
             pa.array([zlib.compress(tables.tobytes(), 1)], pa.binary())], ["doc_id", "size", "digest"])
    return run


def _merge_tables(described: DataFrame) -> np.ndarray:
    """Sum the partitions' counter tables on the executors, pair by pair."""
    packed = described.where("size is null").select("digest").rdd.map(lambda r: bytes(r[0]))

    def add(a: bytes, b: bytes) -> bytes:
        both = np.frombuffer(zlib.decompress(a), np.int64) + np.frombuffer(zlib.decompress(b), np.int64)
        return zlib.compress(both.tobytes(), 1)

    zero = zlib.compress(np.zeros(2 << COUNTER_BITS, np.int64).tobytes(), 1)
    packed = packed.coalesce(max(1, min(packed.getNumPartitions(), 512)))
    out = packed.treeReduce(add, 3) if not packed.isEmpty() else zero
    return np.frombuffer(zlib.decompress(out), np.int64).reshape(2, -1)


def _windows(n: int, slack: Fraction, counters):
    """The pivots to which each document is dealt, and its subspace counts."""
    def run(batches):
        release_stores()
        shingles, size = Shingler(n), np.uint64((1 << COUNTER_BITS) - 1)
        for batch in slices(batches):
            digests, sizes, pivots, offsets, cells = [], [], [], [0], []
            for text in _texts(batch):
                members = shingles(text)
                digests.append(_digest(members))
                sizes.append(len(members))
                seen = np.minimum(counters.value[0][(members & size).astype(np.int64)],
                                  counters.value[1][((members >> np.uint64(32)) & size).astype(np.int64)])
                reach = int(slack * len(members)) + 1 if len(members) else 0
                pivots.append(members[np.lexsort((members, seen))[:reach]].view(np.int64))
                offsets.append(offsets[-1] + reach)
                at = (members >> np.uint64(56)).astype(np.int64)
                cells.append(np.minimum(np.bincount(at, minlength=CELLS), 127).astype(np.int8))
            flat = np.concatenate(pivots) if pivots else np.empty(0, np.int64)
            counts = np.concatenate(cells) if cells else np.empty(0, np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * CELLS, pa.int32()), pa.array(counts))],
                ["doc_id", "digest", "size", "pivots", "cells"])
    return run


def _bit(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(ids.astype(np.int64).view(np.uint64) + _K) >> np.uint64(64 - MEMBER_BITS)).astype(np.int64)


def _member_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the ids whose sets are needed: a filter of fixed size that may
    let others through but never drops one."""
    def run(batches):
        bits = np.zeros(1 << MEMBER_BITS, bool)
        for batch in batches:
            bits[_bit(batch.column(0).to_numpy(zero_copy_only=False))] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], ["bits"])

    def either(a: bytes, b: bytes) -> bytes:
        return zlib.compress((np.frombuffer(zlib.decompress(a), np.uint8) | np.frombuffer(zlib.decompress(b), np.uint8)).tobytes(), 1)

    packed = _step(ids.mapInArrow(frugal(run), "bits binary")).rdd.map(lambda r: bytes(r[0]))
    packed = packed.coalesce(max(1, min(packed.getNumPartitions(), 64)))
    return np.frombuffer(zlib.decompress(packed.treeReduce(either, 2)), np.uint8)


def _sets(n: int, wanted):
    """Shingle sets of the documents that the filter lets through."""
    def run(batches):
        release_stores()
        shingles = Shingler(n)
        for batch in slices(batches, 1024):
            batch = batch.filter(batch.column("doc_id").is_valid())
            ids = batch.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
            at = _bit(ids)
            hit = np.flatnonzero(wanted.value[at >> 3] & (128 >> (at & 7)))
            if not len(hit):
                continue
            part = batch.take(pa.array(hit))
            sets = [shingles(t) for t in _texts(part)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))],
                ["doc_id", "digest", "members"])
    return run


def _confirm(num: int, den: int):
    """Exact test of pairs that carry both sets."""
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            va, vb = (x.values.to_numpy(zero_copy_only=False) for x in (a, b))
            oa, ob = (x.offsets.to_numpy() for x in (a, b))
            good = []
            for i in range(batch.num_rows):
                x, y = va[oa[i]:oa[i + 1]], vb[ob[i]:ob[i + 1]]
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def _near(num: int, den: int):
    """The two windows as a condition on columns of a and b."""
    apart = F.aggregate(F.zip_with("cells_a", "cells_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda s, x: s + x)
    total = F.col("size_a") + F.col("size_b")
    return ((den * F.least("size_a", "size_b") >= num * F.greatest("size_a", "size_b"))
            & ((den + num) * apart <= (den - num) * total))


def _within(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs (a, b) that both windows let through."""
    left, right = (facts.select(*(F.col(c).alias(f"{c}_{s}") for c in ("id", "size", "cells"))) for s in "ab")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return (pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
            .where(_near(num, den)).select("a", "b"))


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose sets are as similar as asked."""
    one, two = (sets.select(F.col("id").alias(f"id_{s}"), F.col("members").alias(f"set_{s}")) for s in "ab")
    both = (pairs.join(one, F.col("a") == F.col("id_a")).select("a", "b", "set_a")
            .join(two, F.col("b") == F.col("id_b")).select("a", "b", "set_a", "set_b"))
    return both.mapInArrow(frugal(_confirm(num, den)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): smallest id reachable over links (a, b).  Labels flow over
    links, then jump to their label's label, until nothing changes."""
    both = _step(links.select("a", "b").union(links.select("b", "a")).where("a is not null and b is not null").distinct())
    labels = _step(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        told = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("told"))
        near = (labels.join(told, F.col("id") == F.col("a"), "left")
                .select("id", F.col("comp").alias("was"), F.least("comp", "told").alias("comp")))
        jump = labels.select(F.col("id").alias("via"), F.col("comp").alias("far"))
        new = _step(near.join(jump, F.col("comp") == F.col("via"), "left")
                    .select("id", "was", F.least("comp", "far").alias("comp")))
        if new.where("comp <> was").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")
        tidy(links.sparkSession)


def _block_pairs(num: int, den: int):
    """Candidate pairs between two blocks of a region, by the windows."""
    def run(key, table):
        first, second = key[2].as_py(), key[3].as_py()
        blk = table.column("block").to_numpy()
        ids, comp, size = (table.column(c).to_numpy() for c in ("id", "comp", "size"))
        cells = np.stack(table.column("cells").to_numpy(zero_copy_only=False)).astype(np.int32)
        rows, cols = np.flatnonzero(blk == first), np.flatnonzero(blk == second)
        a, b = [], []
        for i in rows:
            c = cols[(comp[cols] != comp[i]) & (ids[cols] > ids[i] if first == second else True)]
            c = c[den * np.minimum(size[c], size[i]) >= num * np.maximum(size[c], size[i])]
            apart = np.abs(cells[c] - cells[i]).sum(axis=1)
            c = c[(den + num) * apart <= (den - num) * (size[c] + size[i])]
            a.append(np.full(len(c), ids[i]))
            b.append(ids[c])
        return pa.table({"a": np.concatenate(a) if a else np.empty(0, np.int64),
                         "b": np.concatenate(b) if b else np.empty(0, np.int64)},
                        schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return run


def jaccard_components(documents: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for each row of ``documents``
    (doc_id, text); two documents link at num/den Jaccard similarity or more
    (den * intersection >= num * union)."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = _step(docs.mapInArrow(frugal(_describe(n)), "doc_id long, size long, digest binary"))
    sizes = described.where("size is not null")
    classes = _step(sizes.where("size > 0").groupBy("digest")
                    .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("size").alias("size")))
    # a smaller set has no partner but its equals: already one shingle more is too far
    small = -(-num // (den - num)) if den > num else None
    counters = spark.sparkContext.broadcast(_merge_tables(described))

    slack = 1 - Fraction(num, den)
    dealt = (docs.where("doc_id is not null")
             .mapInArrow(frugal(_windows(n, slack, counters)),
                         "doc_id long, digest binary, size long, pivots array<long>, cells array<tinyint>")
             .where(F.col("size") >= (1 << 62 if small is None else small)))
    reps = classes.where("rep is not null").select(F.col("rep").alias("id"), F.col("digest").alias("rep_digest"))
    points = (dealt.join(reps, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("rep_digest")))
              .groupBy("id", "digest").agg(F.first("size").alias("size"), F.first("cells").alias("cells"),
                                           F.first("pivots").alias("pivots")))
    points = _step(points.select("id", "size", "cells", "pivots"))
    counters.destroy()
    rows = points.select("id", F.col("size").cast("int").alias("size"), F.explode("pivots").alias("pivot"))
    regions = (rows.groupBy("pivot").agg(F.count("*").alias("n"), F.min("id").alias("hub"), F.max("id").alias("last"),
                                         F.bit_xor(F.xxhash64("id")).alias("who"),
                                         F.min("size").alias("low"), F.max("size").alias("high"))
               # the size window of a region of two needs no more than this
               .where((F.col("n") > 2) | ((F.col("n") == 2) & (den * F.col("low") >= num * F.col("high")))))
    # regions with the same members are one region
    regions = _step(regions.groupBy("n", "hub", "last", "who").agg(F.min("pivot").alias("region")))
    more = regions.where("n > 2").select("region", "n", "hub")
    side = F.broadcast(more) if more.count() <= BROADCAST_REGIONS else more
    members = _step(rows.join(side, F.col("pivot") == F.col("region")).select("region", "n", "hub", "id", "size"))
    twos = regions.where("n = 2").select(F.col("hub").alias("a"), F.col("last").alias("b"))
    links = _links(docs, n, points.select("id", "size", "cells"), twos, members, classes, num, den)
    named = (classes.join(components(links), F.col("rep") == F.col("id"), "left")
             .select("digest", F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id")))
    out = sizes.join(named, "digest", "left")
    empty = F.col("size") == 0
    return out.select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def _links(docs, n, facts, twos, members, classes, num, den) -> DataFrame:
    """All links that the components need, region by region."""
    spark = docs.sparkSession
    small, left = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
    fits = den * F.least("size", "size_b") >= num * F.greatest("size", "size_b")
    other = small.select(F.col("region").alias("at"), F.col("id").alias("b"), F.col("size").alias("size_b"))
    within = (small.join(other, (F.col("region") == F.col("at")) & (F.col("id") < F.col("b")) & fits)  # at most SMALL rows a region
              .select(F.col("id").alias("a"), "b"))
    hub = left.where("id = hub").select(F.col("region").alias("at"), F.col("id").alias("b"), F.col("size").alias("size_b"))
    pairs = (left.join(hub, (F.col("region") == F.col("at")) & (F.col("id") != F.col("b")) & fits)
             .select(F.col("id").alias("a"), "b"))
    pairs = _step(_within(twos.union(within).union(pairs), facts, num, den))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The links among pairs, with the sets of their documents only."""
        if pairs.isEmpty():
            return spark.createDataFrame([], "a long, b long")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        wanted = spark.sparkContext.broadcast(_member_filter(ids))   # needs no distinct ids, so no shuffle
        reps = classes.select(F.col("rep").alias("id"), F.col("digest").alias("rep_digest")).join(ids.distinct(), "id")
        sets = (docs.where("doc_id is not null").mapInArrow(frugal(_sets(n, wanted)), "doc_id long, digest binary, members array<long>")
                .join(reps, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("rep_digest")))
                .groupBy("id", "digest").agg(F.first("members").alias("members")).select("id", "members"))
        found = _step(_linked(pairs, _step(sets), num, den))
        wanted.destroy()
        del sets
        tidy(spark)
        return found

    links = confirmed(pairs)
    left = left.select("region", "id")
    for k in range(HUB_ROUNDS):
        comps = components(links)
        at = (left.select("region", "id").join(comps.withColumnRenamed("id", "cid"), F.col("id") == F.col("cid"), "left")
              .select("region", "id", F.coalesce("comp", "id").alias("comp")))
        # only regions that still hold several components go on
        open_ = (at.groupBy("region").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high"))
        left = _step(at.join(open_.select("region", "low"), "region"))
        if left.isEmpty():
            return links
        if k + 1 < HUB_ROUNDS:
            # next hubs: some members outside the region's lowest component
            hubs = (left.where("comp <> low").groupBy("region")
                    .agg(*(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(j))).alias(f"h{j}") for j in range(HUBS)))
                    .select("region", F.explode(F.array_distinct(F.array(*(f"h{j}" for j in range(HUBS))))).alias("h"))
                    .select("region", F.col("h.id").alias("hub"), F.col("h.comp").alias("hub_comp")))
            pairs = left.join(hubs, "region").where("comp <> hub_comp").select(F.col("id").alias("a"), F.col("hub").alias("b"))
            links = links.union(confirmed(_step(_within(pairs, facts, num, den))))
    counts = left.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cells = left.join(facts.withColumnRenamed("id", "fid"), F.col("id") == F.col("fid")).join(counts, "region")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # each member goes to the block pairs of its own block, never to all pairs of members
    spread = (cells.withColumn("block", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
              .select("region", "blocks", "one", "two", "block", "id", "comp", "size", "cells"))
    pairs = spread.groupBy("region", "blocks", "one", "two").applyInArrow(_block_pairs(num, den), "a long, b long")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links.union(confirmed(_step(pairs)))


def keep_one(documents: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One document of each component: the one whose doc_id names it.  Rows
    without words, or without an id, are no copies of anything and stay."""
    found = jaccard_components(documents.select("doc_id", "text"), n, num, den)
    gone = (found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    kept = documents.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
    return kept
