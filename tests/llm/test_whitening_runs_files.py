"""Whitening, periodic runs and token files against plain versions of the same
definitions, exact round trips, and awkward tables."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skupulse.llm import packing, periodic, queries, tokenfile, whitening
from tests.llm.test_corpus_operators import DOCS, SF, awkward, words_of


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- whitening

def plain_whitening(vectors, most):
    """(n, exact deviations, whitened, explained) by whole numbers and numpy's eigh."""
    x = [[int(np.floor(256 * float(c))) for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centre = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    cov = centre.T @ centre / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:most], vecs[:, ::-1][:, :most]
    dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    own = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    return n, dev, own @ vecs / np.sqrt(values), values / np.trace(cov)


def check_whitening(got, vectors, most, components):
    n, dev, white, explained = plain_whitening(vectors, most)
    assert len(got) == len(vectors) * components
    for c in range(1, components + 1):
        rows = sorted((r for r in got if r.component == c), key=lambda r: r.vec_id)
        mine = np.array([r.whitened for r in rows])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.allclose(sign * mine, white[:, c - 1], atol=1e-9)
        assert [int(r.deviation) for r in rows] == dev and {r.n for r in rows} == {n}
        assert all(abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in rows)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = queries.op11_embedding_whitening(spark, SF).collect()
    vectors = [r.embedding for r in rows.orderBy("vec_id").collect()]
    check_whitening(got, vectors, 4, 4)


def test_whitening_awkward(spark):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(40, 6)) * [5, 3, 2, 1, 0.5, 0.4] + 9).tolist()
    rows = [(i, v, 0, "k") for i, v in enumerate(base)]
    rows += [(100 + i, base[0], 1, None) for i in range(60)]                    # a hot vector
    rows += [(200, [0.0] * 6, 1, None), (200, [-0.0] * 6, 1, None)]             # zero, repeated id
    bad = [(300, None), (301, []), (302, [1.0] * 5), (303, [float("nan")] + [0.0] * 5), (304, [float("inf")] * 6), (305, [None] + [0.0] * 5)]
    df = spark.createDataFrame(rows + [(i, v, 0, "k") for i, v in bad], "vec_id long, embedding array<double>, n int, x string")
    got = whitening.whiten(df.repartition(7), most=4).collect()
    ids = {r.vec_id for r in got}
    assert not ids & {i for i, _ in bad} and len(got) == 4 * len(rows)
    n, dev, white, _ = plain_whitening([v for _, v, *_ in rows], 4)
    one = {(r.vec_id, r.component): r for r in got}
    assert int(one[0, 1].deviation) == dev[0] and one[0, 1].n == n == 41
    assert max(r.identity_error for r in got) < 1e-9
    assert abs(abs(one[5, 2].whitened) - abs(white[5, 1])) < 1e-9
    null_id = whitening.whiten(df.withColumn("vec_id", F.lit(None).cast("long"))).count()
    assert null_id == len(got)


def test_whitening_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)]              # rank one
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert len(got) == 9 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_whitening_of_huge_numbers(spark):
    rows = [(0, [1e300, 3.0]), (1, [-1e300, 5.0]), (2, [2.0 ** 50, 5.0]), (3, [0.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=1).collect()
    x = [[max(-2 ** 62, min(2 ** 62, int(256 * a))), int(256 * b)] for _, (a, b) in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((4 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert [None if r.deviation is None else int(r.deviation) for r in sorted(got, key=lambda r: r.vec_id)] == [w if w < 10 ** 38 else None for w in want]


def test_factorisation():
    rng = np.random.default_rng(0)
    for d, rank in ((1, 1), (5, 5), (9, 4), (64, 64)):
        a = rng.normal(size=(d, rank)) * np.logspace(0, -3, rank)
        v = a @ a.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12)
        assert (np.triu(factor, 1) == 0).all()
        values, vectors = whitening.components(v)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        assert np.allclose(values, want, rtol=1e-9)
        assert np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-12)
        assert np.allclose(vectors.T * values @ vectors, v, atol=1e-12)


def test_rows_pack_exactly():
    x = np.array([[0, 1], [-1, 40_000], [2 ** 31, -2 ** 31], [-2 ** 15, 2 ** 15 - 1], [-2 ** 62, 2 ** 62]], np.int64)
    packed = whitening.pack_rows(x)
    assert (whitening.unpack_rows(packed) == x).all()
    assert [len(p) for p in packed] == [5, 9, 17, 5, 17]


# ---- periodic runs

def plain_runs(words, least=24, times=3):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j > i else i + 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def repeated(doc, text):
    words, h = words_of(text), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def plain_digests(words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_runs_are_all_runs():
    rng = random.Random(5)
    for _ in range(1_500):
        k, least, words = rng.choice([1, 2, 3, 5, 30]), rng.choice([2, 6, 24]), []
        while len(words) < rng.randint(0, 150):
            kind = rng.random()
            if kind < 0.5:
                unit = [rng.randrange(k) for _ in range(rng.randint(1, 12))]
                words += (unit * rng.randint(1, 9))[:rng.randint(1, 100)]
            elif kind < 0.7 and words:
                a = rng.randrange(len(words))
                words += words[a:a + rng.randint(1, 40)]
            else:
                words += [rng.randrange(3 * k) for _ in range(rng.randint(1, 20))]
        assert periodic.text_runs(words, least) == plain_runs(words, least)


def test_segments_split_and_recurse():
    unit = ["a", "b", "c"]
    words = ["x"] + unit * 10 + ["y"] + ["a"] * 5 + ["x"] + ["z"] * 30 + ["x"]
    # x occurs three times, so only the parts that y cuts off lose it
    assert periodic.segments(words) == [(1, 31), (38, 68)]
    assert periodic.segments(["a", "b"] * 20) == [(0, 40)]
    assert periodic.segments(list(range(100))) == [] == periodic.segments([])
    # long nested and degenerate texts end quickly
    a, b = [0], [0, 1]
    while len(b) < 50_000:
        a, b = b, b + a
    assert len(periodic.text_runs(b)) > 1_000
    assert periodic.text_runs([1] * 300_000) == [(0, 300_000, 1)]
    assert periodic.text_runs(list(range(50_000)) * 4) == [(0, 200_000, 50_000)]


def test_run_query_against_plain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        words = repeated(r.doc_id, docs[r.doc_id])
        if len(words) < 1_500:   # the plain version is quadratic
            assert tuple(r)[1:] == plain_digests(words)
    assert sum(r.n_runs for r in got) > 5


def test_runs_awkward(spark, odd, none):
    got = periodic.digests(periodic.find_runs(periodic.repeat_some(odd))).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(((d, *plain_digests(repeated(d, t))) for d, t in texts if len(words_of(t)) < 1_500), key=str)
    long = {d for d, t in texts if len(words_of(t)) >= 1_500}
    assert sorted((tuple(r) for r in got if r.doc_id not in long), key=str) == want
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert (by[11].n_runs, by[11].start, by[11].length, by[11].period) == (1, 0, 3000, 1)
    assert by[0].start is None and by[0].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.digests(periodic.find_runs(periodic.repeat_some(none))).count() == 0


def test_best_run_ties(spark):
    rows = [(1, [(5, 30, 10), (0, 24, 8), (9, 24, 8)]), (2, [(0, 24, 2), (40, 48, 4)]), (3, []), (4, [(0, 25, 8), (30, 26, 8)])]
    df = spark.createDataFrame([(d, r, "") for d, r in rows], f"doc_id long, runs {periodic.RUNS}, collapsed string")
    got = {r.doc_id: (r.start, r.length, r.period, r.exponent_milli) for r in periodic.digests(df).collect()}
    assert got == {1: (0, 24, 8, 3000), 2: (0, 24, 2, 12000), 3: (None,) * 4, 4: (30, 26, 8, 3250)}


# ---- token files

def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


def plain_rows(rows):
    """(doc_id, start, n_tokens, crc32) by the tokenizer alone, for distinct ids."""
    known, out, start = tokenizer(), [], 0
    for doc, text in sorted(rows):
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_query_against_tokenizer(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_token_output(spark, SF).collect())
    assert got == plain_rows(docs)


def test_token_files_awkward(spark, odd, none, tmp_path):
    tokenfile.write(odd.repartition(5), str(tmp_path / "odd"), block_tokens=500)
    got = tokenfile.read(spark, str(tmp_path / "odd")).orderBy("start").collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    known = tokenizer()
    want = sorted((-1 if d is None else d, tuple(known.encode(t or "", add_special_tokens=False).ids) + (2,)) for d, t in texts)
    mine = [(-1 if r.doc_id is None else r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert sorted(mine) == want and [d for d, _ in mine] == [d for d, _ in want]
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    every = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got])
    for first, last in ((0, at), (0, 1), (at - 1, at), (63, 65), (777, 2_345), (at, at + 9), (5, 5)):
        part = tokenfile.read_range(spark, str(tmp_path / "odd"), first, last).orderBy("start").collect()
        mine = np.concatenate([np.frombuffer(r.ids, "<u4") for r in part] + [np.empty(0, "<u4")])
        assert mine.tolist() == every[first:last].tolist()
    blocks = spark.read.parquet(str(tmp_path / "odd" / "blocks"))
    assert blocks.count() > 3 and blocks.where("n_tokens > 500 and size(doc_ids) > 1 and n_tokens - element_at(lengths, -1) >= 500").count() == 0
    tokenfile.write(none, str(tmp_path / "none"))
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0


def test_token_files_of_one_hot_id(spark, tmp_path):
    rows = [(7, f"word{i % 50} and more " * 40) for i in range(3_000)] + [(1, "first"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfile.write(df, str(tmp_path / "hot"), block_tokens=2_000)
    got = tokenfile.read(spark, str(tmp_path / "hot"))
    assert got.count() == len(rows)
    parts = spark.read.parquet(str(tmp_path / "hot" / "blocks")).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(parts) > 2 and max(p.n for p in parts) < 0.6 * sum(p.n for p in parts)


def huffman_cost(counts):
    import heapq
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n in (2, 3, 5, 50, 1000):
        counts = rng.integers(1, 1000, n) ** 2
        free = tokenfile.code_lengths(counts, 40)
        assert (free * counts).sum() == huffman_cost(counts.tolist())
        tight = tokenfile.code_lengths(counts, 10)
        assert tight.max() <= 10 and abs((2.0 ** -tight).sum() - 1) < 1e-12
    # all limited codes of five symbols, by trial
    import itertools
    for counts in ([1, 1, 2, 50, 900], [1, 2, 4, 8, 16], [7, 7, 7, 7, 7]):
        best = min(sum(a * b for a, b in zip(counts, c, strict=True)) for c in itertools.product((1, 2, 3), repeat=5)
                   if sum(2.0 ** -x for x in c) <= 1)
        assert (tokenfile.code_lengths(np.array(counts), 3) * counts).sum() == best
    assert tokenfile.code_lengths(np.array([9])).tolist() == [1] and len(tokenfile.code_lengths(np.array([], np.int64))) == 0


def test_codes_round_trip():
    rng = np.random.default_rng(2)
    counts = 2 ** np.arange(40)
    ids = np.sort(rng.choice(70_000, 40, replace=False))
    codes = tokenfile.Codes(ids, tokenfile.code_lengths(counts, 16))
    for n in (1, 63, 64, 65, 5_000):
        text = rng.choice(ids, n)
        bits, offsets = codes.encode(text)
        assert (codes.decode(bits, offsets, n) == text).all() and len(offsets) == -(-n // 64)
        for first, last in ((0, 1), (n - 1, n), (n // 2, n), (n // 3, 2 * n // 3), (n, n + 5)):
            assert codes.decode(bits, offsets, n, first, last).tolist() == text[first:last].tolist()
    one = tokenfile.Codes(np.array([2]), np.array([1]))
    assert one.decode(*one.encode(np.full(100, 2)), 100).tolist() == [2] * 100


def test_split_ids_equals_tokenizer():
    known, words = tokenizer(), packing.known_words(packing.tokenizer_path())
    texts = [None, "", "  ", "<|endoftext|> a<|endoftext|>b", "I'll they're O'T'S x", " a b \x1c c\x85d", "é É ẞ İ", "a ́",
             "中文 Ж, ok. 12ab3", "퟿", "don't'sx ''s", "ǅ", "Ω K", "\x0b\x0c a\tb\r\nc", "x" * 3000]
    ids, n = packing.split_ids(pa.array(texts), words, "<u4")
    for text, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == known.encode(text or "", add_special_tokens=False).ids
