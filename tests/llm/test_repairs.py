"""Cases that earlier versions of the operators got wrong or slow."""

import base64
import json
import time

import numpy as np
from pyspark.sql import functions as F

from skupulse.llm import langid, mixing, quality, secrets, toxic


def test_signed_tokens_and_keys():
    words = secrets.automaton()
    part = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    token = part({"alg": "HS256", "typ": "JWT"}) + "." + part({"sub": "1"}) + ".c2lnbmF0dXJl"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(b"k" * 48).decode() + "\n-----END RSA PRIVATE KEY-----"
    text = f"a {token} b {part({'no': 1})}.x.y {pem}"
    got = [(text[a:b], k) for a, b, k in secrets.scan(text, words) if k in ("jwt", "pem")]
    assert got == [(token, "jwt"), (pem, "pem")]
    long = "eyJhbGciOi" * 40_000      # one run, 40,000 hits
    began = time.perf_counter()
    assert secrets.scan(long, words) == [] and secrets.scan(long + "." + long, words) == []
    assert time.perf_counter() - began < 5


def test_mix_buckets_stay_even(spark):
    """Low-quality documents do not pile up in a source's last bucket."""
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"),
                               F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 0.5).otherwise(0.25).alias("quality"))
    sized = df.withColumn("source_key", F.lit("=s")).withColumn("key", mixing.draw())
    rows = mixing._summed(mixing._with_targets(sized, mixing._prepared(sized, (1,), 3)))
    biggest = rows.groupBy("bucket").count().agg(F.max("count")).first()[0]
    assert biggest < 3 * mixing.BUCKET_ROWS
    # words before each document, by key
    got = np.array([r.before for r in rows.orderBy("key", "doc_id").select("before").collect()])
    assert (got == 10 * np.arange(n)).all()


def test_mix_takes_by_key(spark):
    """taken per document by the plain loop: complete epochs, then by falling key order."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sized = mixing._sized(docs).collect()
    per = {r.source_key: r for r in mixing.targets(mixing._sized(docs)).collect()}
    for source, figures in per.items():
        left = figures["rest"]
        for r in sorted((r for r in sized if r.source_key == source), key=lambda r: (r["key"], r.doc_id, r.size)):
            part = max(0, min(r.size, left))
            left -= part
            assert got[r.doc_id].taken == figures.epochs * r.size + part


def test_rules_that_reject_nothing_go_by_cost(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = quality.rule_order(docs)
    assert sorted(k for k, _, _ in order) == sorted(quality.RULES) and all(s > 0 for _, s, _ in order)
    assert [f[1] / f[2] for f in order] == sorted((f[1] / f[2] for f in order), reverse=True)


def test_folding_keeps_offsets():
    text = "aİb idiot ÉẞǅΣ"
    assert len(toxic.fold(text)) == len(text) and toxic.fold("ABC É") == "abc é"
    assert [m.span() for m in toxic.WORD.finditer(toxic.fold(text))][1] == (4, 9)


def test_copies_count_once_in_the_sample(spark):
    rows = [("the cat sat", "en")] * 500 + [("der hund lief", "de"), ("le chat noir", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string")
    one = spark.createDataFrame(sorted(set(rows)), "text string, lang string")
    a, b = langid.fit(df), langid.fit(one)
    assert a["langs"] == b["langs"] == ["de", "en", "fr"]
    by = lambda m: dict(zip(m["grams"], m["logs"][:-1].tolist(), strict=True))
    assert by(a) == by(b)
