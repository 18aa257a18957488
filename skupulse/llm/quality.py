"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A bounded sample gives each rule's selectivity (share of documents it rejects)
and cost (seconds to evaluate it alone); rules run by rejections per cost,
highest first, and a document stops at the first rule that rejects it.  The
order changes time only: a document is kept when no rule rejects it.

Base figures per text: words, code points in words, symbols, repeated lines and
words inside repeated 3-word windows.  Windows are compared by 64-bit hashes
inside the row, so nothing is exploded or shuffled.

Defined results: null text has no words; texts of fewer than 50 words, or with
more than half of their words in repeated windows, fail the base and are not
kept; repeated rows are judged alike; extra columns are passed over.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import SPACE, cut, hash_share

SAMPLE_ROWS = 1_000      # documents that estimate cost and selectivity
REPEATS = 3              # evaluations of a rule on the sample, after a first one
SYMBOLS = "#*$%&|<>"

# The rules; each condition rejects.  n_words etc. are the base
# figures, text is the document.
RULES = {
    "symbols": "10 * n_symbols > 3 * n_words",
    "exclamations": "10 * (length(text) - length(replace(text, '!', ''))) > 3 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 40 * n_words",
    "capitals": r"2 * regexp_count(text, '\\p{Lu}') > regexp_count(text, '\\p{L}')",
    "letters": r"10 * regexp_count(text, '\\p{L}') < 5 * word_chars",
}


def _n_repeat() -> Column:
    """Words covered by the starts of repeated windows: each start covers three
    words less the overlap with the next start."""
    follows = F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1)))
    cover = F.zip_with("starts", follows, lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.aggregate(cover, F.lit(0), lambda s, x: s + x)).cast("long")


def base_figures(documents: DataFrame) -> DataFrame:
    """doc_id, text and the base figures of every document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("words", F.array_remove(F.split("text", f"[{SPACE}]+"), ""))
    docs = docs.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    hashes = F.transform(F.sequence(F.lit(0), F.size("words") - 3),
                         lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    docs = docs.withColumn("hashes", F.when(F.size("words") >= 4, hashes))
    # most texts repeat no window; only the others are sorted
    placed = F.array_sort(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    docs = docs.withColumn("placed", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), placed))
    again = F.filter("placed", lambda e, i: (F.get("placed", i - 1)["h"] == e["h"]) | (F.get("placed", i + 1)["h"] == e["h"]))
    docs = docs.withColumn("starts", F.when(F.col("placed").isNotNull(), F.array_sort(F.transform(again, lambda e: e["i"]))))
    symbols = F.length("text") - F.length(F.translate("text", SYMBOLS, ""))
    figures = F.struct(
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _n_repeat().alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"))
    # a generator of one row: filters on the figures stay above it and are not
    # folded, with all array expressions, into one predicate below
    return docs.select("doc_id", "text", F.inline(F.array(figures)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_order(documents: DataFrame, rules: dict[str, str] | None = None, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) by rejections per second, from a sample.

    Shares are smoothed, (rejected + 1/2) / (rows + 1), so that rules which rejected
    nothing there still go by their cost; seconds are the least of ``REPEATS``."""
    rules = rules or RULES
    docs = documents.select("doc_id", "text")
    sample = cut(base_figures(hash_share(docs, rows, docs.count(), "doc_id", "text").distinct())).where(~base_failed())
    found = sample.agg(F.count(F.lit(1)).alias("rows"), *(F.sum(F.expr(r).cast("int")).alias(k) for k, r in rules.items())).first()

    def seconds(condition: str) -> float:
        began = time.perf_counter()
        sample.agg(F.sum(F.expr(condition).cast("int"))).collect()
        return time.perf_counter() - began

    least = {k: min(seconds(r) for _ in range(REPEATS + 1)) for k, r in ({"": "true"} | rules).items()}
    scored = [(k, ((found[k] or 0) + 0.5) / (found.rows + 1), max(least[k] - least[""], 1e-3)) for k in rules]
    return sorted(scored, key=lambda f: (-f[1] / f[2], f[0]))


def judge(documents: DataFrame, rules: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The base figures, base_failed, kept and rejected_by of every document."""
    rules = rules or RULES
    order = order or [k for k, _, _ in rule_order(documents, rules)]
    by = F.when(base_failed(), F.lit("base"))
    for name in order:  # CASE stops at the first branch that holds
        by = by.when(F.expr(rules[name]), F.lit(name))
    out = base_figures(documents).withColumn("rejected_by", by)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      base_failed().alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


# The same figures and rules in DuckDB.
ORACLE = r"""
with d as (
  select row_number() over () rid, doc_id, coalesce(text, '') as text from documents
), w as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), g as (
  select rid, unnest(words) as w1, unnest(range(1, len(words) + 1)) as i from w
), h as (
  select rid, i, w1, lead(w1, 1) over p as w2, lead(w1, 2) over p as w3 from g window p as (partition by rid order by i)
), t as (
  select rid, i, count(*) over (partition by rid, w1, w2, w3) as n from h where w3 is not null
), c as (
  select rid, count(distinct p) as n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) as p from t where n > 1) group by rid
), m as (
  select doc_id, text, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines) as n_lines,
         length(regexp_replace(text, '[^!]', '', 'g')) as n_exclaim,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as n_upper,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) as n_letters
  from w left join c using (rid)
), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > 3 * n_words or 10 * n_exclaim > 3 * n_words or 2 * n_dup_lines > n_lines
            or word_chars < 2 * n_words or word_chars > 40 * n_words or 2 * n_upper > n_letters
            or 10 * n_letters < 5 * word_chars) as kept
from b
"""
