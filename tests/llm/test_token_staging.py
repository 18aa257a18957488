"""Token files: counts over a batch's cells in a row, and a store of words of its own size."""

from collections import Counter

from skupulse.llm import packing, tokenfile


def test_ids_are_counted_over_all_documents(spark):
    rows = [(i, "word " * (i % 7) + f"x{i % 11}" if i % 5 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    staged, width = tokenfile.token_ids(docs)
    known = packing.known_words(packing.tokenizer_path())
    plain = Counter()
    for _, text in rows:
        own = known.tokenizer.encode(text or "", add_special_tokens=False).ids
        plain.update([*own, packing.END_ID])
    assert tokenfile.count_ids(staged, width) == dict(plain)


def test_store_keeps_as_many_words_as_asked():
    few = packing._Words(packing.tokenizer_path(), 3)
    assert [len(few[w]) > 0 for w in "one two three four five".split()] == [True] * 5 and len(few) == 3
    assert packing.known_words(packing.tokenizer_path(), 7).most == 7
