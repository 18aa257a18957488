"""What the packing asks of the tokenizer."""

import pyarrow as pa

from skupulse.llm import packing


def test_new_words_go_to_the_model():
    """New words of plain letters skip the tokenizer's steps before its model; the ids are
    the tokenizer's all the same, also where words or chunks go to it as they are."""
    known = packing._Words(packing.tokenizer_path(), 500)
    plain = known.tokenizer
    calls = []

    class Counted:
        def encode(self, text, **more):
            calls.append(text)
            return plain.encode(text, **more)

    known.tokenizer = Counted()
    letters = [chr(97 + k) for k in range(26)] + [chr(k) for k in range(0xDF, 0x100) if k != 0xF7]
    texts = [" ".join(f"{a}{b}{a * k}{b}x's, {a.upper()}nd {k}" for a in letters for b in "qeo") for k in range(1, 20)]
    texts += ["", "\u00c7A n'est \u65e5\u672c ok w\u00f6rd \u00df", "a<|endoftext|>b <|x 1234", None]
    ids, n = packing.split_ids(pa.array(texts), known, "<u4")
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]
    assert not any(packing.LETTERS.fullmatch(c) for c in calls)
    assert len(calls) < 40 and len(known) == 500
