"""Secret scanning: keyword automaton, anchored patterns near hits, checksums.

One Aho-Corasick pass over a whole text finds the keywords of all kinds; each
kind's pattern is then tried only at the places its keywords point to, and
kinds with an embedded checksum must pass it.  Long hexadecimal runs have no
keyword; a run of 32 or more covers one of every 32 places, so only those
places are looked at before a run is measured.

Kinds, in this order: ``assign``, ``access``, ``hex`` (leftmost, not
overlapping, per kind), then the checked ones: ``github`` (CRC-32 in base 62),
``jwt`` (three base64url parts, JSON header), ``card`` (Luhn, issuer prefix),
``iban`` (remainder 97), ``pem`` (private key block with a valid base64 body).

Defined results: null text is empty and has no spans; spans are code points,
end exclusive; offsets never shift, as only ASCII letters are folded.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import frugal, slices

# The three base kinds.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Issuer keywords, and the patterns tried there.
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
CARD = re.compile(r"(?<![0-9])[2-6][0-9]{3}(?:[ -]?[0-9]{4}){3}(?![0-9])")
IBAN = re.compile(r"(?<![A-Z0-9])([A-Z]{2})([0-9]{2})([A-Z0-9]{11,30})(?![A-Z0-9])")
PEM = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
IBAN_LANDS = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
# Words that announce a card number, within CARD_REACH code points after them.
CARD_WORDS = ("card", "visa", "mastercard")
CARD_REACH = 40
KINDS = ("assign", "access", "hex", "github", "jwt", "card", "iban", "pem")
HEX = frozenset("0123456789abcdef")
BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
FOLD = {ord(c): c.lower() for c in string.ascii_uppercase}


def automaton() -> ahocorasick.Automaton:
    """Keywords in ASCII lower case; the value names kinds and length."""
    out = ahocorasick.Automaton()
    words = {w: "assign" for w in ASSIGN_WORDS} | {"akia": "access", "eyj": "jwt", "-----begin ": "pem"}
    words |= {f"gh{c}_": "github" for c in "pousr"} | {w: "card" for w in CARD_WORDS}
    words |= {land.lower() + d: "iban" for land in IBAN_LANDS for d in string.digits}
    for word, kind in words.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _github_valid(body: str, check: str) -> bool:
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def _jwt_valid(header: str) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(found, dict) and "alg" in found


def _iban_valid(land: str, check: str, rest: str) -> bool:
    return land in IBAN_LANDS and int("".join(str(int(c, 36)) for c in rest + land + check)) % 97 == 1


def _pem_valid(body: str) -> bool:
    try:
        return len(base64.b64decode("".join(body.split()), validate=True)) >= 16
    except (ValueError, binascii.Error):
        return False


def _walk(pattern, text, starts, good):
    """Leftmost matches that don't overlap, tried at ``starts`` only."""
    end, out = 0, []
    for at in sorted(starts):
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            if good(m):
                out.append((m.start(), m.end()))
    return out


def _hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 32 or more lower-case hexadecimal digits."""
    out, end = [], 0
    for i, c in enumerate(text[31::32]):
        at = 31 + 32 * i
        if c in HEX and at >= end:
            first = at
            while first and text[first - 1] in HEX:
                first -= 1
            last = at + 1
            while last < len(text) and text[last] in HEX:
                last += 1
            end = last
            if last - first >= 32:
                out.append((first, last))
    return out


def _tokens(text: str, hits) -> list[tuple[int, int]]:
    """Signed tokens at the hits.  Where no pattern follows a run of their
    characters, none follows it for a later hit in the same run either, so a long
    run is read once."""
    out, done = [], 0
    for at in sorted(hits):
        if at < done:
            continue
        if m := JWT.match(text, at):
            done = m.end()
            if _jwt_valid(m[1]):
                out.append(m.span())
        else:
            done = max(at + 1, JWT_RUN.match(text, at).end())
    return out


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind."""
    hits: dict[str, set[int]] = {}
    for last, (kind, size) in words.iter(text if text.isascii() and text.islower() else text.translate(FOLD)):
        hits.setdefault(kind, set()).add(last - size + 1)
    found: dict[str, list[tuple[int, int]]] = {}
    if at := hits.get("assign"):
        found["assign"] = _walk(ASSIGN, text, at, lambda m: len(m[2]) >= 8)
    if at := hits.get("access"):
        found["access"] = _walk(ACCESS, text, at, lambda m: len(m[0]) >= 16)
    found["hex"] = _hex_runs(text)
    if at := hits.get("github"):
        found["github"] = _walk(GITHUB, text, at, lambda m: _github_valid(m[1], m[2]))
    if at := hits.get("jwt"):
        found["jwt"] = _tokens(text, at)
    if at := hits.get("card"):
        near = {m.start() for p in at if (m := CARD.search(text, p, p + CARD_REACH + 19))}
        found["card"] = _walk(CARD, text, near, lambda m: luhn(re.sub("[ -]", "", m[0])))
    if at := hits.get("iban"):
        found["iban"] = _walk(IBAN, text, at, lambda m: _iban_valid(*m.groups()))
    if at := hits.get("pem"):
        found["pem"] = _walk(PEM, text, at, lambda m: _pem_valid(m[2]))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((a, b, k) for k, spans in found.items() for a, b in spans), key=lambda s: (s[0], order[s[2]], s[1]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _report(batches):
    words = automaton()
    for batch in slices(batches):
        spans = [scan(t, words) if t else [] for t in batch.column("text").to_pylist()]
        base = [[s for s in x if s[2] in KINDS[:3]] for x in spans]
        count = lambda kind: pa.array([sum(s[2] == kind for s in x) for x in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), count("assign"), count("access"), count("hex"),
             pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string()),
             pa.array([_joined(x) for x in spans], pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans per document."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(frugal(_report), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def cut_out(text: str, spans, mark: str = "[secret]") -> str:
    """The text with each joined stretch of spans replaced by ``mark``."""
    out, end = [], 0
    for a, b, _ in spans:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]]) if out else text


def redact(documents: DataFrame) -> DataFrame:
    """The documents with secrets replaced in the text; n_chars follows where
    the column exists.  Other columns stay as they are."""
    names = documents.columns

    def run(batches):
        words = automaton()
        for batch in slices(batches):
            cols = dict(zip(names, batch.columns, strict=True))
            old = cols["text"].to_pylist()
            new = [cut_out(t, scan(t, words)) if t else t for t in old]
            cols["text"] = pa.array(new, cols["text"].type)
            if "n_chars" in cols:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, cols["n_chars"].to_pylist(), strict=True)]
                cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names)

    return documents.mapInArrow(frugal(run), documents.schema)
