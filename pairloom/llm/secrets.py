"""Secret scans with structural confirmation.

Base patterns (see ``BASE``) report assignments, access ids and long hex runs. Beyond them, runs
of base64 or hex are decoded and reported only if what they decode to has the structure of a
secret: a DER private key whose nested lengths add up, an OpenSSH private key whose length-prefixed
fields fit, or a signed token with a JSON header that names its algorithm. Runs that decode to
anything else (digests, images, public keys) are not. A key may begin inside a run, as where a path
is glued to it, and go on over lines, real or escaped ones, with quotes or the prefixes of
comments, diffs and mails between; its own lengths tell where it ends. A PEM key may stand in base64 as a whole.

Letters that go on over lines are joined once (``_Chain``) and decoded once for each offset modulo 4, and the outer layout of a key is read
there before anything is copied. So a text that repeats the head of a key a million times takes time in proportion to its length.

A pass over the bytes finds the texts that can hold a match at all; only those meet the patterns.

Defined results: null counts as an empty text and has no spans; every row gives one row, repeated
ones too; spans count code points, the end exclusive; columns beyond ``doc_id`` and ``text`` play
no part, whatever their names. Empty in, empty out.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bytesets import chunks


class Span(NamedTuple):
    start: int
    kind: str
    end: int


#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

#: Pattern, group whose length counts, least length.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", _ASSIGN, 2, 6), ("access", _ACCESS, 0, 20), ("hex", _HEX, 0, 24))

#: Least run of base64 or hex that is decoded.
LEAST_RUN = 40
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_ESCAPED = re.compile(r"(?:\\+r)?\\+n|\\+r|\r")
#: What stands at the ends of lines beside the base64.
_ASIDE = " \t\v\f>#*;|\"',\\"
#: Line prefixes that the lines after it repeat.
_PREFIX = re.compile(r"[ \t>#+*;|/%-]{1,16}")
_NEXT_LINE = re.compile(r"""["']?[ \t]*(?:\r?\n|(?:\\+r)?\\+n)""")
_NEXT_PREFIX = re.compile(r"""[ \t>#*;|]*["']?""")
_BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_RUN)
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{%d,}" % LEAST_RUN)
_BASE64, _HEX_DIGITS = re.compile(r"[A-Za-z0-9+/_-]*"), re.compile(r"[0-9A-Fa-f]*")
#: Runs that can hold the letters of an OpenSSH key's or a PEM key's beginning.
_BASE64_SHORT, _HEX_SHORT = re.compile(r"[A-Za-z0-9+/_-]{14,}"), re.compile(r"[0-9A-Fa-f]{30,}")
#: Where a DER sequence can begin: 0x30 and a length.
_DER_BASE64, _DER_HEX = re.compile(r"(?=M[A-P])"), re.compile(r"(?=30(?:8[1-4]|[0-7]))")
#: "openssh-key-v1" and "-----BEGIN"
_SSH_BASE64, _SSH_HEX = re.compile("b3BlbnNzaC1rZXktdjEA"), re.compile("6f70656e7373682d6b65792d763100", re.I)
_PEM_BASE64 = re.compile("LS0tLS1CRUdJTi")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]*)\.(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)")


# Decoding and structure ----------------------------------------------------------------


def decode_base64(run: str) -> bytes | None:
    """Standard or URL-safe base64, padding optional; None if it is neither."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return None


class Node(NamedTuple):
    """A DER element; ``parts`` if it is made of others."""

    tag: int
    body: bytes
    parts: tuple["Node", ...]


def parse_der(data: bytes, depth: int = 0) -> tuple[Node, ...] | None:
    """The elements that fill ``data`` exactly, or None if a length does not fit."""
    if depth > 16:
        return None
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > len(data):
            return None
        body = data[at : at + size]
        parts: tuple[Node, ...] | None = ()
        if tag & 0x20:
            parts = parse_der(body, depth + 1)
            if parts is None:
                return None
        out.append(Node(tag, body, parts))
        at += size
    return tuple(out)


_INT, _OCTETS, _OID, _SEQ = 0x02, 0x04, 0x06, 0x30


def is_private_key_der(data: bytes) -> bool:
    """One DER sequence laid out as a private key: PKCS#8, encrypted PKCS#8, RSA or DSA
    numbers, or an elliptic-curve key."""
    if data[:1] != b"\x30":
        return False
    top = parse_der(data)
    if top is None or len(top) != 1:
        return False
    parts = top[0].parts
    tags = [p.tag for p in parts]

    def algorithm(node: Node) -> bool:
        return node.tag == _SEQ and bool(node.parts) and node.parts[0].tag == _OID

    if len(parts) >= 3 and tags[0] == _INT and tags[2] == _OCTETS and algorithm(parts[1]):
        return parts[0].body in (b"\x00", b"\x01")
    if len(parts) == 2 and tags[1] == _OCTETS and algorithm(parts[0]):
        return len(parts[1].body) >= 32
    if len(parts) >= 2 and tags[:2] == [_INT, _OCTETS] and parts[0].body == b"\x01":
        return len(parts[1].body) >= 16
    numbers = [p for p in parts if p.tag == _INT]
    if len(numbers) == len(parts) and parts[0].body in (b"\x00", b"\x01"):
        return len(parts) in (6, 9) and max(len(p.body) for p in parts) >= 32
    return False


def openssh_size(data: bytes, start: int = 0) -> int | None:
    """The bytes of an OpenSSH container at ``start`` of ``data``: its magic, then length-prefixed fields."""
    magic = b"openssh-key-v1\x00"
    if not data.startswith(magic, start):
        return None
    at = start + len(magic)

    def field() -> bool:
        nonlocal at
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    for _ in range(3):  # cipher, key derivation, its options
        if not field():
            return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return None
    return at - start if all(field() for _ in range(count + 1)) else None


def is_openssh_key(data: bytes) -> bool:
    """One OpenSSH container and nothing else."""
    return openssh_size(data) == len(data)


def _json_object(segment: str) -> dict | None:
    data = decode_base64(segment)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    head = _json_object(header)
    if head is None or not isinstance(head.get("alg"), str) or _json_object(payload) is None:
        return False
    return head["alg"].lower() == "none" or len(decode_base64(signature) or b"") >= 16


def _key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if is_private_key_der(data) else "ssh" if is_openssh_key(data) else None


# Keys inside runs and over lines ---------------------------------------------------------


def _line_prefix(text: str, at: int) -> str:
    """What stands on the line before ``at``, if it looks like the prefix of a comment, diff or mail."""
    low = max(0, at - 17)
    prefix = text[max(text.rfind("\n", low, at) + 1, low) : at]
    return prefix.strip() if _PREFIX.fullmatch(prefix) else ""


def _pems(text: str) -> Iterator[tuple[int, int]]:
    """PEM private keys that decode to one."""
    ends: dict[str, list[int]] = {}
    for m in _END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    begins = list(_BEGIN.finditer(text))
    for i, m in enumerate(begins):
        own = ends.get(m[1], [])
        nearest = bisect_left(own, m.end())
        if nearest == len(own) or (i + 1 < len(begins) and begins[i + 1].start() < own[nearest]):
            continue
        end, mark = own[nearest], f"-----END {m[1]}-----"
        prefix = _line_prefix(text, m.start())
        lines = _ESCAPED.sub("\n", text[m.end() : end]).split("\n")
        body = "".join(line.strip(_ASIDE) for line in lines)
        bodies = [body]
        if prefix:
            bodies.append("".join(line.strip().removeprefix(prefix).strip(_ASIDE) for line in lines))
        if any(_key_kind(decode_base64("".join(b.split()))) for b in bodies):
            yield m.start(), end + len(mark)


def _next_piece(text: str, end: int, prefix: str, letters: re.Pattern) -> int | None:
    """Where letters that end at ``end`` go on in the next line, if they do."""
    line = _NEXT_LINE.match(text, end)
    if not line:
        return None
    at = line.end()
    while at < len(text) and text[at] in " \t":
        at += 1
    if prefix and text.startswith(prefix, at):
        at += len(prefix)
    at = _NEXT_PREFIX.match(text, at).end()
    return at if letters.match(text, at).end() > at else None


class _Chain:
    """Letters that go on over lines, joined. Pieces are ``starts`` in the text and ``offsets`` among the letters."""

    def __init__(self, text: str, at: int, prefix: str, letters: re.Pattern):
        self.starts, self.offsets, pieces, size = [], [], [], 0
        while at is not None:
            end = letters.match(text, at).end()
            self.starts.append(at)
            self.offsets.append(size)
            pieces.append(text[at:end])
            size += end - at
            at = _next_piece(text, end, prefix, letters)
        self.letters = "".join(pieces)
        self.is_hex = letters is _HEX_DIGITS
        self.decoded: dict[int, bytes] = {}
        self.pems: dict[int, tuple[int, int]] = {}

    def end_of(self, offset: int) -> int:
        """Where in the text the first ``offset`` letters end."""
        piece = bisect_left(self.offsets, offset) - 1
        return self.starts[piece] + offset - self.offsets[piece]

    def data(self, offset: int) -> tuple[bytes, int]:
        """Decoded bytes, and the place among them of those that begin at the letter ``offset``. Decoded once for each remainder."""
        unit = 2 if self.is_hex else 4
        phase = offset % unit
        if phase not in self.decoded:
            decode = _decode_hex if self.is_hex else _decode_open
            self.decoded[phase] = decode(self.letters[phase:])
        return self.decoded[phase], offset // unit * (1 if self.is_hex else 3)

    def last_pem(self, offset: int) -> tuple[int, int]:
        """Start of the last PEM private key among the bytes with the remainder of ``offset``, and the end of the white space after it."""
        phase = offset % 4
        if phase not in self.pems:
            plain = self.data(offset)[0].decode("latin-1")
            last = (-1, -1)
            for start, end in _pems(plain):
                last = start, end
            start, end = last
            while 0 <= end < len(plain) and plain[end].isspace():
                end += 1
            self.pems[phase] = start, end
        return self.pems[phase]


class _Chains:
    """The chains of one text, built when they are met; all places of a run, and all lines with one prefix, share one."""

    def __init__(self, text: str, letters: re.Pattern):
        self.text, self.letters = text, letters
        self.known: dict[tuple[int, str], tuple[_Chain, int]] = {}

    def at(self, run: int, at: int) -> tuple[_Chain, int]:
        """The chain through ``at`` in the run that begins at ``run``, and the place of ``at`` among its letters."""
        prefix = _line_prefix(self.text, at)
        start = at if prefix else run
        if (start, prefix) not in self.known:
            chain = _Chain(self.text, start, prefix, self.letters)
            for piece, offset in zip(chain.starts, chain.offsets):
                self.known.setdefault((piece, prefix), (chain, offset))
        chain, offset = self.known[start, prefix]
        return chain, offset + at - start


def _laid_out(data: bytes, at: int, size: int) -> bool:
    """Whether the outer parts of the DER sequence of ``size`` bytes at ``at`` can be those of a private key. Nothing is copied."""
    end = at + size
    if end > len(data):
        return False
    at += 2 + (data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0)
    tags = []
    while at < end:
        if at + 2 > end:
            return False
        tag, length = data[at], data[at + 1]
        body = at + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or body + width > end:
                return False
            length = int.from_bytes(data[body : body + width], "big")
            body += width
        if body + length > end:
            return False
        if not tags and tag == _INT and data[body : body + length] not in (b"\x00", b"\x01"):
            return False
        tags.append(tag)
        head = tags[:3]
        numbers = len(tags) <= 9 and all(t == _INT for t in tags)
        pkcs8 = head == [_INT, _SEQ, _OCTETS][: len(head)]
        sealed = len(tags) <= 2 and tags == [_SEQ, _OCTETS][: len(tags)]
        curve = head[:2] == [_INT, _OCTETS][: len(head)]
        if not (numbers or pkcs8 or sealed or curve):
            return False
        at = body + length
    return True


def _der_size(head: bytes) -> int | None:
    """The bytes of the DER sequence that begins so, if it begins as private keys do."""
    if len(head) < 3 or head[0] != _SEQ:
        return None
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4 or head[1] == 0x80 or head[2 + width : 3 + width] not in (b"\x02", b"\x30"):
        return None
    return 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])


def _decode_hex(run: str) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2])


def _decode_whole_hex(run: str) -> bytes | None:
    return None if len(run) % 2 else bytes.fromhex(run)


def _decode_open(run: str) -> bytes:
    """Base64 that may be cut anywhere."""
    return decode_base64(run[:-1] if len(run) % 4 == 1 else run) or b""


def _exact(text: str, chain: _Chain, offset: int, size: int) -> tuple[bytes, int] | None:
    """The ``size`` bytes that are encoded from the letter ``offset``, and their end in the text, if an encoding ends there."""
    need = 2 * size if chain.is_hex else -(-4 * size // 3)
    run = chain.letters[offset : offset + need]
    if len(run) < need:
        return None
    end = chain.end_of(offset + need)
    if chain.is_hex:
        data = _decode_hex(run)
    else:
        data = decode_base64(run) or b""
        plain = run.replace("-", "+").replace("_", "/")
        if base64.b64encode(data).decode().rstrip("=") != plain:
            return None
    padded = end
    while not chain.is_hex and padded < min(end + 2, len(text)) and text[padded] == "=":
        padded += 1
    if padded == end and text[end : end + 1].isascii() and text[end : end + 1].isalnum():
        return None
    return data, padded


def _keys_within(text: str) -> Iterator[Span]:
    """Keys that begin anywhere in a run and may go on over lines: by kind of letters, each kind's by place."""
    base64_chains = _Chains(text, _BASE64)
    for chains, runs, short, der, ssh, head, decode in (
        (base64_chains, _BASE64_RUN, _BASE64_SHORT, _DER_BASE64, _SSH_BASE64, 12, _decode_open),
        (_Chains(text, _HEX_DIGITS), _HEX_RUN, _HEX_SHORT, _DER_HEX, _SSH_HEX, 14, _decode_hex),
    ):
        done = 0
        for run in runs.finditer(text):
            for m in der.finditer(text, run.start(), run.end()):
                at = m.start()
                size = _der_size(decode(text[at : min(at + head, run.end())].rstrip("="))) if at >= done else None
                if not size:
                    continue
                chain, offset = chains.at(run.start(), at)
                got = _exact(text, chain, offset, size) if _laid_out(*chain.data(offset), size) else None
                if got and is_private_key_der(got[0]):
                    done = got[1]
                    yield Span(at, "der", done)
        for run in short.finditer(text):
            for m in ssh.finditer(text, run.start(), run.end()):
                chain, offset = chains.at(run.start(), m.start())
                size = openssh_size(*chain.data(offset))
                got = _exact(text, chain, offset, size) if size else None
                if got:
                    yield Span(m.start(), "ssh", got[1])
    done = 0
    for run in _BASE64_SHORT.finditer(text):
        for m in _PEM_BASE64.finditer(text, run.start(), run.end()):
            if m.start() < done:
                continue
            chain, offset = base64_chains.at(run.start(), m.start())
            start, end = chain.last_pem(offset)
            begin = chain.data(offset)[1]
            if start >= begin:
                done = chain.end_of(min(offset - (-4 * (end - begin) // 3), len(chain.letters)))
                while text[done : done + 1] == "=":
                    done += 1
                yield Span(m.start(), "pem", done)


class _Known:
    """Spans found so far. They come in series, each sorted by start."""

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.starts: list[int] = []
        self.farthest: list[int] = []
        self.new: list[tuple[int, int]] = []
        self.newest = 0

    def add(self, start: int, end: int) -> None:
        self.new.append((start, end))
        self.newest = max(self.newest, end)

    def settle(self) -> None:
        """A series is over."""
        self.spans = sorted(self.spans + self.new)
        self.starts = [a for a, _ in self.spans]
        self.farthest = list(accumulate((b for _, b in self.spans), max))
        self.new, self.newest = [], 0

    def hold(self, start: int, end: int) -> bool:
        """Whether one span holds all of this."""
        before = bisect_right(self.starts, start)
        return self.newest >= end or (before > 0 and self.farthest[before - 1] >= end)


def find_spans(text: str | None) -> list[Span]:
    """All spans of one text, by start and kind."""
    text = text or ""
    found = [
        Span(m.start(), kind, m.end())
        for kind, pattern, group, least in BASE
        for m in pattern.finditer(text)
        if len(m[group]) >= least
    ]
    known = _Known()
    for start, end in _pems(text):
        found.append(Span(start, "pem", end))
        known.add(start, end)
    known.settle()
    for m in _TOKEN.finditer(text):
        if is_signed_token(*m.groups()):
            found.append(Span(m.start(), "jwt", m.end()))
    for pattern, decode in ((_BASE64_RUN, decode_base64), (_HEX_RUN, _decode_whole_hex)):
        for m in pattern.finditer(text):
            kind = _key_kind(decode(m[0]))
            if kind and not known.hold(m.start(), m.end()):
                found.append(Span(m.start(), kind, m.end()))
                known.add(m.start(), m.end())
        known.settle()
    last = 0
    for span in _keys_within(text):
        if span.start < last:
            known.settle()
        last = span.start
        if not known.hold(span.start, span.end):
            found.append(span)
            known.add(span.start, span.end)
    return sorted(set(found), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


# Over columns --------------------------------------------------------------------------

_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[ord(c) for c in "0123456789abcdef"]] = True
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_MARKS = (b"AKIA", b"-----BEGIN ", b"eyJ")


def _has_run(of: np.ndarray, length: int) -> np.ndarray:
    """Where a run of ``length`` begins."""
    if len(of) < length:
        return np.zeros(0, np.int64)
    breaks = np.zeros(len(of) + 1, np.int32)
    np.cumsum(~of, out=breaks[1:])
    return np.flatnonzero(breaks[length:] == breaks[:-length])


def _suspects(texts) -> np.ndarray:
    """Which texts of a chunk can have a span. What straddles two texts only adds a suspect."""
    at = [_has_run(_RUN_BYTE[texts.data], LEAST_RUN), _has_run(_HEX_BYTE[texts.data], 24)]
    raw = texts.data.tobytes()
    lowered = raw.lower()  # of bytes: A-Z only
    for where, marks in ((raw, _MARKS), (lowered, _NAMES)):
        for mark in marks:
            hits, i = [], where.find(mark)
            while i >= 0:
                hits.append(i)
                i = where.find(mark, i + 1)
            at.append(np.array(hits, np.int64))
    docs = np.searchsorted(texts.starts, np.concatenate(at), "right") - 1
    return np.unique(docs)


def column_spans(column: pa.Array) -> dict[int, list[Span]]:
    """The spans of each text of an Arrow column that has any, by position."""
    out = {}
    for texts in chunks(column):
        for i in _suspects(texts).tolist():
            spans = find_spans(column[texts.first + i].as_py())
            if spans:
                out[texts.first + i] = spans
    return out


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_confirmed long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base_sha256", pa.string()),
        ("spans", pa.string()),
        ("n_confirmed", pa.int64()),
    ]
)
_BASE_KINDS = ("assign", "access", "hex")


def _digest(spans: list[Span]) -> tuple:
    base = [s for s in spans if s.kind in _BASE_KINDS]
    counts = [sum(s.kind == k for s in base) for k in _BASE_KINDS]
    sha = hashlib.sha256(joined(base).encode()).hexdigest()
    return (*counts, sha, joined(spans), len(spans) - len(base))


_NOTHING = _digest([])


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = column_spans(batch.column("text"))
        rows = [_digest(found[i]) if i in found else _NOTHING for i in range(batch.num_rows)]
        columns = zip(*rows) if rows else [[] for _ in _NOTHING]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:]))],
            schema=_ARROW,
        )


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of the secrets of every whole text. Nothing is shuffled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, SCHEMA)


def redact_text(text: str, spans: list[Span], mask: str) -> str:
    """``text`` with the union of the spans replaced."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], mask]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` counted anew, where there is
    such a column. Rows and all other columns stay; a null text stays null."""

    @F.pandas_udf("string")
    def masked(column: pd.Series) -> pd.Series:
        arrow = pa.array(column, pa.large_string(), from_pandas=True)
        found = column_spans(arrow)
        if found:
            column = column.copy()
            for i, spans in found.items():
                column.iloc[i] = redact_text(arrow[i].as_py(), spans, mask)
        return column

    out = docs.withColumn("text", masked(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out
