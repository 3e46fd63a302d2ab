"""Secret scans by a recursive decoding worklist.

Every layer of a text is scanned with the base patterns; URL escapes, Unicode escapes, base64
and compressed runs in it are unwrapped into further layers, until nothing new appears. A layer
seen before is not taken up again, so that cycles end. Each layer knows, for each of its
characters, the span of the original text it came from, so that findings map back.

Compressed streams are read whole, all members, and again if they hold streams. Base64 may run over
lines or follow a slash, dash or underscore. A layer with some broken characters is still scanned, one
that is mostly binary isn't. Other encodings (base32, rot13, brotli, archives' own formats) aren't unwrapped.

Null and empty texts have no findings. Findings that start at the same place are in the order of their
kinds. Very long texts are scanned whole; what a layer keeps of its places grows with its escapes, not its
characters. Repeated rows give repeated results. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import html
import re
import urllib.parse
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The kinds in their order.
KINDS = ("assign", "access", "hex")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

_ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#(?:x[0-9A-Fa-f]{1,6}|[0-9]{1,7});")
#: A token, and lines after it that hold nothing else (JSON may write their ends as two characters).
_BASE64 = re.compile(r"""(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{16,}={0,2})((?:(?:\r?\n|(?:\\r)?\\n)[ \t]*[A-Za-z0-9+/_-]+={0,2}(?=[ \t]*(?:[\r\n"'<\\]|\Z)))*)""")
_UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
#: Bytes written with escapes among plain characters, as compressed streams are.
_PERCENT_BYTES = re.compile(r"(?:x(?=%))?%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9._~*'()!+-])+")
_SLASH_BYTES = re.compile(r"(?:x(?=\\x))?\\x[0-9A-Fa-f]{2}(?:\\x[0-9A-Fa-f]{2}|\\[nrtabfv0\\'\"]|[\x20-\x5B\x5D-\x7E])+")
_SLASHED = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)")
_NAMED = {"n": 10, "r": 13, "t": 9, "a": 7, "b": 8, "f": 12, "v": 11, "0": 0}
_STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]", re.S)


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the base patterns' matches; those too short are dropped after matching."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _unescape(run: str) -> str | None:
    if run[0] == "%":
        return urllib.parse.unquote_to_bytes(run).decode("utf-8", "replace")
    if run[0] == "&":
        out = html.unescape(run)
        return out if out != run else None
    units = b"".join((int(a or b, 16)).to_bytes(2, "little") for a, b in _UNIT.findall(run))
    return units.decode("utf-16-le", "replace")


def _windows(raw: bytes, bound: int, overlap: int) -> Iterator[bytes]:
    """All that the gzip or zlib stream at the start of raw unfolds to, every member of it, in windows of about bound
    bytes that overlap; nothing if it is none. A stream that breaks off gives what came before."""
    held, again = bytearray(), False
    while raw:
        if raw[:2] == b"\x1f\x8b":
            wbits = 31
        elif len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] * 256 + raw[1]) % 31 == 0:
            wbits = 15
        else:
            break
        d = zlib.decompressobj(wbits)
        try:
            while not d.eof:
                part = d.decompress(raw, 1 << 20)
                held += part
                raw = d.unconsumed_tail
                if len(held) >= bound:
                    yield bytes(held)
                    held, again = held[-overlap:], True
                if not part and not raw:
                    break
        except zlib.error:
            break
        if not d.eof:
            break
        raw = d.unused_data
    if len(held) > (overlap if again else 0):
        yield bytes(held)


def _readable(raw: bytes) -> str | None:
    """Bytes as text, if at most a quarter of it is broken or control characters."""
    text = raw.decode("utf-8", "replace")
    if len(text) < 6:
        return None
    bad = text.count("\ufffd") + sum(map(text.count, _CONTROLS)) if not text.isprintable() or "\ufffd" in text else 0
    return text if 4 * bad <= len(text) else None


_CONTROLS = [chr(c) for c in range(32) if chr(c) not in "\t\n\r"]


def _texts_in(raw: bytes, bound: int, overlap: int, anywhere: bool = False) -> Iterator[str]:
    """The texts in some bytes: themselves, and what streams in them unfold to, again and again. anywhere: streams may start later, too."""
    work, seen = [(raw, anywhere)], set()
    while work:
        raw, anywhere = work.pop()
        key = hashlib.blake2b(raw, digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        starts = [m.start() for m in _STREAM.finditer(raw)] if anywhere else [0]
        unfolded = False
        for at in starts:
            for window in _windows(raw[at:] if at else raw, bound, overlap):
                unfolded = True
                work.append((window, False))
        if not unfolded and (text := _readable(raw)) is not None:
            yield text


def _decoded(token: str, probe: bool = False) -> Iterator[bytes]:
    """The bytes that a base64 (or hex) token stands for, if it is one. probe: of its start only."""
    body = token.rstrip("=")
    if probe:
        body = body[:64]
    if len(body) % 4 != 1:
        try:
            yield base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            pass
    if len(body) % 2 == 0 and _HEXED.fullmatch(body):
        yield bytes.fromhex(body)


_HEXED = re.compile(r"[0-9A-Fa-f]+")
_JOIN = re.compile(r"\s+|(?:\\r)?\\n")
_AFTER = re.compile(r"[/_-](?=[A-Za-z0-9+][A-Za-z0-9+/_-]{15})")


def _promising(raw: bytes) -> bool:
    return _STREAM.match(raw) is not None or _readable(raw) is not None


def _token_texts(m: re.Match, bound: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """The texts in a token: in all of its lines, in its first line, or else in what follows a slash, dash or underscore; each with its start and end."""
    whole, first = m.group(), m.group(1)
    tries = [(_JOIN.sub("", whole), m.start(), m.end())] if m.group(2) else []
    tries.append((first, m.start(), m.end(1)))
    found = False
    for token, start, end in tries:
        for raw in _decoded(token):
            for text in _texts_in(raw, bound, overlap):
                found = True
                yield text, start, end
    if found:
        return
    for cut in _AFTER.finditer(first):
        start = m.start() + cut.end()
        if any(map(_promising, _decoded(first[cut.end() :], True))):
            tokens = [(_JOIN.sub("", whole[cut.end() :]), m.end())] if m.group(2) else []
            for token, end in [*tokens, (first[cut.end() :], m.end(1))]:
                for raw in _decoded(token):
                    for text in _texts_in(raw, bound, overlap):
                        yield text, start, end


class Layer:
    """A text inside another. Of its pieces, each from `at` on, the plain ones are copies of the outer text from `source` on; the others stand for source to end."""

    def __init__(self, text: str, outer: Layer | None = None):
        self.text, self.outer = text, outer
        self.at: list[int] = []
        self.source: list[int] = []
        self.end: list[int] = []
        self.plain: list[bool] = []

    def add(self, at: int, source: int, end: int, plain: bool) -> None:
        self.at.append(at)
        self.source.append(source)
        self.end.append(end)
        self.plain.append(plain)

    def fresh(self, start: int, end: int) -> bool:
        """Whether a character from start to end isn't a copy."""
        if self.outer is None:
            return True
        return not all(self.plain[bisect_right(self.at, start) - 1 : bisect_right(self.at, end - 1)])

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """The span of the outermost text that start to end came from."""
        layer = self
        while layer.outer is not None:
            i, j = bisect_right(layer.at, start) - 1, bisect_right(layer.at, end - 1) - 1
            a = layer.source[i] + (start - layer.at[i] if layer.plain[i] else 0)
            b = layer.source[j] + end - layer.at[j] if layer.plain[j] else layer.end[j]
            start, end, layer = a, b, layer.outer
        return start, end


def _unslash(run: str) -> bytes:
    out, last = bytearray(), 0
    for m in _SLASHED.finditer(run):
        out += run[last : m.start()].encode("latin-1", "replace")
        out.append(int(m.group(1), 16) if m.group(1) else _NAMED.get(m.group(2), ord(m.group(2)) & 255))
        last = m.end()
    return bytes(out + run[last:].encode("latin-1", "replace"))


def _unwrap(outer: Layer, bound: int, overlap: int) -> Iterator[Layer]:
    """The layers directly inside a layer: its text with all escapes resolved, and the contents of each encoded token and each escaped stream."""
    text = outer.text

    def inside(content: str, start: int, end: int) -> Layer:
        layer = Layer(content, outer)
        layer.add(0, start, end, False)
        return layer

    escapes = "%" in text or "\\" in text or "&#" in text
    runs = [(m.start(), m.end(), out) for m in _ESCAPE.finditer(text) if (out := _unescape(m.group()))] if escapes else []
    if runs:
        parts, layer, size, last = [], Layer("", outer), 0, 0
        for start, end, out in [*runs, (len(text), len(text), "")]:
            if start > last:
                layer.add(size, last, start, True)
                parts.append(text[last:start])
                size += start - last
            if out:
                layer.add(size, start, end, False)
                parts.append(out)
                size += len(out)
            last = end
        layer.text = "".join(parts)
        yield layer
    for pattern, raw in ((_PERCENT_BYTES, urllib.parse.unquote_to_bytes), (_SLASH_BYTES, _unslash)) if escapes else ():
        for m in pattern.finditer(text):
            data = raw(m.group())
            if _STREAM.search(data):
                for content in _texts_in(data, bound, overlap, True):
                    yield inside(content, m.start(), m.end())
    for m in _BASE64.finditer(text):
        for content, start, end in _token_texts(m, bound, overlap):
            yield inside(content, start, end)


def scan(text: str | None, bound: int = 1 << 26, overlap: int = 1 << 20) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """The base findings, all findings, and how many layers were read.

    A compressed stream is read to its end; one that unfolds to more than bound bytes is several layers, each of which begins with the last `overlap` bytes of the one before."""
    text = text or ""
    base = base_matches(text)
    every, seen = set(base), {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work, layers = [Layer(text)], 1
    while work:
        for inner in _unwrap(work.pop(), bound, overlap):
            place = inner.origin(0, len(inner.text))
            key = hashlib.blake2b(inner.text.encode("utf-8", "surrogatepass") + repr(place).encode(), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            for start, kind, end in base_matches(inner.text):
                if inner.fresh(start, end):
                    a, b = inner.origin(start, end)
                    every.add((a, kind, b))
            work.append(inner)
    return base, sorted(every), layers


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long"


def scan_documents(docs: DataFrame, bound: int = 1 << 26) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts of base findings, base spans, all spans, layers read."""

    def run(batches):
        for batch in batches:
            rows = [scan(text.as_py(), bound) for text in batch.column(1)]
            count = lambda k: pa.array([sum(x[1] == k for x in base) for base, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(0), count(1), count(2), pa.array([_written(b) for b, _, _ in rows], pa.string()), pa.array([_written(e) for _, e, _ in rows], pa.string()), pa.array([n for _, _, n in rows], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.released(run), SCHEMA)


def redact(text: str, spans: str) -> str:
    """text with each finding replaced by its kind in brackets; findings that overlap become one."""
    merged: list[list] = []
    for kind, start, end in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)), key=lambda x: x[1:]):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    parts, last = [], 0
    for kind, start, end in merged:
        parts += [text[last:start], f"[{kind}]"]
        last = end
    return "".join([*parts, text[last:]])


def redact_documents(docs: DataFrame, bound: int = 1 << 26) -> DataFrame:
    """The rows of docs, all columns, with findings in text replaced; n_chars, if there is one, counts the new text."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            new = []
            for t in texts:
                found = _written(scan(t, bound)[1])
                new.append(redact(t, found) if found else t)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, columns[names.index("text")].type)
            if "n_chars" in names and pa.types.is_integer(columns[names.index("n_chars")].type):
                old = columns[names.index("n_chars")]
                columns[names.index("n_chars")] = pa.array([n if a is b or a == b else len(b) for n, a, b in zip(old.to_pylist(), texts, new, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(common.released(run), docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_layers")

