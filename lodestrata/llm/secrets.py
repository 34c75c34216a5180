r"""Secret scans over recursively decoded layers.

A text is the first layer on a worklist. Each layer is scanned by the rules,
then unwrapped: percent escapes, Unicode escapes (\uXXXX, \xXX, &#N;) and base64
tokens. Bytes that any of these give are decompressed (gzip, zlib, bzip2,
zstandard; every member, stream or frame) as long as they are compressed. Every
result is a new layer, until nothing unwraps: nesting has no depth limit. A layer
that equals one of those it came from closes a cycle and is left out. Each layer
maps its characters to those of the text, so a finding is placed in the text
however deep it lay.

Texts are first sifted for the literals and wrappings of which every rule needs
one, so the sift is wider than the rules; there is no shuffle.

Defined results: null and empty texts give nothing; a row with a null doc_id is
scanned. Repeated rows are each reported. A finding that several layers show at
the same place is reported for the outermost. Compressed data that is damaged is
read up to the damage. Bytes that aren't UTF-8 are scanned with replacements.
Data that inflates beyond `most` bytes is reported by the rule "oversized-layer"
and scanned in windows of `most` bytes, which overlap by an eighth, as it is
read: a secret longer than the overlap may be reported in part. Other columns
aren't read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import chunks

MOST = 64 << 20
OUT = "doc_id long, rule string, start int, `end` int, path string, secret_sha256 string, length int"

RULES: list[tuple[str, re.Pattern[str]]] = [
    (name, re.compile(p, re.S))
    for name, p in (
        ("aws-access-key", r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Za-z0-9])"),
        ("github-token", r"(?<![A-Za-z0-9])(?P<s>gh[pousr]_[A-Za-z0-9]{36,})"),
        ("google-api-key", r"(?<![A-Za-z0-9])(?P<s>AIza[0-9A-Za-z_-]{35})"),
        ("slack-token", r"(?<![A-Za-z0-9])(?P<s>xox[abprs]-[A-Za-z0-9-]{10,})"),
        ("jwt", r"(?<![A-Za-z0-9])(?P<s>eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
        ("private-key", r"(?P<s>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?)"),
        ("url-password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:(?P<s>[^\s/:@]{3,128})@"),
        ("assigned-secret", r"(?i)(?:key|secret|token|passwd|password|pwd|credential)[\"']?\s{0,8}[:=]\s{0,8}[\"']?(?P<s>[A-Za-z0-9+/_.~!@#$^&*-]{8,}={0,2})"),
    )
]
WRAPPED = r"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x?[0-9A-Fa-f]+;|[A-Za-z0-9+/_-]{16}"
#: A literal of every rule, or a wrapping. Python folds two more letters into k and s.
SIFT = rf"{WRAPPED}|AKIA|ASIA|gh[pousr]_|AIza|xox[abprs]-|eyJ|PRIVATE KEY|://|[kK\x{{212A}}][eE][yY]|(?i:token|pwd|credential|pa[s\x{{017F}}]{{2}}w|[s\x{{017F}}]ecret)"

#: One character at a time, so that spans are exact.
_HEX, _NEXT = "[0-9A-Fa-f]", "%[89ABab][0-9A-Fa-f]"
URL = re.compile(f"%[CDcd]{_HEX}{_NEXT}|%[Ee]{_HEX}{_NEXT}{_NEXT}|%[Ff][0-4]{_NEXT}{_NEXT}{_NEXT}|%{_HEX}{{2}}")
UNICODE = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|x[0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{60,}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")


@dataclass
class Layer:
    text: str
    start: np.ndarray | int  # of each character in the original text; one value where all share a span
    end: np.ndarray | int
    path: tuple[str, ...]
    above: frozenset[bytes]

    def span(self, a: int, b: int) -> tuple[int, int]:
        if isinstance(self.start, int):
            return self.start, int(self.end)
        return int(self.start[a]), int(self.end[b - 1])


def _percent(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")


def _escape(s: str) -> str:
    if s[0] == "&":
        n = int(s[3:-1], 16) if s[2] == "x" else int(s[2:-1])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"
    if s[1] == "x":
        return chr(int(s[2:], 16))
    units = bytes.fromhex(s.replace("\\u", ""))
    return units.decode("utf-16-be", "replace")


def inline(layer: Layer, pattern: re.Pattern[str], decode, name: str) -> Layer | None:
    """The layer with its escapes replaced."""
    parts, starts, ends, at = [], [], [], 0
    whole = isinstance(layer.start, int)

    def plain(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if not whole:
            starts.append(layer.start[a:b])
            ends.append(layer.end[a:b])

    for m in pattern.finditer(layer.text):
        plain(at, m.start())
        new = decode(m.group())
        parts.append(new)
        if not whole:
            a, b = layer.span(m.start(), m.end())
            starts.append(np.full(len(new), a))
            ends.append(np.full(len(new), b))
        at = m.end()
    if not at:
        return None
    plain(at, len(layer.text))
    text = "".join(parts)
    return Layer(text, layer.start if whole else np.concatenate(starts), layer.end if whole else np.concatenate(ends), (*layer.path, name), layer.above)


MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\x28\xb5\x2f\xfd": "zstd"}
#: Percent-encoded bytes, and decoded characters that are such bytes.
ENCODED = re.compile(r"[A-Za-z0-9_.~!*'()%-]+")
BYTES = re.compile(r"(?:\x1f\x8b\x08|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda])[\x00-\xff]*")


def compressed(data: bytes) -> str | None:
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return next((kind for magic, kind in MAGIC.items() if data.startswith(magic)), None)


def _member(data: bytes, kind: str, step: int) -> Iterator[bytes]:
    """Pieces of the first member; returns what follows it. Raises at damage."""
    if kind == "bzip2":
        d = bz2.BZ2Decompressor()
        for at in range(0, len(data), step):
            yield d.decompress(data[at : at + step], PIECE)
            while not d.eof and not d.needs_input:
                yield d.decompress(b"", PIECE)
            if d.eof:
                return d.unused_data + data[at + step :]
        return b""
    if kind == "zstd":
        d = zstandard.ZstdDecompressor().decompressobj()
        for at in range(0, len(data), min(step, 256)):  # a block may give 128 KiB for 4 bytes
            yield d.decompress(data[at : at + min(step, 256)])
            if d.eof:
                return d.unused_data + data[at + min(step, 256) :]
        return b""
    d = zlib.decompressobj(31 if kind == "gzip" else 15)
    for at in range(0, len(data), step):
        yield d.decompress(data[at : at + step], PIECE)
        while d.unconsumed_tail:
            yield d.decompress(d.unconsumed_tail, PIECE)
        if d.eof:
            return d.unused_data + data[at + step :]
    yield d.flush()
    return b""


PIECE = 1 << 20


def pieces(data: bytes, kind: str) -> Iterator[bytes]:
    """The content of every member, up to damage."""
    while data and compressed(data) == kind:
        given = 0
        try:
            run = _member(data, kind, PIECE)
            while True:
                try:
                    piece = next(run)
                except StopIteration as end:
                    data = end.value
                    break
                given += len(piece)
                yield piece
        except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
            # once more byte by byte, for what the piece with the damage gave before it
            try:
                seen = 0
                for piece in _member(data, kind, 1):
                    seen += len(piece)
                    if seen > given:
                        yield piece[-(seen - given) :]
                        given = seen
            except (zlib.error, OSError, EOFError, ValueError, zstandard.ZstdError):
                pass
            return


def inflate(data: bytes, most: int) -> Iterator[tuple[bytes, str, bool]]:
    """Windows of the content of compressed data, the kind, and whether there
    are several; nothing if it isn't compressed or nothing can be read."""
    kind = compressed(data)
    if kind is None:
        return
    held, many = bytearray(), False
    for piece in pieces(data, kind):
        held += piece
        while len(held) > most:
            many = True
            yield bytes(held[:most]), kind, True
            del held[: most - most // 8]
    if held:
        yield bytes(held), kind, many


def _inner(data: bytes, layer: Layer, path: tuple[str, ...], above: frozenset[bytes], span: tuple[int, int], most: int, plain: bool) -> Iterator[Layer]:
    """Layers of bytes: decompressed as long as they are compressed."""
    found = False
    for got, kind, many in inflate(data, most):
        found = True
        digest = hashlib.blake2b(got, digest_size=16).digest()
        if digest not in above:  # else a cycle
            yield from _inner(got, layer, (*path, kind, "oversized") if many else (*path, kind), above | {digest}, span, most, True)
    if plain and not found:
        text = data.decode("utf-8", "replace")
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        yield Layer(text, *span, path, above - {digest})  # the layer adds its own


def unwrapped(layer: Layer, most: int) -> Iterator[Layer]:
    if "%" in layer.text:
        if new := inline(layer, URL, _percent, "url"):
            yield new
        for m in ENCODED.finditer(layer.text):
            if "%" not in m.group():
                continue
            yield from _inner(unquote_to_bytes(m.group()), layer, (*layer.path, "url"), layer.above, layer.span(*m.span()), most, False)
    if ("\\" in layer.text or "&#" in layer.text) and (new := inline(layer, UNICODE, _escape, "unicode")):
        yield new
        for m in BYTES.finditer(new.text):
            yield from _inner(m.group().encode("latin-1"), layer, new.path, layer.above, new.span(*m.span()), most, False)
    for m in BASE64.finditer(layer.text):
        token = re.sub(r"[\r\n=]", "", m.group()).translate({45: 43, 95: 47})
        token = token[: len(token) - (len(token) % 4 == 1)]
        yield from _inner(base64.b64decode(token + "=" * (-len(token) % 4)), layer, (*layer.path, "base64"), layer.above, layer.span(*m.span()), most, True)


def findings(text: str, most: int = MOST) -> list[tuple[str, int, int, str, str]]:
    """rule, start, end, path and secret of each finding of a text."""
    at = np.arange(len(text))
    out: dict[tuple, tuple[int, tuple[str, int, int, str, str]]] = {}

    def put(key: tuple, depth: int, row: tuple[str, int, int, str, str]) -> None:
        if key not in out or depth < out[key][0]:
            out[key] = depth, row

    work: list[Iterator[Layer]] = [iter([Layer(text, at, at + 1, (), frozenset())])]
    while work:  # layers are made as they are needed, so that few are held
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if digest in layer.above:  # a cycle
            continue
        layer.above |= {digest}
        path, depth = ">".join(layer.path), len(layer.path)
        if "oversized" in layer.path:
            a, b = layer.span(0, 1)
            put(("oversized-layer", a, b), depth, ("oversized-layer", a, b, path, ""))
        for rule, pattern in RULES:
            for m in pattern.finditer(layer.text):
                a, b = layer.span(*m.span("s"))
                # one span may hold several secrets of a decoded token
                key = (rule, a, b) if not isinstance(layer.start, int) else (rule, a, b, m.group("s"))
                put(key, depth, (rule, a, b, path, m.group("s")))
        work.append(unwrapped(layer, most))
    return sorted(row for _, row in out.values())


KINDS = pa.schema([("doc_id", pa.int64()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("path", pa.string()), ("secret_sha256", pa.string()), ("length", pa.int32())])


def _scan(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in chunks(batch):
                hit = part.filter(pc.match_substring_regex(part.column("text"), SIFT))
                for i, text in zip(hit.column("doc_id").to_pylist(), hit.column("text").to_pylist()):
                    rows += [(i, r, a, b, p, hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest(), len(s)) for r, a, b, p, s in findings(text, most)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], KINDS.field(c).type) for c in range(len(KINDS))], schema=KINDS)

    return run


def scan(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, rule, start and end (characters of the text), path (the layers,
    outermost first), secret_sha256, length. The secret itself isn't repeated."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_scan(most), OUT)
