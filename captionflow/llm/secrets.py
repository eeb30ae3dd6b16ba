"""Secret scans with a recursive decoding worklist.

The whole text is scanned; then every encoded stretch (URL escapes, Unicode escapes,
base64, and compressed bytes inside base64) is unwrapped into a new layer, which is
scanned and unwrapped in turn until nothing new appears. What cannot be decoded in a
stretch is replaced, not a reason to leave the rest. A layer whose content was
seen before is not opened again, so encodings that contain themselves end. Every
character of a layer keeps the span of the original text that it came from; findings
are reported as spans of the original text.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_or_empty

# Kinds in their order, and the patterns of the base findings.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_RUN = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
UNICODE_ONE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs over single line ends, as in MIME, PEM and quoted mail, of lines of any width.
BASE64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{4,}\r?\n[\x20\t>]*)+[A-Za-z0-9+/_-]+={0,2}")
LEAST_BASE64 = 16
#: Compressed layers are streams: they are decoded in pieces of this many bytes, whatever
#: their size, and so are compressed layers in them. A piece is cut behind the last sign
#: that no finding and no encoding has; what follows is carried over to the next piece.
PIECE = 1 << 23
#: Bounds that keep a decompression bomb from filling a worker or its time: one unbroken
#: run of signs in a stream, in characters, and all bytes decoded from one run of the text.
#: What exceeds them is counted (``n_unopened``), and redaction takes the run out whole.
MAX_RUN, MAX_DECODED = 1 << 26, 1 << 32
#: The signs of findings and encodings.
RUN_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=:\"'%\\{}- \r\n\t>"
REDACTED = "[SECRET]"


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the findings in one layer, by kind leftmost and not
    overlapping; matches that are too short are dropped."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# ---------------------------------------------------------------- layers
class Layer:
    """A text and, for each of its characters, the span of the original text."""

    def __init__(self, text: str, first: np.ndarray | int | None = None, last: np.ndarray | int | None = None):
        self.text, self.first, self.last = text, first, last

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.first is None:
            return start, end
        if isinstance(self.first, int):
            return self.first, self.last
        return int(self.first[start]), int(self.last[end - 1])

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """This layer with stretches (start, end, new text) replaced."""
        text, first, last, at = [], [], [], 0
        for start, end, new in [*parts, (len(self.text), len(self.text), "")]:
            text += [self.text[at:start], new]
            if not isinstance(self.first, int):
                keep = np.arange(at, start)
                first.append(keep if self.first is None else self.first[at:start])
                last.append(keep + 1 if self.first is None else self.last[at:start])
                if new:
                    a, z = self.span(start, end)
                    first.append(np.full(len(new), a))
                    last.append(np.full(len(new), z))
            at = end
        if isinstance(self.first, int):
            return Layer("".join(text), self.first, self.last)
        return Layer("".join(text), np.concatenate(first), np.concatenate(last))


def _from_url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _from_unicode(run: str) -> str:
    points = [int(max(m), 16) for m in UNICODE_ONE.findall(run)]
    text = "".join(chr(p) if p <= 0x10FFFF else "\N{REPLACEMENT CHARACTER}" for p in points)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


#: Where compressed bytes may start inside other bytes.
COMPRESSED_INSIDE = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
COMPRESSED = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01-\xff]", re.DOTALL)


class _Source(io.RawIOBase):
    """Pieces of bytes as a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest:
            piece = next(self.pieces, None)
            if piece is None:
                return 0
            self.rest = piece
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of gzip, zlib, bzip2, xz or zstandard bytes, of all members one after
    the other, in pieces; nothing for others. Of broken members what comes before the
    fault; after the last member what follows it."""
    data, members = next(pieces, b""), 0
    while len(data) < 16 and (more := next(pieces, None)) is not None:
        data += more
    try:
        while COMPRESSED.match(data):
            members += 1
            if data[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard
                source = _Source(itertools.chain([data], pieces))
                reader = zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True)
                while out := reader.read(PIECE):
                    yield out
                return
            if data[:1] in b"\x1f\x78":
                d = zlib.decompressobj(47)  # gzip or zlib
            else:
                d = bz2.BZ2Decompressor() if data[:3] == b"BZh" else lzma.LZMADecompressor()
            is_zlib = hasattr(d, "unconsumed_tail")
            while not d.eof:
                out = d.decompress(data, PIECE)
                data = d.unconsumed_tail if is_zlib else b""
                if out:
                    yield out
                if not d.eof and not data and (is_zlib or d.needs_input):
                    if (data := next(pieces, b"")) == b"":
                        return
            data = d.unused_data.lstrip(b"\0")  # members may be padded
            while len(data) < 16 and (more := next(pieces, None)) is not None:
                data = (data + more).lstrip(b"\0")
        if members and data:
            yield data
            yield from pieces
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return
    except Exception as e:
        if type(e).__name__ != "ZstdError":
            raise


class TooMuch(Exception):
    """More bytes than one run may decode to."""


def _contents(data: bytes) -> Iterator[str | None]:
    """The texts of what bytes are compressed from, through any number of layers; None
    stands for a run that is too long. Layers that fit one piece are compared with those
    before, so bytes that are compressed from themselves end; larger ones end by size."""
    decoded, seen, level = 0, {hashlib.sha256(data).digest()}, iter([data])

    def counted(pieces: Iterator[bytes]) -> Iterator[bytes]:
        nonlocal decoded
        for piece in pieces:
            decoded += len(piece)
            if decoded > MAX_DECODED:
                raise TooMuch
            yield piece
    try:
        while True:
            pieces = counted(_inflated(level))
            first = next(pieces, None)
            if first is None:
                return
            second = next(pieces, None)
            if second is None:
                digest = hashlib.sha256(first).digest()
                if digest in seen:
                    return
                seen.add(digest)
                yield from _texts_of(first)
                level = iter([first])
            elif COMPRESSED.match(first):
                level = itertools.chain([first, second], pieces)
            else:
                yield from _segments(itertools.chain([first, second], pieces))
                return
            if not COMPRESSED.match(first):
                return
    except TooMuch:
        yield None


def _segments(pieces: Iterator[bytes]) -> Iterator[str | None]:
    """The text of a stream in segments, cut where no finding or encoding can go on, and
    that without its NULs if it has any; None where a run is too long."""
    for_plain, for_wide = (codecs.getincrementaldecoder("utf-8")("replace") for _ in range(2))
    held, wide, nuls = "", "", False

    def cut(text: str) -> tuple[str, str]:
        kept = text.rstrip(RUN_SIGNS)
        return kept, text[len(kept):]
    for piece in pieces:
        nuls = nuls or b"\0" in piece
        done, held = cut(held + for_plain.decode(piece))
        yield done
        if nuls:
            done, wide = cut(wide + for_wide.decode(piece.replace(b"\0", b"")))
            yield done
        else:
            wide = held
            for_wide.setstate(for_plain.getstate())
        if max(len(held), len(wide)) > MAX_RUN:
            yield None
            yield held  # its parts are scanned all the same
            yield wide
            held = wide = ""
    yield held
    if nuls:
        yield wide


BASE64_SIGNS = str.maketrans("-_", "+/", "=\r\n\t >")


def _base64_bytes(body: str) -> bytes:
    """What base64 signs, of any number, decode to."""
    body = body[:len(body) - 1] if len(body) % 4 == 1 else body
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _texts_of(data: bytes) -> Iterator[str]:
    """The text of bytes, and that of UTF-16 or UTF-32 among them."""
    yield data.decode("utf-8", "replace")
    if b"\0" in data:
        yield data.replace(b"\0", b"").decode("utf-8", "replace")


def _opened(data: bytes) -> Iterator[str | None]:
    """The texts of bytes and of what they are compressed from; None stands for what is
    too large."""
    yield from _texts_of(data)
    if COMPRESSED.match(data):
        yield from _contents(data)


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return b"\0" not in data


def _starts(data: bytes) -> bool:
    """False where bytes only look like the header of zlib or gzip data."""
    try:
        return data[:1] not in b"\x1f\x78" or zlib.decompressobj(47).decompress(data) is not None
    except zlib.error:
        return False


def _from_base64(run: str) -> Iterator[str | None]:
    """The texts in a base64 run (None as above). If it is no text as it stands, other
    signs may be in front: then it is read at its four alignments, with any bytes before
    the text or the compressed bytes. What is no text gives signs that no finding has."""
    body = run.translate(BASE64_SIGNS)
    if len(body) < LEAST_BASE64:
        return
    data = _base64_bytes(body)
    if _is_text(data) and len(body) % 4 != 1:
        yield from _opened(data)
        return
    for k in range(4):
        data = _base64_bytes(body[k:])
        yield from _opened(data)
        for m in COMPRESSED_INSIDE.finditer(data):
            if m.start() and _starts(data[m.start():m.start() + 256]):
                yield from _contents(data[m.start():])


def _unwrapped(layer: Layer):
    """The layers one decoding below, and the spans of runs with more than is opened."""
    for mark, pattern, decode in (("%", URL_RUN, _from_url), ("\\", UNICODE_RUN, _from_unicode)):
        if mark in layer.text:
            parts = [(m.start(), m.end(), decode(m[0])) for m in pattern.finditer(layer.text)]
            if parts:
                yield layer.replaced(parts)
    for m in itertools.chain(BASE64_RUN.finditer(layer.text), BASE64_LINES.finditer(layer.text)):
        a, z = layer.span(m.start(), m.end())
        for new in _from_base64(m[0]):
            yield (a, z) if new is None else Layer(new, a, z)


def scan_layers(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(base findings, all findings, spans of the runs not opened in full) of a text;
    findings are (start, kind, end) in code points of the text, sorted, none twice. Large
    layers come as segments, one at a time."""
    base = base_findings(text)
    found, seen, large = set(base), set(), []
    work = [_unwrapped(Layer(text))]
    while work:
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        if isinstance(below, tuple):
            if below not in large:
                large.append(below)
            continue
        where = (below.first, below.last) if isinstance(below.first, int) else None
        key = (hashlib.sha256(below.text.encode("utf-8", "surrogatepass")).digest(), where)
        if key in seen:
            continue
        seen.add(key)
        for start, kind, end in base_findings(below.text):
            a, z = below.span(start, end)
            found.add((a, kind, z))
        work.append(_unwrapped(below))
    return base, sorted(found), large


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """(base findings, all findings, number of runs not opened in full) of a text."""
    base, found, large = scan_layers(text)
    return base, found, len(large)


def span_list(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


# ---------------------------------------------------------------- Spark
def scan_column(text: Column) -> Column:
    """Struct of n_assign, n_access, n_hex, base_spans, spans, n_unopened."""
    @F.arrow_udf("n_assign long, n_access long, n_hex long, base_spans string, spans string, n_unopened long")
    def secrets(column: pa.Array) -> pa.Array:
        out = []
        for value in column:
            base, all_found, unopened = scan(value.as_py())
            n = [sum(1 for x in base if x[1] == k) for k in range(3)]
            out.append((*n, span_list(base), span_list(all_found), unopened))
        names = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_unopened"]
        cols = list(zip(*out)) if out else [()] * 6
        return pa.StructArray.from_arrays(
            [pa.array(c, pa.string() if n in ("base_spans", "spans") else pa.int64()) for n, c in zip(names, cols)], names)
    return secrets(F.coalesce(text, F.lit("")))


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans, n_unopened) for each
    row. Null and empty texts have no findings; repeated rows and null ids stay; an
    empty table gives no rows; other columns are not read. Spans are
    ``kind:start:end``, sorted by start, then kind, comma-joined."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", scan_column(F.col("text")).alias("s")).select("doc_id", "s.*")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch that findings cover replaced by one mark."""
    out, at, until = [], 0, -1
    for a, _, z in spans:
        if a >= until:
            if until >= 0:
                at = until
            out += [text[at:a], REDACTED]
            until = z
        else:
            until = max(until, z)
    return "".join(out) + text[until:] if until >= 0 else text


def redacted_text(text: str) -> str:
    """``text`` without its findings and without the runs that were not opened in full."""
    _, found, large = scan_layers(text)
    return redact(text, sorted(found + [(a, len(KINDS), z) for a, z in large]))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` and runs not opened in full replaced, and ``n_chars``, if there is
    such a column, counted anew; null texts stay null, other columns stay, whatever their
    names. Repeated rows and null ids are redacted one by one, texts of any length whole; an
    empty table stays empty."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def redacted(column: pa.Array) -> pa.Array:
        return pa.array([None if (t := v.as_py()) is None else redacted_text(t) for v in column], pa.string())
    out = docs.withColumn("text", redacted("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_or_empty()).cast(kind)))
    return out.select(*docs.columns)
