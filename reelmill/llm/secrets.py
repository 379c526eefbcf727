"""Secret scans with a recursive decoding worklist.

A document's text is the first layer. Every layer is scanned for secrets and for encoded parts: URL
escapes, Unicode escapes, base64 runs and compressed data. Each decoded part becomes a layer of its
own, whatever its bytes are, and joins the worklist, unless the same layer has been seen in this document, so that data which
decode to themselves end the search. The list runs dry when nothing decodes any more. What is found
in a layer is mapped back to the characters of the text that hold it: URL and Unicode escapes
character by character, base64 and compressed data to the whole run.

All streams of a compressed run are unpacked, one after the other. What is larger than ``LAYER_BYTES``
is searched in windows of that size, which overlap by a quarter, one at a time. Only a decompression
bomb, beyond that size and more than ``BOMB`` times its run, is given up there and counted in ``oversized``.
An encoded run longer than the overlap that crosses the end of a window is read in two parts.

Base patterns are applied leftmost and non-overlapping; matches that fail their length are dropped
without another try. Texts without any mark of a secret or an encoding are passed over on their bytes.

Defined results: a null or empty text has no findings; equal texts have equal findings; other columns
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from reelmill.llm.batches import buffer, text_slices

KINDS = ("assign", "access", "hex")
LAYER_BYTES, BOMB = 32 << 20, 200
#: Bytes that are read, fed to Zstandard and unpacked at once.
READ, FEED, PIECE = 1 << 14, 1 << 8, 1 << 20
#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
VALUE_LENGTH, ACCESS_LENGTH = 6, 20

#: Bytes without which a text has no base match, and the encodings' marks.
WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
MARKS = re.compile(rb"AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f]{2}|&#[xX0-9]|[A-Za-z0-9+/_-]{16}")
ESCAPED = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
#: The last line after full ones may have any length.
BASE64 = re.compile(r"(?:(?:[A-Za-z0-9+/_-]{60,}\r?\n)+[A-Za-z0-9+/_-]*|[A-Za-z0-9+/_-]{16,})={0,2}")
URL_SAFE = str.maketrans("-_", "+/", "\r\n=")


def base_matches(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, in characters."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= VALUE_LENGTH]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Places:
    """Where the characters of a text lie in the one that it was made from, and through it in the document.

    The text is segments: unchanged ones, and runs of characters that stand for one run of the other
    text. Only where segments begin is kept, so an escape costs a few numbers however long the text is.
    """

    def __init__(self, segments: list[tuple[int, int, int]], outer: Places | None):
        """(first character, first in the other text, length of the run there or 0 if unchanged) of each segment."""
        self.at, self.base, self.run = (np.array(c, np.int64) for c in zip(*segments))
        self.outer = outer

    def span(self, first: int, last: int) -> tuple[int, int]:
        i, j = np.searchsorted(self.at, [first, last - 1], side="right") - 1
        start = self.base[i] + (0 if self.run[i] else first - self.at[i])
        end = self.base[j] + (self.run[j] or last - self.at[j])
        return self.outer.span(int(start), int(end)) if self.outer is not None else (int(start), int(end))


class Layer:
    """Decoded text and where its characters lie in the document: as ``places`` tell, all at ``span``, or where they are."""

    def __init__(self, text: str, via: str, depth: int, places: Places | None = None, span=None, window=False):
        self.text, self.via, self.depth, self.places, self.span, self.window = text, via, depth, places, span, window

    def place(self, first: int, last: int) -> tuple[int, int]:
        if self.span is not None:
            return self.span
        return (first, last) if self.places is None else self.places.span(first, last)

    def inside(self, text: str, via: str, first: int, last: int, window: bool = False) -> Layer:
        """A layer whose characters all stand for one run of this one; ``window``: one of several, to be searched at once."""
        return Layer(text, f"{self.via}>{via}" if self.via else via, self.depth + 1, span=self.place(first, last), window=window)

    def aligned(self, pieces: list[tuple[str, int, int]], via: str) -> Layer:
        """The whole layer with some runs replaced: (characters, start, end), each character at its own place."""
        via = f"{self.via}>{via}" if self.via else via
        text, segments, size, at = [], [], 0, 0

        def add(chars: str, base: int, run: int) -> None:
            nonlocal size
            if chars:
                text.append(chars)
                segments.append((size, base, run))
                size += len(chars)

        for chars, first, last in pieces:
            add(self.text[at:first], at, 0)
            add(chars, first, last - first)
            at = last
        add(self.text[at:], at, 0)
        if self.span is not None or not segments:
            return Layer("".join(text), via, self.depth + 1, span=self.span)
        return Layer("".join(text), via, self.depth + 1, Places(segments, self.places))


def readings(data: bytes) -> list[str]:
    """Decoded bytes as text, whatever they are: as UTF-8 with replacements, and without zero bytes if there are any.

    The latter is how UTF-16 and UTF-32 of either order show their ASCII characters, of which the
    patterns and the encodings consist.
    """
    found = [data.decode("utf-8", "replace")]
    return [*found, data.replace(b"\0", b"").decode("utf-8", "replace")] if b"\0" in data else found


#: Where compressed data may begin: gzip, zlib, bz2, Zstandard.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17\x72)|\x28\xb5\x2f\xfd")


def alignments(run: str) -> Iterator[bytes]:
    """The bytes of a base64 run from its first, second, third and fourth character on."""
    for shift in range(4):
        part = run[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        if len(part) > 1:
            yield base64.b64decode(part + "=" * (-len(part) % 4))


def plainly(data: bytes) -> bool:
    """Whether bytes are text without any odd character, so that no other alignment is meant."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable()


def opener(head: bytes):
    """A reader for the compressed data that begin so, or None."""
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd" or (head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5):  # a frame, or one to skip
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    return None


class Source:
    """Pieces of bytes, to be read by length."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.head = pieces, b""

    def peek(self, n: int) -> bytes:
        while len(self.head) < n and (piece := next(self.pieces, None)) is not None:
            self.head += piece
        return self.head[:n]

    def read(self, n: int) -> bytes:
        out = self.peek(n)
        self.head = self.head[len(out) :]
        return out


def expanded(source: Source, ends: list[int] | None = None) -> Iterator[bytes]:
    """Pieces of what the compressed streams in a row hold, up to the first error or other bytes; ``ends`` gets their ends."""
    try:
        head = source.read(READ)
        at = len(head)
        while (reader := opener(head)) is not None:
            while not reader.eof:
                if hasattr(reader, "needs_input"):  # bz2
                    piece, head = reader.decompress(head, PIECE), b""
                    hungry = reader.needs_input
                elif hasattr(reader, "copy"):  # zlib
                    piece = reader.decompress(head, PIECE)
                    head = reader.unconsumed_tail
                    hungry = not head and len(piece) < PIECE
                else:
                    piece, head = reader.decompress(head[:FEED]), head[FEED:]
                    hungry = not head
                if piece:
                    yield piece
                if not reader.eof and hungry:
                    head = source.read(READ)
                    at += len(head)
                    if not head:
                        return
            head = reader.unused_data + head
            if ends is not None:
                ends.append(at - len(head))
            more = source.read(READ) if len(head) < READ else b""
            at, head = at + len(more), head + more
    except (zlib.error, OSError, ValueError, EOFError):
        return
    except Exception as error:  # zstandard has an error class of its own
        if type(error).__name__ != "ZstdError":
            raise


def pieces_of(data) -> Iterator[bytes]:
    view = memoryview(data)
    return (bytes(view[i : i + READ]) for i in range(0, len(view), READ))


def unpack(data: bytes) -> bytes | None:
    """Decompressed bytes; None if the data are not compressed; OverflowError beyond the limit."""
    if opener(bytes(data[:4])) is None:
        return None
    out = bytearray()
    for piece in expanded(Source(pieces_of(data))):
        out += piece
        if len(out) > LAYER_BYTES:
            raise OverflowError
    return bytes(out) or None


def streams_end(data) -> int:
    """Where the complete streams at the beginning of ``data`` end."""
    ends, size = [0], 0
    for piece in expanded(Source(pieces_of(data)), ends):
        size += len(piece)
        if size > max(LAYER_BYTES, BOMB * len(data)):
            return len(data)
    return ends[-1]


def unpacked_windows(data: bytes) -> Iterator[bytes | None]:
    """What a large run holds, in overlapping windows, then what that holds if it is compressed again; None for a bomb."""
    source, levels, known = Source(pieces_of(data)), 0, set()
    while opener(source.peek(4)) is not None:
        nested = Source(expanded(source))
        again, size, window, digest = nested.peek(4), 0, bytearray(), hashlib.sha256()
        while piece := nested.read(PIECE):
            size += len(piece)
            window += piece
            digest.update(piece)
            while len(window) >= LAYER_BYTES:
                yield bytes(window[:LAYER_BYTES])
                del window[: LAYER_BYTES - LAYER_BYTES // 4]
            if size > max(LAYER_BYTES, BOMB * len(data)):
                yield None
                return
        yield bytes(window)
        if opener(again) is None or digest.digest() in known:
            return
        known.add(digest.digest())
        # One level further in, from the beginning: nothing of the levels is kept.
        levels += 1
        source = Source(pieces_of(data))
        for _ in range(levels):
            source = Source(expanded(source))


def _utf8_pieces(data: bytes, at: int) -> Iterator[tuple[str, int, int]]:
    """Characters of percent-escaped bytes with their places; bytes that are no text stay escaped."""
    i = 0
    while i < len(data):
        size = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4
        try:
            yield data[i : i + size].decode("utf-8"), at + 3 * i, at + 3 * min(i + size, len(data))
        except UnicodeDecodeError:
            size = 1
        i += size


def _unicode_char(m: re.Match) -> str | None:
    t = m[0]
    if t.startswith("&#"):
        code = int(t[3:-1], 16) if t[2] in "xX" else int(t[2:-1])
    elif len(t) == 12:
        high, low = int(t[2:6], 16), int(t[8:], 16)
        code = 0x10000 + ((high - 0xD800) << 10) + low - 0xDC00
    else:
        code = int(t[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def decoded(layer: Layer) -> Iterator[Layer | None]:
    """All layers one step further in; None for one that is too large."""
    text = layer.text

    def bytes_inside(data: bytes, via: str, first: int, last: int, before: tuple[bytes, ...] = ()) -> Iterator[Layer | None]:
        before = (*before, data)
        try:
            opened = unpack(data)
        except OverflowError:
            for part in unpacked_windows(data):
                for plain in [None] if part is None else readings(part):
                    yield None if plain is None else layer.inside(plain, f"{via}>compressed", first, last, window=True)
            return
        if opened is not None:
            for plain in readings(opened):
                yield layer.inside(plain, f"{via}>compressed", first, last)
            if opened not in before:  # perhaps compressed once more
                yield from bytes_inside(opened, f"{via}>compressed", first, last, before)
        elif via == "base64" and isinstance(data, bytes):
            for plain in readings(data):
                yield layer.inside(plain, via, first, last)

    if "%" in text:
        pieces = []
        for m in ESCAPED.finditer(text):
            data = bytes.fromhex(m[0].replace("%", ""))
            yield from (x for x in bytes_inside(data, "url", m.start(), m.end()))
            pieces += _utf8_pieces(data, m.start())
        if pieces:
            yield layer.aligned(pieces, "url")
    if "\\" in text or "&#" in text:
        pieces = [(c, m.start(), m.end()) for m in UNICODE.finditer(text) if (c := _unicode_char(m)) is not None]
        if pieces:
            yield layer.aligned(pieces, "unicode")
    for m in BASE64.finditer(text):
        # What is glued to a run shifts its alignment; what is compressed may begin anywhere in it.
        for data in alignments(m[0].translate(URL_SAFE)):
            yield from bytes_inside(data, "base64", m.start(), m.end())
            done = None
            for c in MAGIC.finditer(data, 1):
                done = streams_end(data) if done is None else done
                if c.start() >= done:
                    part = memoryview(data)[c.start() :]
                    yield from bytes_inside(part, "base64", m.start(), m.end())
                    done = c.start() + streams_end(part)
            if plainly(data):
                break


def scan_text(text: str) -> tuple[list[tuple[str, int, int, int, str]], int, int]:
    """Findings (kind, start, end, depth, way of decoding), layers, and layers that were too large."""
    seen: set[tuple[bytes, tuple | None]] = set()
    found: dict[tuple[str, int, int], tuple[int, str]] = {}
    layers = oversized = 0

    def search(start: Layer) -> None:
        nonlocal layers, oversized
        work = deque([start])
        while work:
            layer = work.popleft()
            # The same text from another run is another place, so the place is part of the key.
            raw = layer.text.encode("utf-8", "surrogatepass")
            key = (hashlib.sha256(raw).digest(), layer.span)
            if key in seen:
                continue
            seen.add(key)
            layers += 1
            if not worth_scanning(raw):
                continue
            for kind, first, last in base_matches(layer.text):
                place = (kind, *layer.place(first, last))
                if place not in found or layer.depth < found[place][0]:
                    found[place] = (layer.depth, layer.via)
            for inner in decoded(layer):
                if inner is None:
                    oversized += 1
                elif inner.window:
                    search(inner)
                else:
                    work.append(inner)

    search(Layer(text, "", 0))
    rows = [(k, s, e, depth, via) for (k, s, e), (depth, via) in found.items()]
    return sorted(rows, key=lambda r: (r[1], KINDS.index(r[0]), r[2])), layers, oversized


def worth_scanning(raw: bytes) -> bool:
    """Whether a text can have a finding: a mark, or a word of the first pattern in either case."""
    if MARKS.search(raw):
        return True
    low = raw.lower()
    return any(w in low for w in WORDS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, findings (kind, start, end, depth, via) by start, layers, oversized; depth 0 is the text itself."""
    finding = StructType([
        StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
        StructField("depth", IntegerType()), StructField("via", StringType()),
    ])
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("findings", ArrayType(finding)),
        StructField("layers", IntegerType()), StructField("oversized", IntegerType()),
    ])
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("via", pa.string())])

    def work(batches):
        for rows in text_slices(batches):
            data, places = buffer(rows.column("text"))
            data, places = data.tobytes(), places.tolist()
            found, layers, oversized = [], [], []
            for first, last in zip(places, places[1:]):
                raw = data[first:last]
                hits, n, large = scan_text(raw.decode("utf-8")) if worth_scanning(raw) else ([], 1, 0)
                found.append([dict(zip(("kind", "start", "end", "depth", "via"), h)) for h in hits])
                layers.append(n)
                oversized.append(large)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(found, pa.list_(struct)), pa.array(layers, pa.int32()), pa.array(oversized, pa.int32())], names=schema.names
            )

    return docs.select("doc_id", "text").mapInArrow(work, schema)
