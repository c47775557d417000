"""Secret scan with a recursive decoding worklist.

Each text is a first layer. A layer is scanned, then every encoded run in it (percent escapes, unicode escapes, base64,
base64 of gzip, zlib or zstandard) is decoded into a further layer, until no run is left. Of escapes, only the words around
them are a layer, so that a long chain of escapes costs no square. A layer keeps, for each of its
characters, the start and end in the original text that it came from, so whatever is found at any depth maps back. Base64 is
decoded at all four alignments, over line breaks, and as UTF-8 or UTF-16; bytes that are no text stay in the layer. A layer
that was seen before over the same place is not entered again, which ends cycles.
"""
from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import urllib.parse
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import repeat

import zstandard
from pyspark.sql import DataFrame

from .spans import Span, scan_texts

KINDS = ("assign", "access", "hex")
# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so this equals [0-9a-f]+ with short runs dropped
WORDS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_LETTER = "[A-Za-z0-9+/_-]"
#: A run of base64 letters, also over line breaks (real ones or written as \n).
BASE64 = re.compile(rf"(?<!{_LETTER})({_LETTER}{{16,}}+(?:[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*{_LETTER}++)*+)={{0,2}}")
BREAK = re.compile(rf"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*")
#: How gzip, zlib and zstandard begin in base64.
PACKED = re.compile(r"H4sI|KLUv|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]")
#: A layer that has none of these holds no secret and no further layer.
SIGNS = re.compile(rf"password|passwd|secret|token|api_?key|AKIA|[0-9a-f]{{24}}|%[0-9a-f]{{2}}|\\[ux]|&\#[0-9x]|{_LETTER}{{16}}", re.IGNORECASE | re.ASCII)
WORD = re.compile(r"\S+")
#: Words that may be a line of base64, or become one when their escapes are decoded.
LINE = re.compile(r"[A-Za-z0-9+/_%\\&#;{}=-]+")
#: So many bytes of a compressed blob tell whether it is one.
PROBE = 4096
#: What unpacks to more bytes than this is scanned in pieces that overlap.
PIECE = 1 << 26
OVERLAP = 1 << 20


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _unpacked(data: bytes) -> Iterator[bytes]:
    """The content of a compressed blob that data begin with, in pieces; nothing if there is none. A damaged blob gives what comes before the damage."""
    kept = bytearray()
    while data:
        zstd = data[:4] == b"\x28\xb5\x2f\xfd"
        if not zstd and data[:2] != b"\x1f\x8b" and data[:1] != b"\x78":
            break
        unpacker = zstandard.ZstdDecompressor().decompressobj() if zstd else zlib.decompressobj(47)
        at, rest, before = 0, b"", len(kept)
        try:
            while not unpacker.eof and (rest or at < len(data)):
                if zstd:
                    part, at = unpacker.decompress(data[at:at + 512]), at + 512
                else:
                    if not rest:
                        rest, at = data[at:at + (1 << 16)], at + (1 << 16)
                    part = unpacker.decompress(rest, 1 << 22)
                    rest = unpacker.unconsumed_tail
                kept += part
                if len(kept) >= PIECE:
                    yield bytes(kept)
                    del kept[:-OVERLAP]
        except (zlib.error, zstandard.ZstdError):
            break
        data = unpacker.unused_data + data[at:] if unpacker.eof else b""  # further members
    if kept:
        yield bytes(kept)


def _texts(data: bytes) -> Iterator[tuple[str, str]]:
    """data as texts, with their encodings: bytes that are not UTF-8 stay as single characters."""
    yield data.decode("utf-8", "surrogateescape"), "utf-8"
    if b"\0" in data:
        even = data[:len(data) & ~1]
        for name in ("utf-16-le", "utf-16-be"):
            with contextlib.suppress(UnicodeDecodeError):
                yield even.decode(name, "surrogatepass"), name


def _widths(text: str, encoding: str) -> Iterator[int]:
    """The bytes of each character."""
    if encoding == "utf-8":
        return (1 if c < "\x80" or "\udc80" <= c <= "\udcff" else 2 if c < "\u0800" else 3 if c <= "\uffff" else 4 for c in text)
    return (2 if c <= "\uffff" else 4 for c in text)


def _from_base64(letters: str) -> bytes:
    letters = letters[:len(letters) - (len(letters) % 4 == 1)]
    return base64.b64decode(letters + "=" * (-len(letters) % 4))


class _Same(Sequence):
    """One number, size times."""

    def __init__(self, value: int, size: int):
        self.value, self.size = value, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        return _Same(self.value, len(range(self.size)[at])) if isinstance(at, slice) else self.value

    def __iter__(self) -> Iterator[int]:
        return repeat(self.value, self.size)


class _Layer:
    """A decoded text with the place in the original text of each of its characters."""

    def __init__(self, text: str, starts: Sequence[int], ends: Sequence[int], depth: int = 1):
        self.text, self.starts, self.ends, self.depth = text, starts, ends, depth


def _code_point(escape: str) -> int:
    return int(escape[3:-1], 16) if escape[1:3] in ("u{", "#x", "#X") else int(escape[2:-1]) if escape[0] == "&" else int(escape[2:], 16)


def _unescaped(layer: _Layer, pattern: re.Pattern) -> _Layer | None:
    """All percent runs, or all unicode escapes, of a layer decoded at once; None if there are none."""
    text, starts, ends, at = [], array("q"), array("q"), 0
    same = isinstance(layer.starts, _Same)  # then only the text is built

    def put(piece: str, begin: int, end: int) -> None:
        text.append(piece)
        if same:
            return
        starts.extend([layer.starts[begin]] * len(piece))
        ends.extend([layer.ends[end - 1]] * len(piece))

    changed = False
    for m in pattern.finditer(layer.text):
        text.append(layer.text[at:m.start()])
        if not same:
            starts.extend(layer.starts[at:m.start()])
            ends.extend(layer.ends[at:m.start()])
        at, place = m.end(), m.start()
        if pattern is PERCENT:
            for piece in urllib.parse.unquote_to_bytes(m[0]).decode("utf-8", "surrogateescape"):
                width = 3 * len(piece.encode("utf-8", "surrogateescape"))
                if "\udc80" <= piece <= "\udcff":  # not UTF-8: stays as it was written
                    put(layer.text[place:place + 3], place, place + 3)
                else:
                    put(piece, place, place + width)
                    changed = True
                place += width
        else:
            value = _code_point(m[0])
            good = value < 0x110000
            put(chr(value) if good else m[0], m.start(), m.end())
            changed = changed or good
    if not changed:
        return None
    text.append(layer.text[at:])
    if not same:
        starts.extend(layer.starts[at:])
        ends.extend(layer.ends[at:])
    out = "".join(text)
    if pattern is UNICODE and any("\ud800" <= c <= "\udfff" for c in out):
        # pairs of surrogates become one character
        joined, s2, e2, i = [], [], [], 0
        while i < len(out):
            pair = "\ud800" <= out[i] <= "\udbff" and i + 1 < len(out) and "\udc00" <= out[i + 1] <= "\udfff"
            joined.append((out[i] + out[i + 1]).encode("utf-16", "surrogatepass").decode("utf-16") if pair else out[i])
            if not same:
                s2.append(starts[i])
                e2.append(ends[i + pair])
            i += 1 + pair
        out, starts, ends = "".join(joined), s2, e2
    if same:
        starts, ends = _Same(layer.starts.value, len(out)), _Same(layer.ends.value, len(out))
    return _Layer(out, starts, ends, layer.depth + 1)


def _pieces(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Where in a text the words stand that hold an escape, each with the two words before and after it and the base64 lines around.

    An assignment has at most three words (key, sign, value), and other kinds have one, so nothing that holds an escape crosses
    the edge of a piece but a run of base64 over lines: its first line has 16 letters, all but its ends are lines by themselves.
    """
    if not (first := pattern.search(text)):
        return []
    words = [m.span() for m in WORD.finditer(text)]
    places: list[list[int]] = []  # numbers of the first and last word

    def line_goes_on(i: int) -> bool:
        """Whether a run may go on from word i to the next one."""
        return BREAK.fullmatch(text, words[i][1], words[i + 1][0]) is not None

    def whole(i: int) -> bool:
        return LINE.fullmatch(text, *words[i]) is not None

    at = 0
    for m in pattern.finditer(text, first.start()):
        while words[at][1] <= m.start():
            at += 1
        last = at
        while words[last][1] < m.end():
            last += 1
        begin, end = max(0, at - 2), min(len(words) - 1, last + 2)
        covered = places[-1][1] if places else -1
        if last > covered or end > covered:
            low, high, long = at, last, any(words[i][1] - words[i][0] >= 16 for i in range(at, last + 1))
            while low > covered + 1 and line_goes_on(low - 1):
                low -= 1
                long = long or words[low][1] - words[low][0] >= 16
                if not whole(low):
                    break
            while long and high + 1 < len(words) and line_goes_on(high):
                high += 1
                if not whole(high):
                    break
            if long:
                begin, end = min(begin, low), max(end, high)
        if places and begin <= covered + 1:
            places[-1][1] = max(covered, end)
        else:
            places.append([begin, end])
    return [(words[begin][0], words[end][1]) for begin, end in places]


def _gzip_content(data: bytes, at: int) -> int | None:
    """Where the content of a gzip member begins, behind its header (RFC 1952); None if the header does not end."""
    flags, place = data[at + 3:at + 4], at + 10
    if not flags:
        return None
    if flags[0] & 4:  # extra field
        place += 2 + int.from_bytes(data[place:place + 2], "little")
    for bit in (8, 16):  # name, comment: up to a zero byte
        if flags[0] & bit:
            place = data.find(0, place) + 1
            if not place:
                return None
    place += flags[0] & 2  # checksum of the header
    return place if place < len(data) else None


def _begins_blob(data: bytes, at: int) -> bool:
    """Whether anything can be unpacked from a compressed blob at a place of data, by the first ``PROBE`` bytes of its content."""
    if data[at:at + 4] == b"\x28\xb5\x2f\xfd":
        unpacker = zstandard.ZstdDecompressor().decompressobj()
    elif data[at:at + 2] == b"\x1f\x8b":
        unpacker, at = zlib.decompressobj(-15), _gzip_content(data, at)
        if at is None:
            return False
    else:
        unpacker = zlib.decompressobj()
    try:
        for place in range(at, min(at + PROBE, len(data)), 512):
            if unpacker.decompress(data[place:place + 512]) or unpacker.eof:
                break
    except (zlib.error, zstandard.ZstdError):
        return False
    return True


def find_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans of a text, and those found in what is encoded in it."""
    own = base_spans(text)
    more: list[Span] = []
    seen: set[tuple[int, int, str]] = set()
    unpacked: set[tuple[int, int, bytes]] = set()
    work: list[_Layer] = []

    def enter(layer: _Layer) -> None:
        key = (layer.starts[0], layer.ends[-1], layer.text)
        if key not in seen:
            seen.add(key)
            work.append(layer)

    def expand(layer: _Layer) -> None:
        """Every layer below a text."""
        body, starts, ends = layer.text, layer.starts, layer.ends
        for pattern, sign in ((PERCENT, "%"), (UNICODE, "\\"), (UNICODE, "&#")):
            if sign in body:
                for begin, end in _pieces(body, pattern):
                    part = _Layer(body[begin:end], starts[begin:end], ends[begin:end], layer.depth)
                    if (inner := _unescaped(part, pattern)) is not None and inner.text:
                        enter(inner)
        for m in BASE64.finditer(body):
            letters, places = m[1], range(m.start(), m.end(1))
            if (breaks := [x.span() for x in BREAK.finditer(letters)]):
                edges = [0, *(at for span in breaks for at in span), len(letters)]
                parts = list(zip(edges[::2], edges[1::2]))
                places = array("q", (m.start() + i for begin, end in parts for i in range(begin, end)))
                letters = "".join(letters[begin:end] for begin, end in parts)
            letters = letters.replace("-", "+").replace("_", "/")
            decoded = [_from_base64(letters[shift:]) for shift in range(4)]  # whatever letters stand before what was encoded
            for shift, data in enumerate(decoded):
                for inner, encoding in _texts(data):
                    if not SIGNS.search(inner):
                        continue
                    s2, e2, at = array("q"), array("q"), 0
                    for width in _widths(inner, encoding):
                        s2.append(starts[places[shift + at * 4 // 3]])
                        e2.append(ends[places[shift - (-(at + width) * 4 // 3) - 1]])
                        at += width
                    enter(_Layer(inner, s2, e2, layer.depth + 1))
            for head in PACKED.finditer(letters):
                data, at = decoded[head.start() % 4], head.start() // 4 * 3
                if _begins_blob(data, at):
                    unpack(data[at:], starts[places[head.start()]], ends[m.end() - 1], layer.depth + 1)

    def unpack(data: bytes, start: int, end: int, depth: int) -> None:
        """Every layer in a compressed blob: a character of it has no place of its own."""
        blobs = [data]
        while blobs:
            for piece in _unpacked(blobs.pop()):
                key = (start, end, hashlib.sha256(piece).digest())
                if key in unpacked:
                    continue
                unpacked.add(key)
                blobs.append(piece)
                for inner, _ in _texts(piece):
                    if SIGNS.search(inner):
                        enter(_Layer(inner, _Same(start, len(inner)), _Same(end, len(inner)), depth))

    expand(_Layer(text, range(len(text)), range(1, len(text) + 1), 0))
    while work:
        layer = work.pop()
        more += [(kind, layer.starts[s], layer.ends[e - 1]) for kind, s, e in base_spans(layer.text)]
        expand(layer)
    return own, more


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Offsets are code points of the original text, end exclusive. A null or empty text has no spans. Repeated rows are scanned
    each on their own, null ids stay null, other columns are ignored. A text is held whole by one task, however long.
    """
    return scan_texts(docs, find_secrets, KINDS, KINDS, id_col, text_col)
