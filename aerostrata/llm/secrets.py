"""Secret scans with recursive decoding.

Every text is scanned with the base patterns. A worklist then unwraps encoded regions (percent, backslash and character reference
escapes, base64, compressed data) layer by layer until nothing new appears; each layer is scanned with the same patterns and the
spans found are mapped back to the code points of the original text that gave them. A layer already seen in the same text
region (a cycle) is not entered again.

Escapes are decoded over a whole layer, so that a secret may begin or end outside of them. What still holds escapes after that is
brought to its fixpoint in one pass from left to right, which decodes an escape as soon as its last character is there, be it written or
decoded: so the depth of nested escapes costs no further layers, and time and memory are linear in the text. Base64 regions are of both
alphabets, in one line or broken over lines, and decoded from each of the four places where a group may start, so that
words joined to them do no harm; 16-bit text inside is read too. Compressed data (gzip of several members, zlib, bzip2, one inside
another) is read as a stream of overlapping windows, whatever its size, and maps to its whole region; it is found anywhere in
base64, in percent escapes with plain letters between them, and in runs of \\xXX. Raw deflate data, which has no mark, isn't. What isn't
UTF-8 is replaced; only bytes too few for any secret are dropped. Of data compressed twice or more, NESTED_MOST bytes are
read, so that no bomb stops a job. Offsets are arrays of four bytes a character, and layers are opened depth first; each is smaller
than the one around it, or the last one of its kind.

Kinds: assign, access, hex in the text itself; the same with the suffix _layer for what a decoded layer shows.

Cases: null text counts as empty; empty texts have no spans; several findings with one span and kind count once.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerostrata.llm.common import append_columns, table

KINDS = ("assign", "access", "hex")
ALL_KINDS = (*KINDS, "assign_layer", "access_layer", "hex_layer")
ORDER = {k: i for i, k in enumerate(ALL_KINDS)}
#: Bytes of compressed content that are scanned at once, and by how many the next ones overlap them.
WINDOW = 8 << 20
WINDOW_OVERLAP = 64 << 10

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(
    r"\\u([Dd][89ABab][0-9A-Fa-f]{2})\\u([Dd][C-Fc-f][0-9A-Fa-f]{2})"
    r"|(?:[\\%]u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|&\#[xX]([0-9A-Fa-f]{1,6});)"
    r"|\\([0-3][0-7]{2})|&\#([0-9]{1,7});|&(amp|quot|apos|lt|gt|equals|colon);"
)
ESCAPE_MARKS = ("\\", "%u", "&")
REFERENCES = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "equals": "=", "colon": ":"}
#: The end of a text that a closing sign makes an escape.
CLOSED = re.compile(r"(?:\\u\{([0-9A-Fa-f]{1,6})\}|&\#[xX]([0-9A-Fa-f]{1,6});|&\#([0-9]{1,7});|&(amp|quot|apos|lt|gt|equals|colon);)$")
_HEX = frozenset("0123456789abcdefABCDEF")
_OCTAL = frozenset("01234567")
#: Compressed data in percent or \\x escapes, with plain letters between them.
PACKED = re.compile(r"(?:%1[Ff]%8[Bb]%08|(?:x|%78)%(?:9[Cc]|[Dd][Aa]|01|5[Ee])|(?:BZh|%42%5[Aa]%68))[^\s\"'<>]*|(?:\\x1[Ff]\\x8[Bb]\\x08|(?:x|\\x78)\\x(?:9[Cc]|[Dd][Aa]|01|5[Ee])|BZh)[^\s\"'<>]*")
#: Base64 that may begin compressed data.
PACKED64 = re.compile(rb"(?=H4sI|e[AFJN]|Qlpo|[-_/])")
NESTED_MOST = 1 << 30
SPACE = re.compile(r"\s")
BYTE_RUN = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}")
SURROGATE = re.compile("[\ud800-\udfff]")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: The same over several lines, read from the start of a word.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\t\x20]*+[A-Za-z0-9+/_-]++)++={0,2}")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_PLAIN_ALPHABET = bytes.maketrans(b"-_", b"+/")
#: Fewer characters than these hold no base pattern, whatever layers are between.
PLAIN = re.compile(rb"[\t\n\r\x20-\x7e]{16}")
PLAIN_16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16,}|(?:\x00[\t\n\r\x20-\x7e]){16,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _decoded(data: bytes, at: np.ndarray) -> tuple[str, np.ndarray]:
    """Text of the data, bytes that aren't UTF-8 replaced one by one, with the offset of each character."""
    text = data.decode("utf-8", "surrogateescape")
    if len(text) == len(data):
        return (text, at) if text.isascii() else (SURROGATE.sub("\ufffd", text), at)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    widths = 1 + (points >= 0x80).astype(np.int32) + (points >= 0x800) + (points >= 0x10000)
    widths[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    return SURROGATE.sub("\ufffd", text), at[np.cumsum(widths) - widths]


class _Pieces:
    """A layer put together from pieces of a text and what stands for its escapes, with offsets."""

    def __init__(self, text: str):
        self.text, self.out, self.at, self.done = text, [], [], 0

    def put(self, start: int, end: int, run: str, at: np.ndarray) -> None:
        """`run`, whose characters come from the offsets `at`, for the text from start to end."""
        self.out += [self.text[self.done : start], run]
        self.at += [np.arange(self.done, start, dtype=np.int32), at]
        self.done = end

    def layer(self) -> tuple[str, np.ndarray]:
        n = len(self.text)
        return "".join([*self.out, self.text[self.done :]]), np.concatenate([*self.at, np.arange(self.done, n + 1, dtype=np.int32)])


def _percent(text: str) -> tuple[str, np.ndarray, list[tuple[bytes, int, int]]]:
    """Decoded text, for each of its characters and the end the offset in the text, and runs of bytes with their places."""
    pieces, runs = _Pieces(text), []
    for m in PERCENT.finditer(text):
        data = unquote_to_bytes(m[0])
        runs.append((data, m.start(), m.end()))
        pieces.put(m.start(), m.end(), *_decoded(data, np.arange(m.start(), m.end(), 3, dtype=np.int32)))
    return *pieces.layer(), runs


def _char(code: int) -> str:
    return "\ufffd" if 0xD800 <= code < 0xE000 or code > 0x10FFFF else chr(code)


def _pair(high: int, low: int) -> str:
    return chr(0x10000 + ((high - 0xD800) << 10) + low - 0xDC00)


def _escapes(text: str) -> tuple[str, np.ndarray, list[tuple[bytes, int, int]]]:
    """The same for backslash escapes and character references; two surrogates are one character, one alone is replaced."""
    pieces, runs = _Pieces(text), []
    for m in ONE_ESCAPE.finditer(text):
        if m[1]:
            char = _pair(int(m[1], 16), int(m[2], 16))
        elif m[8]:
            char = _char(int(m[8], 8))
        elif m[9]:
            char = _char(int(m[9]))
        else:
            char = REFERENCES[m[10]] if m[10] else _char(int(m[3] or m[4] or m[5] or m[6] or m[7], 16))
        pieces.put(m.start(), m.end(), char, np.array([m.start()], np.int32))
    for m in BYTE_RUN.finditer(text):
        runs.append((bytes.fromhex(m[0].replace("\\x", "")), m.start(), m.end()))
    return *pieces.layer(), runs


def _fixpoint(text: str) -> tuple[str, np.ndarray, list[tuple[bytes, int, int]]]:
    """The text without any escape, however they are nested: each is decoded when its last character comes, and what it gives may be the
    last character of another. Every step takes away characters for good, so the work is linear."""
    out: list[str] = []
    at: list[int] = []

    def end(n: int) -> str | None:
        """What the escape at the end of `out` stands for, and with it its length."""
        nonlocal size
        c = out[-1]
        if c in "};":
            m = CLOSED.search("".join(out[-12:]))
            if m is None:
                return None
            size = m.end() - m.start()
            return REFERENCES[m[4]] if m[4] else _char(int(m[3]) if m[3] else int(m[1] or m[2], 16))
        if n >= 3 and out[-3] == "%" and out[-2] in _HEX:
            size, code = 3, int(out[-2] + c, 16)
            return chr(code if code < 128 else 0xDC00 + code)  # a byte of UTF-8
        if n >= 4 and out[-4] == "\\":
            if out[-3] == "x" and out[-2] in _HEX:
                size = 4
                return chr(int(out[-2] + c, 16))
            if out[-3] in "0123" and out[-2] in _OCTAL and c in _OCTAL:
                size = 4
                return chr(int(out[-3] + out[-2] + c, 8))
        if n >= 6 and out[-5] == "u" and out[-6] in "\\%" and all(x in _HEX for x in out[-4:-1]):
            size, code = 6, int("".join(out[-4:]), 16)
            if 0xDC00 <= code < 0xE000 and n >= 7 and "\ud800" <= out[-7] < "\udc00":
                size = 7
                return _pair(ord(out[-7]), code)
            return chr(code) if 0xD800 <= code < 0xDC00 else _char(code)
        if n >= 10 and out[-9] == "U" and out[-10] == "\\" and all(x in _HEX for x in out[-8:-1]):
            size = 10
            return _char(int("".join(out[-8:]), 16))
        return None

    size = 0
    for i, c in enumerate(text):
        out.append(c)
        at.append(i)
        while out[-1] in _HEX or out[-1] in "};":
            got = end(len(out))
            if got is None:
                break
            start = at[-size]
            del out[-size:], at[-size:]
            out.append(got)
            at.append(start)
    coded = [b"\xef\xbf\xbd" if "\ud800" <= c < "\udc00" else c.encode("utf-8", "surrogateescape") if not "\ud800" <= c <= "\udfff" or "\udc80" <= c <= "\udcff" else b"\xef\xbf\xbd" for c in out]
    data = b"".join(coded)
    places = np.repeat(np.array(at, np.int32), np.fromiter(map(len, coded), np.int64, len(coded)))
    layer, offsets = _decoded(data, places)
    runs = []
    for m in re.finditer(rb"\x1f\x8b\x08", data):
        start = int(places[m.start()])
        space = SPACE.search(text, start)
        runs.append((data[m.start() :], start, space.start() if space else len(text)))
    return layer, np.append(offsets, np.int32(len(text))), runs


def inflatable(data: bytes) -> bool:
    """Whether data starts as gzip, zlib or bzip2 data do."""
    return data[:2] == b"\x1f\x8b" or data[:3] == b"BZh" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0)


def _opens(data: bytes) -> bool:
    """Whether data that starts so can be read on."""
    try:
        if not inflatable(data):
            return False
        (bz2.BZ2Decompressor() if data[:3] == b"BZh" else zlib.decompressobj(47)).decompress(data[:4096], 1024)
    except (zlib.error, OSError):
        return False
    return True


def _content(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Content of compressed data, one member after the other, in parts of WINDOW bytes at most; of broken data, as far as it can be read."""
    data = next(chunks, b"")
    while inflatable(data):
        bzip = data[:3] == b"BZh"
        z = bz2.BZ2Decompressor() if bzip else zlib.decompressobj(47)
        while not z.eof:
            try:
                out = z.decompress(data, WINDOW)
            except (zlib.error, OSError):
                return
            data = b"" if bzip else z.unconsumed_tail
            if out:
                yield out
            elif not data and not z.eof:
                data = next(chunks, b"")
                if not data:
                    return
        data = z.unused_data or next(chunks, b"")


def inflate(data: bytes) -> Iterator[bytes]:
    """Content of compressed data, of the innermost where one is in another, in windows that overlap by WINDOW_OVERLAP."""
    stream, seen, nested, read = iter([data]), set(), False, 0
    while True:
        out = _content(stream)
        first = next(out, None)
        if first is None:
            return
        head = first[:4096]
        stream = chain([first], out)
        if head in seen or not _opens(first):
            break
        seen.add(head)
        nested = True
    tail = b""
    for part in stream:
        yield tail + part
        tail, read = part[-WINDOW_OVERLAP:], read + len(part)
        if nested and read >= NESTED_MOST:
            return


def _inflated(data: bytes) -> Iterator[str]:
    for window in inflate(data):
        yield window.decode("utf-8", "replace")


def _symbols(text: bytes) -> bytes:
    """Data of base64 symbols of either alphabet; a lone last symbol holds no byte."""
    core = text.translate(_PLAIN_ALPHABET)
    core = core[: len(core) - (len(core) % 4 == 1)]
    return base64.b64decode(core + b"=" * (-len(core) % 4))


def _base64(region: str) -> Iterator[tuple[str, np.ndarray | None]]:
    """Decoded layers of a base64 region with offsets in it; None: the layer stands for the whole region."""
    raw = region.encode()
    places = np.flatnonzero(_IS_SYMBOL[np.frombuffer(raw, np.uint8)]).astype(np.int32)
    core = raw if len(places) == len(raw) else np.frombuffer(raw, np.uint8)[places].tobytes()
    # compressed data may start anywhere; what is compressed maps to the whole region
    starts = {0, *(np.flatnonzero(np.diff(places) > 1) + 1).tolist(), *(m.start() + (core[m.start()] in b"-_/") for m in PACKED64.finditer(core))}
    for i in sorted(starts):
        if inflatable(_symbols(core[i : i + 4])) and _opens(_symbols(core[i : i + 5464])):
            for content in _inflated(_symbols(core[i:])):
                yield content, None
    for i in range(min(4, len(core))):
        data = _symbols(core[i:])
        if PLAIN.search(data):
            k = np.arange(len(data), dtype=np.int32)
            text, at = _decoded(data, places[i + k // 3 * 4 + k % 3])
            yield text, np.append(at, np.int32(len(region)))
        for m in PLAIN_16.finditer(data):
            k = np.arange(m.start() + (m[0][0] == 0), m.end(), 2, dtype=np.int32)
            yield data[k[0] : m.end() : 2].decode("ascii"), np.append(places[i + k // 3 * 4 + k % 3], np.int32(len(region)))


def _repr_bytes(text: str) -> bytes:
    """Bytes of a text with \\xXX for those that aren't letters."""
    return re.sub(rb"\\x([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text.encode("utf-8", "surrogatepass"))


def layers(text: str, unescaped: bool = False) -> Iterator[tuple[str, np.ndarray | None, int, int, bool]]:
    """Decoded regions of one text: (layer, offsets in the region or None for all of it, start, end, whether escapes were decoded).
    A text that came out of escapes and has more of them is brought to its fixpoint."""
    percent = "%" in text and PERCENT.search(text) is not None
    escapes = any(mark in text for mark in ESCAPE_MARKS) and ONE_ESCAPE.search(text) is not None
    for some, decode in ((percent or escapes, _fixpoint),) if unescaped else ((percent, _percent), (escapes, _escapes)):
        if some:
            layer, at, runs = decode(text)
            yield layer, at, 0, len(text), True
            for data, start, end in runs:
                for content in _inflated(data):
                    yield content, None, start, end, False
    if percent or escapes:
        for m in PACKED.finditer(text):
            data = _repr_bytes(m[0]) if "\\x" in m[0] else unquote_to_bytes(m[0])
            if _opens(data):
                for content in _inflated(data):
                    yield content, None, m.start(), m.end(), False
    for m in BASE64.finditer(text):
        for layer, at in _base64(m[0]):
            yield layer, at, m.start(), m.end(), False
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            if len(m[0]) >= 20:
                for layer, at in _base64(m[0]):
                    yield layer, at, m.start(), m.end(), False


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans and those of all layers, by start, then kind, then end."""
    found = set(base_spans(text))
    # open layers, innermost last: what is left of them, their text, its offsets in the original, and their region there
    work = [(layers(text), text, None, 0, len(text))]
    seen: set[tuple[int, int, bytes]] = set()
    while work:
        rest, now, at, lo, hi = work[-1]
        got = next(rest, None)
        if got is None:
            work.pop()
            continue
        layer, offsets, start, end, unescaped = got
        outside = len(work) > 1 and at is None  # `now` stands for its whole region
        first, last = (lo, hi) if outside else (start, end) if at is None else (int(at[start]), int(at[end]))
        key = (first, last, hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest())
        if key in seen:
            continue
        seen.add(key)
        to = None if offsets is None or outside else offsets + start if at is None else at[start + offsets]
        plain = None
        for a, b, kind in base_spans(layer):
            if offsets is not None and now[start + offsets[a] : start + offsets[b]] == layer[a:b]:  # stands there undecoded
                plain = set(base_spans(now)) if plain is None else plain
                if (start + offsets[a], start + offsets[b], kind) in plain:
                    continue
            found.add((first, last, f"{kind}_layer") if to is None else (int(to[a]), min(last, int(to[b])), f"{kind}_layer"))
        work.append((layers(layer, unescaped), layer, to, first, last))
    return sorted(found, key=lambda s: (s[0], ORDER[s[2]], s[1]))


def _joined(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(texts: Sequence[str | None]):
    out = []
    for text in texts:
        spans = all_spans(text or "")
        base = [s for s in spans if s[2] in KINDS]
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
        out.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
    return list(zip(*out, strict=True)) if out else [[]] * 5


def scan(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans. A map over the scan, without a shuffle."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    fields += [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
    return append_columns(df, [F.col(text)], fields, _scan, keep)


def redact(df: DataFrame, text: str = "text", mask: str = "[{kind}]", count: str | None = "n_secrets") -> DataFrame:
    """Replace every found span (overlapping ones together) by its first kind's mask; adds their number as `count`
    (None: not). Null texts stay null; the columns keep their order."""

    def run(texts):
        new, counts = [], []
        for t in texts:
            spans = all_spans(t or "")
            counts.append(len(spans))
            if not spans:
                new.append(t)
                continue
            out, at, i = [], 0, 0
            while i < len(spans):
                a, b, kind = spans[i]
                i += 1
                while i < len(spans) and spans[i][0] < b:
                    b = max(b, spans[i][1])
                    i += 1
                out += [t[at:a], mask.format(kind=kind.removesuffix("_layer"))]
                at = b
            new.append("".join([*out, t[at:]]))
        return [new, counts]

    named = count or "__n_secrets"
    fields = [T.StructField(text, T.StringType()), T.StructField(named, T.LongType())]
    got = append_columns(df, [F.col(text)], fields, run)
    return got.select(*[f"`{c}`" for c in df.columns if c.lower() != named.lower()], *([named] if count else []))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
