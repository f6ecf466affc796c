"""Secret scans: a worklist of decoded layers, each rescanned, with spans mapped back to the text.

Every text is scanned as it stands. Then percent escapes, backslash and HTML character escapes, base64 runs
and compressed bytes are decoded; each decoded layer is scanned and decoded again until no new layer appears.
A layer whose content has been seen in this text is not visited again, which ends cycles. An escape sign that is itself escaped again and again
(%252525..., \\u005cu005c..., &#38;#38;...) is unwrapped at once, as the forms between differ in nothing but how often.

Cases: a null text counts as empty and has no span; repeated rows give repeated results; other columns,
also such named like those added, are kept (an added column takes the place of one with its name); an empty table gives an empty result; a very long text is
scanned whole, in time that grows with its length times its layers (each is shorter than the one it comes from).
Work is per row: no shuffle. A layer keeps its text only until its own layers are made, and then how its places map to those of the layer above: a few
numbers for each escape, line or character beyond ASCII, so that long base64 runs take a few times their length.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import functools
import hashlib
import lzma
import re
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import small_batches

#: Kinds in the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Runs are maximal, so asking for the length here drops what dropping short matches would.
HEX = re.compile(rf"[0-9a-f]{{{MIN_HEX},}}")

#: Characters of a base64 run whose places are worked out when one is asked for.
AT_ONCE = 4096
#: Bytes that pieces of a long layer have in common, and what an xz layer may take to decompress.
OVERLAP, XZ_MEMORY = 64 << 10, 128 << 20
#: A run that may be base64, over several lines if they are long.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,}\r?\n)*[A-Za-z0-9+/_-]{16,}={0,2}")
#: Lines of such signs, each but the last ended; what of them is one wrapped run is told by their widths.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{4,}+\r?\n)+[A-Za-z0-9+/_-]*={0,2}")
LINE = re.compile(r"([A-Za-z0-9+/_-]+={0,2})\r?\n?")
#: The first part: an escape sign that is escaped again and again.
PERCENT = re.compile(r"%(?:25){2,}|(?:%(?!2525)[0-9A-Fa-f]{2})+")
AGAIN = r"\\(?:u005[cC]|x5[cC]|U0000005[cC]|u\{0{0,4}5[cC]\}){2,}|&(?:#0{0,5}38;|#[xX]0{0,4}26;){2,}"
ESCAPE = re.compile(
    rf"{AGAIN}|(?:(?!{AGAIN})(?:\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}}|\\x[0-9A-Fa-f]{{2}}|\\u\{{[0-9A-Fa-f]{{1,6}}\}}|&#[0-9]{{1,7}};|&#[xX][0-9A-Fa-f]{{1,6}};))+"
)
IS_AGAIN = re.compile(AGAIN)
#: Compressed bytes (gzip, zlib, bzip2 or xz) with percent escapes, in which bytes that need none may stand as they are.
PACKED_PERCENT = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%[0-9A-Fa-f]{2}|BZh[1-9]1AY%26SY|%42%5[aA]%68|%[fF][dD]7zXZ%00|%[fF][dD]%37)(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
ONE_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("layers", T.StringType())])
RESULT = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("truncated", T.BooleanType())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as number, end) of the secrets that stand in a text as they are."""
    out = []
    low = text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode("utf-8")  # bytes.lower() is ASCII's
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if BASE64.search(text):  # a hex secret is such a run too
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


class _Cuts:
    """Places by cuts (place here, start above, end above, is it one to one), each up to the next."""

    def __init__(self, cuts: list[tuple[int, int, int, bool]]):
        self.cuts, self.at = cuts, [c[0] for c in cuts]

    def up(self, start: int, end: int) -> tuple[int, int]:
        at, first, last, exact = self.cuts[max(0, bisect.bisect_right(self.at, start) - 1)]
        a = first + (start - at) if exact else first
        at, first, last, exact = self.cuts[max(0, bisect.bisect_right(self.at, end - 1) - 1)]
        return a, first + (end - at) if exact else last


class _Base64Places:
    """Places of a text decoded from base64 digits, by rule: digits follow each other within a line, bytes within the characters."""

    def __init__(self, run: str, at: int, n: int, text: str):
        self.made, self.n = (run, at, text), n
        if len(run) > AT_ONCE:  # long texts aren't kept
            self._make()

    def _make(self) -> None:
        run, at, text = self.made
        self.made = None
        raw = np.frombuffer(run.encode(), np.uint8)
        digit = (raw != 10) & (raw != 13)
        first = np.flatnonzero(digit & ~np.concatenate(([False], digit[:-1])))
        size = np.flatnonzero(digit & ~np.concatenate((digit[1:], [False]))) + 1 - first
        self.line_at, self.line_digit = first + at, np.cumsum(size) - size
        # characters beyond ASCII, and the bytes more than characters up to each
        self.wide = self.extra = None
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.wide = np.flatnonzero(code >= 128)
            c = code[self.wide]
            size = np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4)))
            self.extra = np.concatenate(([0], np.cumsum(size - 1)))

    def _byte(self, i: int) -> int:
        return i if self.wide is None else i + int(self.extra[np.searchsorted(self.wide, i)])

    def _digit(self, k: int) -> int:
        line = int(np.searchsorted(self.line_digit, k, "right")) - 1
        return int(self.line_at[line]) + k - int(self.line_digit[line])

    def up(self, start: int, end: int) -> tuple[int, int]:
        if self.made:
            self._make()
        a, b = self._byte(start), self._byte(end) - 1
        return self._digit(a // 3 * 4 + a % 3), self._digit(min(self.n - 1, b // 3 * 4 + b % 3 + 1)) + 1


class _Layer:
    """A decoded text, and how its places map to those of the layer above."""

    def __init__(self, text: str, places, above, name: str):
        self.text, self.places, self.above, self.name = text, places, above, name
        self.depth = above.depth + 1 if above else 0

    def up(self, start: int, end: int) -> tuple[int, int]:
        """Where a span lies in the text from which all layers come."""
        layer = self
        while layer.above:
            start, end = layer.places.up(start, end)
            layer = layer.above
        return start, end

    def path(self) -> str:
        names, layer = [], self
        while layer.above:
            names.append(layer.name)
            layer = layer.above
        return ">".join(reversed(names))


def _opener(data: bytes):
    """What decompresses these bytes; None if they aren't compressed."""
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    return None


def _inflate(data: bytes, most: int, cut: list):
    """The decompressed bytes of all members, in pieces of at most most bytes; each piece but the first begins with the last OVERLAP bytes of the
    one before. cut gets an entry if there is more than one piece, or a member needs too much memory."""
    piece, first = b"", True
    while (d := _opener(data)) is not None:
        try:
            got = d.decompress(data, max(1, most - len(piece)))
            while True:
                piece += got
                if len(piece) >= most:
                    yield piece
                    piece, first = piece[-min(OVERLAP, most // 2) :], False
                if d.eof:
                    break
                got = d.decompress(getattr(d, "unconsumed_tail", b""), max(1, most - len(piece)))
                if not got and not d.eof:
                    break  # the member has no end
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError) as e:
            if "emory" in str(e):
                cut.append(True)
            break
        if not d.eof or not d.unused_data:
            break
        data = d.unused_data
    if not first:
        cut.append(True)
    if first and piece or not first and len(piece) > min(OVERLAP, most // 2):
        yield piece


def _readable(text: str) -> bool:
    return text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable()


def _bytes_layers(data: bytes, above: _Layer, places, whole: tuple[int, int], name: str, most: int, cut: list):
    """Layers of decoded bytes. places: makes the map of the places of a text decoded from them."""
    seen = set()
    every = _Cuts([(0, *whole, False)])
    while (mark := hashlib.sha256(data).digest()) not in seen:  # compressed bytes in compressed bytes
        seen.add(mark)
        pieces = _inflate(data, most, cut)
        packed = next(pieces, None)
        if packed is None:
            break
        data, name, places = packed, f"{name}>inflate", None
        for more in pieces:
            yield _Layer(more.decode("utf-8", "replace"), every, above, name)
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or 4 * data.count(0) > len(data):  # two bytes a character
        big = data[:2] == b"\xfe\xff" or data[:2] != b"\xff\xfe" and data[::2].count(0) > data[1::2].count(0)
        yield _Layer(data.decode("utf-16-be" if big else "utf-16-le", "replace"), every, above, f"{name}>utf16")
    if places is None:
        yield _Layer(data.decode("utf-8", "replace"), every, above, name)
    else:
        text = data.decode("utf-8", "surrogateescape")
        yield _Layer(re.sub("[\udc80-\udcff]", "\ufffd", text) if not text.isascii() else text, places(text), above, name)


def _rewritten(layer: _Layer, pattern, decode, name: str):
    """The whole text with every escape in it decoded, as one layer."""
    parts, cuts, here, at = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        plain = layer.text[at : m.start()]
        if plain:
            cuts.append((here, at, m.start(), True))
            here += len(plain)
        parts.append(plain)
        for piece, first, last in decode(m[0]):
            cuts.append((here, m.start() + first, m.start() + last, False))
            here += len(piece)
            parts.append(piece)
        at = m.end()
    if parts:
        if at < len(layer.text):
            cuts.append((here, at, len(layer.text), True))
        yield _Layer("".join(parts) + layer.text[at:], _Cuts(cuts), layer, name)


def _percent(run: str):
    if run.startswith("%2525"):
        yield "%", 0, len(run)
        return
    data = bytes.fromhex(run.replace("%", ""))
    text, at = data.decode("utf-8", "surrogateescape"), 0
    for c in text:
        n = len(c.encode("utf-8", "surrogateescape"))
        yield ("\ufffd" if "\udc80" <= c <= "\udcff" else c), 3 * at, 3 * (at + n)
        at += n


def _escapes(run: str):
    if IS_AGAIN.match(run):
        yield run[0], 0, len(run)
        return
    found = [(int(next(g for g in m.groups()[:3] if g), 16) if m[4] is None else int(m[4]), m.start(), m.end()) for m in ONE_ESCAPE.finditer(run)]
    k = 0
    while k < len(found):
        code, first, last = found[k]
        if 0xD800 <= code < 0xDC00 and k + 1 < len(found) and 0xDC00 <= found[k + 1][0] < 0xE000:  # a pair
            code, last, k = 0x10000 + ((code - 0xD800) << 10) + found[k + 1][0] - 0xDC00, found[k + 1][2], k + 1
        yield (chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"), first, last
        k += 1


def _escaped_bytes(run: str) -> bytes:
    """The bytes that escapes stand for; none if one of them is not a byte."""
    codes = [int(next(g for g in m.groups()[:3] if g), 16) if m[4] is None else int(m[4]) for m in ONE_ESCAPE.finditer(run)]
    return bytes(codes) if max(codes) < 256 else b""


def _children(layer: _Layer, most: int, cut: list):
    text = layer.text
    if "%" in text:
        yield from _rewritten(layer, PERCENT, _percent, "url")
        for m in PACKED_PERCENT.finditer(text):  # escaped compressed bytes
            if _opener(data := unquote_to_bytes(m[0])):
                yield from _bytes_layers(data, layer, None, m.span(), "url", most, cut)
    if "\\" in text or "&#" in text:
        yield from _rewritten(layer, ESCAPE, _escapes, "unicode")
        for m in ESCAPE.finditer(text):
            if len(m[0]) >= 32 and not IS_AGAIN.match(m[0]) and (data := _escaped_bytes(m[0])) and _opener(data):
                yield from _bytes_layers(data, layer, None, m.span(), "unicode", most, cut)
    runs = [((run, at),) for m in WRAPPED.finditer(text) for run, at in _wrapped(m[0], m.start())]
    runs += [tuple(_base64_parts(m[0], m.start())) for m in BASE64.finditer(text)]
    done, upto = [], []  # starts of wrapped runs that were readable, and the last end up to each: what BASE64 finds in them are pieces of them
    for parts in runs:
        for run, at in parts:
            k = bisect.bisect_right(done, at)
            if k and at + len(run) <= upto[k - 1]:
                continue
            body = run.translate(_NOT_DIGITS) if "\n" in run else run.rstrip("=")
            if len(body) % 4 == 1:
                continue
            data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
            places = functools.partial(_Base64Places, run, at, len(body))
            good = False
            for x in _bytes_layers(data, layer, places, (at, at + len(run)), "base64", most, cut):
                good |= x.name != "base64" or _readable(x.text)
                yield x
            if good:
                if "\n" in run:
                    done.append(at)
                    upto.append(max(at + len(run), upto[-1] if upto else 0))
                break


#: Takes line ends and fillers out.
_NOT_DIGITS = dict.fromkeys(map(ord, "\r\n="))


def _wrapped(block: str, at: int):
    """The wrapped runs of a block of lines: lines of one width with what follows them, if that is shorter."""
    lines = [(m.start(), m.end(1), m.end(1) - m.start()) for m in LINE.finditer(block)]
    k = 0
    while k < len(lines):
        j = k
        while j + 1 < len(lines) and lines[j + 1][2] == lines[k][2]:
            j += 1
        short = j + 1 < len(lines) and lines[j + 1][2] < lines[k][2]
        for last in (j + 1, j) if short else (j,):  # a shorter line may also be other text
            if last > k:
                yield block[lines[k][0] : lines[last][1]], at + lines[k][0]
        k = j + 1


def _base64_parts(run: str, at: int):
    """The run, and if it has signs that may also divide words, what lies between them."""
    yield run, at
    if re.search("[/_+-]", run):
        for m in re.finditer(r"[A-Za-z0-9]{16,}={0,2}|[A-Za-z0-9+]{16,}={0,2}", run):
            yield m[0], at + m.start()


def scan(text: str, most: int) -> tuple[list[tuple[int, int, int, int, str]], bool]:
    """(start, kind, end, depth, layers) of all secrets of a text, and whether a layer was cut at the bound."""
    top = _Layer(text, None, None, "")
    found = {(s, k, e): (0, "") for s, k, e in base_spans(text)}
    cut: list[bool] = []
    if "%" in text or "\\" in text or "&#" in text or BASE64.search(text) or WRAPPED.search(text):
        seen, work = {hashlib.sha256(text.encode("utf-8", "replace")).digest()}, [top]
        while work:
            layer = work.pop()
            for child in _children(layer, most, cut):
                mark = hashlib.sha256(child.text.encode("utf-8", "replace")).digest()
                if mark in seen:
                    continue
                seen.add(mark)
                work.append(child)
                for s, k, e in base_spans(child.text):
                    a, b = child.up(s, e)
                    found.setdefault((a, k, b), (child.depth, child.path()))
            layer.text = ""
    return [(*key, *found[key]) for key in sorted(found)], any(cut)


def scan_secrets(df: DataFrame, text: str = "text", spans: str = "spans", truncated: str = "truncated", max_layer_bytes: int = 64 << 20) -> DataFrame:
    """Add spans (array of kind, start, end in code points, depth of decoding: 0 as it stands, layers: how it
    was decoded) and truncated: some compressed layer is longer than max_layer_bytes (a decompression bomb) and was scanned in
    pieces of that size, which overlap (only what is longer than OVERLAP and lies across an end may be missed), or an xz layer needs
    over XZ_MEMORY to be read and was left as it is."""

    small_batches(df.sparkSession)

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            every, short = scan(x.as_py() or "", max_layer_bytes)
            out.append({"spans": [{"kind": KINDS[k], "start": s, "end": e, "depth": d, "layers": p} for s, k, e, d, p in every], "truncated": short})
        return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("layers", pa.string())]))), ("truncated", pa.bool_())]))

    keep = [F.col(f"`{c}`") for c in df.columns if c not in (spans, truncated)]
    out = df.select(*keep, found(F.col(text)).alias("__found"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (spans, truncated)], F.col("__found.spans").alias(spans), F.col("__found.truncated").alias(truncated))


def redacted(text: str, most: int, mark: str = "[{}]") -> str:
    """The text with each secret, and each encoded run that holds one, replaced by its kind; overlapping spans are one."""
    parts, at, kind = [], 0, None
    spans = sorted((s, e, k) for s, k, e, _, _ in scan(text, most)[0])
    for s, e, k in spans:
        if kind is not None and s < at:
            at = max(at, e)
            continue
        parts += [text[at:s], mark.format(KINDS[k])]
        at, kind = e, k
    return "".join(parts) + text[at:] if spans else text


def redact_secrets(df: DataFrame, text: str = "text", max_layer_bytes: int = 64 << 20) -> DataFrame:
    """The same rows and columns with secrets replaced in the text (null stays null)."""

    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else redacted(t, max_layer_bytes) for x in texts], pa.string())

    return df.withColumn(text, of(F.col(f"`{text}`")))
