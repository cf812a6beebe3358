"""A reader of plain PDF files: pages, document information and the text that pages show.

Files are read object by object wherever they lie, so a broken cross-reference table does no
harm.  Streams may be plain or deflated, objects may lie in object streams.  Encrypted files and
fonts with codes of their own give no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]()<>/]+|/[^\s\[\]()<>/]*", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|\r|\n)|(.))", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Operators that start a new line of text.
_LINE = {b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"BT"}
INFO = ("title", "author", "subject", "creator", "producer")


@dataclass
class Document:
    pages: int = 0
    info: dict[str, str] = field(default_factory=dict)
    text: str = ""


def string(token: bytes) -> str:
    """A literal or hexadecimal string as text."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:

        def plain(m: re.Match) -> bytes:
            if m[1]:
                return bytes([int(m[1], 8) & 255])
            return b"" if m[2] else _ESCAPED.get(m[3], m[3])

        raw = _ESCAPE.sub(plain, token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def _stream(body: bytes) -> tuple[bytes, bytes]:
    """An object's dictionary and the bytes of its stream."""
    found = _STREAM.match(body)
    if not found:
        return body, b""
    head, data = found[1], found[2]
    if b"/FlateDecode" in head:
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            data = b""
    return head, data


def _objects(data: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            head, inner = _stream(body)
            count, first = (re.search(rb"/%s\s+(\d+)" % k, head) for k in (b"N", b"First"))
            if not (count and first):
                continue
            numbers = [int(x) for x in inner[: int(first[1])].split()[: 2 * int(count[1])]]
            ends = [*numbers[3::2], len(inner) - int(first[1])]
            for number, start, end in zip(numbers[::2], numbers[1::2], ends, strict=False):
                found.setdefault(number, inner[int(first[1]) + start : int(first[1]) + end])
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    """The objects that a key refers to, one or an array of them."""
    found = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
    return [int(x) for x in _REF.findall(found[1])] if found else []


def _page_order(objects: dict[int, bytes]) -> list[int]:
    """Pages in the order of the page tree; those it does not reach come last, by number."""
    pages = [n for n, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", body)]
    roots = [n for n, body in objects.items() if re.search(rb"/Type\s*/Pages\b", body) and not _refs(body, b"Parent")]
    order: list[int] = []
    seen: set[int] = set()
    waiting = roots[::-1]
    while waiting:
        number = waiting.pop()
        if number in seen:
            continue
        seen.add(number)
        if number in objects and re.search(rb"/Type\s*/Page\b", objects[number]):
            order.append(number)
        else:
            waiting.extend(_refs(objects.get(number, b""), b"Kids")[::-1])
    return order + [n for n in pages if n not in seen]


def _shown(content: bytes) -> Iterator[str]:
    """The strings that a page's text operators show, and line breaks."""
    operands: list[bytes] = []
    for token in _TOKEN.findall(content):
        first = token[:1]
        if first in b"([<]/" or first.isdigit() or first in b"+-.":
            operands.append(token)
            continue
        if token in _LINE:
            yield "\n"
        if token in (b"Tj", b"'", b'"', b"TJ"):
            for x in operands:
                if x[:1] in b"(<":
                    yield string(x)
                elif token == b"TJ" and re.fullmatch(rb"-\d+(?:\.\d*)?", x) and float(x) < -200:
                    yield " "  # a gap as wide as a space
        operands = []


def read(data: bytes) -> Document:
    """A document, as far as it can be read; raises ValueError if it is no PDF or encrypted."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise ValueError("encrypted")
    objects = _objects(data)
    order = _page_order(objects)
    if not order:
        raise ValueError("no pages")
    texts = []
    for number in order:
        content = b"\n".join(_stream(objects.get(n, b""))[1] for n in _refs(objects[number], b"Contents"))
        texts.append(re.sub(r"\n{2,}", "\n", "".join(_shown(content))).strip())
    info = {}
    refs = _refs(data, b"Info") or [n for body in objects.values() for n in _refs(body, b"Info")]
    for number in refs[:1]:
        for key in INFO:
            value = re.search(rb"/%s\s*(\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>)" % key.capitalize().encode(), objects.get(number, b""), re.S)
            if value:
                info[key] = string(value[1]).strip()
    return Document(len(order), info, "\n".join(texts))
