"""A small PDF text reader: page order from the page tree, plain and deflated content streams, literal and hex strings.

It covers PDFs with single-byte text encodings. Others need a page reader of a PDF library (see ``files.pdf_pages``).
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOW = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|/\w+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + "0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2))
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].strip() == b"" else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _text(content: bytes) -> str:
    """Shown strings of a content stream; moves to another line begin a line, wide gaps in arrays are spaces."""
    out: list[str] = []
    args: list[bytes] = []
    for token in _SHOW.findall(content):
        first = token[:1]
        if first in b"(<[]/" or first.isdigit() or first in b"-.":
            args.append(token)
            continue
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for a in args:
                if a[:1] in b"(<":
                    out.append(_string(a))
                elif token == b"TJ" and a[:1] == b"-" and float(a) < -200:
                    out.append(" ")
        elif token == b"T*" or token in (b"Td", b"TD", b"Tm") and out and out[-1] != "\n" and (token == b"Tm" or len(args) < 2 or float(args[-1]) != 0):
            out.append("\n")
        args.clear()
    return "".join(out).strip("\n")


def read_pages(data: bytes) -> list[str]:
    """Texts of a PDF's pages in order."""
    if data[:4] != b"%PDF":
        raise PdfError("not a PDF")
    objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}

    def refs(body: bytes, key: bytes) -> list[int]:
        m = re.search(key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def content(n: int) -> bytes:
        body = objects.get(n, b"")
        m = _STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    order, todo, seen = [], roots[::-1], set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        kids = refs(objects.get(n, b""), rb"/Kids")
        if re.search(rb"/Type\s*/Page\b", objects.get(n, b"")):
            order.append(n)
        todo += kids[::-1]
    if not order:
        raise PdfError("no pages")
    return [_text(b"\n".join(content(c) for c in refs(objects[n], rb"/Contents"))) for n in order]
