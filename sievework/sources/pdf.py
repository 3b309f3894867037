"""The text of a PDF file, page by page: what is needed of the format to read letters that carry their own meaning.

Objects are found by their marks, also inside object streams; content streams are read as they are or inflated.  Strings
are read by the font's map to Unicode where it has one, else as Western letters.  A new line begins where the text moves
down or up.  Scanned pages have no text; encrypted files and files without pages are unreadable.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(
    rb"\s+|%[^\r\n]*|(?P<hex><[0-9A-Fa-f\s]*>)|<<|>>|(?P<open>\()|(?P<mark>[\[\]])|(?P<name>/[^\s/()<>\[\]{}%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*][A-Za-z0-9'\"*]*)|.", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A move between two strings of one array, in thousandths of the letter size, from which on it is a space.
_GAP = 200


#: Bytes that a stream may inflate to: a small file must not fill a task's memory.
LARGEST = 256 << 20


class Unreadable(ValueError):
    pass


def _inflated(head: bytes, data: bytes) -> bytes:
    if b"/FlateDecode" in head:
        try:
            opener = zlib.decompressobj()
            out = opener.decompress(data, LARGEST)
        except zlib.error:
            return b""
        if opener.unconsumed_tail:
            raise Unreadable("a stream is too long")
        return out
    return b"" if b"/Filter" in head else data


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """number -> (its own text, its stream's content)."""
    found: dict[int, tuple[bytes, bytes]] = {}
    at = 0
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        end = len(data) if end < 0 else end
        s = _STREAM.search(data, m.end(), end)
        if s:
            head = data[m.end() : s.start()]
            size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = s.end() + int(size[1]) if size and data[s.end() + int(size[1]) :].lstrip()[:9] == b"endstream" else data.find(b"endstream", s.end())
            stop = len(data) if stop < 0 else stop
            found[int(m[1])] = head, _inflated(head, data[s.end() : stop])
            at = data.find(b"endobj", stop)
            at = len(data) if at < 0 else at
        else:
            found[int(m[1])] = data[m.end() : end], b""
            at = end
    for head, body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", head):
            n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
            numbers = [int(x) for x in body[:first].split()[: 2 * n]]
            places = [*numbers[1::2], len(body) - first]
            for number, start, stop in zip(numbers[::2], places, places[1:]):
                found.setdefault(number, (body[first + start : first + stop], b""))
    return found


def _inner(text: bytes, name: bytes) -> bytes:
    """The dictionary, array or reference behind a name, as it stands; empty if there is none."""
    m = re.search(rb"/%s(?![A-Za-z0-9])\s*" % name, text)
    if not m:
        return b""
    pairs = {b"<<": b">>", b"[": b"]"}
    for begin, end in pairs.items():
        if text.startswith(begin, m.end()):
            depth, at = 0, m.end()
            while at < len(text):
                if text.startswith(begin, at):
                    depth, at = depth + 1, at + len(begin)
                elif text.startswith(end, at):
                    depth, at = depth - 1, at + len(end)
                    if not depth:
                        break
                else:
                    at += 1
            return text[m.end() : at]
    rest = re.match(rb"\d+\s+\d+\s+R|[^\s/<>\[\]]+|/[^\s/<>\[\]]+", text[m.end() :])
    return rest[0] if rest else b""


def _resolved(objects: dict, text: bytes) -> bytes:
    m = re.fullmatch(rb"\s*(\d+)\s+\d+\s+R\s*", text)
    return objects.get(int(m[1]), (b"", b""))[0] if m else text


def _pages(objects: dict) -> list[bytes]:
    """The page objects in reading order, each with what it takes from above."""
    out: list[bytes] = []
    seen: set[int] = set()

    def walk(number: int, resources: bytes) -> None:
        if number in seen or number not in objects:
            return
        seen.add(number)
        text = objects[number][0]
        own = _inner(text, b"Resources") or resources
        kids = _resolved(objects, _inner(text, b"Kids"))
        if kids:
            for m in _REF.finditer(kids):
                walk(int(m[1]), own)
        elif re.search(rb"/Type\s*/Page\b", text):
            out.append(text if _inner(text, b"Resources") else text + b" /Resources " + own)

    for text, _ in list(objects.values()):
        if re.search(rb"/Type\s*/Catalog\b", text) and (m := _REF.match(_inner(text, b"Pages"))):
            walk(int(m[1]), b"")
    return out or [t for t, _ in objects.values() if re.search(rb"/Type\s*/Page\b", t)]


def _unicode(x: bytes) -> str:
    return bytes.fromhex(x.decode()).decode("utf-16-be", "replace")


def _map(body: bytes) -> dict[int, str]:
    """A font's map from codes to text."""
    out: dict[int, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", body, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[int(code, 16)] = _unicode(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", body, re.S):
        for low, high, to, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            first, last = int(low, 16), min(int(high, 16), int(low, 16) + 65_535)
            texts = [_unicode(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", listed)] if listed else []
            for i in range(last - first + 1):
                out[first + i] = (texts[i] if i < len(texts) else "") if listed else _unicode(to)[:-1] + chr(ord(_unicode(to)[-1]) + i)
    return out


def _fonts(objects: dict, page: bytes) -> dict[bytes, tuple[dict[int, str], int]]:
    """name -> (map to text, bytes of a code) of the fonts that have a map."""
    out = {}
    fonts = _resolved(objects, _inner(_resolved(objects, _inner(page, b"Resources")), b"Font"))
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", fonts):
        font = objects.get(int(number), (b"", b""))[0]
        if m := _REF.match(_inner(font, b"ToUnicode")):
            out[name] = _map(objects.get(int(m[1]), (b"", b""))[1]), 2 if re.search(rb"/Subtype\s*/Type0\b", font) else 1
    return out


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets, from behind the first of them, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            c = data[at : at + 1]
            if octal := re.match(rb"[0-7]{1,3}", data[at : at + 3]):
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                out += b"" if c in b"\r\n" else _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _said(data: bytes, font: tuple[dict[int, str], int] | None) -> str:
    if font:
        known, width = font
        return "".join(known.get(int.from_bytes(data[i : i + width], "big"), "") for i in range(0, len(data), width))
    if data.startswith(b"\xfe\xff"):
        return data[2:].decode("utf-16-be", "replace")
    return data.decode("cp1252", "replace")


def _runs(content: bytes, fonts: dict) -> Iterator[str]:
    """The text of a content stream; line ends where the text leaves its line."""
    stack: list = []
    font, at, height = None, 0, None
    while at < len(content):
        m = _TOKEN.match(content, at)
        at = m.end()
        if m["open"]:
            value, at = _string(content, at)
            stack.append(value)
        elif m["hex"]:
            digits = re.sub(rb"[<>\s]", b"", m["hex"])
            stack.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif m["number"]:
            stack.append(float(m["number"]))
        elif m["name"]:
            stack.append(m["name"].decode("latin-1"))
        elif m["word"]:
            word = m["word"]
            if word == b"Tf" and len(stack) >= 2 and isinstance(stack[-2], str):
                font = fonts.get(stack[-2][1:].encode("latin-1"))
            elif word in (b"Td", b"TD") and len(stack) >= 2:
                yield "\n" if stack[-1] else " "
            elif word == b"T*":
                yield "\n"
            elif word == b"Tm" and len(stack) >= 6:
                yield "\n" if height is not None and stack[-1] != height else ""
                height = stack[-1]
            elif word in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                yield ("" if word == b"Tj" else "\n") + _said(stack[-1], font)
            elif word == b"TJ":
                for x in stack:
                    if isinstance(x, bytes):
                        yield _said(x, font)
                    elif isinstance(x, float) and x < -_GAP:
                        yield " "
            elif word == b"ET":
                yield "\n"
                height = None
            stack = []
        elif m["mark"] == b"[":
            stack = []


def pdf_text(data: bytes) -> tuple[str, int]:
    """The text (pages with a blank line between them) and the number of pages."""
    if b"/Encrypt" in data[-4096:] or b"%PDF" not in data[:1024]:
        raise Unreadable("no readable PDF")
    objects = _objects(data)
    pages = _pages(objects)
    if not pages:
        raise Unreadable("no pages")
    out = []
    for page in pages:
        place = _inner(page, b"Contents")
        listed = _resolved(objects, place) if place and not place.startswith(b"[") and not objects.get(int(_REF.match(place)[1]), (b"", b""))[1] else place
        content = b"\n".join(objects.get(int(m[1]), (b"", b""))[1] for m in _REF.finditer(listed))
        lines = "".join(_runs(content, _fonts(objects, page))).split("\n")
        out.append("\n".join(x for x in (" ".join(line.split(" ")).strip() for line in lines) if x))
    return "\n\n".join(out), len(pages)
