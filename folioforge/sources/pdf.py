"""Page texts of PDF files, and simple files from lines of text.

Read are plain objects and those packed in object streams, with streams that are raw or
deflated: the page tree in its order, and of each page's content the strings that its text
operators show. A string is decoded by its font's map to Unicode where there is one, else
as UTF-16 where it begins with that mark, else as Windows-1252. The catalog is found by
the trailer or a cross-reference stream; of an object that stands more than once, as after
an update, the last counts. Encrypted files give no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*)\r?\n?endstream", re.S)
_REFERENCE = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Cmap:
    """A font's map of codes to Unicode text."""

    def __init__(self, raw: bytes):
        self.width, self.text = 1, {}
        if space := re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", raw):
            self.width = len(space[1]) // 2
        wide = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", raw, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                self.text[int(code, 16)] = wide(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", raw, re.S):
            for low, high, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", block, re.S):
                listed = re.findall(rb"<([0-9A-Fa-f]+)>", each)
                for k in range(min(int(high, 16) - int(low, 16) + 1, len(listed) if listed else 1 << 16)):
                    start = wide(listed[k] if listed else to)
                    self.text[int(low, 16) + k] = start if listed else start[:-1] + chr(ord(start[-1]) + k)

    def decode(self, raw: bytes) -> str:
        codes = (int.from_bytes(raw[i : i + self.width], "big") for i in range(0, len(raw), self.width))
        return "".join(self.text.get(c, "\ufffd") for c in codes)


def _string(token: bytes, cmap: Cmap | None = None) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex((re.sub(rb"\s", b"", token[1:-1]) + b"0" * (len(re.sub(rb"\s", b"", token[1:-1])) % 2)).decode())
    else:

        def plain(m: re.Match) -> bytes:
            x = m[1]
            return bytes([int(x, 8) & 255]) if x.isdigit() and x < b"8" else b"" if x.endswith(b"\n") else _NAMED.get(x, x)

        raw = _ESCAPE.sub(plain, token[1:-1])
    if cmap:
        return cmap.decode(raw)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _shown(content: bytes, fonts: dict[bytes, Cmap] | None = None) -> str:
    """The lines that a content stream shows: a move to another place begins a line."""
    lines, held, inside, name, cmap = [""], [], False, b"", None
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<":
            held.append(_string(token, cmap))
        elif token[:1] == b"/":
            name = token[1:]
        elif token == b"Tf":
            cmap = (fonts or {}).get(name)
        elif token == b"BT":
            inside = True
            lines += [""] if lines[-1] else []
        elif token == b"ET":
            inside = False
        elif inside and token in (b"T*", b"Td", b"TD", b"'", b'"'):
            lines.append("")
        if inside and token in (b"Tj", b"TJ", b"'", b'"'):
            lines[-1] += "".join(held)
        if token.isalpha() or token in (b"T*", b"'", b'"'):
            held = []
    return "\n".join(lines[1:] if len(lines) > 1 and not lines[0] else lines)


class File:
    """The objects of a PDF file."""

    def __init__(self, raw: bytes):
        self.raw, self.objects = raw, {int(n): body for n, body in _OBJECT.findall(raw)}
        for n, body in list(self.objects.items()):
            head = body.split(b"stream", 1)[0]
            if re.search(rb"/Type\s*/ObjStm\b", head):
                count, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"N", b"First"))
                data = self.stream(n)
                at = [int(x) for x in data[:first].split()][: 2 * count]
                ends = [*at[3::2], len(data) - first]
                for number, low, high in zip(at[::2], at[1::2], ends, strict=False):
                    self.objects.setdefault(number, data[first + low : first + high])

    def stream(self, n: int) -> bytes:
        m = _STREAM.search(self.objects.get(n, b""))
        if not m:
            return b""
        if b"/FlateDecode" not in m[1]:
            return m[2]
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return b""

    def root(self) -> int | None:
        """The page tree's number: by the last trailer or cross-reference stream that names a
        catalog, else by any catalog."""
        for n in reversed(re.findall(rb"/Root\s+" + _REFERENCE, self.raw)):
            if tree := re.search(rb"/Pages\s+" + _REFERENCE, self.objects.get(int(n), b"")):
                return int(tree[1])
        tree = re.search(rb"/Pages\s+" + _REFERENCE, self.raw)
        return int(tree[1]) if tree else None

    def inner(self, body: bytes, key: bytes) -> bytes:
        """The dictionary under a key, given there or by reference."""
        if m := re.search(rb"/" + key + rb"\s+" + _REFERENCE, body):
            return self.objects.get(int(m[1]), b"")
        if not (m := re.search(rb"/" + key + rb"\s*<<", body)):
            return b""
        depth, at = 1, m.end()
        for edge in re.finditer(rb"<<|>>", body[at:]):
            depth += 1 if edge[0] == b"<<" else -1
            if not depth:
                return body[at : at + edge.start()]
        return body[at:]

    def fonts(self, resources: bytes) -> dict[bytes, Cmap]:
        out = {}
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REFERENCE, self.inner(resources, b"Font")):
            if to := re.search(rb"/ToUnicode\s+" + _REFERENCE, self.objects.get(int(n), b"")):
                out[name] = Cmap(self.stream(int(to[1])))
        return out

    def pages(self, n: int, above: frozenset = frozenset(), resources: bytes = b"") -> Iterator[str]:
        body = self.objects.get(n, b"")
        if n in above:
            return
        resources = self.inner(body, b"Resources") or resources  # a page takes its parents' if it has none
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            for k in re.findall(_REFERENCE, kids[1]):
                yield from self.pages(int(k), above | {n}, resources)
        elif re.search(rb"/Type\s*/Page\b", body):
            of = re.search(rb"/Contents\s*(?:\[(.*?)\]|" + _REFERENCE + rb")", body, re.S)
            parts = re.findall(_REFERENCE, of[1]) if of and of[1] else [of[2]] if of else []
            yield _shown(b"\n".join(self.stream(int(k)) for k in parts), self.fonts(resources))


def pages(raw: bytes) -> list[str]:
    """The text of each page; nothing of a file that isn't such a PDF."""
    return list(each_page(raw))


def each_page(raw: bytes) -> Iterator[str]:
    """The same, one page after another."""
    file = File(raw)
    root = None if re.search(rb"/Encrypt\s+\d", raw) else file.root()
    if root is not None:
        yield from file.pages(root)


def made(lines_of_pages: list[list[str]]) -> bytes:
    """A PDF file with a page for each list of lines."""
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(lines_of_pages)))
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(lines_of_pages)} >>".encode()]
    for i, lines in enumerate(lines_of_pages):
        strings = [re.sub(rb"([()\\])", rb"\\\1", line.encode("cp1252", "replace").replace(b"\r", b"\\r")) for line in lines]
        shown = b"BT /F1 10 Tf 12 TL 50 800 Td\n" + b"".join(b"(%s) Tj T*\n" % s for s in strings)[:-3].rstrip() + b"\nET"
        packed = zlib.compress(shown)
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents {4 + 2 * i} 0 R >>".encode())
        bodies.append(f"<< /Length {len(packed)} /Filter /FlateDecode >>\nstream\n".encode() + packed + b"\nendstream")
    out, places = b"%PDF-1.4\n", []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(bodies) + 1, len(out))


def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, path, content of rows of doc_id, path and pages (lists of lines)."""
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "path": b["path"], "content": [made([list(lines) for lines in p]) for p in b["pages"]]})
