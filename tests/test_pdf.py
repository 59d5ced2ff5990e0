"""PDF files with object streams, cross-reference streams and fonts' maps to Unicode."""

import zlib

from folioforge.sources import files, pdf

TEXTS = ["Grüße", "αβγ", "日本"]


def codes(text, known):
    return "".join(f"{known.setdefault(c, len(known) + 3):04x}" for c in text)


def modern(texts, update=None):
    """A file whose page objects lie in an object stream; strings are codes of a font whose map
    has single characters and a range, inherited from the page tree's resources."""
    known = {}
    shown = [codes(t, known) for t in texts]
    chars = "".join(f"<{v:04x}> <{k.encode('utf-16-be').hex()}>\n" for k, v in known.items())
    cmap = f"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0100> <0119> <0041> endbfrange 1 beginbfrange <0200> <0201> [<0066006c> <2013>] endbfrange {len(known)} beginbfchar\n{chars}endbfchar".encode()
    n = len(texts)
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{10 + i} 0 R' for i in range(n))}] /Count {n} /Resources << /Font << /F1 5 0 R >> >> >>".encode(), 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"}
    packed |= {10 + i: f"<< /Type /Page /Parent 2 0 R /Contents {50 + i} 0 R >>".encode() for i in range(n)}
    body, head = b"", []
    for number, x in packed.items():
        head.append(f"{number} {len(body)}")
        body += x + b" "
    first = " ".join(head).encode() + b" "

    def stream(number, data, more=b""):
        z = zlib.compress(data)
        return b"%d 0 obj\n<< /Length %d /Filter /FlateDecode %s >>\nstream\n" % (number, len(z), more) + z + b"\nendstream\nendobj\n"

    out = b"%PDF-1.5\n" + stream(6, cmap) + stream(7, first + body, b"/Type /ObjStm /N %d /First %d" % (len(packed), len(first)))
    for i, s in enumerate(shown):
        out += stream(50 + i, f"BT /F1 12 Tf [<{s}> -20 <01000119>] TJ T* <02000201> Tj ET".encode())
    out += stream(8, b"\0" * 20, b"/Type /XRef /Root 1 0 R /Size 60 /W [1 2 1]")
    if update:
        out += stream(50, update)
    return out + b"startxref\n9\n%%EOF"


def test_packed_objects_and_unicode_maps():
    assert pdf.pages(modern(TEXTS)) == [f"{t}AZ\nfl–" for t in TEXTS]


def test_an_update_replaces_objects():
    assert pdf.pages(modern(TEXTS, b"BT (later) Tj ET"))[0] == "later"


def test_files_without_text():
    assert pdf.pages(b"") == pdf.pages(b"%PDF-1.5 nothing") == pdf.pages(modern(TEXTS).replace(b"/W [1 2 1]", b"/Encrypt 9 0 R")) == []
    assert pdf.pages(modern([])) == []


def test_pages_come_one_by_one(spark):
    rows = [("a.pdf", bytearray(modern(TEXTS))), ("b.pdf", bytearray(pdf.made([["x", "y"], [], ["(z)"]]))), ("c.pdf", bytearray(b"")), ("d.pdf", None)]
    got = files.pdf_pages(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((r.path, r.page, r.text) for r in got) == [("a.pdf", 1, "GrüßeAZ\nfl–"), ("a.pdf", 2, "αβγAZ\nfl–"), ("a.pdf", 3, "日本AZ\nfl–"), ("b.pdf", 1, "x\ny"), ("b.pdf", 2, ""), ("b.pdf", 3, "(z)")]
