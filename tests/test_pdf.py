"""PDF files made here in several encodings and compressions, read back."""

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from keepsake.functions import lines
from keepsake.sources import formats, pdf


def stream(body: bytes, extra: str = "", length: bool = True) -> bytes:
    return f"<< {extra} {f'/Length {len(body)}' if length else ''} >>\nstream\n".encode() + body + b"\nendstream"


def written(objects: dict[int, bytes], trailer: str = "/Root 1 0 R") -> bytes:
    out = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
    for number, body in objects.items():
        out += f"{number} 0 obj\n".encode() + body + b"\nendobj\n"
    return out + f"trailer\n<< {trailer} >>\nstartxref\n0\n%%EOF".encode()


def one_page(content: bytes, font: str = "/Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding", more: dict[int, bytes] | None = None, extra: str = "", trailer: str = "/Root 1 0 R") -> bytes:
    return written({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", 4: stream(content, extra), 5: f"<< {font} >>".encode(), **(more or {})}, trailer)


def shown(*texts: bytes) -> bytes:
    return b"BT /F1 12 Tf 14 TL 72 720 Td " + b" T* ".join(b"(" + t.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj" for t in texts) + b" ET"


def packed_lzw(data: bytes) -> bytes:
    """Every byte as a code of its own, with the table begun anew before it grows wide."""
    bits = ""
    for i in range(0, len(data), 200):
        bits += f"{256:09b}" + "".join(f"{b:09b}" for b in data[i : i + 200])
    bits += f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def predicted(data: bytes, columns: int) -> bytes:
    """Rows as differences to the row above."""
    data += b" " * (-len(data) % columns)
    rows = [data[i : i + columns] for i in range(0, len(data), columns)]
    return b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True)) for row, before in zip(rows, [bytes(columns), *rows], strict=False))


CODES = b"""/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0003> <0020> <0010> <D83DDE00> endbfchar 2 beginbfrange <0041> <005A> <0061> <0020> <0021> [<00E9> <FB01>] endbfrange endcmap end end"""
PLAIN = shown(b"First line of the page", b"second (with parts) here")
CASES = {
    "plain": (one_page(PLAIN), "First line of the page\nsecond (with parts) here"),
    "flate": (one_page(zlib.compress(PLAIN), extra="/Filter /FlateDecode"), "First line of the page\nsecond (with parts) here"),
    "cut_flate": (one_page(zlib.compress(PLAIN)[:-4], extra="/Filter /FlateDecode"), "First line of the page\nsecond (with parts) here"),
    "two_filters": (one_page(base64.a85encode(zlib.compress(PLAIN)) + b"~>", extra="/Filter [/ASCII85Decode /FlateDecode]"), "First line of the page\nsecond (with parts) here"),
    "hex": (one_page(PLAIN.hex().encode() + b">", extra="/Filter /ASCIIHexDecode"), "First line of the page\nsecond (with parts) here"),
    "lzw": (one_page(packed_lzw(PLAIN * 3), extra="/Filter /LZWDecode"), "\n".join(["First line of the page\nsecond (with parts) here"] * 3)),
    "runs": (one_page(bytes([len(PLAIN) - 1]) + PLAIN + b"\x80", extra="/Filter /RunLengthDecode"), "First line of the page\nsecond (with parts) here"),
    "predictor": (one_page(zlib.compress(predicted(PLAIN, 16)), extra="/Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 16 >>"), "First line of the page\nsecond (with parts) here"),
    "western": (one_page(shown("Grüße – “naïve” €5".encode("cp1252"))), "Grüße – “naïve” €5"),
    "mac": (one_page(shown("Grüße naïve".encode("mac_roman")), "/Type /Font /Subtype /TrueType /Encoding /MacRomanEncoding"), "Grüße naïve"),
    "differences": (one_page(shown(b"A\x01\x02\x03 z"), "/Type /Font /Subtype /Type1 /Encoding << /Differences [1 /eacute /uni20AC /Scaron 122 /germandbls] >>"), "Aé€Š ß"),
    "composite": (one_page(b"BT /F1 10 Tf 72 700 Td <0041004200030020002100100043> Tj ET", "/Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 6 0 R /DescendantFonts [7 0 R]", {6: stream(zlib.compress(CODES), "/Filter /FlateDecode"), 7: b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [65 [500 510] 70 80 400] >>"}), "ab éﬁ\U0001f600c"),
    "kerned": (one_page(b"BT /F1 12 Tf 72 700 Td [(Wo) 20 (rd) -300 (next)] TJ 0 -14 Td (o\\143tal \\\nline) Tj ET"), "Word next\noctal line"),
    "moved": (one_page(b"q 1 0 0 1 50 50 cm BT /F1 12 Tf 1 0 0 1 0 600 Tm (left) Tj 1 0 0 1 200 600 Tm (right) Tj ET Q BT /F1 12 Tf 10 20 Td (low) ' (lower) Tj ET"), "left right\nlowlower"),
    "form": (one_page(b"/X1 Do BT /F1 12 Tf 72 600 Td (after the form) Tj ET").replace(b"/Font << /F1 5 0 R >>", b"/Font << /F1 5 0 R >> /XObject << /X1 6 0 R >>").replace(b"trailer", b"6 0 obj\n" + stream(shown(b"inside the form"), "/Type /XObject /Subtype /Form") + b"\nendobj\ntrailer"), "inside the form\nafter the form"),
    "image": (one_page(b"BI /W 2 /H 2 ID \x00(\xff) EI BT /F1 12 Tf 72 700 Td (text after image) Tj ET"), "text after image"),
    "no_length": (one_page(PLAIN).replace(f"/Length {len(PLAIN)}".encode(), b"/Length 99 0 R"), "First line of the page\nsecond (with parts) here"),
}


def in_object_stream() -> bytes:
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 8 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R 6 0 R] /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Type /Font /Subtype /Type1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R /Resources << /Font << /F1 5 0 R >> >> >>"]
    numbers, offsets = [1, 2, 3, 5, 8], [sum(len(p) + 1 for p in parts[:i]) for i in range(5)]
    head = " ".join(f"{n} {o}" for n, o in zip(numbers, offsets, strict=True)).encode() + b" "
    holder = stream(zlib.compress(head + b" ".join(parts)), f"/Type /ObjStm /N 5 /First {len(head)} /Filter /FlateDecode")
    return written({4: stream(b"BT /F1 12 Tf 72 700 Td (first page) Tj ET"), 6: stream(b"BT /F1 12 Tf 72 650 Td (shared part) Tj ET"), 9: holder, 10: stream(b"", "/Type /XRef /Root 1 0 R /W [1 2 1] /Size 11")}, "/Size 11")


CASES["object_stream"] = (in_object_stream(), "first page\nshared part\n\nshared part")
BROKEN = {"none": b"no pdf at all", "empty": b"", "encrypted": one_page(PLAIN, trailer="/Root 1 0 R /Encrypt 9 0 R"), "no_pages": b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj", "circle": written({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [2 0 R] >>"}), "bad_flate": one_page(b"no flate data", extra="/Filter /FlateDecode")}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(k, v[0]) for k, v in CASES.items()] + list(BROKEN.items())
    return spark.createDataFrame(rows, "path string, content binary")


def test_files_are_read_back(files):
    got = {r["path"]: r for r in pdf.texts(files).collect()}
    assert {k: got[k]["text"] for k in CASES} == {k: v[1] for k, v in CASES.items()}
    assert all(got[k]["error"] is None and got[k]["pages"] == (2 if k == "object_stream" else 1) for k in CASES)
    assert all(got[k]["error"] and got[k]["text"] == "" for k in BROKEN) and "encrypted" in got["encrypted"]["error"]


def test_a_damaged_file_stops_no_other(spark):
    whole = CASES["object_stream"][0]
    rows = [(f"{i}", whole[:i] + bytes([i * 7 % 256]) + whole[i + 3 :]) for i in range(0, len(whole), 11)] + [("whole", whole)]
    got = {r["path"]: r["text"] for r in pdf.texts(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert len(got) == len(rows) and got["whole"] == CASES["object_stream"][1]


def test_larger_lines_are_headings(spark):
    body = b"".join(f"BT /F1 10 Tf 72 {700 - 12 * i} Td (body line {i}) Tj ET ".encode() for i in range(5))
    file = one_page(b"BT /F1 18 Tf 72 730 Td (A larger line) Tj ET " + body, trailer="/Root 1 0 R /Info << /Title (The title) >>")
    row = pdf.texts(spark.createDataFrame([("a", file)], "path string, content binary"), headings=True).first()
    assert row["text"].split("\n")[0] == "## A larger line" and "## body" not in row["text"] and row["title"] == "The title"
    heights = pdf.page_lines(pdf.items(spark.createDataFrame([("a", file)], "path string, content binary"))).collect()
    assert {h["body_height"] for h in heights} == {10.0} and len(heights) == 6


def test_documents_of_a_folder(spark, tmp_path):
    words = " ".join(f"{'abcdefghij'[i % 10]}{'klmnopq'[i % 7]}ord" for i in range(120))
    text = [b"INTRODUCTION PART", *(f"{words[i : i + 60]}.".encode() for i in range(0, len(words), 60)), b"References", b"1. gone"]
    (tmp_path / "a.pdf").write_bytes(one_page(shown(*text)))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.pdf").write_bytes(one_page(shown(b"short")))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in formats.parsed(formats.read_documents(spark, str(tmp_path))).collect()}
    assert rows["b.pdf"]["error"] == "not a PDF file" and rows["b.pdf"]["sections"] == [] and "no extractable text" in rows["c.pdf"]["error"]
    assert rows["a.pdf"]["error"] is None and rows["a.pdf"]["text"].count("ord") == 120 and [s["heading"] for s in rows["a.pdf"]["sections"]] == ["INTRODUCTION PART"]


def test_pdf_sections(spark):
    many = " ".join(f"word{i}" for i in range(120))
    text = f"{many}\nINTRODUCTION PART\n[Page 2]\n{many}\n2.1 Methods Of It\nA short part.\n## 3 Marked\n{many}\nRESULTS OF IT\n{many}\n## lower\nend"
    rows = spark.range(1).select(lines.pdf_sections(F.lit(text)).alias("s"), lines.pdf_sections(F.lit("no heading")).alias("none")).first()
    found = [(s["heading"], s["level"], len(s["text"].split())) for s in rows["s"]]
    assert found == [(None, 0, 120), ("INTRODUCTION PART", 1, 120), ("3 Marked", 1, 120), ("RESULTS OF IT", 1, 123)] or found == [(None, 0, 120), ("INTRODUCTION PART", 1, 120 + 7), ("3 Marked", 1, 120), ("RESULTS OF IT", 1, 123)], found
    assert rows["none"] == []


def test_strict_headings(spark):
    asked = ["INTRODUCTION", "1.2 Methods", "Methods", "SMITH v. JONES", "A = B", "12", "page 3", "ENDS,", "X", "PART 3"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "i int, x string").select("i", lines.strict_heading(F.col("x")).alias("is")).orderBy("i").collect()
    assert [r["is"] for r in rows] == [True, True] + [False] * 8
