"""PDF files written here by hand: tables and streams of references, object streams, composite fonts, positions."""

import zlib

import pytest

from quernstone.session import ship
from quernstone.sources import pdf, readers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)
    pdf.register(spark)


def stream(body: bytes, extra: bytes = b"", deflate: bool = True) -> bytes:
    raw = zlib.compress(body) if deflate else body
    return b"<<%s%s/Length %d>>\nstream\n%s\nendstream" % (extra, b"/Filter/FlateDecode" if deflate else b"", len(raw), raw)


def plain_file(objects: dict[int, bytes], start: bytes | None = None) -> bytes:
    """A file with a table of references; object 1 is the catalogue."""
    out, at = b"%PDF-1.4\n%\xe2\xe3\n", {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table, size = len(out), max(objects) + 1
    rows = b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 65535 f \n" for n in range(size))
    return out + b"xref\n0 %d\n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%s\n%%%%EOF" % (size, rows, size, start or b"%d" % table)


def packed_file(objects: dict[int, bytes]) -> bytes:
    """A file whose plain objects lie in an object stream, with a stream of references and row predictors."""
    inner = {n: b for n, b in objects.items() if b"\nstream\n" not in b}
    out, places = b"%PDF-1.7\n", {}
    for n, body in objects.items():
        if n not in inner:
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    held, last = max(objects) + 1, max(objects) + 2
    head, body = b"", b""
    for i, (n, b) in enumerate(inner.items()):
        head += b"%d %d " % (n, len(body))
        body += b + b"\n"
        places[n] = (2, held, i)
    places[held] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (held, stream(head + body, b"/Type/ObjStm/N %d/First %d" % (len(inner), len(head))))
    places[last] = (1, len(out), 0)
    rows, before = b"", bytes(8)
    for n in range(last + 1):
        kind, a, b = places.get(n, (0, 0, 0))
        row = bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(3, "big")
        rows += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))  # the difference to the row above
        before = row
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (last, stream(rows, b"/Type/XRef/Size %d/W[1 4 3]/Root 1 0 R/DecodeParms<</Predictor 12/Columns 8>>" % (last + 1)), places[last][1])


CHINESE = "贵州茅台：营业收入增长"
GLYPH = {c: 100 + 3 * i for i, c in enumerate(dict.fromkeys(CHINESE))}


def cmap() -> bytes:
    pairs = b"".join(b"<%04X> <%s>\n" % (g, c.encode("utf-16-be").hex().encode()) for c, g in list(GLYPH.items())[:-2])
    rest = b"".join(b"<%04X> <%04X> [<%s>]\n" % (g, g, c.encode("utf-16-be").hex().encode()) for c, g in list(GLYPH.items())[-2:])
    n = len(GLYPH)
    return b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n%d beginbfchar\n%sendbfchar\n3 beginbfrange\n%s<0030> <0039> <0030>\nendbfrange endcmap" % (n - 2, pairs, rest)


def codes(text: str) -> bytes:
    return b"<" + b"".join(b"%04X" % GLYPH.get(c, ord(c)) for c in text) + b">"


def objects(mapped: bool = True) -> dict[int, bytes]:
    """Two pages: Chinese in a composite font, and one in a simple font."""
    first = b"BT /F1 12 Tf 72 700 Td %s Tj 0 -20 Td [%s -2000 %s] TJ ET" % (codes(CHINESE[:5]), codes(CHINESE[5:9]), codes("2023"))
    second = b"q 1 0 0 1 0 0 cm BT /F2 10 Tf 14 TL 1 0 0 1 72 700 Tm (Net sales \\(EUR\\)) Tj T* (grew) Tj 40 0 Td (fast) Tj (er) Tj 0 -14 Td (\\340 la carte\\205) Tj ET Q"
    return {
        1: b"<</Type/Catalog/Pages 2 0 R>>",
        2: b"<</Type/Pages/Count 2/Kids[3 0 R 4 0 R]/Resources<</Font<</F1 6 0 R/F2 9 0 R>>>>>>",
        3: b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>",
        4: b"<</Type/Page/Parent 2 0 R/Contents[10 0 R]>>",
        5: stream(first),
        6: b"<</Type/Font/Subtype/Type0/BaseFont/ABCDEF+SimSun/Encoding/Identity-H/DescendantFonts[7 0 R]%s>>" % (b"/ToUnicode 8 0 R" if mapped else b""),
        7: b"<</Type/Font/Subtype/CIDFontType2/CIDSystemInfo<</Registry(Adobe)/Ordering(Identity)/Supplement 0>>/DW 1000/W[48 57 500]>>",
        8: stream(cmap()),
        9: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>",
        10: stream(second, deflate=False),
    }


FIRST, SECOND = CHINESE[:5] + "\n" + CHINESE[5:9] + " 2023", "Net sales (EUR)\ngrew faster\nà la carte…"


@pytest.mark.parametrize("write", [plain_file, packed_file, lambda o: plain_file(o, b"7"), lambda o: packed_file(o).replace(b"startxref", b"startxxxx")])
def test_pages_of_all_kinds_of_files(write):
    """The same text from tables, streams and, where these are damaged, from a scan of the file."""
    assert list(pdf.read_pages(write(objects()))) == [(1, FIRST, None), (2, SECOND, None)]
    assert list(pdf.read_pages(write(objects()), 1, 2)) == [(2, SECOND, None)]
    assert [x[0] for x in pdf.read_pages(write(objects()), text=False)] == [1, 2]


def test_what_cannot_be_decoded_is_an_error():
    (one, two) = pdf.read_pages(plain_file(objects(mapped=False)))
    assert one[:2] == (1, None) and "SimSun" in one[2] and two == (2, SECOND, None)
    with pytest.raises(pdf.PdfError, match="encrypted"):
        list(pdf.read_pages(plain_file(objects()).replace(b"/Root 1 0 R", b"/Root 1 0 R/Encrypt<<>>")))
    with pytest.raises(pdf.PdfError, match="not a PDF"):
        list(pdf.read_pages(b"junk"))
    with pytest.raises(ValueError, match="page 1: .*SimSun"):
        readers.plain_pages(plain_file(objects(mapped=False)))


def test_fonts():
    def page(font: bytes, shown: bytes, more: dict | None = None) -> str:
        o = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>>", 4: stream(b"BT /F 10 Tf " + shown + b" ET"), 5: font}
        ((_, text, error),) = pdf.read_pages(plain_file({**o, **(more or {})}))
        return text if error is None else "!" + error

    wide = b"<</Type/Font/Subtype/Type0/BaseFont/SongTi/Encoding/%s/DescendantFonts[<</DW 1000>>]>>"
    assert page(wide % b"GBK-EUC-H", b"<%s> Tj" % "净利润 5%".encode("gbk").hex().encode()) == "净利润 5%"
    assert page(wide % b"UniGB-UCS2-H", b"<%s> Tj" % "净利润".encode("utf-16-be").hex().encode()) == "净利润"
    assert page(wide % b"Identity-H", b"<0001> Tj").startswith("!SongTi")
    names = b"<</Type/Font/Subtype/Type1/BaseFont/A/Encoding<</Differences[1/uni4E2D/A/hyphen/fi/g123]>>>>"
    assert page(names, b"<01020304> Tj") == "中A-fi" and page(names, b"<05> Tj") == "!A does not say what its codes mean"
    own = b"<</Type/Font/Subtype/TrueType/BaseFont/B/FontDescriptor<</Flags 4/FontFile2 6 0 R>>>>"
    assert page(own, b"(xyz) Tj", {6: stream(b"")}) == "!B does not say what its codes mean"
    assert page(b"<</Type/Font/Subtype/Type1/BaseFont/Courier>>", b"(a) Tj 100 0 Td (b) Tj 0 3 Td (c) Tj -100 0 Td (d) Tj") == "a bc\nd"


def test_forms_and_inline_images():
    o = objects()
    o[3] = b"<</Type/Page/Contents 5 0 R/Resources<</XObject<</X 11 0 R>>>>>>"
    o[5] = stream(b"/X Do BI /W 1 /H 1 ID (x) Tj EI q Q")
    o[11] = stream(b"BT /F 10 Tf (in a form) Tj ET", b"/Type/XObject/Subtype/Form/Matrix[1 0 0 1 5 5]/Resources<</Font<</F 9 0 R>>>>")
    assert next(iter(pdf.read_pages(plain_file(o)))) == (1, "in a form", None)


def test_the_data_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(plain_file(objects()))
    (tmp_path / "sub" / "b.PDF").write_bytes(packed_file(objects(mapped=False)))
    (tmp_path / "bad.pdf").write_bytes(b"junk")
    (tmp_path / "note.txt").write_bytes(b"no PDF")
    rows = spark.read.format("pdf_pages").load(str(tmp_path)).collect()
    assert sorted((r["filename"], r["page"] or 0, r["text"]) for r in rows) == [("a", 1, FIRST), ("a", 2, SECOND), ("b", 1, None), ("b", 2, SECOND), ("bad", 0, None)]
    assert {r["filename"]: r["error"] for r in rows if r["error"]}["bad"] == "not a PDF"
    few = spark.read.format("pdf_pages").schema("page int, filename string").load(f"file://{tmp_path}")
    assert few.columns == ["page", "filename"] and few.where("page = 2").count() == 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("pdf_pages").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("pdf_pages").schema("colour string").load(str(tmp_path)).count()
    parsed = readers.parsed_pdfs(spark, str(tmp_path))
    assert readers.parse_index(parsed).where("filename = 'b'").first()["error"] is not None and parsed.count() == 5


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    o = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[%s]>>" % b" ".join(b"%d 0 R" % n for n in range(10, 110)), 3: b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>"}
    for n in range(10, 110):
        o[n] = b"<</Type/Page/Contents %d 0 R/Resources<</Font<</F 3 0 R>>>>>>" % (n + 1000)
        o[n + 1000] = stream(b"BT /F 9 Tf (page %d) Tj ET" % (n - 9), deflate=False)
    (tmp_path / "large.pdf").write_bytes(plain_file(o))
    df = spark.read.format("pdf_pages").option("bytes", 4000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 4
    assert sorted((r["page"], r["text"]) for r in df.collect()) == [(i, f"page {i}") for i in range(1, 101)]


def test_damaged_files_give_rows_not_failures(spark):
    """Any cut and any flipped byte: text, an error of a page, or an error of the file."""
    import random

    r = random.Random(4)
    for write in (plain_file, packed_file):
        whole = write(objects())
        for _ in range(150):
            raw = bytearray(whole[: r.randrange(20, len(whole))] if r.random() < 0.3 else whole)
            for _ in range(r.randrange(1, 8)):
                raw[r.randrange(9, len(raw))] = r.randrange(256)
            try:
                for page, text, error in pdf.read_pages(bytes(raw)):
                    assert page >= 1 and (text is None) == (error is not None)
            except (pdf.PdfError, LookupError, ValueError, TypeError, AttributeError, zlib.error, RecursionError):
                pass
