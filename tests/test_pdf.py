"""Page counts and sizes of hand-made PDFs of all three forms, and of broken ones."""

import zlib

import pytest

from sheetlake.sources import files, pdf

OBJECTS = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /MediaBox [0 0 1190.55 841.89] >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents (a \\) \\( << ) >>",
    4: b"<< /Type /Pages /Parent 2 0 R /Kids [5 0 R 6 0 R] /Count 2 % a comment >>\n >>", 5: b"<< /Type /Page /Parent 4 0 R /MediaBox [ 10 20 110 220.5 ] /ID <0aff> >>", 6: b"<</Type/Page/Parent 4 0 R/Rotate 90/Flag true>>",
}
WANT = [(1190.55, 841.89), (100.0, 200.5), (1190.55, 841.89)]


def _bodies(out: bytes, objects: dict) -> tuple[bytes, dict]:
    places = {}
    for n, text in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, text)
    return out, places


def _end(out: bytes, at: int) -> bytes:
    return out + b"startxref\n%d\n%%%%EOF\n" % at


def table(objects=OBJECTS, start=b"%PDF-1.4\n", more=b"") -> bytes:
    out, places = _bodies(start, objects)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for n, place in places.items():
        out += b"%d 1\n%010d 00000 n \n" % (n, place)
    return _end(out + b"trailer\n<< /Size %d /Root 1 0 R %s >>\n" % (len(objects) + 1, more), at)


def stream(objects=OBJECTS, packed=False, predictor=False) -> bytes:
    """With a cross-reference stream; ``packed`` puts all objects into an object stream."""
    own = {}
    if packed:
        heads, bodies = b"", b""
        for n, text in objects.items():
            heads += b"%d %d " % (n, len(bodies))
            bodies += text + b" "
        data = zlib.compress(heads + bodies)
        own[7] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(objects), len(heads), len(data), data)
    else:
        own = dict(objects)
    out, places = _bodies(b"%PDF-1.7\n", own)
    rows = [bytes([0, 0, 0, 0])]
    for n in range(1, 9):
        if n in places:
            rows.append(bytes([1]) + places[n].to_bytes(2, "big") + b"\0")
        elif packed and n in objects:
            rows.append(bytes([2]) + (7).to_bytes(2, "big") + bytes([n - 1]))
        else:
            rows.append(bytes(4))
    at = len(out)
    if predictor:
        before, made = bytes(4), b""
        for r in rows:
            made += b"\x02" + bytes((x - y) & 255 for x, y in zip(r, before))
            before = r
        data, how = zlib.compress(made), b"/DecodeParms << /Predictor 12 /Columns 4 >>"
    else:
        data, how = zlib.compress(b"".join(rows)), b""
    out += b"8 0 obj\n<< /Type /XRef /W [1 2 1] /Size 9 /Root 1 0 R /Filter /FlateDecode %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (how, len(data), data)
    return _end(out, at)


def updated() -> bytes:
    """A second section that replaces the page tree's first node."""
    first = table()
    out = first + b"2 0 obj\n<< /Type /Pages /Kids [5 0 R] /Count 1 >>\nendobj\n"
    at = len(out)
    place = first.__len__()
    previous = int(first.rsplit(b"startxref\n", 1)[1].split()[0])
    return _end(out + b"xref\n2 1\n%010d 00000 n \ntrailer\n<< /Size 7 /Root 1 0 R /Prev %d >>\n" % (place, previous), at)


@pytest.mark.parametrize("made", [table(), stream(), stream(predictor=True), stream(packed=True), stream(packed=True, predictor=True), b"junk\n" * 0 + table(start=b"%PDF-1.0\r\n")])
def test_all_forms(made):
    assert pdf.File(made).pages() == WANT and pdf.facts_of(made)[:2] == (3, True)


def test_newer_sections_count():
    assert pdf.File(updated()).pages() == [(100.0, 200.5)]


def test_broken_files_have_a_note():
    whole = stream(packed=True)
    loop = {**OBJECTS, 4: b"<< /Kids [2 0 R 4 0 R 5 0 R] >>"}
    assert pdf.facts_of(table(loop))[0] == 2  # each node once
    broken = [b"", b"no pdf", b"%PDF-1.4\n", table()[:200], table().replace(b"/Root", b"/Toor"), table({1: b"<< /Pages 2 0 R >>"}), table({1: b"<< /Pages 2 0 R >>", 2: b"[" * 500}), whole.replace(b"/FlateDecode", b"/OtherDecode"), b"%PDF-1.4\nstartxref\n999999\n"]
    broken += [whole[:n] for n in range(0, len(whole), 37)]
    for data in broken:
        count, _, sizes, note = pdf.facts_of(data)
        assert count is None and sizes is None and note
    assert pdf.facts_of(None) == (None, None, None, None)


def test_facts_of_discovered_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(stream(packed=True))
    (tmp_path / "b.PDF").write_bytes(b"oops")
    (tmp_path / "c.png").write_bytes(b"x")
    got = {r.filename: r.pdf for r in files.discover(spark, str(tmp_path)).collect()}
    assert (got["a.pdf"].page_count, got["a.pdf"].is_pdf, got["a.pdf"].note) == (3, True, None) and [tuple(p) for p in got["a.pdf"].pages] == WANT
    assert (got["b.PDF"].page_count, got["b.PDF"].is_pdf) == (None, False) and got["b.PDF"].note and got["c.png"] is None


def test_the_command_warns_of_more_pages(spark, tmp_path):
    from sheetlake import command
    from sheetlake.operators import chain, parse

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(table())
    command.process(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/products")).first().warnings == [parse.PLACEHOLDER, chain.MANY_PAGES]
