"""Crops against a plain decoder of its own, which goes through a page byte by byte."""

import io
import random
import struct
import zlib

import pytest

from sheetlake.operators import crops
from sheetlake.sources import png

SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def guess(kind, a, b, c):
    if kind == 4:
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
    return (0, a, b, (a + b) // 2)[kind]


def code(rows, kinds, step, back=False):
    """Rows with their filters applied, or taken off again."""
    out, above = [], None
    for row, kind in zip(rows, kinds):
        done = bytearray()
        plain = done if back else row
        top = above or bytes(len(row))
        for i, v in enumerate(row):
            a, c = (plain[i - step], top[i - step]) if i >= step else (0, 0)
            g = guess(kind, a, top[i], c)
            done.append((v + g if back else v - g) & 255)
        above = bytes(done) if back else row
        out.append(bytes(done))
    return out


def build(width, height, rows, kinds, depth, colour, pieces=7, extra=b"", interlaced=0):
    step = max(1, depth * SAMPLES[colour] // 8)
    packed = zlib.compress(b"".join(bytes([k]) + r for k, r in zip(kinds, code(rows, kinds, step))))
    cuts = [packed[i:i + pieces] for i in range(0, len(packed), pieces)]
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"k\0v") + extra + b"".join(chunk(b"IDAT", c) for c in cuts) + chunk(b"IEND", b"")


def samples(content):
    """width, height, depth, colour, the chunks' names, and each row as a list of pixels, read the plain way."""
    at, packed, names = 8, b"", []
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at:at + 8])
        data = content[at + 8:at + 8 + size]
        assert struct.unpack(">I", content[at + 8 + size:at + 12 + size])[0] == zlib.crc32(kind + data)
        names.append(kind)
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", data[:10])
        packed += data if kind == b"IDAT" else b""
        at += 12 + size
    bits = depth * SAMPLES[colour]
    stride, raw = (width * bits + 7) // 8, zlib.decompress(packed)
    assert len(raw) == height * (stride + 1)
    lines = [raw[i * (stride + 1):(i + 1) * (stride + 1)] for i in range(height)]
    rows = code([line[1:] for line in lines], [line[0] for line in lines], max(1, bits // 8), back=True)
    text = ["".join(f"{b:08b}" for b in r)[:width * bits] for r in rows]
    return width, height, depth, colour, names, [[t[i:i + bits] for i in range(0, len(t), bits)] for t in text]


def page(rng, width, height, depth, colour, kinds=None, **more):
    stride = (width * depth * SAMPLES[colour] + 7) // 8
    rows = [rng.randbytes(stride) for _ in range(height)]
    return build(width, height, rows, kinds or [rng.randrange(5) for _ in range(height)], depth, colour, **more)


@pytest.mark.parametrize("depth,colour", [(1, 0), (2, 0), (4, 3), (1, 3), (8, 0), (8, 3), (8, 2), (8, 4), (8, 6), (16, 0), (16, 2), (16, 4), (16, 6)])
@pytest.mark.parametrize("rows", [1, 3, 256])
def test_crops_equal_a_plain_decode(monkeypatch, depth, colour, rows):
    monkeypatch.setattr(png, "BAND_ROWS", rows)
    monkeypatch.setattr(png, "PIECE", 11)
    rng = random.Random(depth * 100 + colour * 10 + rows)
    shown = chunk(b"PLTE", bytes(range(48))) + chunk(b"pHYs", bytes(9))
    for kinds in (None, [0] * 17, [1] * 17, [2] * 17, [3] * 17, [4] * 17):
        content = page(rng, 23, 17, depth, colour, kinds, extra=shown)
        pixels = samples(content)[5]
        boxes = [png.Box("all", 0, 0, 23, 17), png.Box("dot", 22, 16, 1, 1), png.Box("odd", 3, 5, 9, 7), png.Box("odd", 3, 5, 9, 7), png.Box("top", 5, 0, 11, 1)]
        boxes += [png.Box(f"b{i}", x := rng.randrange(23), y := rng.randrange(17), rng.randint(1, 23 - x), rng.randint(1, 17 - y)) for i in range(9)]
        got = list(png.cut(io.BytesIO(content), boxes))
        assert sorted(g[0] for g in got) == sorted(b.id for b in boxes) and all(g[2] is None for g in got)
        by_id = {b.id: b for b in boxes}
        for name, crop, _ in got:
            b = by_id[name]
            width, height, d, c, names, held = samples(crop)
            assert (width, height, d, c) == (b.width, b.height, depth, colour) and names[:3] == [b"IHDR", b"PLTE", b"pHYs"]
            assert held == [r[b.x:b.x + b.width] for r in pixels[b.y:b.y + b.height]]


def test_pages_that_cannot_be_cut():
    rng = random.Random(1)
    good, box = page(rng, 8, 8, 8, 2), [png.Box("a", 0, 0, 2, 2), png.Box("b", 0, 6, 2, 2)]
    why = lambda content, boxes=box: {i: e for i, _, e in png.cut(io.BytesIO(content), boxes)}
    assert why(b"") == why(b"\xff\xd8\xff") == {"a": "not a PNG image", "b": "not a PNG image"}
    assert set(why(good[:60]).values()) == {"image ends early"} and set(why(png.SIGNATURE).values()) == {"image ends early"}
    assert set(why(page(rng, 8, 8, 8, 2, interlaced=1)).values()) == {"interlaced image"}
    odd = good[:33] + chunk(b"IDAT", zlib.compress((b"\5" + bytes(24)) * 8)) + chunk(b"IEND", b"")
    assert set(why(odd).values()) == {"unknown row filter"}
    outside = [png.Box("l", -1, 0, 2, 2), png.Box("r", 7, 0, 2, 2), png.Box("d", 0, 7, 1, 2), png.Box("n", 0, 0, 0, 1), png.Box("ok", 7, 7, 1, 1)]
    assert why(good, outside) == {"l": "box outside the image", "r": "box outside the image", "d": "box outside the image", "n": "box outside the image", "ok": None}
    head = good.index(b"IDAT")
    broken = bytearray(good)
    broken[head + 4] ^= 0xFF  # the packed stream's first byte
    assert set(why(bytes(broken)).values()) == {"damaged image data"}
    assert why(good, []) == {}


def test_rows_below_the_last_box_are_not_read(monkeypatch):
    monkeypatch.setattr(png, "BAND_ROWS", 4)
    content = page(random.Random(2), 64, 400, 8, 0)
    stream = io.BytesIO(content)
    assert [e for _, _, e in png.cut(stream, [png.Box("a", 1, 1, 5, 5)])] == [None] and stream.tell() < len(content) / 10


def test_cut_over_rows(spark, tmp_path):
    rng = random.Random(3)
    content = page(rng, 40, 30, 8, 2)
    (tmp_path / "a page.png").write_bytes(content)
    pixels, path = samples(content)[5], f"file:{tmp_path}/a page.png"
    rows = [(path, f"t{i}", i % 30, i % 20, 10, 10, "x") for i in range(31)] + [(path, "t1", 1, 1, 10, 10, "y"), (path, None, 0, 0, 1, 1, "x"), (path, "null", None, 0, 1, 1, "x"), (None, "no", 0, 0, 1, 1, "x"), (str(tmp_path / "gone.png"), "gone", 0, 0, 1, 1, "x")]
    boxes = spark.createDataFrame(rows, "image_path string, id string, x int, y int, width int, height int, crop string")
    images = spark.createDataFrame([(path, bytearray(content))], "image_path string, image binary")
    for got in (crops.cut(boxes, boxes_a_row=5), crops.cut(boxes, images, boxes_a_row=5)):
        got = got.collect()
        assert len(got) == len(rows)
        errors = {r.id: r.error for r in got if r.error}
        assert errors == {"null": "box with a null", "no": "no image", "gone": "no image"}
        for r in got:
            if r.crop is not None and r.id is not None:
                i = int(r.id[1:])
                assert samples(bytes(r.crop))[5] == [p[i % 30:i % 30 + 10] for p in pixels[i % 20:i % 20 + 10]]
    assert crops.cut(boxes.limit(0)).count() == 0


def test_an_endpoint_is_sent_the_crops(spark, tmp_path):
    """Tiles and targets are asked with their own pictures, and the pictures are among the documents."""
    import json

    from sheetlake import command
    from sheetlake.sources import providers

    source, marks = tmp_path / "in", tmp_path / "marks"
    source.mkdir()
    marks.mkdir()
    content = page(random.Random(4), 1400, 300, 8, 0, [2] * 300, pieces=5000)
    (source / "DEMO_AB12.png").write_bytes(content)
    (source / "DEMO_CD34.png").write_bytes(content[:-2000])  # the last rows are missing
    pixels = samples(content)[5]

    def ask(prompt, image, name):
        part = name.rsplit("/", 1)[1]
        (marks / part).write_bytes(image)
        if "target" in part:
            return providers.Answer("completed", json.dumps({"classification": "note", "confidence": 0.9}))
        found = [{"raw_text": "9", "value": "9", "type": "linear", "label": "B"}] if "tile" in part else []
        return providers.Answer("completed", json.dumps({"product_name": part, "dimensions": found}))

    box = [[10.0, 10.0], [40.0, 30.0]]
    texts = [{"file_name": "DEMO_AB12.png", "ordinal": 1, "polygon": box, "text": "77", "confidence": 0.9, "engine": "e"}]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, texts)))
    out = str(tmp_path / "out")
    got = command.process(spark, str(source), out, ask=ask, extractor="ollama", extract_crops=True, texts=str(tmp_path / "t.jsonl"), write_documents=True, calls={"lanes": 2})
    assert got == {"found": 2, "processed": 2, "skipped": 0, "failed": 0}
    ids = ["page_001_tile_001", "page_001_tile_002", "page_001_ocr_target_001"]
    assert {m.name for m in marks.iterdir()} == {"DEMO_AB12.png", "DEMO_CD34.png", *[f"DEMO_AB12.png#{i}" for i in ids]}
    internal = tmp_path / "out/documents/internal"
    assert sorted(p.name for d in ("crops", "ocr_target_crops") for p in (internal / d).iterdir()) == sorted(f"demo_ab12_{i}.png" for i in ids)
    for i, (folder, x) in zip(ids, (("crops", 0), ("crops", 768), ("ocr_target_crops", 0))):
        crop = (marks / f"DEMO_AB12.png#{i}").read_bytes()
        assert crop == (internal / folder / f"demo_ab12_{i}.png").read_bytes()
        width, height, _, _, _, held = samples(crop)
        assert held == [r[x:x + width] for r in pixels[:height]]
    errors = spark.read.parquet(f"{out}/work/batch=0/part=0/tile-crops").filter("image IS NULL")
    assert {(r.path.rsplit("/", 1)[1], r.error) for r in errors.collect()} == {("DEMO_CD34.png", "image ends early")}
    audits = {a.tiles and len(a.tiles): len(a.tile_extractions) for a in spark.read.parquet(f"{out}/audits").collect()}
    assert audits == {2: 2}
    statuses = {json.loads(e)["status"] if isinstance(e, str) else e.status for a in spark.read.parquet(f"{out}/audits").collect() for e in a.tile_extractions}
    assert statuses == {"validation_failed", "not_run"}  # the answers leave fields out
