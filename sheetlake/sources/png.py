"""Boxes cut out of PNG pages in one pass that holds a band of rows, whatever the page's size.

Kept small on purpose: it runs inside tasks, a page at a time (see
``operators.crops``). Interlaced pages are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

# Fixed values of the format: its first bytes, samples a pixel by colour type, and chunks that say how samples are shown.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SHOWN = (b"PLTE", b"tRNS", b"gAMA", b"cHRM", b"sRGB", b"iCCP", b"sBIT", b"pHYs")

PIECE = 1 << 20  # bytes that are read or inflated at a time
BAND = 1 << 22  # bytes of a band, unless one row has more
BAND_ROWS = 256


class Unreadable(ValueError):
    """What keeps a page from being read."""


class Box(NamedTuple):
    id: str
    x: int
    y: int
    width: int
    height: int


class Page:
    """The header of a PNG stream, and then its rows in bands."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.shown = stream, []
        if stream.read(8) != SIGNATURE:
            raise Unreadable("not a PNG image")
        kind, size = self._head()
        if kind != b"IHDR" or size != 13:
            raise Unreadable("no image header")
        self.width, self.height, self.depth, self.colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", self._data(size))
        if not self.width or not self.height or self.colour not in SAMPLES or self.depth not in (1, 2, 4, 8, 16) or packing or filters:
            raise Unreadable("bad image header")
        if self.depth < 8 and SAMPLES[self.colour] > 1:
            raise Unreadable("bad image header")
        if interlaced:
            raise Unreadable("interlaced image")
        self.bits = SAMPLES[self.colour] * self.depth
        self.stride = (self.width * self.bits + 7) // 8

    def _exactly(self, n: int) -> bytes:
        data = self.stream.read(n)
        while len(data) < n:  # remote streams may give less than was asked for
            more = self.stream.read(n - len(data))
            if not more:
                raise Unreadable("image ends early")
            data += more
        return data

    def _head(self) -> tuple[bytes, int]:
        size, kind = struct.unpack(">I4s", self._exactly(8))
        return kind, size

    def _data(self, size: int) -> bytes:
        data = self._exactly(size)
        self._exactly(4)  # the sum of the chunk; damage shows in the packed stream's own sum
        return data

    def _packed(self) -> Iterator[bytes]:
        """The packed rows in pieces; display chunks on the way are kept, others passed over."""
        while True:
            kind, size = self._head()
            if kind == b"IEND":
                return
            if kind in SHOWN:
                self.shown.append((kind, self._data(size)))
                continue
            while size > 0:
                piece = self._exactly(min(size, PIECE))
                size -= len(piece)
                if kind == b"IDAT":
                    yield piece
            self._exactly(4)

    def _inflated(self) -> Iterator[bytes]:
        unpack = zlib.decompressobj()
        try:
            for piece in self._packed():
                while piece and not unpack.eof:
                    yield unpack.decompress(piece, PIECE)
                    piece = unpack.unconsumed_tail
            yield unpack.flush()
        except zlib.error as e:
            raise Unreadable("damaged image data") from e

    def bands(self) -> Iterator[tuple[int, np.ndarray]]:
        """The first row and the bytes (rows, stride) of each band, in order."""
        line = self.stride + 1
        rows, at = max(1, min(BAND_ROWS, BAND // line)), 0
        before, held = np.zeros(self.stride, np.uint8), bytearray()
        step = max(1, self.bits // 8)
        pieces = self._inflated()
        while at < self.height:
            n = min(rows, self.height - at)
            while len(held) < n * line:
                piece = next(pieces, None)
                if piece is None:
                    raise Unreadable("image ends early")
                held += piece
            band = np.frombuffer(bytes(held[:n * line]), np.uint8).reshape(n, line)
            del held[:n * line]
            plain = _plain(band[:, 0], band[:, 1:], before, step)
            yield at, plain
            at, before = at + n, plain[-1]


def _plain(kinds: np.ndarray, coded: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters; ``before`` is the row above the first."""
    if kinds.max() > 4:
        raise Unreadable("unknown row filter")
    if kinds.max() > 2:
        return _swept(kinds, coded, before, step)
    out = np.empty_like(coded)
    for i, kind in enumerate(kinds):
        if kind == 1:
            out[i] = np.cumsum(coded[i].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            out[i] = coded[i] + before if kind == 2 else coded[i]
        before = out[i]
    return out


def _swept(kinds: np.ndarray, coded: np.ndarray, before: np.ndarray, step: int) -> np.ndarray:
    """As ``_plain`` for all filters: pixels of all rows that lie on one diagonal depend on the two diagonals before it only."""
    n, width = len(coded), coded.shape[1] // step
    given = np.zeros((width + n + 1, n + 1, step), np.int16)
    made = np.zeros((width + n + 3, n + 1, step), np.int16)  # two diagonals of zeros first
    for i, row in enumerate(coded, 1):
        given[i:i + width, i] = row.reshape(width, step)
    made[2:2 + width, 0] = before.reshape(width, step)
    kind = np.concatenate([[0], kinds])[:, None]
    for d in range(1, width + n):
        low, high = max(1, d - width + 1), min(n, d) + 1
        left, up, corner, k = made[d + 1, low:high], made[d + 1, low - 1:high - 1], made[d, low - 1:high - 1], kind[low:high]
        to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.where(k == 4, nearest, np.where(k == 3, (left + up) >> 1, np.where(k == 2, up, np.where(k == 1, left, 0))))
        made[d + 2, low:high] = (given[d, low:high] + guess) & 255
    return np.stack([made[i + 2:i + 2 + width, i].reshape(-1) for i in range(1, n + 1)]).astype(np.uint8)


class _Crop:
    """A PNG under construction, with the page's kind of samples."""

    def __init__(self, page: Page, box: Box):
        self.page, self.box, self.pack, self.parts = page, box, zlib.compressobj(), []
        self.above = None  # the last row, where rows are coded as differences

    def add(self, at: int, band: np.ndarray) -> bool:
        """Take the box's rows from a band; whether the last one is there."""
        page, box = self.page, self.box
        rows = band[max(0, box.y - at):box.y + box.height - at]
        first, end = box.x * page.bits, (box.x + box.width) * page.bits
        if page.bits % 8:
            rows = np.packbits(np.unpackbits(rows, axis=1)[:, first:end], axis=1)
        else:
            rows = rows[:, first // 8:end // 8]
        coded = np.zeros((len(rows), rows.shape[1] + 1), np.uint8)
        if page.depth >= 8 and page.colour != 3:
            above = np.zeros((1, rows.shape[1]), np.uint8) if self.above is None else self.above
            coded[:, 0], coded[:, 1:] = 2, rows - np.concatenate([above, rows[:-1]])
            self.above = rows[-1:].copy()
        else:
            coded[:, 1:] = rows
        self.parts.append(self.pack.compress(coded.tobytes()))
        return box.y + box.height <= at + len(band)

    def content(self) -> bytes:
        def chunk(kind: bytes, data: bytes) -> bytes:
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

        p, packed = self.page, b"".join([*self.parts, self.pack.flush()])
        header = struct.pack(">IIBBBBB", self.box.width, self.box.height, p.depth, p.colour, 0, 0, 0)
        return SIGNATURE + chunk(b"IHDR", header) + b"".join(chunk(k, d) for k, d in p.shown) + chunk(b"IDAT", packed) + chunk(b"IEND", b"")


def cut(stream: BinaryIO, boxes: list[Box]) -> Iterator[tuple[str, bytes | None, str | None]]:
    """id, PNG and error of each box, as soon as its last row has been read.

    A box that does not lie inside the page has an error; so have those whose
    rows cannot be read any more. The rows below the last box are not read.
    """
    waiting = sorted(boxes, key=lambda b: b.y, reverse=True)
    open_: list[_Crop] = []
    try:
        page = Page(stream)
        inside = [b for b in waiting if b.width > 0 and b.height > 0 and b.x >= 0 and b.y >= 0 and b.x + b.width <= page.width and b.y + b.height <= page.height]
        if len(inside) < len(waiting):
            fits = set(map(id, inside))
            yield from [(b.id, None, "box outside the image") for b in waiting if id(b) not in fits]
        waiting = inside
        bands = page.bands() if waiting else iter(())
        for at, band in bands:
            while waiting and waiting[-1].y < at + len(band):
                open_.append(_Crop(page, waiting.pop()))
            still = []
            while open_:
                crop = open_.pop()
                if crop.add(at, band):
                    yield crop.box.id, crop.content(), None
                else:
                    still.append(crop)
            open_ = still
            if not waiting and not open_:
                return
    except Unreadable as e:
        yield from [(b.id, None, str(e)) for b in [*waiting, *[c.box for c in open_]]]


def samples(stream: BinaryIO) -> bytes | None:
    """All rows of a small picture; None if it cannot be read."""
    try:
        return b"".join(band.tobytes() for _, band in Page(stream).bands())
    except Unreadable:
        return None
