"""Reading and writing of TIFF and BigTIFF images with their georeference, block by block.

Blocks (strips or tiles) may be stored plainly, with Deflate or with LZW, and
with horizontal differencing. Other compressions raise an error.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# TIFF tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, SOFTWARE, ARTIST, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 305, 315, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
SCALE, TIE, MATRIX, GEO_KEYS, GEO_DOUBLES, GEO_TEXT, METADATA, NODATA, RPC = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113, 50844
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072


@dataclass
class Header:
    """What a file says of its first image."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    transform: tuple[float, ...] | None  # x0, dx, rx, y0, ry, dy
    epsg: int | None
    nodata: float | None
    descriptions: list[str]
    rpc: list[float] | None
    tags: dict[int, tuple] = field(repr=False)
    order: str = "<"

    @property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a block."""
        if TILE_WIDTH in self.tags:
            return self.tags[TILE_HEIGHT][0], self.tags[TILE_WIDTH][0]
        return min(self.tags.get(ROWS, (self.height,))[0], self.height), self.width

    @property
    def grid(self) -> tuple[int, int]:
        """Rows and columns of blocks."""
        h, w = self.block
        return -(-self.height // h), -(-self.width // w)


def header(f) -> Header:
    """Of an open binary file."""
    f.seek(0)
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    (version,) = struct.unpack(order + "H", start[2:4])
    big = version == 43
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + ("Q" if big else "I"), start[8:16] if big else start[4:8])
    f.seek(at)
    (n,) = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))
    size, width = (20, 8) if big else (12, 4)
    raw, tags = f.read(n * size), {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", raw, i * size)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), raw, i * size + 4)
        code = TYPES.get(kind)
        if code is None:
            continue
        length = count * struct.calcsize("=" + code)
        value = raw[(i + 1) * size - width : (i + 1) * size]
        if length > width:
            f.seek(struct.unpack(order + ("Q" if big else "I"), value)[0])
            value = f.read(length)
        tags[tag] = (value[:length].rstrip(b"\0").decode("utf-8", "replace"),) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", value[:length])
    bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(form)
    if kind is None or bits not in (8, 16, 32, 64):
        raise ValueError(f"pixels of format {form} with {bits} bits aren't read")
    nodata = tags.get(NODATA, (None,))[0]
    text = tags.get(METADATA, ("",))[0]
    bands = tags.get(SAMPLES, (1,))[0]
    return Header(tags[WIDTH][0], tags[HEIGHT][0], bands, np.dtype(f"{order}{kind}{bits // 8}"), _transform(tags), _epsg(tags), float(nodata) if nodata not in (None, "") else None, _descriptions(text, bands), list(tags[RPC]) if RPC in tags else None, tags, order)


def _transform(tags: dict) -> tuple[float, ...] | None:
    if MATRIX in tags:
        m = tags[MATRIX]
        return m[3], m[0], m[1], m[7], m[4], m[5]
    if SCALE in tags and TIE in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[SCALE], tags[TIE][:6]
        half = 0.5 if _geo(tags).get(RASTER_TYPE) == 2 else 0.0  # pixels as points
        return x - (i + half) * sx, sx, 0.0, y + (j + half) * sy, 0.0, -sy
    return None


def _geo(tags: dict) -> dict[int, int]:
    k = tags.get(GEO_KEYS, ())
    return {k[i]: k[i + 3] for i in range(4, len(k) - 3, 4) if k[i + 1] == 0}


def _epsg(tags: dict) -> int | None:
    keys = _geo(tags)
    found = keys.get(PROJECTED) or keys.get(GEOGRAPHIC)
    return found if found and found != 32767 else None


def _descriptions(text: str, bands: int) -> list[str]:
    import xml.etree.ElementTree as ET

    out = [""] * bands
    try:
        for item in ET.fromstring(text) if text else ():
            if item.get("role") == "description" and int(item.get("sample", -1)) in range(bands):
                out[int(item.get("sample"))] = item.text or ""
    except (ET.ParseError, ValueError):
        pass
    return out


def lzw(data: bytes) -> bytes:
    """Decodes TIFF's LZW: codes of 9 to 12 bits, most significant bit first, widened one code early."""
    out, table, width, held, bits, before = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out += now
        if before:
            table.append(before + now[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        before = now
    return bytes(out)


def read_block(f, h: Header, number: int) -> np.ndarray:
    """Block ``number`` as (rows, columns, samples), whole for tiles even beyond the image; all bands, or one if they are stored apart."""
    tiled = TILE_OFFSETS in h.tags
    at, count = h.tags[TILE_OFFSETS if tiled else OFFSETS][number], h.tags[TILE_COUNTS if tiled else COUNTS][number]
    rows, cols = h.block
    apart = h.tags.get(PLANAR, (1,))[0] == 2
    if not tiled:
        per = h.grid[0]
        rows = min(rows, h.height - number % per * rows)
    samples = 1 if apart else h.bands
    if not count:  # a sparse file's hole
        return np.full((rows, cols, samples), h.nodata or 0).astype(h.dtype.newbyteorder("="))
    f.seek(at)
    data = f.read(count)
    how = h.tags.get(COMPRESSION, (PLAIN,))[0]
    if how in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif how == LZW:
        data = lzw(data)
    elif how != PLAIN:
        raise ValueError(f"compression {how} isn't read")
    out = np.frombuffer(data, h.dtype, rows * cols * samples).reshape(rows, cols, samples).astype(h.dtype.newbyteorder("="))
    predictor = h.tags.get(PREDICTOR, (1,))[0]
    if predictor == 2:
        out = np.cumsum(out, axis=1, dtype=out.dtype)
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} isn't read")
    return out


def read_window(f, h: Header, band: int, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """Rows r0 to r1 and columns c0 to c1 (exclusive) of a band, numbered from 1; only the blocks that they touch are read."""
    (bh, bw), (gh, gw) = h.block, h.grid
    out = np.empty((r1 - r0, c1 - c0), h.dtype.newbyteorder("="))
    apart = h.tags.get(PLANAR, (1,))[0] == 2
    for i in range(r0 // bh, -(-r1 // bh)):
        for j in range(c0 // bw, -(-c1 // bw)):
            block = read_block(f, h, i * gw + j + (band - 1) * gh * gw * apart)[:, :, 0 if apart else band - 1]
            a, b, x, y = max(r0, i * bh), min(r1, (i + 1) * bh), max(c0, j * bw), min(c1, (j + 1) * bw)
            out[a - r0 : b - r0, x - c0 : y - c0] = block[a - i * bh : b - i * bh, x - j * bw : y - j * bw]
    return out


def encode(bands: list[np.ndarray], transform=None, epsg: int | None = None, nodata: float | None = None, descriptions: list[str] | None = None, tile: int = 256, software: str = "rasterloom") -> bytes:
    """A tiled, deflated TIFF of bands of one shape and type; BigTIFF where offsets need it."""
    image = np.stack(bands, axis=2)
    if image.dtype == np.int64 or image.dtype == bool:
        image = image.astype(np.int32)
    image = image.astype(image.dtype.newbyteorder("<"))
    height, width, n = image.shape
    gh, gw = -(-height // tile), -(-width // tile)
    blocks = []
    for i in range(gh):
        for j in range(gw):
            whole = np.zeros((tile, tile, n), image.dtype)
            part = image[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]
            whole[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(whole.tobytes(), 6))
    big = sum(map(len, blocks)) > (1 << 32) - (1 << 20)
    word = "Q" if big else "I"
    form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (image.dtype.itemsize * 8,) * n), COMPRESSION: (3, (DEFLATE,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (n,)), PLANAR: (3, (1,)),
        SOFTWARE: (2, software.encode() + b"\0"), TILE_WIDTH: (4, (tile,)), TILE_HEIGHT: (4, (tile,)), FORMAT: (3, (form,) * n),
    }
    if n > 1:
        tags[EXTRA] = (3, (0,) * (n - 1))
    x0, dx, rx, y0, ry, dy = transform or (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    if rx or ry or dy > 0:
        tags[MATRIX] = (12, (dx, rx, 0.0, x0, ry, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    else:
        tags[SCALE], tags[TIE] = (12, (dx, -dy, 0.0)), (12, (0.0, 0.0, 0.0, x0, y0, 0.0))
    if epsg:
        geographic = 4000 <= epsg < 5000
        tags[GEO_KEYS] = (3, (1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg))
    if nodata is not None:
        tags[NODATA] = (2, f"{nodata:g}".encode() + b"\0")
    if descriptions and len(descriptions) == n:  # lists of another length are left out
        from xml.sax.saxutils import escape

        items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(d)}</Item>' for i, d in enumerate(descriptions))
        tags[METADATA] = (2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0")
    tags[TILE_OFFSETS], tags[TILE_COUNTS] = (16 if big else 4, (0,) * len(blocks)), (16 if big else 4, tuple(map(len, blocks)))
    packed = {t: v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{TYPES[k]}", *v) for t, (k, v) in tags.items()}
    first, entry, inline = (16, 20, 8) if big else (8, 12, 4)
    at = first + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    places = {}
    for t in sorted(packed):
        if len(packed[t]) > inline:
            places[t] = at
            at += len(packed[t]) + len(packed[t]) % 2
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    packed[TILE_OFFSETS] = struct.pack(f"<{len(offsets)}{word}", *offsets)
    out = io.BytesIO()
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first))
    out.write(struct.pack("<Q" if big else "<H", len(tags)))
    for t in sorted(packed):
        kind = tags[t][0]
        count = len(packed[t]) // struct.calcsize("=" + TYPES[kind])
        out.write(struct.pack(f"<HH{word}", t, kind, count) + (struct.pack("<" + word, places[t]) if t in places else packed[t].ljust(inline, b"\0")))
    out.write(struct.pack("<" + word, 0))
    for t in sorted(places):
        out.write(packed[t] + b"\0" * (len(packed[t]) % 2))
    for b in blocks:
        out.write(b)
    return out.getvalue()
