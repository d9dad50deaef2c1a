"""Raster files: round trips, windows that read only their blocks, layouts that other writers use."""

import io
import struct
import zlib

import numpy as np
import pytest

from rasterloom.kernels import tiff
from rasterloom.sources import rasters


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("rasters")
    rng = np.random.default_rng(1)
    image = rng.normal(size=(2, 130, 90)).astype("float32")
    image[0, 5, 7] = -9999
    (at / "a.tif").write_bytes(tiff.encode(list(image), (500000.0, 2.0, 0.0, 4600000.0, 0.0, -2.0), 32636, -9999, ["East/West", "North & South"], tile=32))
    (at / "b.tif").write_bytes(tiff.encode([np.arange(12, dtype="uint16").reshape(3, 4)]))
    (at / "note.txt").write_text("no image")
    return at, image


def test_header_and_windows(folder):
    at, image = folder
    with open(at / "a.tif", "rb") as f:
        h = tiff.header(f)
        assert (h.width, h.height, h.bands, h.epsg, h.nodata, h.descriptions) == (90, 130, 2, 32636, -9999, ["East/West", "North & South"])
        assert h.transform == (500000.0, 2.0, 0.0, 4600000.0, 0.0, -2.0)
        for band, r0, r1, c0, c1 in ((1, 0, 130, 0, 90), (2, 31, 65, 30, 33), (1, 129, 130, 89, 90)):
            assert (tiff.read_window(f, h, band, r0, r1, c0, c1) == image[band - 1, r0:r1, c0:c1]).all()


def test_only_touched_blocks_are_read(folder):
    at, image = folder

    class Counting(io.FileIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            self.taken += len(got)
            return got

    with Counting(at / "a.tif") as f:
        h = tiff.header(f)
        f.taken = 0
        tiff.read_window(f, h, 1, 40, 50, 40, 50)
        assert f.taken == h.tags[tiff.TILE_COUNTS][h.grid[1] + 1]


def strips(image: np.ndarray, compression: int, predictor: int, order: str = ">", rows: int = 5, apart: bool = False) -> bytes:
    """A striped file of another layout than our own writer's."""
    h, w, n = image.shape
    planes = [image[:, :, i : i + 1] for i in range(n)] if apart else [image]
    blocks = []
    for p in planes:
        for r in range(0, h, rows):
            part = p[r : r + rows].astype(image.dtype.newbyteorder(order))
            if predictor == 2:
                part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1).astype(part.dtype)
            raw = part.tobytes()
            blocks.append({1: raw, 8: zlib.compress(raw), 5: lzw_encode(raw)}[compression])
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [image.dtype.itemsize * 8] * n), 259: (3, [compression]), 277: (3, [n]), 278: (3, [rows]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]] * n), 273: (4, [0] * len(blocks)), 279: (4, [len(b) for b in blocks])}
    at = 8 + 2 + 12 * len(tags) + 4
    places = {}
    for t, (k, v) in sorted(tags.items()):
        if len(v) * (2 if k == 3 else 4) > 4:
            places[t] = at
            at += len(v) * (2 if k == 3 else 4)
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags[273] = (4, offsets)
    pack = lambda k, v: struct.pack(f"{order}{len(v)}{'H' if k == 3 else 'I'}", *v)
    out = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(order + "H", len(tags))
    for t, (k, v) in sorted(tags.items()):
        out += struct.pack(order + "HHI", t, k, len(v)) + (struct.pack(order + "I", places[t]) if t in places else pack(k, v).ljust(4, b"\0"))
    out += struct.pack(order + "I", 0)
    for t, (k, v) in sorted(tags.items()):
        if t in places:
            out += pack(k, v)
    return out + b"".join(blocks)


def lzw_encode(data: bytes) -> bytes:
    table, width, bits, codes = {bytes([i]): i for i in range(256)}, 9, "", [(256, 9)]
    size, w = 258, b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        codes.append((table[w], width))
        table[w + c] = size
        size += 1
        if size > (1 << width) - 1 and width < 12:
            width += 1
        if size > 4093:
            codes.append((256, width))
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = c
    if w:
        codes.append((table[w], width))
        if size + 1 > (1 << width) - 1 and width < 12:
            width += 1
    codes.append((257, width))
    bits = "".join(f"{c:0{n}b}" for c, n in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


@pytest.mark.parametrize("compression", [1, 8, 5])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("apart", [False, True])
def test_other_layouts(compression, order, apart):
    rng = np.random.default_rng(3)
    image = (rng.integers(0, 60, (23, 170, 3)) + np.arange(170)[None, :, None]).astype("uint16")
    f = io.BytesIO(strips(image, compression, 2, order, apart=apart))
    h = tiff.header(f)
    for band in (1, 2, 3):
        assert (tiff.read_window(f, h, band, 3, 21, 10, 160) == image[3:21, 10:160, band - 1]).all()


def test_faults():
    with pytest.raises(ValueError):
        tiff.header(io.BytesIO(b"PNG not a tiff..."))


def test_tiles_metadata_and_round_trip(spark, folder, tmp_path):
    at, image = folder
    tiles = rasters.read_tiles(spark, str(at / "a.tif"), tile=64)
    px = rasters.pixels(tiles)
    assert tiles.count() == 2 * 3 * 2 and px.count() == image.size
    assert px.filter("value IS NULL").select("band", "row", "col").collect() == [(1, 5, 7)]
    got = {(r.band, r.row, r.col): r.value for r in px.filter("row % 13 = 0").collect()}
    assert all(v is None or v == image[b - 1, r, c] for (b, r, c), v in got.items())
    window = rasters.pixels(rasters.read_tiles(spark, str(at / "a.tif"), 64, (60, 70, 100, 101), [2])).agg({"row": "min", "col": "max", "value": "count"}).first()
    assert tuple(window) == (100, 70, 22) or set(window) == {100, 70, 22}
    pruned = tiles.filter("band = 2 AND tile_row >= 2")
    assert pruned.count() == 2
    meta = {r.raster_id.rsplit("/", 1)[-1]: r for r in rasters.metadata(spark, str(at)).collect()}
    assert sorted(meta) == ["a.tif", "b.tif"] and meta["a.tif"].valid_map_info and not meta["b.tif"].valid_map_info and meta["a.tif"].res_x == 2.0
    names = {r.raster_id.rsplit("/", 1)[-1]: r.bands for r in rasters.band_names(rasters.metadata(spark, str(at))).collect()}
    assert names == {"a.tif": {"East/West": 1, "North & South": 2}, "b.tif": {"1": 1}}
    out = rasters.write_rasters(tiles, str(tmp_path), "float32", (500000.0, 2.0, 0.0, 4600000.0, 0.0, -2.0), 32636, -9999).collect()
    back = rasters.pixels(rasters.read_tiles(spark, out[0].path, 50))
    assert px.drop("raster_id").exceptAll(back.drop("raster_id")).isEmpty() and back.count() == image.size
    again = rasters.pixels(rasters.tiles_of(px, 50))
    assert px.exceptAll(again).isEmpty() and again.count() == image.size
    parts = rasters.write_tiles(tiles, str(tmp_path / "tiles"), "float32", (500000.0, 2.0, 0.0, 4600000.0, 0.0, -2.0), 32636).collect()
    corner = next(p for p in parts if (p.tile_row, p.tile_col) == (1, 1))
    with open(corner.path, "rb") as f:
        assert tiff.header(f).transform[0] == 500000.0 + 64 * 2.0 and tiff.header(f).transform[3] == 4600000.0 - 64 * 2.0


def test_correlation_product(spark, tmp_path):
    image = np.arange(36, dtype="float32").reshape(3, 3, 4)
    (tmp_path / "c.tif").write_bytes(tiff.encode(list(image)))
    got = rasters.correlation_product(rasters.pixels(rasters.read_tiles(spark, str(tmp_path / "c.tif")))).filter("row = 1 AND col = 2").first()
    assert (got.ew, got.ns, got.snr) == (image[0, 1, 2], image[1, 1, 2], image[2, 1, 2])


def test_models_by_extension(tmp_path):
    from rasterloom.sources import rpc
    from rasterloom.sources.sample_rpc import RPC_TEXT

    want = rpc.parse_rpc(RPC_TEXT)
    (tmp_path / "a.TXT").write_text(RPC_TEXT)
    assert rpc.load_rfm(str(tmp_path / "a.TXT")) == want
    flat = [0.0, 0.0, *(want.scalars[k] for k in rpc.SCALARS), *want.line_num, *want.line_den, *want.samp_num, *want.samp_den]
    assert rpc.from_tag(flat) == want
    texts = {k: str(v) for k, v in want.scalars.items()} | {k: " ".join(map(repr, v)) for k, v in zip(rpc.VECTORS, (want.line_num, want.line_den, want.samp_num, want.samp_den))}
    assert rpc.from_metadata(texts) == want
    (tmp_path / "b.tif").write_bytes(tiff.encode([np.zeros((3, 3), "uint8")]))
    for bad in ("b.tif", "none.txt"):
        with pytest.raises(OSError):
            rpc.load_rfm(str(tmp_path / bad))
    with pytest.raises(NotImplementedError):
        rpc.load_rfm("x.rpb")
    with pytest.raises(ValueError):
        rpc.from_metadata({})
