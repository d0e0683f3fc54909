import numpy as np
import pytest

from quillspark.llm import media


def block_means(plane):
    p = np.pad(plane.astype(float), ((0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)), mode="edge")
    return p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).mean((1, 3))


def images(n, seed=0):
    rng = np.random.default_rng(seed)
    for k in range(n):
        h, w = rng.integers(1, 90, 2)
        plane = np.clip(128 + np.cumsum(np.cumsum(rng.normal(0, 3, (h, w)), 0), 1) + rng.normal(0, 20, (h, w)), 0, 255).astype(np.uint8)
        yield plane, media.encode(plane, int(rng.integers(30, 96)), restart=int(rng.choice([0, 1, 3])), chroma=bool(k % 2))


def test_thumbnails_are_block_means():
    planes, data = zip(*images(60))
    lockstep, scalar = media.decode(list(data), few=0), media.decode(list(data), few=10**9)
    for plane, a, b in zip(planes, lockstep, scalar):
        assert a[:3] == b[:3] == ("ok", plane.shape[1], plane.shape[0])
        assert (a[3] == b[3]).all()
        assert np.abs(a[3] - block_means(plane)).max() <= 6  # half a step of the coarsest table


def test_bad_images():
    whole = next(images(1))[1]
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2", 1)
    got = [x[0] for x in media.decode([None, b"", b"no image", whole, whole[: len(whole) // 2], whole[:-40], progressive])]
    assert got == ["missing", "corrupt", "corrupt", "ok", "corrupt", "corrupt", "unsupported"]
    assert media.decode([progressive])[0][1:3] == media.decode([whole])[0][1:3]


def test_damage_never_crashes():
    rng = np.random.default_rng(3)
    for _, data in images(40, 9):
        b = bytearray(data)
        for k in rng.integers(2, len(b), 3):
            b[k] = rng.integers(256)
        assert media.decode([bytes(b), data])[1][0] == "ok"


def test_huffman_tables():
    with pytest.raises(media.Corrupt):
        media.look_up(bytes([3] + [0] * 15), bytes(3))
    table = media.look_up(media.DC_BITS, media.DC_SYMBOLS)
    assert table[0] == 2 << 8 and table[0xFFFF] == 0


def test_query_rows(spark):
    rows = [(1, "<p>a b</p>" * 300), (2, None), (None, "x"), (3, ""), (1, "<p>a b</p>" * 300), (4, "é" * 200_000)]
    pages = spark.createDataFrame([(i, h, "extra", 0) for i, h in rows], "page_id long, html string, status string, width int")
    out = media.thumbnails(media.previews(pages)).collect()
    assert len(out) == 6
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append(r)
    assert by[1][0] == by[1][1] and by[2][0]["status"] == "missing" and by[None][0]["status"] == "ok"
    assert (by[3][0]["width"], by[3][0]["height"]) == (64, 1)
    plane = media.preview(("é" * 200_000).encode())
    assert (by[4][0]["height"], by[4][0]["width"]) == plane.shape == (-(-400_000 // 512), 64)
    kept = media.thumbnails(media.previews(pages), keep=True).where("id = 1").first()
    assert len(kept["thumbnail"]) == kept["thumb_width"] * kept["thumb_height"]
    assert media.thumbnails(media.previews(pages.where("false"))).count() == 0


def test_long_pages_fit():
    assert media.preview(b"x" * (512 * 65535 + 1)).shape == (32768, 128)


def bits_of(blocks):
    """Entropy-coded data of (component, zigzag block) pairs, symbol by symbol; the codes are those of the standard tables."""
    dc, ac = ({s: format(c, f"0{n}b") for s, c, n in media.codes(b, t)} for b, t in ((media.DC_BITS, media.DC_SYMBOLS), (media.AC_BITS, media.AC_SYMBOLS)))
    low = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    size = lambda v: int(abs(v)).bit_length()
    pred, out = {}, []
    for part, z in blocks:
        d = int(z[0]) - pred.get(part, 0)
        pred[part] = int(z[0])
        out.append(dc[size(d)] + low(d, size(d)))
        run = 0
        for v in map(int, z[1:]):
            if not v:
                run += 1
                continue
            out.append(ac[0xF0] * (run // 16) + ac[(run % 16) << 4 | size(v)] + low(v, size(v)))
            run = 0
        if run:
            out.append(ac[0])
    s = "".join(out)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\x00")


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@pytest.mark.parametrize("shape", [(35, 50), (16, 16), (7, 90), (65, 1)])
@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("sampling", [(2, 2), (2, 1), (1, 2)])
def test_subsampled_colour(shape, wide, sampling):
    """Colour at half the resolution, in one scan and in three, tables of one and of two bytes."""
    h, v = sampling
    rng = np.random.default_rng(shape[0] + 2 * h + v)
    luma, quant = rng.integers(0, 256, shape).astype(np.uint8), media.quantisation(60) * (3 if wide else 1)
    small = [rng.integers(0, 256, (-(-shape[0] // v), -(-shape[1] // h))).astype(np.uint8) for _ in range(2)]
    up = lambda a, b: -(-a // b)
    across, down = up(shape[1], 8 * h), up(shape[0], 8 * v)  # MCUs

    def grid(plane, rows, cols):
        p = np.pad(plane, ((0, rows * 8 - plane.shape[0]), (0, cols * 8 - plane.shape[1])), mode="edge")
        return media.blocks_of(p, quant).reshape(rows, cols, 64)

    y, cb, cr = grid(luma, down * v, across * h), grid(small[0], down, across), grid(small[1], down, across)
    mixed = [x for r in range(down) for c in range(across) for x in [*((0, y[r * v + i, c * h + j]) for i in range(v) for j in range(h)), (1, cb[r, c]), (2, cr[r, c])]]
    table = quant[media.ZIGZAG]
    head = b"\xff\xd8" + segment(0xDB, b"\x10" + table.astype(">u2").tobytes() if wide else b"\0" + table.astype(np.uint8).tobytes())
    head += segment(0xC1 if wide else 0xC0, bytes([8]) + shape[0].to_bytes(2, "big") + shape[1].to_bytes(2, "big") + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += segment(0xC4, b"\0" + media.DC_BITS + media.DC_SYMBOLS) + segment(0xC4, b"\x10" + media.AC_BITS + media.AC_SYMBOLS)
    scan = lambda parts, blocks: segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + b"\0\x3f\0") + bits_of(blocks)
    one = head + scan([0, 1, 2], mixed) + b"\xff\xd9"
    own = lambda g, plane: g[: up(plane.shape[0], 8), : up(plane.shape[1], 8)].reshape(-1, 64)
    scans = [scan([p], [(p, z) for z in own(g, q)]) for p, g, q in ((1, cb, small[0]), (0, y, luma), (2, cr, small[1]))]
    three = head + b"".join(scans) + b"\xff\xd9"
    for few in (0, 10**9):
        for status, width, height, plane in media.decode([one, three], few=few):
            assert (status, height, width) == ("ok", *shape)
            want = np.clip(np.rint(y[: up(shape[0], 8), : up(shape[1], 8), 0] * quant[0] / 8 + 128), 0, 255)
            assert (plane == want).all() and np.abs(plane - block_means(luma)).max() <= quant[0] / 16 + 1
