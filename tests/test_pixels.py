"""Grey images, area means and hashes against loops over pixels; boxes carried along planted shifts; patches."""

from __future__ import annotations

import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tagmill.operators import flow, tracking
from tagmill.sources import pixels

PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def chunk(kind, body):
    return struct.pack(">I4s", len(body), kind) + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows, step):
    """Rows of bytes, each behind the next of the five filters in turn."""
    out, up = b"", bytes(len(rows[0]))
    for k, row in enumerate(rows):
        kind, line = k % 5, []
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out, up = out + bytes([kind]) + bytes(line), row
    return out


def packed(samples, depth):
    """A row of numbers as bytes."""
    if depth == 16:
        return b"".join(struct.pack(">H", s * 257) for s in samples)
    bits = "".join(format(s, f"0{depth}b") for s in samples)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def png(image, colour, depth, palette=None, laced=False):
    """image: rows of pixels, each a tuple of numbers."""
    h, w, step = len(image), len(image[0]), max(1, len(image[0][0]) * depth // 8)
    parts = [(x, y, dx, dy) for x, y, dx, dy in PASSES if x < w and y < h] if laced else [(0, 0, 1, 1)]
    body = b"".join(filtered([packed([s for px in row[x::dx] for s in px], depth) for row in image[y::dy]], step) for x, y, dx, dy in parts)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))
    data = zlib.compress(body)
    out += chunk(b"PLTE", bytes(v for c in palette for v in c)) if palette else b""
    return out + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


def brightness(r, g, b):
    return (4899 * r + 9617 * g + 1868 * b + 8192) // 16384


def made(rng, w, h, n, most):
    return [[tuple(int(v) for v in rng.integers(0, most + 1, n)) for _ in range(w)] for _ in range(h)]


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("w, h", [(13, 11), (1, 1), (3, 9)])
def test_png_of_all_kinds(w, h, laced):
    rng = np.random.default_rng(1)
    for depth in (1, 2, 4, 8, 16):
        top = (1 << min(depth, 8)) - 1
        for colour, n in ((0, 1), (4, 2), (2, 3), (6, 4)):
            if depth >= 8 or colour == 0:
                image = made(rng, w, h, n, top)
                want = [[brightness(*p[:3]) if n > 2 else p[0] * 255 // top for p in row] for row in image]
                assert pixels.decode(png(image, colour, depth, laced=laced)).tolist() == want, (depth, colour)
        if depth <= 8:
            palette, image = [tuple(map(int, rng.integers(0, 256, 3))) for _ in range(top + 1)], made(rng, w, h, 1, top)
            assert pixels.decode(png(image, 3, depth, palette, laced)).tolist() == [[brightness(*palette[p[0]]) for p in row] for row in image]


def bmp(image, depth, palette=None, upward=True):
    w, h = len(image[0]), len(image)
    rows = [b"".join(bytes(p) for p in row) for row in (image[::-1] if upward else image)]
    body = b"".join(r + bytes(-len(r) % 4) for r in rows)
    table = b"".join(bytes([*c, 0]) for c in palette or [])
    head = struct.pack("<IiiHHIIiiII", 40, w, h if upward else -h, 1, depth, 0, len(body), 0, 0, len(palette or []), 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(table) + len(body), 0, 0, 54 + len(table)) + head + table + body


def test_bmp_and_what_is_no_image():
    rng = np.random.default_rng(2)
    for depth, n in ((24, 3), (32, 4)):
        image = made(rng, 5, 4, n, 255)
        for upward in (True, False):
            assert pixels.decode(bmp(image, depth, upward=upward)).tolist() == [[brightness(p[2], p[1], p[0]) for p in row] for row in image]
    palette, image = [(1, 2, 3), (40, 50, 60), (255, 0, 9)], made(rng, 6, 3, 1, 2)
    assert pixels.decode(bmp(image, 8, palette)).tolist() == [[brightness(*palette[p[0]][::-1]) for p in row] for row in image]
    good = png(made(rng, 4, 4, 1, 255), 0, 8)
    for bad in (None, b"", b"\xff\xd8jpeg", good[:40], good[:60], b"BM", b"BM" + bytes(60), good.replace(b"IDAT", b"JDAT"), png(made(rng, 2, 2, 1, 3), 3, 8, [(0, 0, 0)])):
        assert pixels.decode(bad) is None or bad == good


def plain_means(image, width, height):
    h, w = image.shape
    out = []
    for j in range(height):
        row = []
        for i in range(width):
            total = Fraction(0)
            for y in range(h):
                for x in range(w):
                    dx = min(Fraction((i + 1) * w, width), x + 1) - max(Fraction(i * w, width), x)
                    dy = min(Fraction((j + 1) * h, height), y + 1) - max(Fraction(j * h, height), y)
                    if dx > 0 and dy > 0:
                        total += int(image[y, x]) * dx * dy
            row.append(round(total / (Fraction(w, width) * Fraction(h, height))))
        out.append(row)
    return out


@pytest.mark.parametrize("shape", [(8, 9), (17, 31), (40, 23), (5, 4), (1, 1), (16, 18)])
def test_area_means_by_a_loop_over_pixels(shape):
    image = np.random.default_rng(3).integers(0, 256, shape).astype(np.uint8)
    assert pixels.area_means(image, 9, 8).tolist() == plain_means(image, 9, 8)


def test_hashes_of_image_files(spark, tmp_path):
    rng, want = np.random.default_rng(4), {}
    for k, (w, h) in enumerate([(30, 20), (9, 8), (64, 48)]):
        image = made(rng, w, h, 3, 255)
        (tmp_path / f"{k}.png").write_bytes(png(image, 2, 8))
        grey = np.array([[brightness(*p) for p in row] for row in image])
        small = plain_means(grey, 9, 8)
        want[f"{k}.png"] = int("".join("01"[b > a] for row in small for a, b in zip(row, row[1:])), 2)
    (tmp_path / "flat.bmp").write_bytes(bmp([[(7, 7, 7)] * 20] * 20, 24))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "no.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.readable, None if r.hash is None else r.hash % (1 << 64)) for r in pixels.image_hashes(spark, str(tmp_path)).collect()}
    assert got == {n: (True, v) for n, v in want.items()} | {"flat.bmp": (True, 0), "bad.png": (False, None)}


def scene(at, size=(60, 50), w=320, h=240):
    """A textured background with a chequered object."""
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    image = 90 + 40 * np.sin(xx / 11) + 30 * np.cos(yy / 9) + 20 * np.sin((xx + yy) / 17)
    if at is not None:
        j, i = np.mgrid[0 : size[1], 0 : size[0]]
        image[at[1] : at[1] + size[1], at[0] : at[0] + size[0]] = np.where((i // 8 + j // 8) % 2 == 0, 235, 45)
    return np.clip(image, 0, 255).astype(np.uint8)


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def at_box(x, y, w=60, h=50):
    return (x, y, x + w, y + h)


@pytest.mark.parametrize("dx, dy, least", [(6, 0, 0.8), (5, 6, 0.75), (0, 0, 0.98), (-6, 4, 0.75), (0, -7, 0.75)])
def test_planted_shifts(dx, dy, least):
    moved, sure = flow.carry(scene((100, 90)), scene((100 + dx, 90 + dy)), at_box(100, 90))
    assert overlap(moved, at_box(100 + dx, 90 + dy)) > least and sure > 0.5


def test_boxes_that_are_lost():
    one, two = scene((100, 90)), scene((106, 90))
    assert flow.carry(one, None, at_box(100, 90)) == (None, 0.0) and flow.carry(one, two[:100], at_box(100, 90)) == (None, 0.0)
    assert flow.carry(one, two, (5, 5, 7, 90)) == (None, 0.0)
    noise = np.random.default_rng(1).integers(0, 256, one.shape).astype(np.uint8)
    moved, sure = flow.carry(one, noise, at_box(100, 90))
    assert moved is None or sure < tracking.STEP + 0.3
    assert flow.carry(np.full_like(one, 9), np.full_like(one, 9), at_box(100, 90)) == (None, 0.0)
    assert [i for i, *_ in flow.carry_all(one, two, [at_box(100, 90), (5, 5, 6, 6), at_box(98, 88, 64, 54)])] == [0, 2]


def test_corners_are_apart_and_inside():
    found = flow.corners(scene((100, 90)), (105, 94, 155, 136))
    assert 20 < len(found) <= flow.CORNERS and ((found >= (105, 94)) & (found < (155, 136))).all()
    gaps = ((found[:, None] - found[None]) ** 2).sum(2) + 1e9 * np.eye(len(found))
    assert gaps.min() >= flow.DISTANCE**2


def test_chains_in_spark_until_the_object_goes(spark):
    """Frames of two clips: one object moves on and stays in its box, the other vanishes after the fifth step."""
    rows = []
    for clip, path in (("on", [(60 + 4 * k, 80) for k in range(9)]), ("gone", [(60 + 3 * k, 90) if k < 6 else None for k in range(12)])):
        for k, at in enumerate(path):
            rows.append((clip, k, bytearray(scene(at).tobytes()), [float(v) for v in at_box(*path[0])] if k == 0 else None))
    frames = spark.createDataFrame(rows, "clip_id string, frame_no long, content binary, box array<double>").repartition(3)
    chain = flow.Chain(lambda b: np.frombuffer(bytes(b), np.uint8).reshape(240, 320))
    got = tracking.track(frames, chain).collect()
    on = sorted((r for r in got if r.clip_id == "on"), key=lambda r: r.frame_no)
    assert [r.frame_no for r in on] == list(range(1, 9)) and all(0 <= r.confidence <= 1 for r in got)
    assert all(overlap((r.x1, r.y1, r.x2, r.y2), at_box(60 + 4 * r.frame_no, 80)) > 0.7 for r in on)
    gone = [r.frame_no for r in got if r.clip_id == "gone"]
    assert {1, 2, 3, 4, 5} <= set(gone) and max(gone) < 11


def plain_patch(image, box, side):
    h, w = image.shape
    x1, y1, x2, y2 = (int(v) for v in box)
    x1, x2, y1, y2 = max(0, min(x1, x2)), min(w, max(x1, x2)), max(0, min(y1, y2)), min(h, max(y1, y2))
    if x2 - x1 < 4 or y2 - y1 < 4:
        return None
    part, out = image[y1:y2, x1:x2].astype(float), []
    for j in range(side):
        y = min(max((j + 0.5) * (y2 - y1) / side - 0.5, 0), y2 - y1 - 1)
        a = min(int(y), y2 - y1 - 2)
        row = []
        for i in range(side):
            x = min(max((i + 0.5) * (x2 - x1) / side - 0.5, 0), x2 - x1 - 1)
            b = min(int(x), x2 - x1 - 2)
            u, v = x - b, y - a
            row.append((part[a, b] * (1 - u) + part[a, b + 1] * u) * (1 - v) + (part[a + 1, b] * (1 - u) + part[a + 1, b + 1] * u) * v)
        out.append(row)
    return np.array(out)


def test_patches_by_a_plain_loop():
    image = np.random.default_rng(5).integers(0, 256, (40, 60)).astype(np.uint8)
    boxes = [(3, 4, 30, 33), (-10, -5, 20, 9), (50, 30, 99, 99), (30, 20, 3, 4), (0, 0, 60, 40), (5, 5, 8, 20), (70, 5, 90, 30), (10, 10, 14, 14), (1.9, 2.9, 59.5, 39.9)]
    found, good = flow.patches(image, np.array(boxes + [(np.nan, 0, 9, 9)]))
    assert found.shape == (10, 48, 48) and found.dtype == np.float32 and not good[9]
    for k, b in enumerate(boxes):
        want = plain_patch(image, b, 48)
        assert good[k] == (want is not None) and (want is None or np.abs(found[k] - want).max() <= 0.5 + 1e-6)
    flat, good = flow.patches(np.full((20, 20), 7, np.uint8), np.array([(0, 0, 10, 10)]))
    assert good[0] and (flat == 7).all() and tracking.likeness(flat[0], found[0]) == 0.0
    assert tracking.likeness(found[0], found[0]) == pytest.approx(1) and not flow.patches(None, np.array(boxes))[1].any()
