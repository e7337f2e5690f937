import os
import subprocess
import sys
import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tickweave.llm import media
from tickweave.llm.media import decode, encode_coefficients, media_features, parse, restore, store, store_texts, thumbnail_hash


def sequential(data):
    """A plain decoder, a bit at a time, of grey images: the coefficients of each block."""
    p = parse(data)
    book = []
    for counts, symbols in p.tables[0]:
        code, k, codes = 0, 0, {}
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                codes[n, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        book.append(codes)
    raw, parts, k = p.scan.tobytes(), [bytearray()], 0
    while not (raw[k] == 255 and raw[k + 1] == 0xD9):
        if raw[k] == 255 and raw[k + 1] == 0:
            parts[-1].append(255)
            k += 2
        elif raw[k] == 255:
            parts.append(bytearray())
            k += 2
        else:
            parts[-1].append(raw[k])
            k += 1
    blocks, todo = [], -(-p.width // 8) * -(-p.height // 8)
    for part in parts:
        bits = "".join(f"{b:08b}" for b in part)
        at, dc = 0, 0

        def symbol(codes):
            nonlocal at
            n = 1
            while (n, int(bits[at : at + n], 2)) not in codes:
                n += 1
            at += n
            return codes[n, int(bits[at - n : at], 2)]

        def value(n):
            nonlocal at
            if not n:
                return 0
            v = int(bits[at : at + n], 2)
            at += n
            return v if v >> (n - 1) else v - (1 << n) + 1

        for _ in range(min(p.restart or todo, todo - len(blocks))):
            row = [0] * 64
            dc += value(symbol(book[0]))
            row[0], k = dc, 1
            while k < 64:
                s = symbol(book[1])
                if s == 0:
                    break
                k += s >> 4
                if s != 0xF0:
                    row[k] = value(s & 15)
                k += 1
            blocks.append(row)
    return blocks


def payloads(rnd):
    out = [b"\xff" * 576, bytes(range(256)) * 9, b"\x80" * 576, rnd.randbytes(576 * 7), b"plain text " * 576]
    sparse = bytearray(b"\x80" * 1152)
    for _ in range(40):
        sparse[rnd.randrange(1152)] = rnd.randrange(256)
    return [*out, bytes(sparse)]


def test_round_trip_and_against_a_sequential_decoder():
    rnd = random.Random(2)
    stored = store(payloads(rnd))
    for payload, data, image in zip(payloads(random.Random(2)), stored, decode(stored)):
        assert restore(image) == payload
        assert image.coefficients[0].reshape(-1, 64).tolist() == sequential(data)
        assert image.thumbnail().ravel().tolist() == list(payload[::64])
    assert decode([]) == [] and store([]) == []


def test_high_images_grow_wider(monkeypatch):
    monkeypatch.setattr(media, "HIGH", 10)
    payload = random.Random(1).randbytes(576 * 20)
    image = decode(store([payload]))[0]
    assert image.width > 24 and image.height <= 80 and restore(image) == payload


def interleaved(rnd, restart):
    """A 4:2:0 colour image of 40 x 24 pixels, put together from grey blocks: returns it and the coefficients of each plane."""
    units = (3, 2)
    order = [(0, x, y) for y in range(2) for x in range(2)] + [(1, 0, 0), (2, 0, 0)]
    planes = [np.zeros((4, 6, 64), int), np.zeros((2, 3, 64), int), np.zeros((2, 3, 64), int)]
    dc_codes, dc_lengths = media._codes(media.DC_COUNTS, media.DC_SYMBOLS)
    ac_codes, ac_lengths = media._codes(media.AC_COUNTS, media.AC_SYMBOLS)
    scan, bits, last = b"", "", [0, 0, 0]

    def put(v):
        n = abs(v).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def flush(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")

    count = 0
    for uy in range(units[1]):
        for ux in range(units[0]):
            if restart and count and count % restart == 0:
                scan += flush(bits) + b"\xff" + bytes([0xD0 + (count // restart - 1) % 8])
                bits, last = "", [0, 0, 0]
            for c, x, y in order:
                block = [rnd.randint(-200, 200)] + [rnd.choice([0, 0, 0, rnd.randint(-60, 60)]) for _ in range(40)] + [0] * 23
                h, v = (2, 2) if c == 0 else (1, 1)
                planes[c][uy * v + y, ux * h + x] = block
                n, e = put(block[0] - last[c])
                last[c] = block[0]
                bits += f"{int(dc_codes[n]):0{dc_lengths[n]}b}" + e
                run = 0
                for v2 in block[1:]:
                    if v2 == 0:
                        run += 1
                        continue
                    while run > 15:
                        bits += f"{int(ac_codes[0xF0]):0{ac_lengths[0xF0]}b}"
                        run -= 16
                    n, e = put(v2)
                    bits += f"{int(ac_codes[run << 4 | n]):0{ac_lengths[run << 4 | n]}b}" + e
                    run = 0
                bits += f"{int(ac_codes[0]):0{ac_lengths[0]}b}"
            count += 1
    scan += flush(bits)
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    head = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([3] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 24, 40, 3) + b"\x01\x22\0\x02\x11\0\x03\x11\0")
    head += seg(0xC4, b"\0" + media.DC_COUNTS + media.DC_SYMBOLS + b"\x10" + media.AC_COUNTS + media.AC_SYMBOLS)
    head += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0")
    return head + scan + b"\xff\xd9", planes


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_interleaved_colour(restart):
    data, planes = interleaved(random.Random(restart), restart)
    image = decode([data, store([b"\x00" * 576])[0]])[0]
    for got, want in zip(image.coefficients, planes):
        assert (got == want).all()
    assert image.thumbnail().shape == (3, 5)
    want = np.clip(np.round(planes[0][:3, :5, 0] * 3 / 8) + 128, 0, 255)
    assert (image.thumbnail() == want).all()


def test_broken_images_are_refused():
    good = store([b"x" * 576])[0]
    for bad in (b"no", good[:-60] + b"\xff\xd9", good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises((ValueError, IndexError)):
            decode([bad])


def test_rows(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "日本語 " * 30000, "a"] + ["text %d " % k * 50 for k in range(50)]
    df = spark.createDataFrame([(i, t, b"clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes int")
    stored = {r.doc_id: bytes(r.media) for r in store_texts(df).collect()}
    rows = {r.doc_id: r for r in media_features(store_texts(df)).collect()}
    assert len(rows) == len(texts) and rows[2][2:] == rows[6][2:]
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert media_features(store_texts(df.limit(0))).count() == 0


def test_thumbnail_hash_of_small_and_odd_sizes():
    for shape in ((1, 1), (3, 3), (100, 7)):
        assert len(thumbnail_hash(np.arange(shape[0] * shape[1], dtype=np.uint8).reshape(shape))) == 16


def test_long_texts_take_bounded_memory():
    """20 MB under 600 MB beside what the interpreter and its libraries take."""
    code = """
import resource
from tickweave.llm import media
used = int(open('/proc/self/statm').read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (used + 600_000_000, resource.RLIM_INFINITY))
raw = (b'a very long document goes on and on, 0123456789. ' * 420_000)[: 576 * 35_000]
assert media.restore(media.decode(media.store([raw]))[0]) == raw
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env={**os.environ, "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": root})
