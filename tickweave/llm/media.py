"""Media columns: baseline JPEG written and read in numpy, with thumbnails from the DC coefficients.

Reading: markers are parsed (quantisation, frame, Huffman tables, restart interval, scan), the scan's bytes are unstuffed and
cut at restart markers, and all restart intervals of all images of a batch are Huffman-decoded in step: one table lookup
and one coefficient for each interval at a time, as array operations. The luminance thumbnail has a pixel for each 8 x 8 block: its DC
coefficient, dequantised, over 8, plus 128.

Storing a payload without loss: JPEG's lossy step is the quantisation, so bytes are stored behind it, as quantised
coefficients: each block holds 64 bytes, less 128, in zigzag order, the first as the DC coefficient with a step of 8 (so a thumbnail pixel is
that byte). The payload's length is kept in a comment segment.

Blocks are restart intervals, so both ways work on RUN blocks at a time: beside the text, its media and its coefficients (two bytes each)
a task holds arrays of bounded size, about ten bytes for a byte of text in all.

Cases: a null text is empty; an empty text is a payload of 576 bytes of 255; texts of any length are stored whole (the image grows wider once it would be
higher than the format allows; the format ends at 65,535 x 65,535 samples, 4 GB); repeated rows give equal results; an empty table gives an empty result; further columns are not carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import byte_runs, small_batches, table, text_or_empty

UNIT = 576  # nine blocks
WIDE = 3  # blocks in a row, unless the image would be too high
HIGH = 8191  # rows of blocks at most
BATCH_BYTES = 2_000_000  # of payload or of media taken together; a longer one is taken alone
RUN = 16_384  # blocks encoded or decoded at once


@dataclass
class Image:
    width: int
    height: int
    factors: list[tuple[int, int]]  # sampling, horizontal and vertical, of each component
    steps: list[np.ndarray]  # the quantisation table of each component, zigzag order
    coefficients: list[np.ndarray]  # of each component: block rows x blocks x 64, zigzag order, quantised
    comment: bytes

    def thumbnail(self) -> np.ndarray:
        """Luminance, a pixel for each block of the first component that lies in the image."""
        dc = self.coefficients[0][:, :, 0] * int(self.steps[0][0])
        across, down = max(h for h, _ in self.factors), max(v for _, v in self.factors)
        h, v = self.factors[0]
        wide, high = -(-(-(-self.width * h // across)) // 8), -(-(-(-self.height * v // down)) // 8)
        return np.clip(np.round(dc[:high, :wide] / 8) + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits: for an 8 x 8 grid over the thumbnail, whether a cell's mean is over the mean of all cells."""
    h, w = pixels.shape
    sums = np.zeros((h + 1, w + 1), np.int64)
    sums[1:, 1:] = pixels.cumsum(0, dtype=np.int64).cumsum(1)
    top, left = np.arange(8) * h // 8, np.arange(8) * w // 8
    bottom, right = np.maximum(top + 1, np.arange(1, 9) * h // 8), np.maximum(left + 1, np.arange(1, 9) * w // 8)
    box = sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]
    means = box / np.outer(bottom - top, right - left)
    return np.packbits(means > means.mean()).tobytes().hex()


# ---- Huffman tables


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The code and its length of each symbol, from a table of how many codes have each length."""
    code, k = 0, 0
    codes, lengths = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            codes[symbols[k]], lengths[symbols[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return codes, lengths


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits the length (upper byte) and symbol of the code that they begin with; 0 if none."""
    out = np.zeros(65536, np.uint16)
    codes, lengths = _codes(counts, symbols)
    for s in symbols:
        low, n = int(codes[s]) << (16 - int(lengths[s])), int(lengths[s])
        out[low : low + (1 << (16 - n))] = n << 8 | s
    return out


#: DC: categories 0 to 11, 4 bits each. AC: codes for (run, category); those of run 0 that bytes need are short.
DC_COUNTS, DC_SYMBOLS = bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))
AC_SHORT = [0x07, 0x06, 0x05]  # most text bytes, less 128, are in these categories
AC_MIDDLE = [0x04, 0x03, 0x02, 0x01, 0x08, 0x00, 0xF0]
AC_REST = [r << 4 | s for r in range(16) for s in range(1, 11) if (r << 4 | s) not in AC_SHORT + AC_MIDDLE]
AC_COUNTS, AC_SYMBOLS = bytes([0, 3, 0, 0, 7, 0, 0, 0, 0, 0, 0, 0, len(AC_REST), 0, 0, 0]), bytes(AC_SHORT + AC_MIDDLE + AC_REST)


# ---- writing


def _category(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def encode_coefficients(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """blocks x 64 coefficients in zigzag order, each block a restart interval of its own -> (bytes of all, where each block begins).

    The bytes are stuffed and end with the interval's padding; the restart markers are not in them.
    """
    n = len(blocks)
    category = _category(blocks)
    extra = np.where(blocks < 0, blocks + (1 << category) - 1, blocks).astype(np.uint64)
    dc_codes, dc_lengths = _codes(DC_COUNTS, DC_SYMBOLS)
    ac_codes, ac_lengths = _codes(AC_COUNTS, AC_SYMBOLS)
    # runs of zeros: the place of each coefficient since the last that is not zero
    places = np.arange(64)
    last = np.maximum.accumulate(np.where((blocks != 0) | (places == 0), places, 0), axis=1)
    run = np.zeros((n, 64), np.int64)
    run[:, 1:] = places[1:] - last[:, :-1] - 1
    end = last[:, -1]  # after it only zeros: an end-of-block code
    symbol = np.where(blocks != 0, (run % 16) << 4 | category, 0)
    bits = np.where(blocks != 0, ac_lengths[symbol] + category, 0)
    value = (ac_codes[symbol] << category.astype(np.uint64)) | extra
    bits[:, 0] = dc_lengths[category[:, 0]] + category[:, 0]
    value[:, 0] = (dc_codes[category[:, 0]] << category[:, 0].astype(np.uint64)) | extra[:, 0]
    long_run = np.where((blocks != 0) & (places > 0), run // 16, 0)  # each needs codes for sixteen zeros before it
    row, at = np.nonzero(bits)
    value, bits = value[row, at], bits[row, at]
    if long_run.any():
        repeat = long_run[row, at]
        row, at = np.repeat(row, repeat + 1), np.repeat(at, repeat + 1)
        is_last = np.zeros(len(row), bool)
        is_last[np.cumsum(repeat + 1) - 1] = True
        filled_v, filled_b = np.full(len(row), ac_codes[0xF0], np.uint64), np.full(len(row), ac_lengths[0xF0], np.int64)
        filled_v[is_last], filled_b[is_last] = value, bits
        value, bits = filled_v, filled_b
    short = np.flatnonzero(end < 63)
    if len(short):
        row, at = np.concatenate([row, short]), np.concatenate([at, np.full(len(short), 64)])
        value = np.concatenate([value, np.full(len(short), ac_codes[0], np.uint64)])
        bits = np.concatenate([bits, np.full(len(short), ac_lengths[0], np.int64)])
        order = np.lexsort((at, row))
        row, value, bits = row[order], value[order], bits[order]
    total = np.bincount(row, bits, n).astype(np.int64)
    size = -(-total // 8)
    begin = np.concatenate([[0], np.cumsum(size)])
    ahead = np.cumsum(bits) - bits
    first = np.searchsorted(row, np.arange(n))
    position = begin[row] * 8 + ahead - ahead[first][row]
    # the bits of a code lie in five bytes at most; codes do not overlap, so their bytes add up
    shifted = value << (40 - (position & 7) - bits).astype(np.uint64)
    out = np.zeros(begin[-1] + 5, np.float64)
    for k in range(5):
        out += np.bincount((position >> 3) + k, ((shifted >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64), len(out))
    out = out[: begin[-1]].astype(np.uint8)
    padding = size * 8 - total
    out[begin[1:] - 1] |= ((1 << padding) - 1).astype(np.uint8)  # ones fill the last byte
    stuffed = np.cumsum(out == 255)
    shift = np.concatenate([[0], stuffed])
    final = np.zeros(len(out) + int(shift[-1]), np.uint8)
    final[np.arange(len(out)) + shift[:-1]] = out
    return final, begin + shift[begin]


def _head(width: int, height: int, comment: bytes) -> bytes:
    segment = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    steps = bytes([8] + [1] * 63)
    return b"".join([
        b"\xff\xd8",
        segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        segment(0xFE, comment),
        segment(0xDB, b"\0" + steps),
        segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\0"),
        segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        segment(0xDD, struct.pack(">H", 1)),
        segment(0xDA, b"\x01\x01\0\0\x3f\0"),
    ])


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a multiple of 64 bytes) as a grey baseline JPEG."""
    if not payloads:
        return []
    sizes = [len(p) // 64 for p in payloads]
    wide = [max(WIDE, -(-n // HIGH)) for n in sizes]
    blank = [-n % w for n, w in zip(sizes, wide)]  # blocks of zeros that fill the last row
    data = np.frombuffer(b"".join(p + b"\x80" * (64 * b) for p, b in zip(payloads, blank)), np.uint8).reshape(-1, 64)
    runs, begin = [], np.zeros(len(data) + 1, np.int64)
    for k in range(0, len(data), RUN):
        coded, edges = encode_coefficients(data[k : k + RUN].astype(np.int64) - 128)
        runs.append(coded)
        begin[k + 1 : k + len(edges)] = begin[k] + edges[1:]
    raw = np.concatenate(runs)
    del runs, data
    out, at = [], 0
    # markers between the blocks of an image: two more bytes after each block but the last
    for payload, n, w, b in zip(payloads, sizes, wide, blank):
        n += b
        edges = begin[at : at + n + 1]
        size = int(edges[-1] - edges[0])
        scan = np.empty(size + 2 * (n - 1), np.uint8)
        keep = np.ones(len(scan), bool)
        marks = edges[1:-1] - edges[0] + 2 * np.arange(n - 1)
        keep[marks] = keep[marks + 1] = False
        scan[keep] = raw[edges[0] : edges[-1]]
        scan[marks], scan[marks + 1] = 255, 0xD0 + np.arange(n - 1) % 8
        out.append(_head(w * 8, n // w * 8, b"payload=%d" % len(payload)) + scan.tobytes() + b"\xff\xd9")
        at += n
    return out


# ---- reading


@dataclass
class _Parsed:
    width: int
    height: int
    factors: list[tuple[int, int]]
    steps: list[np.ndarray]
    tables: list[tuple[tuple[bytes, bytes], tuple[bytes, bytes]]]  # (DC, AC) of each component
    restart: int
    scan: np.ndarray
    comment: bytes


def parse(data: bytes) -> _Parsed:
    """The segments of a baseline JPEG with one scan of all components."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, steps, huffman, restart, comment, frame = 2, {}, {}, 0, b"", None
    while True:
        while data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                steps[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int64)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huffman[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xC0 or marker == 0xC1:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples")
            frame = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            if frame is None or body[0] != len(frame):
                raise ValueError("only one scan of all components")
            chosen = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            tables = [(huffman[chosen[c] >> 4], huffman[16 | chosen[c] & 15]) for c, *_ in frame]
            rest = np.frombuffer(data, np.uint8, offset=at)
            return _Parsed(width, height, [(h, v) for _, h, v, _ in frame], [steps[q] for *_, q in frame], tables, restart, rest, comment)


@dataclass
class _Intervals:
    """The restart intervals of some images: where their bits lie in data, and what they hold."""

    data: np.ndarray
    first: np.ndarray  # byte
    size: np.ndarray  # bytes
    owner: np.ndarray  # image
    block: np.ndarray  # the first of its blocks among those of all images
    blocks: np.ndarray


def _intervals(parsed: list[_Parsed], units: list[tuple[int, int]], per_unit: list[int]) -> _Intervals:
    pieces, columns, bytes_before, blocks_before = [], [], 0, 0
    for k, p in enumerate(parsed):
        n, scan = units[k][0] * units[k][1], p.scan
        mark = np.flatnonzero(scan[:-1] == 255)
        follow = scan[mark + 1]
        is_restart = (follow >= 0xD0) & (follow <= 0xD7)
        ends = mark[(follow != 0) & ~is_restart]
        final = int(ends[0]) if len(ends) else len(scan)
        cuts = mark[is_restart & (mark < final)]
        each = p.restart or n
        count = -(-n // each)
        if len(cuts) + 1 < count:
            raise ValueError("restart markers are missing")
        begin, end = np.append(0, cuts + 2)[:count], np.append(cuts, final)[:count]
        gone = np.sort(np.concatenate([mark[(follow == 0) & (mark + 1 < final)] + 1, cuts, cuts + 1]))  # stuffing and markers
        place = lambda x: x - np.searchsorted(gone, x)  # noqa: E731, B023
        pieces.append(np.delete(scan[:final], gone))
        todo = np.full(count, each)
        todo[-1] = n - each * (count - 1)
        columns.append((bytes_before + place(begin), place(end) - place(begin), np.full(count, k), blocks_before + np.arange(count) * each * per_unit[k], todo * per_unit[k]))
        bytes_before, blocks_before = bytes_before + len(pieces[-1]), blocks_before + n * per_unit[k]
    return _Intervals(np.concatenate([*pieces, np.full(8, 255, np.uint8)]), *(np.concatenate(c).astype(np.int64) for c in zip(*columns)))


def decode(images: list[bytes]) -> list[Image]:
    """All restart intervals of all images in step, RUN blocks (or one interval) at a time."""
    parsed = [parse(x) for x in images]
    if not parsed:
        return []
    lookups: dict[tuple[bytes, bytes], int] = {}
    number = lambda t: lookups.setdefault(t, len(lookups))
    patterns, layout = [], []
    for p in parsed:
        across, down = max(h for h, _ in p.factors), max(v for _, v in p.factors)
        single = len(p.factors) == 1
        unit = [0] if single else [c for c, (h, v) in enumerate(p.factors) for _ in range(v * h)]
        layout.append((unit, (-(-p.width // 8), -(-p.height // 8)) if single else (-(-p.width // (8 * across)), -(-p.height // (8 * down)))))
        patterns.append([(number(p.tables[c][0]), number(p.tables[c][1]), c) for c in unit])
    longest = max(len(p) for p in patterns)
    dc_table, ac_table, component = (np.zeros((len(parsed), longest), np.int64) for _ in range(3))
    for k, p in enumerate(patterns):
        for j, (d, a, c) in enumerate(p):
            dc_table[k, j], ac_table[k, j], component[k, j] = d, a, c
    widths = np.array([len(p) for p in patterns])
    table_of = np.concatenate([_lookup(*t) for t in lookups])
    every = _intervals(parsed, [u for _, u in layout], [len(u) for u, _ in layout])
    out = np.zeros((int(every.blocks.sum()), 64), np.int16)
    total = np.cumsum(every.blocks)
    low = 0
    while low < len(total):
        high = max(low + 1, int(np.searchsorted(total, total[low] - every.blocks[low] + RUN, side="right")))
        _decode_run(every, slice(low, high), out.reshape(-1), dc_table, ac_table, component, widths, table_of)
        low = high
    result, base = [], 0
    for p, (unit, units) in zip(parsed, layout):
        n = units[0] * units[1] * len(unit)
        mine = out[base : base + n].reshape(units[1], units[0], len(unit), 64)
        base += n
        planes = []
        for c, (h, v) in enumerate(p.factors if len(p.factors) > 1 else [(1, 1)]):
            own = mine[:, :, [j for j, u in enumerate(unit) if u == c], :] if len(unit) > 1 else mine
            planes.append(own.reshape(units[1], units[0], v, h, 64).transpose(0, 2, 1, 3, 4).reshape(units[1] * v, units[0] * h, 64))
        result.append(Image(p.width, p.height, p.factors if len(p.factors) > 1 else [(1, 1)], p.steps, planes, p.comment))
    return result


def _decode_run(
    every: _Intervals, part: slice, flat: np.ndarray, dc_table: np.ndarray, ac_table: np.ndarray, component: np.ndarray, widths: np.ndarray, table_of: np.ndarray
) -> None:
    """Huffman-decode the intervals of a part into flat, one coefficient of each at a time."""
    first, owner, left, block = every.first[part], every.owner[part], every.blocks[part].copy(), every.block[part].copy()
    begin, end = int(first[0]), int((first + every.size[part]).max())
    data = every.data[begin : end + 8]
    words = np.zeros(len(data) - 7, np.uint64)  # the 64 bits from each byte on
    for j in range(8):
        words |= data[j : len(data) - 7 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
    bit = (first - begin) * 8
    limit, width, uniform = bit + every.size[part] * 8, widths[owner], dc_table.shape[1] == 1
    m = len(bit)
    place, turn = np.zeros(m, np.int64), np.zeros(m, np.int64)  # coefficient, and block of the unit
    predictor = np.zeros((m, 4), np.int64)
    alive = np.arange(m)
    while len(alive):
        at = place[alive]
        is_dc = at == 0
        who, t = owner[alive], turn[alive]
        tab = np.where(is_dc, dc_table[who, t], ac_table[who, t])
        b = bit[alive]
        window = words[np.minimum(b >> 3, len(words) - 1)] << (b & 7).astype(np.uint64)
        hit = table_of[(tab << 16) + (window >> np.uint64(48)).astype(np.int64)]
        length, symbol = (hit >> 8).astype(np.int64), (hit & 255).astype(np.int64)
        if not length.all():
            raise ValueError("no such code")
        category = np.where(is_dc, symbol, symbol & 15)
        run = np.where(is_dc, 0, symbol >> 4)
        # the two shifts keep each count under 64
        extra = ((window << length.astype(np.uint64)) >> np.uint64(1) >> (63 - category).astype(np.uint64)).astype(np.int64)
        value = np.where(category == 0, 0, np.where(extra >> np.maximum(category - 1, 0) & 1, extra, extra - (1 << category) + 1))
        b = b + length + category
        bit[alive] = b
        if (b > limit[alive]).any():
            raise ValueError("the scan ends early")
        if is_dc.any():
            i = alive[is_dc]
            c = component[owner[i], turn[i]]
            predictor[i, c] += value[is_dc]
            value[is_dc] = predictor[i, c]
        ends = ~is_dc & (symbol == 0)
        at = at + run
        kept = ~ends & (at < 64)
        flat[block[alive][kept] * 64 + at[kept]] = value[kept]
        at = np.where(ends, 64, at + 1)
        place[alive] = at
        done = at >= 64
        if done.any():
            i = alive[done]
            place[i] = 0
            block[i] += 1
            left[i] -= 1
            if not uniform:
                turn[i] = (turn[i] + 1) % width[i]
            alive = alive[left[alive] > 0]


def restore(image: Image) -> bytes:
    """The payload that store() put into an image."""
    size = int(image.comment.partition(b"=")[2])
    return (image.coefficients[0].reshape(-1) + 128).astype(np.uint8).tobytes()[:size]


# ---- Spark


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, filled up with bytes 255 to a positive multiple of 576, as a JPEG. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_py().encode() for t in batch.column(1)]
            for part in byte_runs([len(r) for r in raw], BATCH_BYTES):
                payloads = [raw[k] + b"\xff" * (max(UNIT, -(-len(raw[k]) // UNIT) * UNIT) - len(raw[k])) for k in part]
                ids = batch.column(0).slice(part.start, len(part))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(raw[k]) for k in part], pa.int64()), pa.array(store(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])

    return small_batches(docs).select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(put, f"doc_id {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) -> what reading the media gives: payload size and digests, the media's own, and the feature `width x height : thumbnail's size : hash`."""
    kind = stored.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [m.as_py() for m in batch.column(2)]
            rows = []
            for part in byte_runs([len(m) for m in media], BATCH_BYTES):
                for k, image in zip(part, decode([media[k] for k in part])):
                    payload, small = restore(image), image.thumbnail()
                    feature = f"{image.width}x{image.height}:{small.shape[1]}x{small.shape[0]}:{thumbnail_hash(small)}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media[k]), hashlib.sha256(media[k]).hexdigest(), feature))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, out)


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_features(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))
