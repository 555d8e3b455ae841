"""Media columns: baseline JPEG, written and read in numpy.

Writing stores bytes as a grey image of flat 8x8 blocks, one for each byte: the quantised DC coefficient of a block
is the byte less 128, with a quantiser step of 8, so that any baseline decoder shows the byte itself as the
luminance of that block. Restart intervals of one block row keep every row decodable on its own.

Reading parses the markers of baseline JPEGs in general (8 bits, Huffman coding, any sampling, with or without
restart intervals), decodes the entropy-coded scan and keeps the DC terms of the luminance: a thumbnail of one
sample for each 8x8 block. Intervals of all images with the same tables are decoded in step, as numpy vectors.
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

from loomlog.llm.common import map_in_arrow, text_or_empty

#: Payloads are padded with bytes 0 to a positive multiple of this, one row of blocks.
UNIT = 64
#: Rows of blocks in one image: 8 times this must stay below 65,536 lines. Longer payloads become several images, one after the other.
MOST_ROWS = 8191
#: Payload bytes that are coded at once.
CHUNK = 1 << 19

# Huffman table for the DC categories 0 to 11 of the luminance; fixed values of the JPEG standard (ITU-T T.81, table K.3):
# number of codes of 1 to 16 bits, then the symbols in the order of their codes.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
#: All AC terms are 0: the only code is that of the end of a block, one bit 0.
AC_COUNTS = (1,) + (0,) * 15
AC_SYMBOLS = (0,)


def huffman_codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, bits) of a canonical table."""
    out, code, k = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, bits))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xDB, bytes([0]) + bytes([8]) + bytes([1]) * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, UNIT * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
        _segment(0xDD, struct.pack(">H", UNIT)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ))


_CATEGORY = np.array([int(abs(d)).bit_length() for d in range(-255, 256)])
_DC = {s: (c, b) for s, c, b in huffman_codes(DC_COUNTS, DC_SYMBOLS)}
#: For a difference d at d + 255: its code, its own bits and the end of the block, as one number, and how many bits that has.
_BITS = np.array([_DC[s][1] + s + 1 for s in _CATEGORY], dtype=np.int64)
_VALUE = np.array([((_DC[s][0] << s | ((d if d > 0 else d + (1 << s) - 1) if s else 0)) << 1) for d, s in zip(range(-255, 256), _CATEGORY.tolist(), strict=True)], dtype=np.int64)


def _rows_coded(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of each row of samples (n x 64 of uint8), stuffed; all together, with each row's length."""
    n = len(samples)
    d = np.empty((n, UNIT), dtype=np.int32)
    d[:, 0] = samples[:, 0].astype(np.int32) - 128
    np.subtract(samples[:, 1:], samples[:, :-1], out=d[:, 1:], dtype=np.int32)
    d += 255
    bits, value = _BITS[d], _VALUE[d]
    ends = np.cumsum(bits, axis=1)
    total = ends[:, -1]
    length = (total + 7) >> 3
    base = np.zeros(n, dtype=np.int64)
    np.cumsum(length[:-1], out=base[1:])
    at = base[:, None] * 8 + ends - bits
    # a code and its value have 17 bits at most: with an offset of 7 they lie within 3 bytes
    word = value << (24 - bits - (at & 7))
    place = (at >> 3).ravel()
    word = word.ravel()
    size = int(base[-1] + length[-1]) + 3
    out = np.bincount(place, word >> 16, size) + np.bincount(place + 1, (word >> 8) & 255, size) + np.bincount(place + 2, word & 255, size)
    out = out[:-3].astype(np.uint8)
    fill = (length * 8 - total).astype(np.int64)
    out[base + length - 1] |= ((1 << fill) - 1).astype(np.uint8)
    stuffed = out == 0xFF
    if stuffed.any():
        length = length + np.add.reduceat(stuffed, base, dtype=np.int64)
        count = 1 + stuffed
        out = np.repeat(out, count)
        out[(np.cumsum(count) - 1)[stuffed]] = 0
    return out, length


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as baseline JPEG images, one after the other."""
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, UNIT)
    coded, length = _rows_coded(samples)
    # each row is followed by the two bytes of a restart marker, or of the end of the image
    rows, marks = [len(p) // UNIT for p in payloads], []
    frames = []
    for n in rows:
        frames.append([min(MOST_ROWS, n - k) for k in range(0, n, MOST_ROWS)])
        for f in frames[-1]:
            m = np.arange(f) % 8 + 0xD0
            m[-1] = 0xD9
            marks.append(m)
    mark = np.concatenate(marks)
    end = np.cumsum(length + 2)
    whole = np.empty(int(end[-1]), dtype=np.uint8)
    is_mark = np.zeros(len(whole), dtype=bool)
    is_mark[end - 1] = is_mark[end - 2] = True
    whole[~is_mark] = coded
    whole[end - 2], whole[end - 1] = 0xFF, mark
    data, out, row, start = whole.tobytes(), [], 0, 0
    for parts in frames:
        image = []
        for f in parts:
            row += f
            stop = int(end[row - 1])
            image += [_header(f), data[start:stop]]
            start = stop
        out.append(b"".join(image))
    return out


class MediaError(ValueError):
    """Not a baseline JPEG that this reader knows."""


@dataclass
class Image:
    """What the markers of one image say. ``scan``: where its entropy-coded bytes begin and end."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]
    steps: dict[int, int]
    tables: tuple
    restart: int
    scan: tuple[int, int]
    data: bytes


def parse_images(data: bytes) -> list[Image]:
    """Marker segments of all images of a media value; MediaError where they are not baseline JPEG."""
    images, at, n = [], 0, len(data)
    while at < n:
        if data[at : at + 2] != b"\xff\xd8":
            raise MediaError("no start of image")
        at += 2
        steps: dict[int, int] = {}
        tables: dict[tuple[int, int], tuple] = {}
        frame, restart = None, 0
        while True:
            if at + 4 > n or data[at] != 0xFF:
                raise MediaError("no marker where one must be")
            marker = data[at + 1]
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    steps[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + (64 << wide) :]
            elif marker == 0xC0:
                depth, height, width, count = struct.unpack_from(">BHHB", body)
                if depth != 8 or not height or not width:
                    raise MediaError("only 8-bit images of known size")
                frame = (width, height, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)])
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise MediaError("not a baseline image")
            elif marker == 0xC4:
                while body:
                    counts = tuple(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = (counts, tuple(body[17 : 17 + sum(counts)]))
                    body = body[17 + sum(counts) :]
            elif marker == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
        if frame is None or body[0] != len(frame[2]):
            raise MediaError("one scan with all components is read")
        use = tuple((h, v, tables[0, t >> 4], tables[1, t & 15]) for (_, h, v, _), t in zip(frame[2], body[2 : 2 + 2 * body[0] : 2], strict=True))
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= n:
                raise MediaError("the scan does not end")
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
                continue
            break
        if data[end + 1] != 0xD9:
            raise MediaError("more than one scan")
        images.append(Image(frame[0], frame[1], frame[2], steps, use, restart, (at, end), data))
        at = end + 2
    return images


_LOOKUPS: dict[tuple, np.ndarray] = {}


def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """For each 16 bits: bits of the code they begin with * 256 + its symbol; 0 where they begin with none."""
    if (counts, symbols) not in _LOOKUPS:
        table = np.zeros(1 << 16, dtype=np.int64)
        for symbol, code, bits in huffman_codes(counts, symbols):
            table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits * 256 + symbol
        _LOOKUPS[counts, symbols] = table
    return _LOOKUPS[counts, symbols]


def _intervals(image: Image) -> list[bytes]:
    """The scan cut at its restart markers, without stuffed bytes."""
    a = np.frombuffer(image.data, dtype=np.uint8)[image.scan[0] : image.scan[1]]
    ff = np.flatnonzero(a[:-1] == 0xFF)
    after = a[ff + 1]
    cuts = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(a), dtype=bool)
    keep[ff[after == 0] + 1] = False
    keep[cuts] = keep[cuts + 1] = False
    kept = np.concatenate(([0], np.cumsum(keep)))
    data, edges = a[keep].tobytes(), [0, *kept[cuts].tolist(), int(kept[-1])]
    return [data[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]


def _decode_dc(parts: list[bytes], blocks: np.ndarray, pattern: list[tuple[int, np.ndarray, np.ndarray]], components: int) -> np.ndarray:
    """Quantised DC terms (intervals x blocks) of scans with one pattern of (component, DC table, AC table) in each unit."""
    # 6 bytes from each place on as one number: a code of 16 bits and a value of 11 at any bit offset
    start, at = np.empty(len(parts), dtype=np.int64), 0
    for k, p in enumerate(parts):
        start[k] = at
        at += len(p) + 8
    raw = np.frombuffer(b"".join(x for p in parts for x in (p, b"\xff" * 8)) + bytes(8), dtype=np.uint8)
    window = np.zeros(len(raw) - 5, dtype=np.int64)
    for k in range(6):
        window |= raw[k : len(raw) - 5 + k].astype(np.int64) << (40 - 8 * k)
    limit = (start + np.array([len(p) for p in parts])) * 8
    order = np.argsort(-blocks, kind="stable")
    pos, limit, left = start[order] * 8, limit[order], blocks[order]
    most = int(left[0]) if len(left) else 0
    out = np.zeros((len(parts), most), dtype=np.int64)
    last = np.zeros((components, len(parts)), dtype=np.int64)
    live = np.searchsorted(-left, -np.arange(most), side="left")
    for b in range(most):
        n = int(live[b])
        component, dc, ac = pattern[b % len(pattern)]
        p = pos[:n]
        off = p & 7
        w = window[p >> 3]
        e = dc[(w >> (32 - off)) & 0xFFFF]
        size, bits = e & 15, e >> 8
        raw_value = (w >> (48 - off - bits - size)) & ((1 << size) - 1)
        low = (1 << size) >> 1
        value = raw_value - np.where(raw_value < low, (1 << size) - 1, 0)
        if not bits.all():
            raise MediaError("no code of the DC table")
        last[component, :n] += value
        out[:n, b] = last[component, :n]
        p = p + bits + size
        todo, k = None, None
        while True:  # AC terms are passed over
            q = p if todo is None else p[todo]
            w = window[q >> 3]
            e = ac[(w >> (32 - (q & 7))) & 0xFFFF]
            if not e.all():
                raise MediaError("no code of the AC table")
            symbol = e & 255
            q = q + (e >> 8) + (symbol & 15)
            if todo is None:
                p, k = q, np.where(symbol == 0, 64, np.where(symbol == 0xF0, 17, (symbol >> 4) + 2))
                todo = np.flatnonzero(k < 64)
                k = k[todo]
            else:
                p[todo] = q
                k = np.where(symbol == 0, 64, np.where(symbol == 0xF0, k + 16, k + (symbol >> 4) + 1))
                more = k < 64
                todo, k = todo[more], k[more]
            if not len(todo):
                break
        if (p > limit[:n]).any():
            raise MediaError("the scan is too short")
        pos[:n] = p
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return out[back]


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """For each image the luminance of its 8x8 blocks by their DC terms alone: uint8, one sample for each block."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        groups.setdefault(image.tables, []).append(k)
    for use, members in groups.items():
        pattern, single = [], len(use) == 1
        for c, (h, v, dc, ac) in enumerate(use):
            pattern += [(c, _lookup(*dc), _lookup(*ac))] * (1 if single else h * v)
        wide, high = max(u[0] for u in use), max(u[1] for u in use)
        parts, blocks, spans = [], [], []
        for k in members:
            image = images[k]
            across, down = (-(-image.width // (8 * (1 if single else wide))), -(-image.height // (8 * (1 if single else high))))
            units = across * down
            own = _intervals(image)
            each = image.restart or units
            if len(own) != -(-units // each):
                raise MediaError("restart markers don't match the size")
            spans.append((len(parts), len(own), across, down))
            parts += own
            blocks += [each] * (len(own) - 1) + [units - each * (len(own) - 1)]
        counts = np.array(blocks, dtype=np.int64) * len(pattern)
        terms = _decode_dc(parts, counts, pattern, len(use))
        h, v = (1, 1) if single else use[0][:2]
        for k, (first, n, across, down) in zip(members, spans, strict=True):
            own = terms[first : first + n]
            flat = own.ravel() if len(set(blocks[first : first + n])) == 1 and own.shape[1] == counts[first] else np.concatenate([t[:c] for t, c in zip(own, counts[first : first + n], strict=True)])
            luma = flat.reshape(-1, len(pattern))[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            step = images[k].steps[images[k].components[0][3]]
            luma = luma[: -(-images[k].height // 8), : -(-images[k].width // 8)]
            out[k] = np.clip(luma * step // 8 + 128, 0, 255).astype(np.uint8)
    return out  # type: ignore[return-value]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits as hex: which cells of an 8x8 grid over the thumbnail are brighter than the mean of all cells."""
    rows, columns = thumb.shape
    wide = thumb[np.arange(8) * rows // 8] if rows < 8 else np.add.reduceat(thumb.astype(np.int64), np.arange(8) * rows // 8, axis=0)
    cells = wide[:, np.arange(8) * columns // 8] if columns < 8 else np.add.reduceat(wide.astype(np.int64), np.arange(8) * columns // 8, axis=1)
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()


def payload_of(text: bytes) -> bytes:
    return text + bytes(UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of about CHUNK bytes."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > CHUNK:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a, b in _chunks([len(t) for t in texts]):
            media = encode_payloads([payload_of(t) for t in texts[a:b]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


_FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, images int, thumb_hash string, error string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _FEATURES.split(", ")]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in _FEATURES.split(", ")]
    for batch in batches:
        media = batch.column(2).to_pylist()
        rows = []
        for a, b in _chunks([len(m or b"") for m in media]):
            parsed, errors = [], []
            for m in media[a:b]:
                try:
                    parsed.append(parse_images(m or b""))
                    errors.append(None if m else "no media")
                except (MediaError, struct.error, KeyError, IndexError) as e:
                    parsed.append([])
                    errors.append(str(e) or type(e).__name__)
            try:
                thumbs = iter(thumbnails([i for own in parsed for i in own]))
                shown = [[next(thumbs) for _ in own] for own in parsed]
            except MediaError:  # one bad scan among them: one by one
                shown = []
                for k, own in enumerate(parsed):
                    try:
                        shown.append(thumbnails(own))
                    except MediaError as e:
                        shown.append([])
                        errors[k] = str(e)
            for m, own, own_thumbs, error in zip(media[a:b], parsed, shown, errors, strict=True):
                if error is not None:
                    rows.append((None, None, None, len(m or b""), hashlib.sha256(m or b"").hexdigest(), None, None, None, None, error))
                    continue
                payload = b"".join(t.tobytes() for t in own_thumbs)
                grid = own_thumbs[0] if len(own_thumbs) == 1 or len({t.shape[1] for t in own_thumbs}) > 1 else np.concatenate(own_thumbs)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), max(i.width for i in own), sum(i.height for i in own), len(own), average_hash(grid), None))
        columns = [batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types[2:], strict=True))] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def store_jpeg(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded, as baseline JPEG; a null text is an empty one, 64 bytes 0."""
    return map_in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")), _store, "doc_id bigint, n_bytes bigint, media binary")


def jpeg_features(media: DataFrame) -> DataFrame:
    """Reads a media column (doc_id, n_bytes, media): dimensions, thumbnail hash, and digests of thumbnail bytes and media.

    The thumbnail's samples, row by row, are the payload; of several images in one value, one after the other. A
    value that is null or no baseline JPEG gets a row with ``error`` and nulls. Equal media, equal values. Rows stay
    one for one; an empty table gives an empty one.
    """
    return map_in_arrow(media.select("doc_id", "n_bytes", "media"), _read, _FEATURES)


def text_media(docs: DataFrame) -> DataFrame:
    """Stores the texts of docs as media and reads them back, with a ``feature`` string.

    A null text is an empty one; texts of any length are stored whole, in several images where one is too small; equal
    texts have equal values, and repeated rows get a row each; other columns of docs, whatever they are called, are
    not looked at; an empty table gives an empty one.
    """
    read = jpeg_features(store_jpeg(docs))
    return read.withColumn("feature", F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumb_hash")))
