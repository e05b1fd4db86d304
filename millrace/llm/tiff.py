"""TIFF: pages in a binary column, read and written.

Reading walks the chain of image directories in either byte order, decodes strips or tiles
(uncompressed, PackBits, LZW, deflate), undoes the horizontal predictor on 8- and 16-bit
samples, joins separate planes, and emits one row per page. Writing covers the same
forms for 8-bit pages, and is what stores a text as media.

A text as media: its UTF-8 bytes, followed by bytes 0 up to a positive multiple of 64, are the
8-bit gray samples of pages 64 wide and at most PAGE_BYTES large. The stored form follows
from the payload alone, so equal texts give equal files.

Defined results: a null text is an empty one, whose payload is 64 bytes 0. Null and empty content, and
content that isn't TIFF, has no pages. A page whose form isn't supported or that is damaged is a row
without data and with the reason in `error`, and the walk goes on to the next directory; a directory that can't be read
ends it with such a row. A page's data is held at once, and one that would be larger than
MOST_BYTES is such a row, too. Directories that form a loop are read once. Rows repeated under one key each give
rows. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_arrow, map_batches, map_slices

#: Fixed values of the format: tags, field types' sizes and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODE = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END_OF_DATA = 256, 257

#: Payload bytes of a page that a text is stored in.
PAGE_BYTES = 1 << 20

#: Decoded bytes of the largest page that is read, and of what its strips or tiles may unpack to.
MOST_BYTES = 1 << 30


@dataclass
class Page:
    width: int | None = None
    height: int | None = None
    samples: int | None = None
    bits: int | None = None
    compression: int | None = None
    predictor: int | None = None
    data: bytes | None = None  # rows from the top, samples interleaved; 16-bit samples little-endian
    error: str | None = None


def unpack_bits(data: bytes, most: int = 1 << 62) -> bytes:
    """Runs and literals, until there are `most` bytes or a little more."""
    out, at, size = [], 0, 0
    while at < len(data) and size < most:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            out.append(data[at + 1 : at + 2] * (257 - n) if n > 128 else b"")
            at += 2 if n > 128 else 1
        size += len(out[-1])
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    out, at = [], 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            some = data[k : min(k + 128, end)]
            out.append(bytes([len(some) - 1]) + some)

    for m in _RUN.finditer(data):
        literal(m.start())
        out.append(bytes([257 - len(m[0])]) + m[1])
        at = m.end()
    literal(len(data))
    return b"".join(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, each width ending one code early, until there are `most` bytes or a little more."""
    start = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last = list(start), 9, b""
    out: list[bytes] = []
    held = have = size = 0
    for byte in data:
        held = held << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == CLEAR:
            table, width, last = list(start), 9, b""
            continue
        if code == END_OF_DATA or size >= most:
            break
        if not last:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:  # no code reaches further
                table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        size += len(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    start = {bytes([k]): k for k in range(256)}
    held = have = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have)
            held &= (1 << have) - 1

    put(CLEAR, 9)
    table, n, width, run = dict(start), 258, 9, b""
    for k in range(len(data)):
        longer = run + data[k : k + 1]
        if longer in table:
            run = longer
            continue
        put(table[run], width)
        table[longer] = n
        n += 1
        if n == 4094:  # before codes run out
            put(CLEAR, 12)
            table, n, width = dict(start), 258, 9
        elif n == 1 << width:
            width += 1
        run = data[k : k + 1]
    if run:
        put(table[run], width)
        if n + 1 == 1 << width and width < 12:  # the reader adds an entry for this code, too
            width += 1
    put(END_OF_DATA, width)
    if have:
        put(0, 8 - have)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: Decoders get the bytes and how many samples' bytes are needed.
_DECODE = {NONE: lambda b, n: b[:n], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 4), PACKBITS: pack_bits}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """Fields of whole numbers in the directory at a place, and the place of the next one."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind not in FIELD_CODE:
            continue
        place = at + 10 + 12 * k
        if FIELD_SIZE[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        fields[tag] = struct.unpack_from(f"{order}{count}{FIELD_CODE[kind]}", data, place)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _one(fields: dict[int, tuple], tag: int, default: int | None = None) -> int | None:
    """A field's first value. A field without values counts as absent."""
    return (fields.get(tag) or (default,))[0]


def _page(data: bytes, fields: dict[int, tuple], order: str) -> Page:
    page = Page(_one(fields, WIDTH), _one(fields, HEIGHT), _one(fields, SAMPLES, 1), _one(fields, BITS, 1), _one(fields, COMPRESSION, 1), _one(fields, PREDICTOR, 1))
    try:
        page.data = _samples(data, fields, order, page)
    except Exception as e:  # whatever a damaged file holds, it costs no more than its page
        page.error = str(e) or type(e).__name__
    return page


def _samples(data: bytes, fields: dict[int, tuple], order: str, page: Page) -> bytes:
    one = lambda tag, default=None: _one(fields, tag, default)
    width, height, samples = page.width, page.height, page.samples
    if page.bits not in (8, 16) or len(set(fields.get(BITS) or (1,))) > 1 or page.compression not in _DECODE or page.predictor not in (1, 2):
        raise ValueError("form not supported")
    tiled = TILE_OFFSETS in fields
    across = one(TILE_WIDTH) if tiled else width
    down = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    places, counts = (fields.get(t, ()) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    if not all((width, height, samples, across, down)):
        raise ValueError("a size is 0")
    planes = samples if one(PLANAR, 1) == 2 else 1
    deep = samples // planes
    columns, rows = -(-width // across), -(-height // down)
    if max(width * height, across * down * columns * rows) * samples * page.bits // 8 > MOST_BYTES:
        raise ValueError("too large")
    if planes * rows * columns > min(len(places), len(counts)):
        raise ValueError("blocks are missing")
    kind = np.dtype("u1") if page.bits == 8 else np.dtype(order + "u2")
    blocks = []
    for k in range(planes * rows * columns):  # all are decoded before the image takes its memory
        high = down if tiled else min(down, height - k % (rows * columns) * down)
        raw = _DECODE[page.compression](data[places[k] : places[k] + counts[k]], high * across * deep * kind.itemsize)
        block = np.frombuffer(raw, dtype=kind, count=high * across * deep).reshape(high, across, deep)
        blocks.append(np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if page.predictor == 2 else block)
    image = np.zeros((height, width, samples), dtype=kind.newbyteorder("<"))
    for k, block in enumerate(blocks):
        plane, rest = divmod(k, rows * columns)
        top, left = (rest // columns) * down, (rest % columns) * across
        image[top : top + len(block), left : left + across, plane * deep : (plane + 1) * deep] = block[: height - top, : width - left]
    return image.tobytes()


def pages(content: bytes | None) -> Iterator[Page]:
    """Pages in order of the directories."""
    order = {b"II": "<", b"MM": ">"}.get((content or b"")[:2])
    if order is None or len(content) < 8:
        return
    magic, at = struct.unpack_from(order + "HI", content, 2)
    seen: set[int] = set()
    while magic == 42 and at and at not in seen:
        seen.add(at)
        try:
            fields, at = _directory(content, at, order)
        except struct.error as e:
            yield Page(error=f"directory: {e}")
            return
        yield _page(content, fields, order)


def write_page(data: bytes, width: int, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, rows_per_strip: int = 256) -> tuple[dict, list[bytes]]:
    """Fields and blocks of a page of 8-bit gray samples. tile: side of square tiles, 0 for strips."""
    image = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    height = len(image)
    down, across = (tile, tile) if tile else (min(rows_per_strip, height), width)
    blocks = []
    for top in range(0, height, down):
        for left in range(0, width, across):
            block = image[top : top + down, left : left + across]
            if tile:
                block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1])))
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.uint8(0))
            blocks.append(_ENCODE[compression](block.tobytes()))
    fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
    fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile]} if tile else {ROWS_PER_STRIP: [down]}
    return fields, blocks


def write_file(made: list[tuple[dict, list[bytes]]], order: str = "<") -> bytes:
    """A file of such pages, in either byte order."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for fields, blocks in made:
        places = []
        for b in blocks:
            places.append(len(out))
            out += b
        tiled = TILE_WIDTH in fields
        fields = fields | {TILE_OFFSETS if tiled else STRIP_OFFSETS: places, TILE_COUNTS if tiled else STRIP_COUNTS: [len(b) for b in blocks]}
        entries = []
        for tag, values in sorted(fields.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                at = len(out)
                out += packed
                packed = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, 4, len(values)) + packed)
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


#: How a text's payload is stored: compression, predictor, side of tiles.
_FORMS = ((DEFLATE, 2, 0), (PACKBITS, 1, 0), (DEFLATE, 1, 64), (LZW, 2, 0))


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))


def store(payload: bytes, page_bytes: int = PAGE_BYTES) -> bytes:
    compression, predictor, tile = _FORMS[zlib.crc32(payload) % len(_FORMS)]
    return write_file([write_page(payload[at : at + page_bytes], 64, compression, predictor, tile) for at in range(0, len(payload), page_bytes)])


def text_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (of the text), content (the file)."""

    def make():
        def step(c: dict) -> dict:
            return {"doc_id": c["doc_id"], "n_bytes": [len((t or "").encode()) for t in c["text"]], "content": [store(payload_of(t)) for t in c["text"]]}

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, make, "doc_id long, n_bytes long, content binary")


def tiff_pages(files: DataFrame, key: str, content: str = "content", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each page: key, page, width, height, samples, bits, compression, predictor, data, error, and the columns to keep.

    A file's pages follow each other in one partition.
    """
    names = ("width", "height", "samples", "bits", "compression", "predictor", "data", "error")

    def make():
        def step(part: pa.RecordBatch) -> dict:
            found = [(at, k, p) for at, b in enumerate(part.column("content").to_pylist()) for k, p in enumerate(pages(b))]
            out = {n: [getattr(p, n) for _, _, p in found] for n in names}
            rows = pa.array([at for at, _, _ in found], pa.int64())
            return out | {"page": [k for _, k, _ in found]} | {f"kept{k}": part.column(f"kept{k}").take(rows) for k in range(1 + len(keep))}

        return step

    rows = files.select(*(F.col(c).alias(f"kept{k}") for k, c in enumerate((key, *keep))), F.col(content).alias("content"))
    kept = ", ".join(f"kept{k} {files.schema[c].dataType.simpleString()}" for k, c in enumerate((key, *keep)))
    schema = f"{kept}, page int, width long, height long, samples long, bits long, compression long, predictor long, data binary, error string"
    made = map_slices(rows, make, schema, rows=64)
    return made.select(F.col("kept0").alias(key), "page", *names, *(F.col(f"kept{k}").alias(c) for k, c in enumerate(keep, 1)))


class Samples:
    """What is told of a payload, page by page: its digest, its end, and counts of samples."""

    def __init__(self):
        self.sha, self.tail, self.counts, self.steps = hashlib.sha256(), b"", np.zeros(256, dtype=np.int64), 0

    def add(self, data: bytes) -> None:
        x = np.frombuffer(self.tail[-1:] + data, dtype=np.uint8)
        self.steps += int(np.count_nonzero(x[1:] != x[:-1]))
        self.counts += np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        self.sha.update(data)
        self.tail = (self.tail + data[-64:])[-64:]

    def feature(self) -> str:
        """Mean, deviation and entropy of the samples, and the share that differs from the one before."""
        n, value = int(self.counts.sum()), np.arange(256)
        mean = float(self.counts @ value) / n
        deviation = float(np.sqrt(self.counts @ (value - mean) ** 2 / n))
        share = self.counts[self.counts > 0] / n
        return f"mean={mean:.4f};std={deviation:.4f};entropy={-float(share @ np.log2(share)):.4f};steps={self.steps / max(1, n - 1):.4f}"


_DIGEST = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32()),
])


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored files of text_media hold, read back page by page. A file with a page that can't be read has no payload."""
    files = media.select("doc_id", "n_bytes", "content", F.octet_length("content").cast("long").alias("media_bytes"), F.sha2("content", 256).alias("media_sha256"))
    found = tiff_pages(files, "doc_id", keep=("n_bytes", "media_bytes", "media_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []  # a file's columns, its samples and pages so far

        def close() -> None:
            if now:
                (doc, n, size, sha), x, k = now
                told = (int(x.counts.sum()), x.sha.hexdigest(), zlib.crc32(x.tail)) if x else (None, None, None)
                done.append((doc, n, *told, size, sha, x.feature() if x else None, k))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
            done.clear()
            return out

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3)]
            for *file, page, data in zip(*columns, batch.column(4).to_pylist(), (batch.column(5)[k].as_py() for k in range(batch.num_rows)), strict=True):
                if page == 0:
                    close()
                    now = (tuple(file), Samples(), 0)
                if now[1] and data is not None:
                    now[1].add(data)
                now = (now[0], now[1] if data is not None else None, now[2] + 1)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    ordered = found.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "data")
    return in_arrow(ordered, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")
