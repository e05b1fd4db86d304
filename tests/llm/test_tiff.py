import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pytest

from millrace.llm import tiff
from millrace.llm.tiff import DEFLATE, LZW, NONE, PACKBITS, lzw_decode, lzw_encode, media_digests, pack_bits, pages, text_media, tiff_pages, unpack_bits, write_file, write_page


def test_packbits_known_bytes():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")  # the example of the format's description
    assert unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert unpack_bits(b"\x80" + packed) == unpack_bits(packed)


def test_lzw_known_codes():
    """Clear, 7, 258, 8, 8, end: the first codes of the format's example."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 257))
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert lzw_decode(data) == bytes([7, 7, 7, 8, 8]) and lzw_encode(bytes([7, 7, 7, 8, 8])) == data


@pytest.mark.parametrize("letters", [1, 3, 256])
def test_codecs_round_trip(letters):
    rng = random.Random(letters)
    for n in [*range(20), 127, 128, 129, 255, 256, 257, 3000, 40000]:
        data = bytes(rng.randrange(letters) for _ in range(n))
        assert unpack_bits(pack_bits(data)) == data and lzw_decode(lzw_encode(data)) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("form", [NONE, LZW, DEFLATE, PACKBITS])
def test_pages_round_trip(order, form):
    rng = random.Random(4)
    for predictor in (1, 2):
        for tile in (0, 16, 48):
            data = [bytes(rng.randrange(256) for _ in range(50 * h)) for h in (1, 33, 70)]
            file = write_file([write_page(d, 50, form, predictor, tile, 7) for d in data], order)
            found = list(pages(file))
            assert [p.data for p in found] == data and {(p.width, p.compression, p.predictor) for p in found} == {(50, form, predictor)}
            for cut in (0, 3, 8, 20, len(file) // 2, len(file) - 2):
                assert len([p for p in pages(file[:cut]) if not p.error]) <= 3


def _colour(order, planar, predictor=2):
    """A 3 by 2 page of three 16-bit samples, put together by hand."""
    image = np.arange(18, dtype=np.uint16).reshape(2, 3, 3) * 3001
    planes = [image[:, :, k : k + 1] for k in range(3)] if planar == 2 else [image]
    if predictor == 2:
        planes = [np.diff(p, axis=1, prepend=np.zeros((2, 1, p.shape[2]), dtype=np.uint16)) for p in planes]
    blocks = [zlib.compress(p.astype(order + "u2").tobytes()) for p in planes]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    places = []
    for b in blocks:
        places.append(len(out))
        out += b
    fields = {256: [3], 257: [2], 258: [16, 16, 16], 259: [32946], 262: [2], 273: places, 277: [3], 278: [2], 279: [len(b) for b in blocks], 284: [planar], 317: [predictor]}
    entries = b""
    for tag, v in sorted(fields.items()):
        kind, letter = (4, "I") if tag in (273, 279) else (3, "H")
        packed = struct.pack(f"{order}{len(v)}{letter}", *v)
        if len(packed) > 4:
            at = len(out)
            out += packed
            packed = struct.pack(order + "I", at)
        entries += struct.pack(order + "HHI", tag, kind, len(v)) + packed.ljust(4, b"\0")
    struct.pack_into(order + "I", out, 4, len(out))
    return bytes(out + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4), image


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("planar", [1, 2])
def test_colour_pages_of_16_bits(order, planar):
    file, image = _colour(order, planar)
    (page,) = pages(file)
    assert (page.samples, page.bits) == (3, 16) and page.data == image.astype("<u2").tobytes()


def test_directories_in_a_loop_are_read_once():
    file = bytearray(write_file([write_page(b"x" * 64, 8), write_page(b"y" * 64, 8)]))
    second = file.rfind(struct.pack("<HHI", 256, 4, 1)) - 2
    (n,) = struct.unpack_from("<H", file, second)
    struct.pack_into("<I", file, second + 2 + 12 * n, struct.unpack_from("<I", file, 4)[0])
    assert len(list(pages(bytes(file)))) == 2


def test_column_of_files(spark):
    file = write_file([write_page(b"a" * 64, 8), write_page(b"b" * 32, 8, PACKBITS)])
    rows = spark.createDataFrame([(1, file), (2, None), (3, b""), (4, b"II*\0junk"), (None, file)], "id long, content binary")
    found = tiff_pages(rows, "id").collect()
    assert sorted((r["id"] or -1, r["page"], r["width"], r["height"], bytes(r["data"])) for r in found if not r["error"]) == [(i, k, 8, h, d) for i in (-1, 1) for k, h, d in ((0, 8, b"a" * 64), (1, 4, b"b" * 32))]
    assert [(r["id"], r["page"], r["data"]) for r in found if r["error"]] == [(4, 0, None)]


def _set(file, tag, value, nth=0):
    """The file with another first value of a field in its nth directory."""
    out, at = bytearray(file), struct.unpack_from("<I", file, 4)[0]
    for k in range(nth + 1):
        (n,) = struct.unpack_from("<H", out, at)
        if k < nth:
            (at,) = struct.unpack_from("<I", out, at + 2 + 12 * n)
    place = next(at + 2 + 12 * k for k in range(n) if struct.unpack_from("<H", out, at + 2 + 12 * k)[0] == tag)
    struct.pack_into("<I", out, place + 8, value)
    return bytes(out)


@pytest.mark.parametrize("tile", [0, 16])
def test_damaged_pages_cost_no_others(spark, tile):
    """Fields of 0, sizes out of all proportion, forms that aren't read, damaged blocks: an error, and the walk goes on."""
    data = [bytes([k]) * 64 for k in range(3)]
    file = write_file([write_page(d, 8, DEFLATE, 1, tile) for d in data])
    sizes = (322, 323) if tile else (278,)
    cases = [_set(file, tag, 0, 1) for tag in (256, 257, 277, *sizes)]
    cases += [_set(_set(file, 256, 200_000, 1), 257, 4_000_000, 1), _set(file, 258, 1, 1), _set(file, 259, 7, 1), _set(file, 317, 3, 1), _set(file, 324 if tile else 273, 4, 1), _set(file, 325 if tile else 279, 1, 1), _set(file, 277, 10**6, 1)]
    cases += [_set(_set(file, 277, 0, 1), 258, 8, 1)]
    rows = spark.createDataFrame(list(enumerate(cases)), "id long, content binary")
    found = tiff_pages(rows, "id").collect()
    assert len(found) == 3 * len(cases)
    for r in found:
        assert (r["data"] is None and r["error"]) if r["page"] == 1 else (bytes(r["data"]) == data[r["page"]] and r["error"] is None)


@pytest.mark.parametrize("compression", [1, LZW, DEFLATE, PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
def test_any_byte_may_be_damaged(compression, tile):
    """Every byte of a small file, set to several values: pages with data or with an error, and never a failure."""
    file = write_file([write_page(bytes(range(64)), 8, compression, 1, tile), write_page(b"ab" * 32, 8, compression, 1, tile)])
    for at in range(len(file)):
        for value in (0, 1, 127, 128, 255, file[at] ^ 4):
            for p in pages(file[:at] + bytes([value]) + file[at + 1 :]):
                assert (p.data is None) == (p.error is not None)
    for end in range(len(file)):
        assert all((p.data is None) == (p.error is not None) for p in pages(file[:end]))


def test_fields_without_values_and_large_ones(spark):
    """A field of count 0 is absent, and numbers above 2 ** 31 fit; one such file costs no other."""
    good = write_file([write_page(bytes(range(64)), 8)])

    def count(file, tag, n):
        out, at = bytearray(file), struct.unpack_from("<I", file, 4)[0]
        (k,) = struct.unpack_from("<H", out, at)
        place = next(at + 2 + 12 * j for j in range(k) if struct.unpack_from("<H", out, at + 2 + 12 * j)[0] == tag)
        struct.pack_into("<I", out, place + 4, n)
        return bytes(out)

    cases = [good] + [count(good, tag, 0) for tag in (256, 257, 258, 259, 273, 277, 278, 279, 317)] + [_set(good, tag, 2**32 - 1) for tag in (256, 257, 258, 259, 277, 278, 317)]
    found = {r["id"]: r for r in tiff_pages(spark.createDataFrame(list(enumerate(cases)), "id long, content binary"), "id").collect()}
    assert len(found) == len(cases) and bytes(found[0]["data"]) == bytes(range(64))
    assert all((r["data"] is None) == (r["error"] is not None) for r in found.values())
    assert any(r["samples"] == 2**32 - 1 for r in found.values())


def test_blocks_unpack_no_further_than_their_page():
    for code, encode, decode in ((LZW, tiff.lzw_encode, tiff.lzw_decode), (PACKBITS, tiff.pack_bits, tiff.unpack_bits)):
        packed = encode(b"a" * 8_000_000)
        assert len(decode(packed, 64)) <= 64 + 4096 and decode(packed)[:100] == b"a" * 100
        page, (block,) = write_page(b"a" * 64, 8, code)
        (read,) = pages(write_file([(page, [packed])]))
        assert read.data == b"a" * 64 and block != packed


def test_files_with_damaged_pages_have_no_payload(spark):
    good = tiff.store(tiff.payload_of("a text"))
    rows = spark.createDataFrame([(1, 6, good), (2, 6, _set(good, 259, 7)), (3, 6, good)], "doc_id long, n_bytes long, content binary").coalesce(1)
    found = {r["doc_id"]: r for r in media_digests(rows).collect()}
    assert found[1]["payload_bytes"] == found[3]["payload_bytes"] == 64 and found[1]["payload_sha256"] == found[3]["payload_sha256"]
    assert [found[2][c] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "feature")] == [None] * 4 and found[2]["pages"] == 1


def test_feature_a_second_way():
    text = "Ein kurzer Text, zweimal. " * 90
    (page,) = (bytes(tiff.payload_of(text)),)
    one, two = tiff.Samples(), tiff.Samples()
    one.add(page)
    for at in range(0, len(page), 64):
        two.add(page[at : at + 64])
    counts = {b: page.count(bytes([b])) / len(page) for b in set(page)}
    mean = sum(page) / len(page)
    want = (mean, math.sqrt(sum((b - mean) ** 2 for b in page) / len(page)), -sum(p * math.log2(p) for p in counts.values()), sum(a != b for a, b in zip(page, page[1:])) / (len(page) - 1))
    assert one.feature() == two.feature() == "mean=%.4f;std=%.4f;entropy=%.4f;steps=%.4f" % want
    assert two.sha.hexdigest() == hashlib.sha256(page).hexdigest() and two.tail == page[-64:]


def test_all_forms_store_texts_of_any_length():
    rng = random.Random(9)
    forms = set()
    for k in range(60):
        payload = tiff.payload_of("".join(rng.choice("abc de, é") for _ in range(rng.choice((10, 900, 5000, 30000)))))
        found = list(pages(tiff.store(payload)))
        assert b"".join(p.data for p in found) == payload
        forms.add((found[0].compression, len(payload) > 1024))
    assert {(f, x) for f in (LZW, DEFLATE, PACKBITS) for x in (False, True)} <= forms


def test_texts_as_media(docs, none, monkeypatch):
    found = media_digests(text_media(docs)).collect()
    assert len(found) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"])
    for r in found:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    by_payload = {}
    for r in found:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert media_digests(text_media(none)).count() == 0
    file = tiff.store(bytes(range(64)) * 10, page_bytes=128)
    assert len(list(pages(file))) == 5 and b"".join(p.data for p in pages(file)) == bytes(range(64)) * 10
