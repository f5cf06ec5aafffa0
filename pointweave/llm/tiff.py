"""TIFF pages as rows: a reader that walks image directories, and the writer that stores texts.

The reader follows the chain of directories, decodes strips and tiles stored plainly, as PackBits,
LZW or deflate, undoes horizontal differencing, and gives one row per page. The writer stores a
payload as RGB pages of 64 pixels a line, so a line is 192 bytes, with a layout chosen from the
number of lines alone: equal texts give equal files.

Results in special cases: a null or empty text is stored as one line of blanks; texts are stored
whole, over as many pages as they need; a null file has no pages; a file that isn't TIFF, is cut
short, or holds planar samples or such of other than 8 bits raises ValueError; rows are independent, so repeated rows give repeated results and an empty table an empty
one; only doc_id and text (or media) are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, slices, table, texts_of

LINE, WIDTH, SAMPLES, PAGE_LINES, TILE = 192, 64, 3, 1024, 32
#: Fixed values of the format: tags, field types by size, and compression schemes.
W, H, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES_PER_PIXEL, ROWS, COUNTS, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
SIZES = {1: "B", 3: "H", 4: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END, FIRST = 256, 257, 258


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as (257 - n, byte), all else as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    lengths = np.diff(np.concatenate((starts, [len(a)])))
    long = lengths >= 3
    out, done = bytearray(), 0

    def literal(end: int) -> None:
        nonlocal done
        while done < end:
            n = min(128, end - done)
            out.append(n - 1)
            out.extend(data[done : done + n])
            done += n

    for s, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        literal(s)
        while n >= 2:
            k = min(128, n)
            out.extend((257 - k, data[s]))
            n -= k
            done += k
        s = done
    literal(len(data))
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)




def lzw_encode(data: bytes) -> bytes:
    bits, n_bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, n_bits
        bits = bits << width | code
        n_bits += width
        while n_bits >= 8:
            n_bits -= 8
            out.append(bits >> n_bits & 255)
        bits &= (1 << n_bits) - 1

    put(CLEAR, 9)
    names, next_code, width, at, n = {}, FIRST, 9, 0, len(data)
    while at < n:
        code, end = data[at], at + 1
        while end < n and (longer := names.get((code, data[end]))) is not None:
            code = longer
            end += 1
        put(code, width)
        if end < n:
            names[code, data[end]] = next_code
        next_code += 1
        width = 9 if next_code < 511 else 10 if next_code < 1023 else 11 if next_code < 2047 else 12
        if next_code >= 4094:
            put(CLEAR, width)
            names, next_code, width = {}, FIRST, 9
        at = end
    put(END, width)
    if n_bits:
        put(0, 8 - n_bits)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    names, width, bits, n_bits, out, before = list(start), 9, 0, 0, [], b""
    for byte in data:
        bits = bits << 8 | byte
        n_bits += 8
        if n_bits < width:
            continue
        n_bits -= width
        code = bits >> n_bits
        bits &= (1 << n_bits) - 1
        if code == CLEAR:
            names, width, before = list(start), 9, b""
            continue
        if code == END:
            break
        word = names[code] if code < len(names) else before + before[:1]
        out.append(word)
        if before:
            names.append(before + word[:1])
        before = word
        size = len(names) + 1
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6), PACKBITS: pack_bits}
DECODERS = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def layout(lines: int) -> tuple[int, int, bool]:
    """Compression, predictor and whether in tiles, for a payload of so many lines; deflate with differencing for most."""
    return {0: (LZW, 2, False), 1: (PACKBITS, 1, False), 2: (NONE, 1, True), 3: (DEFLATE, 1, False), 4: (DEFLATE, 2, True)}.get(lines % 8, (DEFLATE, 2, False))


def _directory(entries: list[tuple[int, int, list[int]]], at: int, following: bool) -> bytes:
    """A directory at a file offset, its longer values after it, and the offset of the next one."""
    n = len(entries)
    head, tail, free = [], [], at + 2 + 12 * n + 4
    for tag, kind, values in sorted(entries):
        raw = struct.pack(f"<{len(values)}{SIZES[kind]}", *values)
        if len(raw) <= 4:
            head.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        else:
            head.append(struct.pack("<HHII", tag, kind, len(values), free))
            raw += b"\0" * (len(raw) % 2)
            tail.append(raw)
            free += len(raw)
    return struct.pack("<H", n) + b"".join(head) + struct.pack("<I", free if following else 0) + b"".join(tail)


def write_pages(payload: bytes, scheme: tuple[int, int, bool] | None = None, strip: int = 256) -> bytes:
    """A TIFF file that holds the payload (a multiple of 192 bytes) as 8-bit RGB samples."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    compression, predictor, tiled = scheme or layout(len(lines))
    out, at = [b"II*\0\x08\0\0\0"], 8
    for first in range(0, len(lines), PAGE_LINES):
        page = lines[first : first + PAGE_LINES]
        if tiled:
            padded = np.pad(page, ((0, -len(page) % TILE), (0, 0), (0, 0)))
            parts = [padded[y : y + TILE, x : x + TILE] for y in range(0, len(padded), TILE) for x in range(0, WIDTH, TILE)]
        else:
            parts = [page[y : y + strip] for y in range(0, len(page), strip)]
        if predictor == 2:
            parts = [np.concatenate((p[:, :1], np.diff(p, axis=1)), axis=1) for p in parts]
        stored = [ENCODERS[compression](p.tobytes()) for p in parts]
        entries = [(W, 4, [WIDTH]), (H, 4, [len(page)]), (BITS, 3, [8] * SAMPLES), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2]), (SAMPLES_PER_PIXEL, 3, [SAMPLES]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_W, 4, [TILE]), (TILE_H, 4, [TILE])] if tiled else [(ROWS, 4, [strip])]
        places, sizes = (TILE_OFFSETS, TILE_COUNTS) if tiled else (OFFSETS, COUNTS)
        last = first + PAGE_LINES >= len(lines)
        body = b"".join(stored)
        body += b"\0" * (len(body) % 2)
        size = len(_directory([*entries, (places, 4, [0] * len(stored)), (sizes, 4, [0] * len(stored))], at, True))
        offsets = (at + size + np.concatenate(([0], np.cumsum([len(s) for s in stored])))[:-1]).astype(int).tolist()
        directory = bytearray(_directory([*entries, (places, 4, offsets), (sizes, 4, [len(s) for s in stored])], at, True))
        n = struct.unpack_from("<H", directory)[0]
        struct.pack_into("<I", directory, 2 + 12 * n, 0 if last else at + size + len(body))
        out += [bytes(directory), body]
        at += size + len(body)
    return b"".join(out)


def read_pages(media: bytes | None) -> Iterator[Page]:
    """The pages of a TIFF file of either byte order, in the order of its directories; a file that ends too early raises ValueError."""
    try:
        yield from _read(media or b"") if media is not None else ()
    except (struct.error, IndexError, KeyError, zlib.error) as e:
        raise ValueError(f"a broken TIFF file: {e}") from e


def _read(media: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if not order or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("no TIFF file")
    at, seen, number = struct.unpack_from(order + "I", media, 4)[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        n, tags = struct.unpack_from(order + "H", media, at)[0], {}
        for i in range(n):
            entry = at + 2 + 12 * i
            tag, kind, count = struct.unpack_from(order + "HHI", media, entry)
            if kind in SIZES:
                form = f"{order}{count}{SIZES[kind]}"
                place = entry + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", media, entry + 8)[0]
                tags[tag] = struct.unpack_from(form, media, place)
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]
        one = lambda tag, default, t=tags: t.get(tag, (default,))[0]
        if any(b != 8 for b in tags.get(BITS, (1,))) or one(PLANAR, 1) != 1:
            raise ValueError("only interleaved 8-bit samples are read")
        width, height, samples, tiled = one(W, 0), one(H, 0), one(SAMPLES_PER_PIXEL, 1), TILE_OFFSETS in tags
        across, down = (one(TILE_W, 0), one(TILE_H, 0)) if tiled else (width, min(one(ROWS, height), height))
        image = np.zeros((height, width, samples), np.uint8)
        columns = -(-width // across)
        for i, (place, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
            y, x = i // columns * down, i % columns * across
            rows = down if tiled else min(down, height - y)
            part = np.frombuffer(DECODERS[one(COMPRESSION, 1)](media[place : place + size]), np.uint8)[: rows * across * samples].reshape(rows, across, samples)
            if one(PREDICTOR, 1) == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            image[y : y + rows, x : x + across] = part[: height - y, : width - x]
        yield Page(number, width, height, samples, one(COMPRESSION, 1), one(PREDICTOR, 1), tiled, image.tobytes())
        number += 1


def payload_of(text: str) -> bytes:
    """UTF-8, blanks appended up to a positive multiple of a line."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // LINE)) * LINE)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text as a TIFF file."""
    return map_texts(texts_of(docs), "text", lambda texts, rest: {"doc_id": rest["doc_id"], "media": [write_pages(payload_of(x)) for x in texts]}, "doc_id long, media binary")


def tiff_pages(files: DataFrame) -> DataFrame:
    """One row per page of each (doc_id, media), with its samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                for doc, media in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                    for p in read_pages(media):
                        yield pa.RecordBatch.from_pylist([{"doc_id": doc} | p._asdict()], schema=pages)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = "doc_id long, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary"
    pages = to_arrow_schema(_parse_datatype_string(schema))
    return files.select("doc_id", "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text written and read back by this module, as hashes and features of what was read."""

    def run(texts: list[str], rest: dict) -> dict:
        out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for x in texts:
            media = write_pages(payload_of(x))
            pages = list(read_pages(media))
            back = b"".join(p.pixels for p in pages)
            levels = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
            p = pages[0]
            row = (
                len(x.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(),
                f"pages={len(pages)} width={p.width} lines={sum(q.height for q in pages)} scheme={p.compression}/{p.predictor}/{'tiles' if p.tiled else 'strips'} sum={int(levels @ np.arange(256))} levels={int((levels > 0).sum())} top={int(levels.argmax())}",
            )
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": rest["doc_id"]} | out

    return map_texts(texts_of(docs), "text", run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
