"""TIFF columns: write payloads as TIFF files, walk image directories and emit one row per page.

The reader follows the chain of image directories in either byte order, decodes uncompressed, PackBits, LZW and
deflate strips or tiles, undoes the horizontal predictor and returns 8-bit samples. The writer makes every one
of these forms. All work is per row, so nothing is shuffled and memory holds a file and its pages at a time.

A null payload or file gives one row with an error and no pixels; so does a damaged file, which never stops a
job. A null or empty text is stored as its padding. Repeated rows give repeated rows, an empty table an empty
one, and columns other than those named are not read. Very long texts become more pages.
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

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
UNIT = 192  # one row of 64 RGB pixels
WIDTH, SAMPLES = 64, 3
PAGE_ROWS, STRIP_ROWS = 512, 128

# Fixed values of the format: tag numbers, and bytes of each field type.
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "strip_offsets": 273,
    "samples": 277, "rows_per_strip": 278, "strip_bytes": 279, "planar": 284, "predictor": 317, "tile_width": 322,
    "tile_height": 323, "tile_offsets": 324, "tile_bytes": 325,
}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    clear, end = 256, 257
    acc = held = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = (acc << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
            acc &= (1 << held) - 1

    def fresh() -> dict[bytes, int]:
        return {bytes([i]): i for i in range(256)}

    table, width, following, w = fresh(), 9, 258, b""
    put(clear, width)
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        put(table[w], width)
        table[w + c] = following
        following += 1
        if following >= 4094:
            put(clear, width)
            table, width, following = fresh(), 9, 258
        elif following >= (1 << width) - 1:
            width += 1
        w = c
    if w:
        put(table[w], width)
        following += 1
        if following >= (1 << width) - 1 and width < 12:
            width += 1
    put(end, width)
    if held:
        put(0, 8 - held)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    clear, end = 256, 257
    out = bytearray()
    table: list[bytes] = []
    width, acc, held, last = 9, 0, 0, None
    for byte in data:
        acc, held = (acc << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == end:
            break
        if code == clear:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if code < len(table):
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code outside the table")
        out += entry
        if last is not None:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 2 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


ENCODERS = {
    NONE: lambda b: b,
    PACKBITS: packbits_encode,
    LZW: lzw_encode,
    DEFLATE: lambda b: zlib.compress(b, 1),
}


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


DECODERS = {
    NONE: lambda b, n: b,
    PACKBITS: packbits_decode,
    LZW: lzw_decode,
    DEFLATE: _inflate,
    OLD_DEFLATE: _inflate,
}


def _difference(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[:, 1:] -= a[:, :-1]
    return out


def encode(
    payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, page_rows: int = PAGE_ROWS, order: str = "<"
) -> bytes:
    """A file of RGB pages of 64 pixels a row, for a payload that is a multiple of 192 bytes.

    tile: side of square tiles, a multiple of 16; 0 for strips.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload is no positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4  # where the offset of the next directory goes
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        height = len(page)
        if tile:
            full = np.zeros((-(-height // tile) * tile, -(-WIDTH // tile) * tile, SAMPLES), np.uint8)
            full[:height, :WIDTH] = page
            parts = [full[y : y + tile, x : x + tile] for y in range(0, full.shape[0], tile) for x in range(0, full.shape[1], tile)]
        else:
            parts = [page[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        places, sizes = [], []
        for part in parts:
            data = ENCODERS[compression]((_difference(part) if predictor == 2 else part).tobytes())
            places.append(len(out))
            sizes.append(len(data))
            out += data
        t = TAGS
        fields = [
            (t["width"], 3, [WIDTH]), (t["height"], 4, [height]), (t["bits"], 3, [8] * SAMPLES), (t["compression"], 3, [compression]),
            (t["photometric"], 3, [2]), (t["samples"], 3, [SAMPLES]), (t["planar"], 3, [1]), (t["predictor"], 3, [predictor]),
        ]
        if tile:
            fields += [(t["tile_width"], 3, [tile]), (t["tile_height"], 3, [tile]), (t["tile_offsets"], 4, places), (t["tile_bytes"], 4, sizes)]
        else:
            fields += [(t["strip_offsets"], 4, places), (t["rows_per_strip"], 4, [STRIP_ROWS]), (t["strip_bytes"], 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                place = len(out) + len(out) % 2
                out += b"\0" * (len(out) % 2) + data
                data = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height, width, samples


def pages(data: bytes) -> Iterator[Page]:
    """Walk the image directories of a file. Raises ValueError where the file is damaged or not supported."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise ValueError("the chain of directories is damaged")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        if at + 2 + 12 * n + 4 > len(data):
            raise ValueError("a directory is cut off")
        fields: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in (1, 3, 4):
                continue
            size = TYPE_BYTES[kind] * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if place + size > len(data):
                raise ValueError("a field lies outside the file")
            fields[tag] = struct.unpack_from(f"{order}{count}{'BxHI'[kind - 1]}", data, place)
        yield _page(data, fields, len(seen) - 1)
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


#: Bytes that one stored byte can become at most: a run of 128 from two, a string of 4094 from a code of nine bits, and deflate's bound.
MOST = {NONE: 1, PACKBITS: 64, LZW: 3640, DEFLATE: 1033, OLD_DEFLATE: 1033}


def _page(data: bytes, fields: dict[int, tuple[int, ...]], index: int) -> Page:
    def one(name: str, default: int | None = None) -> int:
        if (v := fields.get(TAGS[name])) or default is not None:
            return v[0] if v else default
        raise ValueError(f"the directory has no {name}")

    width, height, samples = one("width"), one("height"), one("samples", 1)
    compression, predictor = one("compression", NONE), one("predictor", 1)
    if set(fields.get(TAGS["bits"], (1,))) != {8} or one("planar", 1) != 1 or predictor not in (1, 2) or compression not in DECODERS:
        raise ValueError("a form of sample, plane, predictor or compression that is not supported")
    tiled = TAGS["tile_offsets"] in fields
    if tiled:
        w, h = one("tile_width"), one("tile_height")
        offsets, sizes = fields[TAGS["tile_offsets"]], fields.get(TAGS["tile_bytes"], ())
    else:
        w, h = width, min(one("rows_per_strip", height), height)
        offsets, sizes = fields.get(TAGS["strip_offsets"], ()), fields.get(TAGS["strip_bytes"], ())
    if not w or not h or not width or not height:
        raise ValueError("an image without pixels")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) != across * down or len(sizes) != len(offsets):
        raise ValueError("the number of strips or tiles is wrong")
    most = sum(min(size, max(0, len(data) - place)) for place, size in zip(offsets, sizes, strict=True)) * MOST[compression]
    if (across * w * down * h if tiled else width * height) * samples > most:
        raise ValueError("more samples than the bytes of the image can hold")
    pixels = np.empty((height, width, samples), np.uint8)
    for k, (place, size) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        want = rows * w * samples
        try:
            raw = DECODERS[compression](data[place : place + size], want)
        except zlib.error as e:
            raise ValueError(f"deflate: {e}") from None
        if len(raw) < want:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, want).reshape(rows, w, samples)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=np.uint8)
        pixels[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return Page(index, width, height, samples, compression, predictor, tiled, pixels)


def read(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per page of every file: key, page, width, height, samples, compression, predictor, tiled, pixels, error."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"

    def run(batches):
        for batch in batches:
            for k, data in zip(batch[key].to_pylist(), batch[media].to_pylist(), strict=True):
                rows = []
                try:
                    if data is None:
                        raise ValueError("no file")
                    for p in pages(data):
                        rows.append((k, p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                        if len(rows) == 64:
                            yield _batch(rows, out)
                            rows = []
                except ValueError as e:
                    rows.append((k, *[None] * 8, str(e)))
                if rows:
                    yield _batch(rows, out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    return df.select(key, media).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and those padded with blanks to a positive multiple of 192."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def features(found: list[Page]) -> str:
    """Pages, rows, sums and horizontal gradients by channel, and a histogram of the samples in 8 bins: all integers."""
    sums, slopes, bins, rows = np.zeros(SAMPLES, np.int64), np.zeros(SAMPLES, np.int64), np.zeros(8, np.int64), 0
    for p in found:
        rows += p.height
        counts = np.bincount(p.pixels.ravel(), minlength=256)
        bins += counts.reshape(8, 32).sum(axis=1)
        sums += p.pixels.reshape(-1, SAMPLES).sum(axis=0, dtype=np.int64)
        slopes += np.abs(np.diff(p.pixels.astype(np.int16), axis=1)).sum(axis=(0, 1), dtype=np.int64)
    return ",".join(map(str, (len(found), rows, *sums.tolist(), *slopes.tolist(), *bins.tolist())))


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_pages int"


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", compression: int = DEFLATE, tile: int = 0) -> DataFrame:
    """Store every text as a TIFF file, read its pages back and return digests of what was read."""
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())]
    )

    def one(key, value):
        n, payload = padded(value)
        media = encode(payload, compression, tile=tile)
        found = list(pages(media))
        back = b"".join(p.pixels.tobytes() for p in found)
        return (key, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(found), len(found))

    def run(batches):
        for batch in batches:
            rows = [one(k, v.as_py()) for k, v in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True)]
            if rows:
                yield _batch(rows, out)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGESTS)
