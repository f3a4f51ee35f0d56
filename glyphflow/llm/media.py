"""TIFF columns: one row per page of every file, read by walking its image directories.

Reads both byte orders, files with 32-bit and with 64-bit offsets, strips and tiles, one or several samples a pixel (interleaved
or in planes) of 1, 2, 4, 8, 16, 32 or 64 bits, signed, unsigned or floating, no compression, PackBits, LZW and deflate, and undoes
horizontal differencing of whole numbers and of floating ones. A picture with a palette is read as its indices. Numbers of tags
and codes are those of the format's specification.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, tidy

#: Field types and their sizes; tags; compression codes. Fixed values of the format.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Kinds of samples by code; their bits.
FORMATS, WIDTHS = {1: "u", 2: "i", 3: "f", 4: "u"}, {"u": (1, 2, 4, 8, 16, 32, 64), "i": (8, 16, 32, 64), "f": (16, 32, 64)}
#: What a cell of a table holds; no page may claim more decoded bytes.
MOST_BYTES = (1 << 31) - 1


class BadTiff(ValueError):
    """The file breaks the format, or uses a part of it that isn't read here."""


def packbits(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out[:most])


def pack_packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at
        while end < len(data) and end - at < 128 and not (end + 2 < len(data) and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a code grows one entry early; 256 clears, 257 ends."""
    plain = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, out, made, last, width, bits, held = list(plain), [], 0, b"", 9, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 256:
            known, last, width = list(plain), b"", 9
            continue
        if code == 257 or made >= most:
            break
        if code < len(known):
            word = known[code]
        elif code == len(known) and last:
            word = last + last[:1]
        else:
            raise BadTiff("an LZW code that isn't known yet")
        out.append(word)
        made += len(word)
        if last and len(known) < 4096:
            known.append(last + word[:1])
        last, width = word, 9 if len(known) < 511 else 10 if len(known) < 1023 else 11 if len(known) < 2047 else 12
    return b"".join(out)[:most]


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width, word = bytearray(), 256, 9, 9, b""
    known = {bytes((i,)): i for i in range(256)}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    while bits >= 8:
        bits -= 8
        out.append(held >> bits & 255)
    held &= (1 << bits) - 1
    size = 258
    for i in range(len(data)):
        if (longer := word + data[i : i + 1]) in known:
            word = longer
            continue
        put(known[word])
        known[longer] = size
        size += 1
        word = data[i : i + 1]
        if size == 4094:
            put(256)
            known, size, width = {bytes((j,)): j for j in range(256)}, 258, 9
        else:
            width = 9 if size < 511 + 1 else 10 if size < 1023 + 1 else 11 if size < 2047 + 1 else 12
    if word:
        put(known[word])
        size += 1
        width = 9 if size < 511 + 1 else 10 if size < 1023 + 1 else 11 if size < 2047 + 1 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpacked(code: int, data: bytes, most: int) -> bytes:
    if code == NONE:
        return data[:most]
    if code in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, most)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from None
    if code == LZW:
        return lzw(data, most)
    if code == PACKBITS:
        return packbits(data, most)
    raise BadTiff(f"compression {code}")


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and tags of each image directory in turn; a directory met again ends the walk."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        order, wide, at = "<" if data[:1] == b"I" else ">", False, 4
    elif data[:8] in (b"II+\0\x08\0\0\0", b"MM\0+\0\x08\0\0"):
        order, wide, at = "<" if data[:1] == b"I" else ">", True, 8
    else:
        raise BadTiff("no TIFF header")
    # Counts of entries, an entry's head, what its value or place takes.
    many, head, place = (order + "Q", order + "HHQ", 8) if wide else (order + "H", order + "HHI", 4)
    link, seen = order + ("Q" if wide else "I"), set()
    first, step = struct.calcsize(many), struct.calcsize(head) + place
    try:
        (at,) = struct.unpack_from(link, data, at)
        while at and at not in seen:
            seen.add(at)
            tags = {}
            (n,) = struct.unpack_from(many, data, at)
            if at + first + n * step > len(data):
                raise BadTiff(f"{n} entries end beyond the file")
            for i in range(n):
                entry = at + first + step * i
                tag, kind, count = struct.unpack_from(head, data, entry)
                if kind not in TYPES:
                    continue
                letter, size = TYPES[kind]
                where = entry + step - place
                if size * count > place:
                    (where,) = struct.unpack_from(link, data, where)
                if where + size * count > len(data):
                    raise BadTiff(f"tag {tag} ends beyond the file")
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}" if len(letter) == 1 else order + letter * count, data, where)
            yield order, tags
            (at,) = struct.unpack_from(link, data, at + first + n * step)
    except struct.error as e:
        raise BadTiff(str(e)) from None


def page(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    """Rows, columns, samples of one image directory; samples of less than 8 bits get a byte each."""
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, length, samples, code = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1), one(COMPRESSION, NONE)
    bits, planar, predictor, letter = set(tags.get(BITS, (1,))), one(PLANAR, 1), one(PREDICTOR, 1), FORMATS.get(one(FORMAT, 1), "")
    if len(bits) != 1 or not bits <= set(WIDTHS.get(letter, ())) or not width or not length or not samples:
        raise BadTiff(f"{width} x {length} x {samples}, bits {sorted(bits)}, format {one(FORMAT, 1)}")
    (bits,) = bits
    if predictor not in (1, 2, 3) or predictor == 2 and (bits < 8 or letter == "f") or predictor == 3 and letter != "f":
        raise BadTiff(f"predictor {predictor} of {bits} bits, format {letter}")
    kind = np.dtype(f"{order}{letter}{max(bits, 8) // 8}")
    if width * length * samples * kind.itemsize > MOST_BYTES:
        raise BadTiff(f"{width} x {length} is larger than is read here")
    tiled = TILE_WIDTH in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, length), length))
    offsets, counts = tags.get(TILE_OFFSETS if tiled else OFFSETS, ()), tags.get(TILE_COUNTS if tiled else COUNTS, ())
    across, down, planes, deep = -(-width // max(1, w)), -(-length // max(1, h)), samples if planar == 2 else 1, 1 if planar == 2 else samples
    if not w or not h or min(len(offsets), len(counts)) < across * down * planes or w * h * deep * kind.itemsize > MOST_BYTES:
        raise BadTiff("too few strips or tiles, or too large ones")
    out = np.zeros((down * h if tiled else length, across * w, samples), kind.newbyteorder("="))
    row_bytes = -(-w * deep * bits // 8)
    for i in range(across * down * planes):
        plane, place = divmod(i, across * down)
        y, x = place // across * h, place % across * w
        rows = h if tiled else min(h, length - y)
        raw = unpacked(code, data[offsets[i] : offsets[i] + counts[i]], rows * row_bytes)
        if len(raw) < rows * row_bytes:
            raise BadTiff(f"strip or tile {i} is short")
        part = samples_of(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes), w, deep, bits, kind, predictor)
        out[y : y + rows, x : x + w, slice(plane, plane + 1) if planar == 2 else slice(None)] = part
    return out[:length, :width]


def samples_of(raw: np.ndarray, w: int, deep: int, bits: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """Rows of bytes as rows x columns x samples, with differences undone."""
    if bits < 8:
        one = np.unpackbits(raw, axis=1)[:, : w * deep * bits].reshape(len(raw), w, deep, bits)
        return (one << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    if predictor == 3:  # bytes differ from those a pixel before; a row has all its first bytes, high ones first, then all second
        whole = np.cumsum(raw.reshape(len(raw), -1, deep), axis=1, dtype=np.uint8).reshape(len(raw), kind.itemsize, w * deep)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(len(raw), w, deep).astype(kind.newbyteorder("="))
    part = np.ascontiguousarray(raw).view(kind).reshape(len(raw), w, deep).astype(kind.newbyteorder("="), copy=False)
    return np.cumsum(part, axis=1, dtype=part.dtype) if predictor == 2 else part


def pages(data: bytes | None) -> list[tuple[int, np.ndarray | None, str | None]]:
    """(number, pixels, error) of each page; a file that can't be walked to its end adds one row with the error."""
    out: list[tuple[int, np.ndarray | None, str | None]] = []
    if data is None:
        return [(0, None, "null")]
    try:
        for order, tags in directories(data):
            try:
                out.append((len(out), page(data, order, tags), None))
            except (BadTiff, struct.error) as e:
                out.append((len(out), None, str(e)))
    except BadTiff as e:
        out.append((len(out), None, str(e)))
    return out


def bytes_of(part: np.ndarray, bits: int, order: str, predictor: int) -> bytes:
    """The reverse of samples_of."""
    rows, w, deep = part.shape
    if bits < 8:
        one = np.unpackbits(part[..., None].astype(np.uint8), axis=3)[..., 8 - bits :].reshape(rows, -1)
        return np.packbits(one, axis=1).tobytes()
    if predictor == 3:
        planes = part.astype(part.dtype.newbyteorder(">")).reshape(rows, w * deep, 1).view(np.uint8).transpose(0, 2, 1).reshape(rows, -1, deep)
        return np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1).tobytes()
    if predictor == 2:
        part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
    return part.astype(part.dtype.newbyteorder(order), copy=False).tobytes()


def encode(images: list[np.ndarray], code: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 1024, order: str = "<", level: int = 1, bits: int | None = None, planar: int = 1, wide: bool = False) -> bytes:
    """A TIFF of rows x columns (x samples) arrays; wide: with 64-bit offsets."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HHHQ", 43, 8, 0, 0) if wide else (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    word, many, head = (order + "Q", order + "Q", order + "HHQ") if wide else (order + "I", order + "H", order + "HHI")
    place, link = struct.calcsize(word), 8 if wide else 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        length, width, samples = image.shape
        size, (h, w) = bits or image.dtype.itemsize * 8, tile or (min(strip_rows, length), width)
        offsets, counts = [], []
        for plane in range(samples) if planar == 2 else [slice(None)]:
            for y in range(0, length, h):
                for x in range(0, width, w):
                    part = image[y : y + h, x : x + w, plane]
                    part = part[:, :, None] if planar == 2 else part
                    if tile and part.shape[:2] != tile:
                        part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                    raw = bytes_of(part, size, order, predictor)
                    packed = raw if code == NONE else zlib.compress(raw, level) if code in (DEFLATE, OLD_DEFLATE) else pack_lzw(raw) if code == LZW else pack_packbits_rows(raw, len(raw) // part.shape[0])
                    offsets.append(len(out))
                    counts.append(len(packed))
                    out += packed
        kind, offset = {"u": 1, "i": 2, "f": 3}[image.dtype.kind], 16 if wide else 4
        tags = {WIDTH: (4, [width]), LENGTH: (4, [length]), BITS: (3, [size] * samples), COMPRESSION: (3, [code]), PHOTOMETRIC: (3, [1 if samples < 3 else 2]), SAMPLES: (3, [samples]), PLANAR: (3, [planar]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (4, [w]), TILE_LENGTH: (4, [h]), TILE_OFFSETS: (offset, offsets), TILE_COUNTS: (4, counts)} if tile else {OFFSETS: (offset, offsets), ROWS_PER_STRIP: (4, [h]), COUNTS: (4, counts)}
        tags |= {} if kind == 1 else {FORMAT: (3, [kind] * samples)}
        entries = []
        for tag, (form, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{TYPES[form][0]}", *values)
            if len(raw) > place:
                out += bytes(len(out) % 2)
                raw, beside = struct.pack(word, len(out)), raw
                out += beside
            entries.append(struct.pack(head, tag, form, len(values)) + raw.ljust(place, b"\0"))
        out += bytes(len(out) % 2)
        struct.pack_into(word, out, link, len(out))
        out += struct.pack(many, len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(place)
    return bytes(out)


def pack_packbits_rows(raw: bytes, width: int) -> bytes:
    """Rows are packed one by one, as the format asks."""
    return b"".join(pack_packbits(raw[at : at + width]) for at in range(0, len(raw), width))


PAGE = "page int, width int, height int, samples int, bits int, format string, pixels binary, error string"


def tiff_pages(files: DataFrame, column: str = "data") -> DataFrame:
    """One row per page: the file's other columns, then page, width, height, samples, bits, format, pixels, error.

    pixels: row by row, samples of a pixel together, low bytes first, in `bits` bits (8 for less); format: uint, int or float.

    Null, empty or broken files: one row with the error and null pixels, after the pages that could be read. The files' own
    columns of those names are dropped.
    """
    names = PAGE.replace(",", "").split()[::2]
    kept = [c for c in files.columns if c != column and c not in names]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in files.select(*kept).schema) + PAGE

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, column, 8_000_000):
                at, rows = [], []
                for i, data in enumerate(batch.column(column).to_pylist()):
                    for n, image, error in pages(data):
                        at.append(i)
                        rows.append((n, *[None] * 6, error) if image is None else (n, image.shape[1], image.shape[0], image.shape[2], image.dtype.itemsize * 8, KINDS[image.dtype.kind], image.tobytes(), None))
                take = pa.array(at, pa.int64())
                types = [pa.int32()] * 5 + [pa.string(), pa.binary(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in kept] + cols, [*kept, *names])

    return files.select(*kept, column).mapInArrow(read, schema)


KINDS = {"u": "uint", "i": "int", "f": "float"}
#: Words of a row of the stored picture; rows to a strip.
ROW, STRIP = 64, 1024


def text_tiff(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and a TIFF of one page that holds them, padded with 0 to rows of 64 samples, by deflate and differences."""
    raw = (text or "").encode()
    padded = raw + bytes(-len(raw) % ROW if raw else ROW)
    return len(raw), encode([np.frombuffer(padded, np.uint8).reshape(-1, ROW)], DEFLATE, 2, strip_rows=STRIP)


def op6_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a TIFF, reads the pages back through the operator and takes digests and features of the pixels."""

    @tidy
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [text_tiff(x) for x in batch.column("text").to_pylist()]
                data = [d for _, d in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array(map(len, data), pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]), pa.array(data, pa.binary())], ["doc_id", "n_bytes", "media_bytes", "media_sha256", "data"])

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part["error"].notna().any():
                raise BadTiff(part["error"].dropna().iloc[0])
            part["payload_bytes"] = part["pixels"].map(len)
            part["payload_sha256"] = part["pixels"].map(lambda x: hashlib.sha256(x).hexdigest())
            part["tail_crc32"] = part["pixels"].map(lambda x: zlib.crc32(x[-64:]))
            part["feature"] = [feature(x, w, h) for x, w, h in zip(part["pixels"], part["width"], part["height"], strict=True)]
            yield part[["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]]

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    key = docs.schema["doc_id"].dataType.simpleString()
    files = docs.mapInArrow(store, f"doc_id {key}, n_bytes long, media_bytes long, media_sha256 string, data binary")
    return tiff_pages(files).mapInPandas(features, f"doc_id {key}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def feature(pixels: bytes, width: int, height: int) -> str:
    """Size, mean and spread of the samples in thousandths, and the number of values that occur."""
    x = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    n, v = int(x.sum()), np.arange(256)
    total, squares = int((x * v).sum()), int((x * v * v).sum())
    return f"{width}x{height} mean {1000 * total // n} var {1000 * (squares * n - total * total) // (n * n)} values {int((x > 0).sum())}"
