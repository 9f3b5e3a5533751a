"""TIFF media columns: walk image directories, decode strips and tiles, one row per page.

``decode_pages`` reads classic and big files of either byte order, chunky or
planar samples of 1 to 64 bits, strips or tiles, stored plainly or by
PackBits, LZW or deflate, with horizontal (2) or floating-point (3)
differencing.  ``encode_pages`` writes grey 8-bit pages for tests and for
payload storage, and ``store_texts`` picks compression, predictor and strips
or tiles by a hash of the text, so that stored texts go through every decoder.

Memory: a strip or tile is inflated to what it has to hold and no more, and
pages are handed on by their decoded size, so neither a file that inflates a
hundredfold nor one of many pages is ever held as a whole; a single page is.

Defined cases: a null or empty medium has no page; a broken one gives the
pages before the fault and then one row with ``error`` set and no pixels; a
directory that points back at an earlier one ends the walk; a null id stays
null; repeated rows give repeated results, and equal texts equal media; a null
text is stored like an empty one, a very long one as several pages; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.llm.common import pieces

PAGES = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, description string, pixels binary, media_bytes long, media_sha256 string, error string"
# fixed values: tags and field sizes of the format
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_AT, TILE_SIZE, FORMAT = 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Decoded bytes that wait to be handed on.
DECODED = 4 << 20


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """One step a run.  ``most``: bytes that are wanted."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        else:
            if c > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - c)
            i += 1 if c == 128 else 2
    return bytes(out)


RUN = re.compile(rb"(.)\1{2,127}", re.S)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more, and what lies between them as it is; one step a run."""
    out, at = bytearray(), 0

    def plain(low: int, high: int) -> None:
        for k in range(low, high, 128):
            part = data[k : min(high, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(data):
        plain(at, m.start())
        out.append(257 - len(m[0]))
        out.extend(m[1])
        at = m.end()
    plain(at, len(data))
    return bytes(out)


def lzw_widths() -> np.ndarray:
    """Bits of the codes that follow a clear code, one after the other; the width grows one code early."""
    table = 257 + np.arange(3839)  # entries when a code is read: the first one after a clear adds none
    table[0] = 258
    return np.where(table >= 2047, 12, np.where(table >= 1023, 11, np.where(table >= 511, 10, 9)))


WIDTHS = lzw_widths()
ENDS = np.cumsum(WIDTHS)
#: A full table keeps twelve bits a code.
FULL = 12 * np.arange(1, 4097)


def lzw_codes(data: bytes) -> Iterator[tuple[bool, np.ndarray]]:
    """(whether a clear code goes before them, codes), some thousand at a time, up to the end code or the end of the data."""
    at, fresh = 9, True
    while True:
        ends = ENDS if fresh else FULL
        first = at >> 3
        bits = np.unpackbits(np.frombuffer(data[first : (at + int(ends[-1]) + 7) >> 3], np.uint8))[at & 7 :]
        n = int(np.searchsorted(ends, len(bits), "right"))
        place = ends[:n, None] - 12 + np.arange(12)  # the last twelve bits up to a code's end
        width = WIDTHS[:n, None] if fresh else 12
        codes = (bits[np.maximum(place, 0)] & (np.arange(12) >= 12 - width)) @ (1 << np.arange(12)[::-1])
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        k = int(stop[0]) if len(stop) else n
        if k or fresh:
            yield fresh, codes[:k]
        if not len(stop):
            if n < len(ends):
                return
            at, fresh = at + int(ends[-1]), False
        elif codes[k] == 257:
            return
        else:
            at, fresh = at + int(ends[k]), True


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, high bit first, taken apart by numpy; one step a code, which stands for several bytes.  ``most``: bytes that are wanted."""
    if len(data) < 2:
        return b""
    if data[0] != 128 or data[1] & 128:
        raise ValueError("LZW data does not start with a clear code")
    out, size, table, previous = [], 0, [], b""
    for fresh, codes in lzw_codes(data):
        if fresh:
            table, previous = [*SINGLE, b"", b""], b""
        for code in codes.tolist():
            if code < len(table):
                entry = table[code]
                if previous and len(table) < 4096:
                    table.append(previous + entry[:1])
            elif code == len(table) and previous:
                entry = previous + previous[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            previous = entry
            size += len(entry)
            if most is not None and size >= most:
                return b"".join(out)
    return b"".join(out)


SINGLE = [bytes([i]) for i in range(256)]


def lzw_encode(data: bytes) -> bytes:
    """Codes by a table of (code, byte); their bits are put together by numpy."""
    codes, cuts, table, nxt, code = [256], [], {}, 258, -1
    get = table.get
    for c in data:
        if code < 0:
            code = c
            continue
        key = code << 8 | c
        longer = get(key)
        if longer is not None:
            code = longer
            continue
        codes.append(code)
        table[key] = nxt
        nxt += 1
        code = c
        if nxt == 4094:
            cuts.append(len(codes))
            codes.append(256)
            table.clear()
            nxt = 258
    if code >= 0:
        codes.append(code)
    codes.append(257)
    values = np.array(codes)
    width = np.empty(len(values), np.int64)
    width[0] = 9
    for a, b in zip([0, *cuts], [*cuts, len(values) - 1]):
        width[a + 1 : b + 1] = WIDTHS[: b - a]
    bits = ((values[:, None] >> np.arange(12)[::-1]) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]]).tobytes()


def inflate(data: bytes, kind: int, most: int) -> bytes:
    """At most about ``most`` bytes of a strip or tile: what it has to hold."""
    if kind == PLAIN:
        return data
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if kind == LZW:
        return lzw_decode(data, most)
    if kind == PACKBITS:
        return unpack_bits(data, most)
    raise ValueError(f"compression {kind} is not supported")


def undo(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """Undo differencing of a block of rows x columns x samples."""
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        raw = block.reshape(rows, columns * samples).view(np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        planes = planes[:, ::-1] if order == "<" else planes
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(block.dtype).reshape(block.shape)
    raise ValueError(f"predictor {predictor} is not supported")


def directories(media: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    if media[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF: no byte order")
    order = "<" if media[:2] == b"II" else ">"
    magic = struct.unpack_from(order + "H", media, 2)[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF: wrong magic number")
    big = magic == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), media, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        count = struct.unpack_from(order + ("Q" if big else "H"), media, at)[0]
        entry, start = (20, at + 8) if big else (12, at + 2)
        tags = {}
        for i in range(count):
            place = start + i * entry
            tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), media, place)
            if kind not in FIELD:
                continue
            shape, place = FIELD[kind], place + (12 if big else 8)
            size = struct.calcsize("=" + shape) * n
            if size > (8 if big else 4):
                place = struct.unpack_from(order + ("Q" if big else "I"), media, place)[0]
            if place + size > len(media):
                raise ValueError(f"tag {tag} lies outside the file")
            tags[tag] = (media[place : place + n].rstrip(b"\0").decode("utf-8", "replace"),) if kind == 2 else struct.unpack_from(f"{order}{n * len(shape)}{shape[0]}", media, place)
        yield order, tags
        at = struct.unpack_from(order + ("Q" if big else "I"), media, start + count * entry)[0]


def image(media: bytes, order: str, tags: dict) -> tuple[dict, bytes]:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    if not width or not height:
        raise ValueError("a page without width or length")
    bits, kind, predictor = one(BITS, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    planar, tiled = one(PLANAR, 1) == 2, TILE_AT in tags
    if tiled:
        w, h, at, sizes = one(TILE_WIDTH), one(TILE_LENGTH), tags[TILE_AT], tags[TILE_SIZE]
    else:
        w, h, at = width, min(one(ROWS, height), height), tags[STRIP_AT]
        sizes = tags.get(STRIP_SIZE) or (len(media) - at[0],)
    if bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"{bits} bits a sample are not supported")
    kept = f"{order}{'f' if one(FORMAT, 1) == 3 else 'u'}{bits // 8}" if bits >= 8 else "u1"
    own = 1 if planar else samples
    across, down = -(-width // w), -(-height // h)
    if len(at) < across * down * (samples if planar else 1) or len(sizes) < len(at):
        raise ValueError("strips or tiles are missing")
    out = np.zeros((samples if planar else 1, height, width, own), kept)
    for i, (place, size) in enumerate(zip(at, sizes)):
        plane, rest = divmod(i, across * down)
        if plane >= len(out):
            break
        row, column = divmod(rest, across)
        rows = h if tiled else min(h, height - row * h)
        line = -(-w * own * bits // 8)
        data = inflate(media[place : place + size], kind, line * rows)
        if bits < 8:
            raw = np.frombuffer(data, np.uint8, line * rows).reshape(rows, line)
            each = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
            block = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : w * own].reshape(rows, w, own)
        else:
            block = np.frombuffer(data, kept, rows * w * own).reshape(rows, w, own)
        block = undo(block, predictor, order)
        top, left = row * h, column * w
        out[plane, top : top + rows, left : left + w] = block[: height - top, : width - left]
    pixels = (out.transpose(1, 2, 0, 3) if planar else out[0]).astype(np.dtype(kept).newbyteorder("<"), copy=False)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": kind, "predictor": predictor, "tiled": tiled, "description": one(DESCRIPTION)}, np.ascontiguousarray(pixels).tobytes()


def decode_pages(media: bytes | None) -> Iterator[dict]:
    """A dict of page facts and little-endian pixels for each directory; a fault ends with a dict that has ``error``."""
    if not media:
        return
    page = 0
    try:
        for order, tags in directories(media):
            facts, pixels = image(media, order, tags)
            yield facts | {"page": page, "pixels": pixels, "error": None}
            page += 1
    except (ValueError, struct.error, zlib.error, KeyError, TypeError, IndexError, UnicodeDecodeError) as e:
        yield {"page": page, "error": str(e) or type(e).__name__}


def encode_pages(payload: bytes, width: int = 64, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, rows_per_strip: int = 1024, page_rows: int = 65_536, description: str | None = None) -> bytes:
    """Grey 8-bit pages of ``width`` samples a row; the payload's length is a multiple of ``width``.  ``tile``: edge of square tiles, 0 for strips."""
    squeeze = {PLAIN: bytes, DEFLATE: lambda b: zlib.compress(b, 1), LZW: lzw_encode, PACKBITS: pack_bits}[compression]
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    note = (description or "").encode() + b"\0"
    for top in range(0, len(pixels), page_rows):
        page = pixels[top : top + page_rows]
        blocks = []
        if tile:
            padded = np.zeros((-(-len(page) // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[: len(page), :width] = page
            blocks = [padded[r : r + tile, c : c + tile] for r in range(0, len(padded), tile) for c in range(0, padded.shape[1], tile)]
        else:
            blocks = [page[r : r + rows_per_strip] for r in range(0, len(page), rows_per_strip)]
        at, sizes = [], []
        for block in blocks:
            data = squeeze((np.diff(block, axis=1, prepend=np.uint8(0)) if predictor == 2 else block).astype(np.uint8).tobytes())
            at.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        fields = [(WIDTH, 4, [width]), (LENGTH, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (DESCRIPTION, 2, note), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_AT, 4, at), (TILE_SIZE, 4, sizes)] if tile else [(STRIP_AT, 4, at), (ROWS, 4, [rows_per_strip]), (STRIP_SIZE, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = values if kind == 2 else struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                place, out = len(out), out + data + b"\0" * (len(data) % 2)
                data = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


def read_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of the files in ``column``, in file order; a map stage without a shuffle."""
    arrow = to_arrow_schema(StructType.fromDDL(PAGES))

    def run(batches):
        rows, held = [], 0
        for piece in pieces(batches, column):
            for key, data in zip(piece.column(0), piece.column(1)):  # file by file: a piece is not decoded as a whole
                key, data = key.as_py(), data.as_py() or b""
                facts = {"doc_id": key, "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                for page in decode_pages(data):
                    rows.append(facts | page)
                    held += len(page.get("pixels") or b"")
                    if held > DECODED or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return media.select("doc_id", column).mapInArrow(run, PAGES)


def form_of(raw: bytes) -> dict:
    """How a text is stored: by a hash of its bytes, so that equal texts are stored equally."""
    h = zlib.crc32(raw)
    return {"compression": (DEFLATE, LZW, PACKBITS, PLAIN)[h % 4], "predictor": 1 + h // 4 % 2, "tile": (0, 32)[h // 8 % 2]}


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes, padded by zeros to a positive multiple of 64, as pages 64 samples wide."""

    def run(batches):
        for piece in pieces(batches, "text"):
            media = []
            for text in piece.column(1).to_pylist():
                raw = (text or "").encode()
                media.append(encode_pages(raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), description=f"n_bytes={len(raw)}", **form_of(raw)))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest_pages(pages: DataFrame) -> DataFrame:
    """One row per medium from its pages, which lie in order behind each other; hashes are updated page by page."""
    arrow = to_arrow_schema(StructType.fromDDL(DIGEST))

    def run(batches):
        held = None

        def close():
            total = max(1, held["payload_bytes"])
            return {k: held[k] for k in ("doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256")} | {"payload_sha256": held["hash"].hexdigest(), "tail_crc32": zlib.crc32(held["tail"]), "feature": f"compression={held['form'][0]};predictor={held['form'][1]};tiled={int(held['form'][2])};pages={held['pages']};width={held['width']};height={held['height']};mean={held['sum'] / total:.6f};distinct={int((held['seen'] > 0).sum())}"}

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["error"]:
                    raise ValueError(f"a medium that was just stored can't be read: {row['error']}")
                if row["page"] == 0:
                    if held:
                        rows.append(close())
                    held = {"doc_id": row["doc_id"], "n_bytes": int(row["description"].removeprefix("n_bytes=")), "payload_bytes": 0, "hash": hashlib.sha256(), "tail": b"", "pages": 0, "height": 0, "width": row["width"], "form": (row["compression"], row["predictor"], row["tiled"]), "sum": 0, "seen": np.zeros(256, np.int64), "media_bytes": row["media_bytes"], "media_sha256": row["media_sha256"]}
                pixels = row["pixels"]
                held["hash"].update(pixels)
                counts = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                held["seen"] += counts
                held["sum"] += int(counts @ np.arange(256))
                held["tail"], held["pages"] = pixels[-64:], held["pages"] + 1
                held["payload_bytes"] += len(pixels)
                held["height"] += row["height"]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([close()], schema=arrow)

    return pages.mapInArrow(run, DIGEST)
