"""Motion-JPEG AVI files: bytes in, bytes back, frames and timed clips.

Writing: a payload becomes 8x8 tiles of three components, one byte per quantised coefficient (the unit
of the format that is stored without loss). Byte b stands for the coefficient b, or b - 255 below 128:
both have eight magnitude bits, which are b itself, so with one-symbol Huffman tables and a restart
behind every tile each tile takes 216 bytes before stuffing. Frames of up to 64 tiles are baseline JPEG
files in a RIFF container with an index.

Reading: the RIFF chunks are walked, frames are found by the index (or in `movi` where it lacks) and
decoded: any baseline Huffman tables with a loop over symbols, tables of one symbol in whole arrays. Luma
is transformed back to pixels; a frame starts a shot when its histogram differs from the one before by
more than ADAPT times the mean difference of the last frames plus FLOOR of its pixels.

Defined results: a null text is the empty text, stored as 192 spaces; equal texts give equal values; only
the id and the text are read; files without frames have no clips.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 192
COLUMNS = 8
ROWS = 8
FPS = 25
BINS = 16
WINDOW = 12
ADAPT = 3.0
FLOOR = 0.25
PAYLOAD_LENGTH = b"plen"


def zigzag() -> np.ndarray:
    """Places of an 8x8 block, diagonal by diagonal, in turning directions."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)),
                   key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()
COSINES = np.array([[(0.125 ** 0.5 if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], "float32")


# writing

def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(width: int, height: int) -> bytes:
    one_symbol = bytes([1] + [0] * 15 + [8])
    return (b"\xff\xd8" + segment(0xDB, bytes([0]) + bytes([1] * 64))
            + segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
            + segment(0xC4, bytes([0x00]) + one_symbol + bytes([0x10]) + one_symbol)
            + segment(0xDD, struct.pack(">H", 1)) + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])))


def tile_bits(tiles: np.ndarray) -> np.ndarray:
    """Nine bits per byte, the symbol's code 0 and the byte: tiles of 192 -> rows of 216."""
    bits = np.zeros((tiles.size, 9), "uint8")
    bits[:, 1:] = np.unpackbits(tiles.reshape(-1, 1), axis=1)
    return np.packbits(bits.reshape(len(tiles), -1), axis=1)


def jpeg_frame(head: bytes, rows: np.ndarray) -> bytes:
    scan = [row.tobytes().replace(b"\xff", b"\xff\x00") for row in rows]
    parts = [head, scan[0]]
    for i, part in enumerate(scan[1:]):
        parts += [bytes((0xFF, 0xD0 + i % 8)), part]
    return b"".join([*parts, b"\xff\xd9"])


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of 192 bytes."""
    tiles = np.frombuffer(payload, "uint8").reshape(-1, TILE)
    rows = min(ROWS, -(-len(tiles) // COLUMNS))
    per_frame = rows * COLUMNS
    frames = -(-len(tiles) // per_frame)
    filled = np.full((frames * per_frame, TILE), 32, "uint8")
    filled[:len(tiles)] = tiles
    width, height = COLUMNS * 8, rows * 8
    head, bits = jpeg_head(width, height), tile_bits(filled)
    images = [jpeg_frame(head, bits[i:i + per_frame]) for i in range(0, len(bits), per_frame)]
    largest = max(map(len, images))
    main = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture)))
    movi, index, at = [b"movi"], [], 4
    for image in images:
        movi.append(chunk(b"00dc", image))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(image)))
        at += len(movi[-1])
    body = header + chunk(PAYLOAD_LENGTH, struct.pack("<Q", len(payload))) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", b"AVI " + body)


# reading

def chunks(data: bytes, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name and place of each chunk between begin and end."""
    while begin + 8 <= end:
        size = struct.unpack_from("<I", data, begin + 4)[0]
        yield data[begin:begin + 4], begin + 8, min(begin + 8 + size, end)
        begin += 8 + size + size % 2


@dataclass
class Movie:
    fps: float
    width: int
    height: int
    frames: list[bytes]
    payload_length: int | None


def read_avi(data: bytes) -> Movie:
    """The first video stream of a RIFF AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    movie, movi, index = Movie(0.0, 0, 0, [], None), None, []
    for name, begin, end in chunks(data, 12, len(data)):
        kind = data[begin:begin + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            for sub, b, e in chunks(data, begin + 4, end):
                if sub == b"avih":
                    period, *_, movie.width, movie.height = struct.unpack_from("<10I", data, b)
                    movie.fps = 1_000_000 / period if period else 0.0
        elif kind == b"movi":
            movi = (begin, end)
        elif kind == b"idx1":
            index = [struct.unpack_from("<4sIII", data, i) for i in range(begin, end - 15, 16)]
        elif kind == PAYLOAD_LENGTH:
            movie.payload_length = struct.unpack_from("<Q", data, begin)[0]
    if movi is None:
        return movie
    places = []
    for name, _, at, size in index:
        base = movi[0] if data[movi[0] + at:movi[0] + at + 4] == name else 0  # offsets count from movi or from the file's start
        if name[2:] in (b"dc", b"db"):
            places.append((base + at + 8, base + at + 8 + size))
    if not index:
        places = [(b, e) for name, b, e in chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    movie.frames = [data[b:e] for b, e in places]
    return movie


@dataclass
class Image:
    width: int
    height: int
    #: Quantised coefficients in zigzag order of each component, block by block in scan order.
    components: list[np.ndarray]
    quantisers: list[np.ndarray]
    sampling: list[tuple[int, int]]


def huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


class Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan ends early")
        return (self.value >> self.left) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        value = self.take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def read_jpeg(data: bytes) -> Image:
    """A baseline JPEG image as quantised coefficients."""
    at, tables, quant, restart, image, parts = 2, {}, {}, 0, None, []
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1:1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype("int32")
                body = body[1 + 64 * (1 + wide):]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17:17 + n])
                body = body[17 + n:]
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            image = Image(width, height, [], [quant[q] for *_, q in parts], [(h, v) for _, h, v, _ in parts])
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images")
    end = data.rindex(b"\xff\xd9")
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data[at:end])]
    most_h, most_v = max(h for h, _ in image.sampling), max(v for _, v in image.sampling)
    tiles = -(-image.width // (8 * most_h)) * -(-image.height // (8 * most_v))
    plan = [(k, use[name] >> 4, 0x10 | use[name] & 15) for k, (name, h, v, _) in enumerate(parts) for _ in range(h * v)]
    image.components = fixed_scan(pieces, tables, plan, tiles, restart) or coded_scan(pieces, tables, plan, tiles, restart, len(parts))
    return image


def fixed_scan(pieces, tables, plan, tiles, restart):
    """All coefficients at once where every table has the one symbol `eight bits follow`; None elsewhere."""
    if restart != 1 or [k for k, *_ in plan] != list(range(len(plan))) or len(pieces) != tiles or any(
            tables[t] != (bytes([1] + [0] * 15), b"\x08") for _, dc, ac in plan for t in (dc, ac)):
        return None
    length = len(plan) * 72
    if any(len(p) != length for p in pieces):
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(pieces), "uint8")).reshape(-1, 9)
    units = np.packbits(bits[:, 1:], axis=1).reshape(tiles, len(plan), 64).astype("int32")
    units -= 255 * (units < 128)
    return [np.ascontiguousarray(units[:, k]) for k in range(len(plan))]


def coded_scan(pieces, tables, plan, tiles, restart, n_components):
    """Coefficients by reading one symbol after the other."""
    codes = {t: huffman(*tables[t]) for t in tables}
    found: list[list[np.ndarray]] = [[] for _ in range(n_components)]
    per_piece = restart or tiles
    for i, piece in enumerate(pieces):
        bits, last = Bits(piece), [0] * n_components
        for _ in range(min(per_piece, tiles - i * per_piece)):
            for k, dc, ac in plan:
                block = np.zeros(64, "int32")
                last[k] += bits.signed(bits.symbol(codes[dc]))
                block[0], j = last[k], 1
                while j < 64:
                    symbol = bits.symbol(codes[ac])
                    if symbol == 0:
                        break
                    j += symbol >> 4
                    if symbol & 15:
                        block[j] = bits.signed(symbol & 15)
                    j += 1
                found[k].append(block)
    return [np.array(x, "int32").reshape(-1, 64) for x in found]


def pixels(blocks: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """Blocks of coefficients -> blocks of 64 samples from 0 to 255."""
    square = np.zeros((len(blocks), 64), "float32")
    square[:, ZIGZAG] = blocks * quantiser
    half = square.reshape(-1, 8) @ COSINES
    full = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ COSINES
    return np.clip(np.rint(full + 128), 0, 255).astype("uint8").reshape(-1, 64)


def histograms(images: list[Image]) -> np.ndarray:
    """Luma pixels of each image in BINS bins."""
    return np.array([np.bincount(pixels(i.components[0], i.quantisers[0]).ravel() >> 4, minlength=BINS) for i in images]).reshape(-1, BINS)


def cuts(found: np.ndarray) -> list[int]:
    """Frames at which a shot begins."""
    if not len(found):
        return []
    steps = np.abs(np.diff(found, axis=0)).sum(axis=1) / 2
    starts = [0]
    for i, step in enumerate(steps):
        recent = steps[max(starts[-1], i - WINDOW):i]
        if step > (ADAPT * recent.mean() if len(recent) else 0) + FLOOR * found[i].sum():
            starts.append(i + 1)
    return starts


def clips(movie: Movie, images: list[Image]) -> list[tuple[int, int, int, int, int]]:
    """clip number, first and last frame, begin and end in milliseconds."""
    starts = cuts(histograms(images))
    ms = lambda frame: round(1000 * frame / movie.fps) if movie.fps else 0
    return [(k, a, b - 1, ms(a), ms(b)) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(images)]))]


def payload_of(movie: Movie, images: list[Image]) -> bytes:
    """The bytes that write_avi stored."""
    units = [np.stack(i.components, axis=1) for i in images]
    flat = np.concatenate([u.reshape(-1) for u in units])
    return np.where(flat < 0, flat + 255, flat).astype("uint8").tobytes()[:movie.payload_length]


# on Spark

def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "replace")
    return len(data), data.ljust(max(1, -(-len(data) // TILE)) * TILE)


def stored_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for begin in range(0, len(batch), 512):
            part = batch.iloc[begin:begin + 512]
            made = [(n, write_avi(data)) for n, data in map(padded, part["text"])]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})


def store(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: the padded text as an AVI file."""
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        stored_rows, f"doc_id {kind}, n_bytes long, media binary")


def clip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, media in zip(batch["doc_id"], batch["media"]):
            movie = read_avi(media)
            rows += [(key, *clip) for clip in clips(movie, [read_jpeg(f) for f in movie.frames])]
        yield pd.DataFrame(rows, columns=["doc_id", "clip", "first_frame", "last_frame", "begin_ms", "end_ms"]).astype(
            {"doc_id": batch["doc_id"].dtype})


def clip_table(media: DataFrame) -> DataFrame:
    """One row per clip of each file: doc_id, clip, first_frame, last_frame, begin_ms, end_ms."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInPandas(
        clip_rows, f"doc_id {kind}, clip int, first_frame int, last_frame int, begin_ms long, end_ms long")


def figure_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sha = lambda data: hashlib.sha256(data).hexdigest()
    for batch in batches:
        rows = []
        for media in batch["media"]:
            movie = read_avi(media)
            images = [read_jpeg(f) for f in movie.frames]
            payload = payload_of(movie, images)
            shots = ",".join(f"{b}-{e}" for *_, b, e in clips(movie, images))
            rows.append((len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media),
                         f"{len(images)}x{movie.width}x{movie.height};clips={shots}"))
        found = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        found.insert(0, "n_bytes", batch["n_bytes"].to_numpy())
        found.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield found


def figures(media: DataFrame) -> DataFrame:
    """One row per file with what is read back from its bytes."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInPandas(figure_rows, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
                                          "media_bytes long, media_sha256 string, feature string")
