"""Media columns: AVI files of motion JPEG.

A payload's bytes become 8-bit grey samples, each sample one block of 8 x 8 pixels. A block has a
DC coefficient alone, quantised by 8, so any baseline decoder gives back its value in all 64
pixels: the JPEG is lossless for such pictures. Code lengths are chosen so that a sample takes
16 bits whatever its value and no byte is 0xFF, which lets whole files be packed and unpacked as
arrays. A frame holds 64 samples, 8 x 8 blocks.

Reading goes the other way: RIFF chunks and the index are parsed, and intra frames decoded by the
tables that stand in them, whatever wrote them: baseline JPEG with one or more components, any
Huffman and quantisation tables, restart intervals. Frames with equal tables are decoded together,
block by block over all of them at once. Shots are found where the histogram difference of two
frames stands out from those before it; they work on the pictures at an eighth of their size, one
sample for each block, which is what its DC coefficient says.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlake.llm.common import materialise, text_of

SIDE = 8
SAMPLES = SIDE * SIDE
FRAMES_PER_SECOND = 25
#: Frames whose differences a new one is compared with, and by how many deviations it must stand out.
MEMORY = 12
DEVIATIONS = 2.5
LEAST_DIFFERENCE = 0.5

#: Category s of a difference (s bits follow) has a code of 10 - s bits, so code and bits are always 10.
_BITS = 10
_END_BITS = 16 - _BITS  # the end-of-block code fills up the 16 bits
_CATEGORIES = 9


def _dc_codes() -> list[int]:
    """Canonical Huffman codes of the categories 0 to 8, the shortest for 8."""
    codes, code, length = [0] * _CATEGORIES, 0, _BITS - (_CATEGORIES - 1)
    for s in range(_CATEGORIES - 1, -1, -1):
        code <<= (_BITS - s) - length
        length = _BITS - s
        codes[s] = code
        code += 1
    return codes


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def _lengths(table: dict[int, int]) -> bytes:
    """BITS and HUFFVAL of a Huffman table given as value -> code length."""
    order = sorted(table, key=lambda v: (table[v], v))
    return bytes(sum(n == k for n in table.values()) for k in range(1, 17)) + bytes(order)


def jpeg_head() -> bytes:
    pixels = SIDE * 8
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
        + _segment(0xC0, struct.pack(">BHHB3B", 8, pixels, pixels, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\0" + _lengths({s: _BITS - s for s in range(_CATEGORIES)}))
        + _segment(0xC4, b"\x10" + _lengths({0: _END_BITS}))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


HEAD = jpeg_head()
TAIL = b"\xff\xd9"
FRAME_BYTES = len(HEAD) + 2 * SAMPLES + len(TAIL)


def _words_by_difference() -> np.ndarray:
    """The 16 bits of a sample by its difference from the one before, plus 255."""
    codes = _dc_codes()
    out = []
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d > 0 else d + (1 << s) - 1
        out.append(((codes[s] << s) | extra) << _END_BITS)
    return np.array(out, ">u2")


_WORDS = _words_by_difference()


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 bytes of a text, filled with zeros up to a positive multiple of 64, and their number before."""
    data = text.encode()
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"), len(data)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _list(kind: bytes, data: bytes) -> bytes:
    return _chunk(b"LIST", kind + data)


def write_avi(payload: bytes) -> bytes:
    """An AVI file with one frame for each 64 bytes of the payload."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, SAMPLES).astype(np.int16)
    n = len(samples)
    before = np.concatenate([np.full((n, 1), 128, np.int16), samples[:, :-1]], axis=1)
    scans = _WORDS[samples - before + 255].view(np.uint8)
    size = FRAME_BYTES + FRAME_BYTES % 2
    frames = np.zeros((n, 8 + size), np.uint8)
    frames[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", FRAME_BYTES), np.uint8)
    frames[:, 8 : 8 + len(HEAD)] = np.frombuffer(HEAD, np.uint8)
    frames[:, 8 + len(HEAD) : 8 + len(HEAD) + 2 * SAMPLES] = scans
    frames[:, 8 + FRAME_BYTES - 2 : 8 + FRAME_BYTES] = np.frombuffer(TAIL, np.uint8)
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # a key frame
    index[:, 2] = 4 + np.arange(n) * (8 + size)
    index[:, 3] = FRAME_BYTES
    pixels = SIDE * 8
    head = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, 0, 0, 0x10, n, 0, 1, FRAME_BYTES, pixels, pixels, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FRAMES_PER_SECOND, 0, n, FRAME_BYTES, 0xFFFFFFFF, 0, 0, 0, pixels, pixels)
    picture = struct.pack("<IiiHH4sIiiII", 40, pixels, pixels, 1, 24, b"MJPG", pixels * pixels * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", head) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", picture)))
    body = b"AVI " + header + _list(b"movi", frames.tobytes()) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """RIFF chunks between two places: name, start and end of the contents."""
    while start + 8 <= end:
        name, size = data[start : start + 4], int.from_bytes(data[start + 4 : start + 8], "little")
        if start + 8 + size > end:
            raise ValueError("chunk runs beyond its list")
        yield name, start + 8, start + 8 + size
        start += 8 + size + size % 2


def read_index(data: bytes) -> tuple[np.ndarray, float]:
    """(start, size) of each video frame from the index of an AVI file, and frames a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, entries = float(FRAMES_PER_SECOND), None, None
    for name, a, b in chunks(data, 12, 8 + int.from_bytes(data[4:8], "little")):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = a
        elif name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in chunks(data, a + 4, b):
                if inner == b"avih":
                    rate = 1e6 / max(1, int.from_bytes(data[c : c + 4], "little"))
        elif name == b"idx1":
            entries = np.frombuffer(data, "<u4", (b - a) // 16 * 4, a).reshape(-1, 4)
    if movi is None or entries is None:
        raise ValueError("no frames or no index")
    video = entries[(entries[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
    return np.stack([video[:, 2].astype(np.int64) + movi + 8, video[:, 3].astype(np.int64)], axis=1), rate


@dataclass(frozen=True)
class Component:
    across: int
    down: int
    quant: np.ndarray
    dc: np.ndarray
    ac: np.ndarray


@dataclass(frozen=True)
class Tables:
    """What a frame says of itself before its scan."""

    width: int
    height: int
    restart: int
    parts: tuple[Component, ...]


#: Fixed value: the order in which a block's 64 coefficients are stored, as places in rows of 8.
ZIGZAG = np.array([8 * y + x for _, _, y, x in sorted((y + x, y if (y + x) % 2 else x, y, x) for y in range(8) for x in range(8))])


def _lookup(lengths: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits the code that they begin with: its value, and its length times 256; 0 where there is none."""
    out = np.zeros(1 << 16, np.int32)
    code = at = 0
    for length in range(1, 17):
        for value in values[at : at + lengths[length - 1]]:
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = value | length << 8
            code += 1
        at += lengths[length - 1]
        code <<= 1
    return out


@lru_cache(256)
def read_tables(head: bytes) -> Tables:
    """Tables of a frame from its bytes before the scan; what isn't a baseline frame is refused."""
    try:
        return _tables(head)
    except (IndexError, KeyError) as e:
        raise ValueError("a frame without its tables, or with broken ones") from e


def _tables(head: bytes) -> Tables:
    at, quant, huffman, restart, size, order = 2, {}, {}, 0, None, None
    while at + 4 <= len(head):
        marker, data = head[at + 1], head[at + 4 : at + 2 + int.from_bytes(head[at + 2 : at + 4], "big")]
        at += 4 + len(data)
        if marker == 0xDB:
            while data:
                wide = data[0] >> 4
                values = np.frombuffer(data, ">u2" if wide else "u1", 64, 1)
                quant[data[0] & 15] = values.astype(np.float64)
                data = data[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while data:
                n = sum(data[1:17])
                huffman[data[0]] = _lookup(data[1:17], data[17 : 17 + n])
                data = data[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(data[:2], "big")
        elif marker in (0xC0, 0xC1):
            if data[0] != 8:
                raise ValueError("samples of more than 8 bits")
            size = int.from_bytes(data[1:3], "big"), int.from_bytes(data[3:5], "big")
            order = {data[k]: (data[k + 1] >> 4, data[k + 1] & 15, data[k + 2]) for k in range(6, 6 + 3 * data[5], 3)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if order is None or data[0] != len(order):
                raise ValueError("a scan that doesn't hold all components")
            parts = tuple(Component(*order[data[k]][:2], quant[order[data[k]][2]], huffman[data[k + 1] >> 4], huffman[16 | data[k + 1] & 15]) for k in range(1, 1 + 2 * data[0], 2))
            return Tables(size[1], size[0], restart, parts)
    raise ValueError("a frame without a scan")


def _scan_start(frame: bytes) -> int:
    """Where the scan begins: after the segments up to the start of scan."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        marker = frame[at + 1]
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return at
    raise ValueError("a frame without a scan")


class _Bits:
    """Bits of many scans at once, a row each, with a place in every one."""

    def __init__(self, scans: np.ndarray):
        self.flat, self.width = np.pad(scans, ((0, 0), (0, 4))).ravel(), scans.shape[1] + 4
        self.base = np.arange(len(scans)) * self.width
        self.last = 8 * (self.width - 4)
        self.place = np.zeros(len(scans), np.int64)

    def peek(self, rows: slice | np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        place = self.place[rows]
        at = self.base[rows] + np.minimum(place, self.last) // 8
        word = self.flat[at].astype(np.int64) << 16 | self.flat[at + 1].astype(np.int64) << 8 | self.flat[at + 2]
        return word >> (8 - place % 8) & 0xFFFF

    def code(self, table: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        found = table[self.peek(rows)]
        if not found.all():
            raise ValueError("a code that isn't in the table")
        self.place[rows] += found >> 8
        return found & 255

    def number(self, bits: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        """Signed numbers of so many bits."""
        value = self.peek(rows) >> (16 - bits)
        self.place[rows] += bits
        return np.where(value < (1 << bits >> 1), value - (1 << bits) + 1, value)


def decode_scans(scans: np.ndarray, tables: Tables, whole: bool = False) -> np.ndarray:
    """The first component of many frames with equal tables: a row of block means for each, or with ``whole`` their pixels.

    ``scans`` holds a row of bytes for each frame, without stuffing and markers.
    """
    n, everything = len(scans), slice(None)
    bits = _Bits(scans)
    many = len(tables.parts) > 1
    most = max(p.across for p in tables.parts), max(p.down for p in tables.parts)
    mcu = (8 * most[0], 8 * most[1]) if many else (8, 8)
    columns, rows = -(-tables.width // mcu[0]), -(-tables.height // mcu[1])
    main = tables.parts[0]
    across, down = (main.across, main.down) if many else (1, 1)
    means = np.empty((n, rows * down, columns * across))
    blocks = np.zeros((n, rows * down, columns * across, 64)) if whole else None
    last = np.zeros((len(tables.parts), n), np.int64)
    for unit in range(rows * columns):
        if tables.restart and unit and unit % tables.restart == 0:
            bits.place = (bits.place + 7) // 8 * 8
            last[:] = 0
        for c, part in enumerate(tables.parts):
            for k in range(part.across * part.down if many else 1):
                last[c] += bits.number(bits.code(part.dc, everything), everything)
                y, x = unit // columns * down + k // across, unit % columns * across + k % across
                if c == 0:
                    means[:, y, x] = last[0] * main.quant[0] / 8 + 128
                    if whole:
                        blocks[:, y, x, 0] = last[0] * main.quant[0]
                at, active = np.zeros(n, np.int64), np.arange(n)
                while len(active):
                    symbol = bits.code(part.ac, active)
                    run, size = symbol >> 4, symbol & 15
                    goes_on = (size > 0) | (run == 15)
                    active, run, size = active[goes_on], run[goes_on], size[goes_on]
                    at[active] += run + 1
                    if (at[active] > 63).any():
                        raise ValueError("more coefficients than a block has")
                    value = bits.number(size, active)
                    if whole and c == 0:
                        blocks[active, y, x, ZIGZAG[at[active]]] = value * main.quant[at[active]]
                    active = active[at[active] < 63]
    if (bits.place > bits.last).any():
        raise ValueError("a scan that ends too early")
    if not whole:
        return np.clip(np.rint(means), 0, 255).astype(np.uint8).reshape(n, -1)
    cosine = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    pixels = cosine.T @ blocks.reshape(*blocks.shape[:3], 8, 8) @ cosine + 128
    picture = pixels.transpose(0, 1, 3, 2, 4).reshape(n, 8 * rows * down, 8 * columns * across)
    return np.clip(np.rint(picture), 0, 255).astype(np.uint8)


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")
#: Frames that are decoded together.
TOGETHER = 4096


def decode_frames(data: bytes, places: np.ndarray, whole: bool = False) -> np.ndarray:
    """Samples of the intra frames of one file: a row of block means for each frame, or with ``whole`` its pixels."""
    runs = decode_runs(data, places, whole)
    return np.concatenate(runs) if runs else np.empty((0, SAMPLES), np.uint8)


def decode_runs(data: bytes, places: np.ndarray, whole: bool = False) -> list[np.ndarray]:
    """The frames at the given places in order, those of one array with equal bytes before their scans, so equal tables."""
    out: list[np.ndarray] = []
    everything = np.frombuffer(data, np.uint8)
    at = 0
    while at < len(places):
        start, size = places[at].tolist()
        offset = _scan_start(data[start : start + size])
        head = data[start : start + offset]
        tables = read_tables(head)
        group = places[at : at + TOGETHER]
        same = (group[:, 0] + offset <= len(data)) & (group[:, 1] >= offset)
        heads = everything[np.minimum(group[:, :1], max(0, len(data) - offset)) + np.arange(offset)]
        same &= (heads == np.frombuffer(head, np.uint8)).all(axis=1)
        n = len(group) if same.all() else int(same.argmin())
        group = group[:n]
        width = size - offset
        plain = None
        if (group[:, 1] == size).all() and int(group[-1, 0]) + size <= len(data):
            plain = everything[group[:, :1] + np.arange(offset, size)]
            if (plain[:, :-2] == 0xFF).any() or width < 2:
                plain = None
        if plain is None:  # stuffed bytes and restart markers are taken out
            scans = [data[a + offset : a + b].removesuffix(TAIL) for a, b in group.tolist()]
            scans = [_RESTART.sub(b"", s).replace(b"\xff\0", b"\xff") for s in scans]
            width = max(map(len, scans))
            plain = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in scans), np.uint8).reshape(n, width)
        out.append(decode_scans(plain, tables, whole))
        at += n
    return out


def histogram_differences(frames: np.ndarray) -> np.ndarray:
    """L1 distance of the 16-bin histograms of each frame and the one before, from 0 to 1."""
    n, samples = frames.shape
    flat = (np.arange(n)[:, None] * 16 + (frames >> 4)).ravel()
    histograms = np.bincount(flat, minlength=16 * n).reshape(n, 16)
    return np.abs(np.diff(histograms, axis=0)).sum(axis=1) / (2 * samples)


def shot_starts(differences: np.ndarray) -> list[int]:
    """Frames at which a shot begins: the first, and those whose difference is large and stands out from the last ones."""
    n = len(differences)
    sums = np.concatenate([[0.0], np.cumsum(differences)])
    squares = np.concatenate([[0.0], np.cumsum(differences**2)])
    at = np.arange(n)
    first = np.maximum(0, at - MEMORY)
    count = np.maximum(1, at - first)
    mean = (sums[at] - sums[first]) / count
    spread = np.sqrt(np.maximum(0, (squares[at] - squares[first]) / count - mean**2))
    cut = (differences >= LEAST_DIFFERENCE) & (differences > mean + DEVIATIONS * spread + 1e-9) & (at > 0)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def clips_of(data: bytes) -> tuple[np.ndarray, list[tuple[int, int, int, int, float]]]:
    """Decoded frames of an AVI file and its clips: (first frame, frames, start ms, end ms, mean level)."""
    return clips_of_all([data])[0]


def clips_of_all(files: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int, int, float]]]]:
    """``clips_of`` for several files, whose frames are decoded together where their tables are equal."""
    data, at, found = b"".join(files), 0, []
    for file in files:
        places, rate = read_index(file)
        found.append((places + [at, 0], rate))
        at += len(file)
    runs = decode_runs(data, np.concatenate([np.empty((0, 2), np.int64), *(p for p, _ in found)]))
    rows = np.concatenate(runs) if len({r.shape[1] for r in runs}) == 1 else [row for run in runs for row in run]
    out, first = [], 0
    for places, rate in found:
        frames = np.asarray(rows[first : first + len(places)], np.uint8)
        first += len(places)
        starts = shot_starts(histogram_differences(frames)) if len(frames) else []
        ends = [*starts[1:], len(frames)]
        ms = lambda frame, rate=rate: round(1000 * frame / rate)
        out.append((frames, [(a, b - a, ms(a), ms(b), round(float(frames[a:b].mean()), 3)) for a, b in zip(starts, ends)]))
    return out


MEDIA = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame) -> DataFrame:
    """Each row's text stored as an AVI file; null texts as empty ones, repeated rows as equal files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # stored files are several times as large as the texts
                part = batch.slice(at, 256)
                stored = [payload_of(t.as_py()) for t in part.column(1)]
                files = [write_avi(p) for p, _ in stored]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in stored], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, MEDIA)


CLIPS = "array<struct<first_frame: int, n_frames: int, start_ms: long, end_ms: long, level: double>>"


def read_media(media: DataFrame, n_bytes: str = "n_bytes") -> DataFrame:
    """doc_id, the payload that the stored bytes hold, digests of both, and the clips, for each media row."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips {CLIPS}"
    names = [f.split()[0] for f in schema.split(", ")[:7]] + ["clips"]
    clip_type = pa.list_(pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("level", pa.float64())]))
    keys = ("first_frame", "n_frames", "start_ms", "end_ms", "level")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            files = batch.column(2)
            read = (x for at in range(0, batch.num_rows, 128) for part in (files.slice(at, 128).to_pylist(),) for x in zip(part, clips_of_all(part)))
            for doc_id, n, (data, (frames, clips)) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), read):
                payload = frames.tobytes()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), [dict(zip(keys, c)) for c in clips]))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip_type]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return media.select("doc_id", F.col(n_bytes).alias("n_bytes"), "media").mapInArrow(run, schema)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip number, first frame, frames, start and end in milliseconds, mean level."""
    return read.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def media_digests(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and digests of the payload as read back and of the stored file, and its clips as text.

    The files are stored in a media column of a table in the shared folder, whose pages are
    compressed, and all values come from what is read there. Equal texts give equal values. An
    empty text is one frame of zeros. An empty table gives no rows. A text may be as long as its
    file, about five times as large, fits a column: 400 MB.
    """
    read = read_media(materialise(to_media(docs), "media", compression="zstd"))
    clip = lambda c: F.concat(c["start_ms"].cast("string"), F.lit("-"), c["end_ms"].cast("string"), F.lit("@"), c["level"].cast("string"))
    return read.withColumn("feature", F.array_join(F.transform("clips", clip), ",")).withColumn("n_clips", F.size("clips")).drop("clips")
