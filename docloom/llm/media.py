"""Media columns: Matroska files, written and parsed, and packet tables.

parse() walks a file's variable-length EBML elements: header, segment, tracks,
cues, clusters with simple blocks and block groups, and undoes lacing of all three
kinds. A segment of unknown size reaches to the end, a cluster of unknown size to the next element of its own level. It gives the packet table: track, timestamp, key flag, and the byte range of
each frame. packets_since() starts at the cluster that the cues name. write() stores samples as one audio track: clusters of blocks with laced
frames of FRAME samples, and a cue per cluster.

Defined cases: null text counts as empty; payloads are padded by zeros to a
positive multiple of 64 bytes; texts of any length are stored whole, in as many clusters as it takes; equal texts give equal values; repeated rows and null
ids are kept; an empty table gives no rows; other columns are ignored, whatever their names. An element that reaches beyond the file's end, and what follows, is ignored;
where a file contradicts itself parse() raises ValueError, and packet_table gives what was read up to there and one more row with the error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Samples (bytes) in a frame, frames laced into a block, blocks in a cluster; ticks are of 1 ms, a sample takes 1/8000 s.
FRAME, LACED, BLOCKS = 64, 64, 64
RATE = 8000

# Element ids of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TICK, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE_ID, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS = 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367
#: A cluster of unknown size ends where one of these begins.
TOP = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, ATTACHMENTS, TAGS))


class Packet(NamedTuple):
    track: int
    timestamp: int
    key: bool
    offset: int
    size: int


def number(n: int, width: int = 0) -> bytes:
    """n as a variable-length size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + number(len(body)) + body


def lace(frames: list[bytes], kind: int) -> bytes:
    """Body of a block after its flags. kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        head += number(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            head += number(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def write(samples: bytes) -> bytes:
    head = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(MAX_ID, 4) + element(MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    info = element(INFO, element(TICK, 1_000_000) + element(MUXER, "docloom") + element(WRITER, "docloom"))
    audio = element(AUDIO, element(RATE_ID, float(RATE)) + element(CHANNELS, 1) + element(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(LACING, 1) + element(CODEC, "A_PCM/INT/LIT") + audio))
    body, cues, step = [info, tracks], [], FRAME * LACED
    at = len(info) + len(tracks)
    for start in range(0, len(samples), step * BLOCKS):
        time = start * 1000 // RATE
        blocks = [element(TIME, time)]
        for b in range(start, min(start + step * BLOCKS, len(samples)), step):
            frames = [samples[i : i + FRAME] for i in range(b, min(b + step, len(samples)), FRAME)]
            kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            blocks.append(element(SIMPLE, b"\x81" + struct.pack(">h", b * 1000 // RATE - time) + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        body.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE, element(CUE_TIME, time) + element(CUE_PLACES, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        at += len(body[-1])
    return head + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """(value, place after it); value -1 is an unknown size."""
    first = data[at]
    width = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        value = -1 if value == (1 << 7 * width) - 1 else value
    return value, at + width


def elements(data: bytes, at: int, end: int, until: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements' bodies, up to one whose id is in until. An unknown size reaches to the end, or for a cluster to the next of its level."""
    while at < end and data[at]:
        kind, at = read_number(data, at, True)
        if at >= end or kind in until:
            return
        size, at = read_number(data, at, False)
        stop = at + size if size >= 0 else max([at, *[stop for _, _, stop in elements(data, at, end, TOP)]]) if kind == CLUSTER else end
        if stop > end:
            return
        yield kind, at, stop
        at = stop


def laced_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if kind == 0:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise ValueError("a fixed lace does not divide its block")
        return [(end - at) // count] * count, at
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif count > 1:
        n, at = read_number(data, at, False)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            raw, at = read_number(data, at, False)
            raw = (1 << 7 * width) - 1 if raw < 0 else raw
            sizes.append(sizes[-1] + raw - (1 << (7 * width - 1)) + 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


class Found(NamedTuple):
    packets: list[Packet]
    cues: list[tuple[int, int]]  # (time, byte place of the cluster)
    codecs: dict[int, str]  # of each track
    error: str | None = None


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _block(data: bytes, a: int, b: int, time: int, key: bool | None, packets: list[Packet]) -> None:
    track, at = read_number(data, a, False)
    stamp, flags = time + struct.unpack_from(">h", data, at)[0], data[at + 2]
    sizes, at = laced_sizes(data, at + 3, b, flags >> 1 & 3)
    lead = bool(flags & 0x80) if key is None else key
    for n in sizes:
        packets.append(Packet(track, stamp, lead, at, n))
        at += n


def _cluster(data: bytes, a: int, b: int, packets: list[Packet]) -> None:
    time = 0
    for kind, c, d in elements(data, a, b):
        if kind == TIME:
            time = _uint(data, c, d)
        elif kind == SIMPLE:
            _block(data, c, d, time, None, packets)
        elif kind == GROUP:
            inner = {x: (y, z) for x, y, z in elements(data, c, d)}
            if BLOCK in inner:
                _block(data, *inner[BLOCK], time, REFERENCE not in inner, packets)


def _segment(data: bytes, a: int, b: int, found: Found) -> None:
    for part, c, d in elements(data, a, b):
        if part == TRACKS:
            for _, e, f in elements(data, c, d):
                track = {k: (x, y) for k, x, y in elements(data, e, f)}
                if NUMBER in track and CODEC in track:
                    found.codecs[_uint(data, *track[NUMBER])] = data[slice(*track[CODEC])].decode("ascii", "replace")
        elif part == CLUSTER:
            _cluster(data, c, d, found.packets)
        elif part == CUES:
            for _, e, f in elements(data, c, d):
                cue = {x: (y, z) for x, y, z in elements(data, e, f)}
                for x, y, z in elements(data, *cue.get(CUE_PLACES, (0, 0))):
                    if x == CUE_CLUSTER:
                        found.cues.append((_uint(data, *cue[CUE_TIME]), a + _uint(data, y, z)))


def read(data: bytes) -> Found:
    """What the file holds; with an error if it contradicts itself, beside what was read up to there."""
    found = Found([], [], {})
    try:
        for kind, a, b in elements(data, 0, len(data)):
            if kind == SEGMENT:
                _segment(data, a, b, found)
    except (IndexError, KeyError, struct.error, ValueError) as e:
        return found._replace(error=f"{type(e).__name__}: {e}")
    return found


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int]], dict[int, str]]:
    """(packets, cues, codecs); ValueError if the file contradicts itself."""
    found = read(data)
    if found.error:
        raise ValueError(found.error)
    return found[:3]


def packets_since(data: bytes, time: int, cues: list[tuple[int, int]]) -> list[Packet]:
    """Packets with that timestamp or later, from the last cluster on whose cue is not after it; from the first one without such a cue."""
    packets: list[Packet] = []
    start = max([place for t, place in cues if t <= time], default=None)
    if start is None:
        return [p for p in parse(data)[0] if p.timestamp >= time]
    for kind, a, b in elements(data, start, len(data)):
        if kind == CLUSTER:
            _cluster(data, a, b, packets)
    return [p for p in packets if p.timestamp >= time]


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def feature_of(packets: list[Packet], cues: list[tuple[int, int]], payload: bytes) -> str:
    """Packets, cues, last timestamp, mean and deviation of the samples, share of sample pairs that cross 128."""
    x = np.frombuffer(payload, dtype=np.uint8)
    crossed = int(np.count_nonzero((x[1:] < 128) != (x[:-1] < 128)))
    s, sq = int(x.sum(dtype=np.int64)), int(np.square(x, dtype=np.int64).sum())
    n = len(x)
    var = max(0.0, sq / n - (s / n) ** 2)
    return f"packets={len(packets)};cues={len(cues)};last={packets[-1].timestamp};mean={s / n:.4f};dev={var ** 0.5:.4f};cross={crossed}"


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each document stored as Matroska and read back through its packet table."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_cues"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                n, payload = payload_of(text)
                media = write(payload)
                packets, cues, _ = parse(media)
                back = b"".join([media[p.offset : p.offset + p.size] for p in packets])
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(packets, cues, back), len(packets), len(cues)))
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long")


def packet_table(files: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row per packet of Matroska files given as bytes: id, packet (from 0), track, timestamp, key, offset, size, error. A file that
    contradicts itself has one more row, with the error alone; null and empty files have no row."""
    id_type = files.schema[id_col].dataType.simpleString()
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in enumerate(b.column(1).to_pylist()):
                found = read(data or b"")
                rows = [(k, *p, None) for k, p in enumerate(found.packets)]
                if found.error:
                    rows.append((None,) * 6 + (found.error,))
                cols = list(zip(*rows, strict=True)) or [()] * 7
                ids = b.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "packet", "track", "timestamp", "key", "offset", "size", "error"])

    return files.select(id_col, bytes_col).mapInArrow(run, f"{id_col} {id_type}, packet long, track long, timestamp long, key boolean, offset long, size long, error string")
