"""Media columns: Matroska files in binary columns, written and parsed into packet tables.

The writer stores a payload as 8-bit mono PCM: EBML head, segment with info, one track, clusters of
laced simple blocks and cues.  The parser reads variable-length element ids and sizes (unknown
sizes too), all four lacing modes, block groups, and cues, and returns one packet per frame with
track, timestamp, key flag and byte range.

Null texts count as empty, and an empty text is a payload of 64 zeros.  A payload of any length is one
file in memory at a time, with as many clusters as it needs; equal texts give equal files.  Rows are
handled one by one and batches are cut by bytes, so many long texts in a row don't add up.  Repeated
rows give repeated rows, an empty table gives an empty one, ids of any type (null too) come back as
they are, and further columns, whatever their names, are not read.  Damaged bytes raise ValueError
with the offset.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element ids of the container format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIME_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC, AUDIO, RATE, CHANNELS, BITS = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PCM = "A_PCM/INT/LIT"
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_PLACES}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469, SEGMENT, EBML}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def vint(n: int, width: int = 0) -> bytes:
    """A size of 1 to 8 bytes; all ones is kept for unknown."""
    width = width or next((w for w in range(1, 9) if n < (1 << 7 * w) - 1), 9)
    if width > 8 or n >= (1 << 7 * width) - 1:
        raise ValueError(f"{n} is too large for a size")
    return (n | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data, at: int, end: int, keep_marker: bool = False) -> tuple[int, int, int]:
    """(value, next offset, width); value -1: unknown size."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - int(data[at]).bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    if keep_marker:
        return raw, at + width, width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width, width


def element(key: int, body: bytes | int | float | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, float):
        body = struct.pack(">d", body)
    elif isinstance(body, str):
        body = body.encode()
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def lace(frames: list[bytes], mode: int) -> bytes:
    """The part of a block after its flags."""
    sizes = [len(f) for f in frames]
    if mode == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    if mode == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == EBML_LACE:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("frames of fixed lacing differ in size")
    return head + b"".join(frames)


def unlace(data, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of a block's frames."""
    if mode == NO_LACE:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes = []
    if mode == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed lacing doesn't divide at byte {at}")
        sizes = [(end - at) // count] * count
    elif mode == XIPH:
        for _ in range(count - 1):
            n = 0
            while True:
                n, at, more = n + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(n)
    elif count > 1:
        n, at, _ = read_vint(data, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            d, at, width = read_vint(data, at, end)
            sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
    if mode != FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"laced sizes run over their block at byte {at}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


@dataclass
class Packet:
    track: int
    timestamp: int
    cluster: int
    offset: int
    size: int
    key: bool
    lacing: int


@dataclass
class Parsed:
    doc_type: str = ""
    time_scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def parse(data: bytes) -> Parsed:
    """Walks all elements once, without recursion; unknown elements are skipped."""
    out, track, cue = Parsed(), {}, {}
    segment, time = 0, 0
    stack: list[tuple[int, int]] = []
    at, end = 0, len(data)
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    while at < end:
        while stack and at >= stack[-1][1]:
            stack.pop()
        start = at
        key, at, _ = read_vint(data, at, end, keep_marker=True)
        size, at, _ = read_vint(data, at, end)
        if key in TOP:  # ends a cluster of unknown size
            while stack and stack[-1][0] not in (SEGMENT,):
                stack.pop()
        stop = (stack[-1][1] if stack else end) if size < 0 else at + size
        if stop > end:
            raise ValueError(f"element {key:x} at byte {start} runs over the end")
        if key in MASTERS:
            stack.append((key, stop))
            if key == SEGMENT:
                segment = at
            elif key == CLUSTER:
                out.clusters.append(start - segment)
            elif key == TRACK:
                track = {}
            elif key == CUE_POINT:
                cue = {}
            continue
        if size < 0:
            raise ValueError(f"element {key:x} at byte {start} has no size")
        if key in (SIMPLE_BLOCK, BLOCK):
            number_, body, _ = read_vint(data, at, stop)
            rel = int.from_bytes(data[body : body + 2], "big", signed=True)
            flags = data[body + 2]
            mode = flags >> 1 & 3
            frames = unlace(data, body + 3, stop, mode)
            step = out.tracks.get(number_, {}).get(DEFAULT_DURATION, 0)
            for k, (offset, n) in enumerate(frames):
                out.packets.append(Packet(number_, time + rel + k * step // max(1, out.time_scale), out.clusters[-1] if out.clusters else 0, offset, n, bool(flags & 0x80) or key == BLOCK, mode))
        elif key == CLUSTER_TIME:
            time = number(at, stop)
        elif key == DOC_TYPE:
            out.doc_type = data[at:stop].decode()
        elif key == TIME_SCALE:
            out.time_scale = number(at, stop)
        elif key == DURATION:
            out.duration = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
        elif key in (TRACK_NUMBER, TRACK_UID, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BITS):
            track[key] = number(at, stop)
            if key == TRACK_NUMBER:
                out.tracks[track[key]] = track
        elif key == CODEC:
            track[key] = data[at:stop].decode()
        elif key == RATE:
            track[key] = struct.unpack(">d" if size == 8 else ">f", data[at:stop])[0]
        elif key in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[key] = number(at, stop)
            if len(cue) == 3:
                out.cues.append((cue[CUE_TIME], cue[CUE_TRACK], cue[CUE_CLUSTER]))
        at = stop
    return out


def mux(payload: bytes, rate: int = 8000, frame: int = 1024, laced: int = 8, cluster_frames: int = 64) -> bytes:
    """The payload as 8-bit mono samples: blocks of `laced` frames, clusters of `cluster_frames`, a cue per cluster."""
    head = element(EBML, element(EBML_VERSION, 1) + element(EBML_READ_VERSION, 1) + element(EBML_MAX_ID, 4) + element(EBML_MAX_SIZE, 8) + element(DOC_TYPE, "matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    step = frame * 1_000_000_000 // rate
    ms = lambda k: k * frame * 1000 // rate
    info = element(INFO, element(TIME_SCALE, 1_000_000) + element(DURATION, len(payload) * 1000 / rate) + element(MUXING_APP, "columns") + element(WRITING_APP, "columns"))
    audio = element(AUDIO, element(RATE, float(rate)) + element(CHANNELS, 1) + element(BITS, 8))
    tracks = element(TRACKS, element(TRACK, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(DEFAULT_DURATION, step) + element(CODEC, PCM) + audio))
    body, cues = [info, tracks], []
    place = len(info) + len(tracks)
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    for first in range(0, len(frames), cluster_frames):
        blocks = [element(CLUSTER_TIME, ms(first))]
        for k in range(first, min(first + cluster_frames, len(frames)), laced):
            group = frames[k : min(k + laced, first + cluster_frames)]
            mode = NO_LACE if len(group) == 1 else FIXED if len(group[0]) == len(group[-1]) else EBML_LACE
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", ms(k) - ms(first), 0x80 | mode << 1) + lace(group, mode)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, ms(first)) + element(CUE_PLACES, element(CUE_TRACK, 1) + element(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    if cues:
        body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def demux(data: bytes, track: int = 1) -> bytes:
    """A track's frames, joined in time order."""
    return b"".join(data[p.offset : p.offset + p.size] for p in parse(data).packets if p.track == track)


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(-len(raw) % unit if raw else unit)


def write_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", portion: int = 1 << 24) -> DataFrame:
    """(id_col, n_bytes, media): every text's padded UTF-8 bytes as a Matroska file."""

    def run(batches):
        for batch in batches:
            keys, at, held, lengths, files = batch.column(0), 0, 0, [], []
            texts = batch.column(1)
            for k in range(len(texts)):
                raw = (texts[k].as_py() or "").encode()
                lengths.append(len(raw))
                files.append(mux(padded(raw)))
                held += len(files[-1])
                if k + 1 == len(texts) or held > portion:
                    yield pa.RecordBatch.from_pydict({id_col: keys.slice(at, len(files)), "n_bytes": pa.array(lengths, pa.int64()), "media": pa.array(files, pa.binary())})
                    at, held, lengths, files = k + 1, 0, [], []

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: one row per frame of every file that is not null."""
    names = ["track", "timestamp", "cluster", "offset", "size", "key", "lacing"]

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parse(data).packets if data is not None else []
                cols = {n: pa.array([getattr(p, n) for p in found], pa.bool_() if n == "key" else pa.int64()) for n in names}
                yield pa.RecordBatch.from_pydict({id_col: pa.array([key] * len(found), batch.column(0).type)} | cols)

    return df.select(id_col, media_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {'boolean' if n == 'key' else 'long'}" for n in names))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(data: bytes) -> tuple[int, str, int, int, str, str]:
    """FEATURES of a file, from the samples and packets that are read back from it."""
    parsed = parse(data)
    payload = b"".join(data[p.offset : p.offset + p.size] for p in parsed.packets)
    samples = np.frombuffer(payload, np.uint8)
    level = int(np.sqrt(np.mean((samples.astype(np.float64) - 128) ** 2)) * 1000) if len(samples) else 0
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    last = parsed.packets[-1].timestamp if parsed.packets else -1
    feature = f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};last_ms={last};rms={level};crossings={crossings};peak={int(samples.max()) if len(samples) else 0}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature


def _described(found: list[tuple]) -> dict:
    cols = list(zip(*found, strict=True)) if found else [()] * 6
    fields = [x.split() for x in FEATURES.split(", ")]
    return {n: pa.array(c, pa.int64() if k == "long" else pa.string()) for (n, k), c in zip(fields, cols, strict=True)}


def features(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads (id_col, n_bytes, media) back and describes the samples and packets."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": batch.column(1)} | _described([describe(x.as_py()) for x in batch.column(2)]))

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {kind}, n_bytes long, {FEATURES}")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """features(write_media(df)) in one map: each file is written, read back and described before the next, so the
    files, which are as large as the table, never travel between Spark and Python."""

    def run(batches):
        for batch in batches:
            lengths, found = [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                lengths.append(len(raw))
                found.append(describe(mux(padded(raw))))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_bytes": pa.array(lengths, pa.int64())} | _described(found))

    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes long, {FEATURES}")
