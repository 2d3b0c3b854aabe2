"""Matroska media columns: writing 8-bit samples as laced blocks, and parsing files into packet tables.

The parser reads variable-length EBML elements (unknown sizes included), tracks, clusters, simple blocks and block
groups with Xiph, EBML or fixed-size lacing, and cues. A packet is a row of track, timestamp and byte range, so its
bytes can be read without parsing the file again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.batches import slices

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
STAMP, SIMPLE, GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK, AUDIO, GROUP, CUE, CUE_AT}
_TOP = {INFO, TRACKS, CLUSTER, CUES}

UNIT = 192
HERTZ = 8000
FRAMES, BLOCKS = 8, 16
_UNIT_MS = UNIT * 1000 // HERTZ


def _id(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(name: int, body: bytes) -> bytes:
    return _id(name) + _size(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
_TRACK = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT")
                                 + element(AUDIO, element(RATE, struct.pack(">f", HERTZ)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def pad(payload: bytes) -> bytes:
    """payload with blanks up to a positive multiple of UNIT."""
    return payload + b" " * (-len(payload) % UNIT if payload else UNIT)


def write(samples: bytes) -> bytes:
    """A file of one 8-bit track whose packets hold UNIT samples each; len(samples) is a multiple of UNIT."""
    packets = len(samples) // UNIT
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", packets * _UNIT_MS)) + element(MUXER, b"lexweave") + element(WRITER, b"lexweave"))
    parts, cues, at = [info, _TRACK], [], len(info) + len(_TRACK)
    for first in range(0, packets, FRAMES * BLOCKS):
        stamp = first * _UNIT_MS
        body = [number(STAMP, stamp)]
        for k in range(first, min(first + FRAMES * BLOCKS, packets), FRAMES):
            frames = min(FRAMES, packets - k)
            lace = b"\x84" + bytes([frames - 1]) if frames > 1 else b"\x80"
            body.append(element(SIMPLE, b"\x81" + struct.pack(">h", (k - first) * _UNIT_MS) + lace + samples[k * UNIT:(k + frames) * UNIT]))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, number(CUE_TIME, stamp) + element(CUE_AT, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, marker: bool) -> tuple[int, int, bool]:
    """Value (with its marker bit if asked for), next place, and whether all value bits are ones (unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"integer cut off at {at}")
    raw = int.from_bytes(data[at:at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return (raw if marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a byte range; an element of unknown size ends before the next of its level."""
    while at < end:
        name, body, _ = _vint(data, at, True)
        size, body, unknown = _vint(data, body, False)
        if unknown:
            to = end
            if name == CLUSTER:
                at = body
                while at < end:
                    inner, nested, _ = _vint(data, at, True)
                    if inner in _TOP:
                        to = at
                        break
                    size, nested, _ = _vint(data, nested, False)
                    at = nested + size
        else:
            to = body + size
        if to > end:
            raise ValueError(f"element {name:#x} at {at} leaves its parent")
        yield name, body, to
        at = to


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; lacing 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        size, odd = divmod(end - at, count)
        if odd:
            raise ValueError("fixed lacing does not divide its block")
        return [(at + i * size, at + (i + 1) * size) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length()
            value, at, _ = _vint(data, at, False)
            # All sizes but the first are signed differences to the one before.
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames leave their block")
    edges = np.cumsum([at, *sizes]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def parse(data: bytes) -> dict[str, list[tuple]]:
    """Tables of a file: tracks (number, kind, codec, rate, depth), packets (track, timestamp in ns, start, end, cluster,
    keyframe), cues (time in ns, track, cluster offset in the file)."""
    out: dict[str, list[tuple]] = {"tracks": [], "packets": [], "cues": []}
    scale = 1_000_000
    for name, a, b in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        clusters = 0
        for top, c, d in elements(data, a, b):
            if top == INFO:
                for leaf, x, y in elements(data, c, d):
                    scale = _uint(data, x, y) if leaf == SCALE else scale
            elif top == TRACKS:
                for entry, x, y in elements(data, c, d):
                    if entry != TRACK:
                        continue
                    found = {leaf: (p, q) for leaf, p, q in elements(data, x, y)}
                    audio = {leaf: (p, q) for leaf, p, q in elements(data, *found[AUDIO])} if AUDIO in found else {}
                    rate = struct.unpack(">f" if audio[RATE][1] - audio[RATE][0] == 4 else ">d", data[slice(*audio[RATE])])[0] if RATE in audio else None
                    out["tracks"].append((_uint(data, *found[NUMBER]), _uint(data, *found[KIND]), data[slice(*found[CODEC])].decode(), rate,
                                          _uint(data, *audio[DEPTH]) if DEPTH in audio else None))
            elif top == CLUSTER:
                stamp = 0
                for leaf, x, y in elements(data, c, d):
                    blocks = [(x, y, True)] if leaf == SIMPLE else [(p, q, False) for inner, p, q in elements(data, x, y) if inner == BLOCK] if leaf == GROUP else []
                    if leaf == STAMP:
                        stamp = _uint(data, x, y)
                    for p, q, simple in blocks:
                        track, p, _ = _vint(data, p, False)
                        offset, flags = struct.unpack_from(">hB", data, p)
                        for s, e in laced(data, p + 3, q, flags >> 1 & 3):
                            out["packets"].append((track, (stamp + offset) * scale, s, e, clusters, bool(flags & 128) if simple else None))
                clusters += 1
            elif top == CUES:
                for point, x, y in elements(data, c, d):
                    held = {leaf: (p, q) for leaf, p, q in elements(data, x, y)} if point == CUE else {}
                    if CUE_AT in held:
                        where = {leaf: _uint(data, p, q) for leaf, p, q in elements(data, *held[CUE_AT])}
                        out["cues"].append((_uint(data, *held[CUE_TIME]) * scale, where.get(CUE_TRACK), a + where.get(CUE_CLUSTER, 0)))
    return out


def _carried(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != column]).alias("row"), F.col(f"`{column}`").alias("value"))
    return rows, rows.schema["row"].dataType.simpleString()


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """(row, media): every whole text as the samples of a Matroska file; null text is an empty one, padded like it."""
    rows, kind = _carried(df.withColumn(text, F.col(text).cast("string")), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "value"):
                media = [write(pad((v.as_py() or "").encode())) for v in part["value"]]
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(media, pa.binary())], ["row", "media"])

    return rows.mapInArrow(run, f"row {kind}, media binary")


_PACKET = "track int, timestamp_ns long, start long, end long, cluster int, keyframe boolean"
_READ = "payload binary, n_packets int, n_clusters int, n_cues int, duration_ns long, feature string"


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """(row, track, timestamp_ns, start, end, cluster, keyframe): one row per packet of every file; null media has none."""
    rows, kind = _carried(df, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["track", "timestamp_ns", "start", "end", "cluster", "keyframe"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in batches:
            for part in slices(batch, "value"):
                tables = [parse(v.as_py())["packets"] if v.is_valid else [] for v in part["value"]]
                of = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
                flat = [p for t in tables for p in t]
                yield pa.RecordBatch.from_arrays([part["row"].take(pa.array(of)), *[pa.array([p[i] for p in flat], t) for i, t in enumerate(types)]], ["row", *names])

    return rows.mapInArrow(run, f"row {kind}, {_PACKET}")


def read_track(df: DataFrame, media: str = "media", track: int = 1) -> DataFrame:
    """df's other columns, media, and the track read back by its packets' byte ranges, with counts and a feature of its samples."""
    kept = [c for c in df.columns if c != media]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{media}`").alias("value"))

    def feature(payload: bytes, packets: int, duration: int) -> str:
        x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
        if not len(x):
            return f"0:{duration}:0:0:0"
        power, turns = int((x * x).sum()), int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
        return f"{packets}:{duration}:{int(x.sum())}:{power}:{turns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "value"):
                out = []
                for v in part["value"]:
                    data = v.as_py() or b""
                    tables = parse(data)
                    own = [p for p in tables["packets"] if p[0] == track]
                    payload = b"".join([data[p[2]:p[3]] for p in own])
                    duration = own[-1][1] - own[0][1] if own else 0
                    out.append((payload, len(own), len({p[4] for p in own}), len(tables["cues"]), duration, feature(payload, len(own), duration)))
                types = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part["row"], part["value"], *[pa.array([o[i] for o in out], t) for i, t in enumerate(types)]],
                                                 ["row", "media", "payload", "n_packets", "n_clusters", "n_cues", "duration_ns", "feature"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, media binary, {_READ}")
