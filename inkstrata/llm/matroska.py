"""Media columns: Matroska files and their packet tables.

``mux`` stores bytes losslessly as 8-bit PCM samples of one audio track: an
EBML header, then a segment of info, tracks, clusters with fixed-size-laced
simple blocks, and cues.  ``packets`` parses any such file (variable-length
integers, nested elements of known or unknown size, EBML, Xiph and fixed-size
lacing, simple blocks and block groups, cues) into rows with track, timestamp
and byte range.  ``media_columns`` and ``packet_table`` apply them to every row
of a DataFrame: no shuffle, one row in memory at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstrata.llm.common import text_of

# Fixed values of the Matroska format: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = frozenset({EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS})
_TOP_LEVEL = frozenset({INFO, TRACKS, CLUSTER, CUES, SEGMENT, EBML})

RATE = 8000
FRAME = 512
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 8
ALIGN = 64


def vint(value: int, length: int = 0) -> bytes:
    """A variable-length size: shortest form, or ``length`` bytes."""
    n = length or max(1, -(-(value + 1).bit_length() // 7))
    if not length and value == (1 << (7 * n)) - 1:
        n += 1
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def mux(payload: bytes, frame: int = FRAME) -> bytes:
    """A Matroska file whose one audio track holds ``payload`` as 8-bit samples."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(RATE))) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, clusters, cues = [info, tracks], len(info) + len(tracks), []
    for at in range(0, len(payload), frame * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER):
        part = payload[at : at + frame * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER]
        start, blocks = at * 1000 // RATE, []
        for off in range(0, len(part), frame * FRAMES_PER_BLOCK):
            data = part[off : off + frame * FRAMES_PER_BLOCK]
            when = (at + off) * 1000 // RATE - start
            whole = len(data) % frame == 0 and len(data) > frame
            lacing = bytes([len(data) // frame - 1]) if whole else b""
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", when, 0x84 if whole else 0x80) + lacing + data))
        cluster = element(CLUSTER, unsigned(CLUSTER_TIMESTAMP, start) + b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, clusters))))
        clusters += len(cluster)
        body.append(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Packet:
    track: int
    timestamp: int
    start: int
    size: int
    keyframe: bool
    lacing: int


@dataclass
class Media:
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    tracks: dict[int, str]
    clusters: list[int]
    duration: float


def _number(data: bytes, at: int, keep: bool) -> tuple[int, int, bool]:
    """(value, next place, is the unknown size) of the variable-length integer at ``at``."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"integer cut short at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    bare = value & ((1 << (7 * n)) - 1)
    return (value if keep else bare), at + n, bare == (1 << (7 * n)) - 1


def _elements(data: bytes, at: int, end: int, inside: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of the elements side by side in [at, end)."""
    while at < end:
        ident, place, _ = _number(data, at, keep=True)
        size, place, unknown = _number(data, place, keep=False)
        if inside == CLUSTER and ident in _TOP_LEVEL:
            return
        stop = end if unknown else place + size
        if stop > end:
            raise ValueError(f"element {ident:#x} at byte {at} runs past its parent")
        if unknown and ident == CLUSTER:
            stop = place
            for _, _, stop in _elements(data, place, end, CLUSTER):  # noqa: B007
                pass
        yield ident, place, stop
        at = stop


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(start, size) of the frames of a block by its lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 2:
        if (end - at) % count:
            raise ValueError("fixed-size lacing doesn't divide the block")
        sizes = [(end - at) // count] * count
    elif kind == 1:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(count - 1):
            before = at
            value, at, _ = _number(data, at, keep=False)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * (at - before) - 1)) - 1))
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing sizes exceed the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """The packet table, cues and tracks of a Matroska file; ``ValueError`` if it is malformed."""
    media = Media([], [], {}, [], 0.0)
    whole = lambda a, b: int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, base: int, simple: bool) -> None:
        track, a, _ = _number(data, a, keep=False)
        when, flags = struct.unpack(">hB", data[a : a + 3])
        kind = flags >> 1 & 3
        media.packets += [Packet(track, base + when, s, n, simple and bool(flags & 0x80), kind) for s, n in _frames(data, a + 3, b, kind)]

    def walk(at: int, end: int, parent: int | None, state: dict) -> None:
        for ident, a, b in _elements(data, at, end, parent):
            if ident == CLUSTER:
                media.clusters.append(a)
                walk(a, b, CLUSTER, {"time": 0})
            elif ident == TRACK_ENTRY:
                walk(a, b, ident, own := {"number": 0, "codec": ""})
                media.tracks[own["number"]] = own["codec"]
            elif ident == CUE_POINT:
                walk(a, b, ident, own := {"cue": 0, "track": 0, "position": 0})
                media.cues.append((own["cue"], own["track"], own["position"]))
            elif ident in _MASTERS:
                walk(a, b, ident, state)
            elif ident == CLUSTER_TIMESTAMP:
                state["time"] = whole(a, b)
            elif ident in (SIMPLE_BLOCK, BLOCK):
                block(a, b, state.get("time", 0), ident == SIMPLE_BLOCK)
            elif ident == DURATION:
                media.duration = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
            elif ident == TRACK_NUMBER:
                state["number"] = whole(a, b)
            elif ident == CODEC_ID:
                state["codec"] = data[a:b].decode("ascii", "replace")
            elif ident == CUE_TIME:
                state["cue"] = whole(a, b)
            elif ident == CUE_TRACK:
                state["track"] = whole(a, b)
            elif ident == CUE_CLUSTER_POSITION:
                state["position"] = whole(a, b)

    walk(0, len(data), None, {})
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    """The stored samples of a track, in packet order."""
    return b"".join(data[p.start : p.start + p.size] for p in media.packets if p.track == track)


def padded(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode()
    return raw.ljust(max(ALIGN, -(-len(raw) // ALIGN) * ALIGN), b"\0")


def media_columns(docs: DataFrame, text: str = "text", keep_file: bool = False) -> DataFrame:
    """Store each text as a Matroska file, read it back and describe what was read.

    Null text counts as empty and gets one frame of 64 zero bytes.  Rows are
    independent: repeated rows give repeated results, an empty table none.
    ``keep_file`` adds the file itself as column ``media``.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" if keep_file else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for value in batch.column("text").to_pylist():
                    file = mux(padded(value))
                    media = parse(file)
                    back = payload_of(file, media)
                    last = media.packets[-1]
                    feature = f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};laced={sum(p.lacing > 0 for p in media.packets)};last_ms={last.timestamp};largest={max(p.size for p in media.packets)};duration_ms={media.duration:.3f};mean={sum(back) / len(back):.6f}"
                    rows.append((len(value.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(file), hashlib.sha256(file).hexdigest(), feature) + ((file,) if keep_file else ()))
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", text_of(text).alias("text")).mapInArrow(run, schema)


def packet_table(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet of each Matroska file: key, packet, track, codec, timestamp, start, size, keyframe, lacing, error.

    A null file gives no row; a malformed one gives a row with only ``error``.
    Packets leave in batches, so a long file doesn't grow a task's memory by
    more than its own table.
    """
    names = ["packet", "track", "codec", "timestamp", "start", "size", "keyframe", "lacing", "error"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, data in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    found = parse(data)
                    rows = [(i, p.track, found.tracks.get(p.track), p.timestamp, p.start, p.size, p.keyframe, p.lacing, None) for i, p in enumerate(found.packets)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(None,) * 8 + (str(e),)]
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    columns = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(part), pa.int64()), *columns], ["key", *names])

    out = files.select(F.col(key).cast("long").alias("key"), F.col(media).alias("media")).mapInArrow(
        run, "key long, packet long, track long, codec string, timestamp long, start long, size long, keyframe boolean, lacing int, error string"
    )
    return out.withColumnRenamed("key", key)
