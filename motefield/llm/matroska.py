"""Media columns: Matroska files written from bytes and parsed into packet tables.

``mux`` stores a payload losslessly as 8-bit PCM samples: a file header, one segment with
its info, one audio track, clusters of laced blocks and a cue for each cluster. ``packets``
parses such bytes: variable-length element ids and sizes, master elements nested to any depth,
segments and clusters of unknown size, cluster
times, simple blocks and block groups, the four lacings, and cues; it gives one entry for
each frame with its track, timestamp and byte range. Reading the byte ranges of a track in
order gives the payload back.

Times are in ticks of the file's scale and in nanoseconds. The frames of a laced block are
apart by the track's default duration, else by an equal share of the block's own, else not at
all. A simple block's flag says whether it is a key frame; a block of a group is one unless it
refers to another. A cluster of unknown size ends where another cluster or another part of the
segment begins.

Null text counts as empty. Bytes that are null, empty or break off give the packets before
the fault and name it in ``error``; nothing is raised. Repeated rows give repeated packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of the elements that are written or read.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
DOC_TYPE, SCALE, DURATION, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, BITS = 0x4282, 0x2AD7B1, 0x4489, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_AT = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION, REFERENCE, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x23E383, 0xFB, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: What ends a segment, and a cluster, of unknown size.
TOP = {EBML, SEGMENT}
ENDS = {SEGMENT: TOP, CLUSTER: TOP | {CLUSTER, INFO, TRACKS, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}}
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_PLACES}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Samples of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, HZ = 576, 8, 16, 48_000
#: Frames are 12 ms long, in the default scale of a millisecond.
FRAME_MS = FRAME * 1000 // HZ


def size_of(n: int) -> bytes:
    """A size as a variable-length integer of least length; all ones is kept for unknown."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_of(len(body)) + body


def number(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def signed_size(n: int) -> bytes:
    """A lace size difference: a variable-length integer shifted to be signed."""
    length = 1
    while not -((1 << 7 * length - 1) - 1) <= n <= (1 << 7 * length - 1) - 1:
        length += 1
    return (n + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")


def lace(frames: list[bytes], how: int) -> bytes:
    """The lace header and the frames of one block."""
    if how == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(x) for x in frames]
    if how == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == 3:
        head += size_of(sizes[0]) + b"".join(signed_size(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))
    return head + b"".join(frames)


def block(frames: list[bytes], track: int, at: int, how: int, key: bool) -> bytes:
    flags = how << 1 | (0x80 if key else 0)
    return size_of(track) + at.to_bytes(2, "big", signed=True) + bytes([flags]) + lace(frames, how)


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of a frame."""
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def mux(payload: bytes) -> bytes:
    """A file of one track of 8-bit samples that holds ``payload``, whole frames long.

    Lacings take turns by block, and one block in four is a block group, so equal payloads
    give equal files and each way of storing a block is in use.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    audio = element(RATE, b"\x47\x3b\x80\x00") + number(CHANNELS, 1) + number(BITS, 8)
    track = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    info = number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(len(frames) * FRAME_MS)))
    parts = [element(INFO, info), element(TRACKS, element(TRACK, track))]
    at, cues, turn, done = sum(map(len, parts)), [], 0, 0
    while done < len(frames):
        begin, body = done * FRAME_MS, [number(TIME, done * FRAME_MS)]
        for _ in range(BLOCKS):
            if done >= len(frames):
                break
            how = turn % 4
            some = frames[done : done + (LACED if how else 1)]
            how = how if len(some) > 1 else 0
            held = block(some, 1, (done * FRAME_MS) - begin, how, True)
            if turn % 4 == 3:
                body.append(element(GROUP, element(BLOCK, held) + number(BLOCK_DURATION, len(some) * FRAME_MS)))
            else:
                body.append(element(SIMPLE, held))
            turn, done = turn + 1, done + len(some)
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, number(CUE_TIME, begin) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_AT, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds; a packet is (track, time, offset, size, key, lacing, cluster,
    nanoseconds), a cue (time, track, place of its cluster)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[tuple[int, str]] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, str, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    error: str = ""


class Broken(ValueError):
    """The bytes are not what the format says."""


def read_vint(raw: bytes, at: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, place behind it, and whether all its bits are ones (an unknown size)."""
    if at >= end or not raw[at]:
        raise Broken(f"no variable-length integer at {at}")
    length = 9 - raw[at].bit_length()
    if at + length > end:
        raise Broken(f"variable-length integer at {at} breaks off")
    value = int.from_bytes(raw[at : at + length], "big")
    bits = value & (1 << 7 * length) - 1
    return (value if keep else bits), at + length, bits == (1 << 7 * length) - 1


def lace_sizes(raw: bytes, at: int, end: int, how: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block, and where the first begins."""
    if how == 0:
        return [end - at], at
    if at >= end:
        raise Broken(f"lace at {at} breaks off")
    count, at, sizes = raw[at] + 1, at + 1, []
    if how == 1:
        for _ in range(count - 1):
            n = 0
            while at < end and raw[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise Broken(f"lace at {at} breaks off")
            sizes.append(n + raw[at])
            at += 1
    elif how == 3 and count > 1:
        n, at, _ = read_vint(raw, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            step, after, _ = read_vint(raw, at, end)
            n += step - ((1 << 7 * (after - at) - 1) - 1)
            sizes.append(n)
            at = after
    if how == 2:
        if (end - at) % count:
            raise Broken(f"fixed lace at {at} does not divide")
        return [(end - at) // count] * count, at
    rest = end - at - sum(sizes)
    if rest < 0 or any(n < 0 for n in sizes):
        raise Broken(f"lace at {at} is longer than its block")
    return [*sizes, rest], at


def packets(raw: bytes | None) -> Media:
    """Parse a file. What precedes a fault is kept, and ``error`` says what the fault is."""
    media = Media()
    if not raw:
        media.error = "no bytes"
        return media
    try:
        _Parser(raw, media).run()
    except Broken as fault:
        media.error = str(fault)
    return media


class _Parser:
    """Walks the elements of a file with a stack of the masters that are open."""

    def __init__(self, raw: bytes, media: Media):
        self.raw, self.media = raw, media
        self.segment = self.time = 0
        self.track: dict[int, object] = {}
        self.cue, self.group = [0, 0, 0], [0, None, False]
        self.defaults: dict[int, int] = {}

    def run(self) -> None:
        raw, at = self.raw, 0
        open_masters = [(len(raw), 0, False)]
        while open_masters:
            end, inside, unknown = open_masters[-1]
            if at >= end:
                self.close(inside)
                open_masters.pop()
                continue
            begin = at
            name, at, _ = read_vint(raw, at, end, keep=True)
            if unknown and name in ENDS.get(inside, ()):
                self.close(inside)
                open_masters.pop()
                at = begin
                continue
            size, at, no_size = read_vint(raw, at, end)
            stop = end if no_size else at + size
            if stop > end:
                raise Broken(f"element at {begin} breaks off")
            if name in MASTERS:
                self.open(name, begin, at)
                open_masters.append((stop, name, no_size))
            else:
                self.read(name, begin, at, stop)
                at = stop

    def open(self, name: int, begin: int, at: int) -> None:
        if name == SEGMENT:
            self.segment = at
        elif name == CLUSTER:
            self.media.clusters.append(begin - self.segment)
            self.time = 0
        elif name == TRACK:
            self.track = {}
        elif name == GROUP:
            self.group = [len(self.media.packets), None, False]

    def close(self, name: int) -> None:
        if name == TRACK:
            number = self.track.get(NUMBER, 0)
            self.media.tracks.append((number, self.track.get(CODEC, "")))
            self.defaults[number] = self.track.get(DEFAULT_DURATION, 0)
        elif name == CUE_PLACES:
            self.media.cues.append(tuple(self.cue))
        elif name == GROUP:
            self.close_group()

    def close_group(self) -> None:
        """A group's duration and references may stand behind its block."""
        first, duration, refers = self.group
        own = self.media.packets[first:]
        for i, p in enumerate(own):
            step = 0
            if duration is not None and not self.defaults.get(p[0]):
                step = i * duration * self.media.scale // len(own)
            at = self.timely(p[7] + step)
            self.media.packets[first + i] = (p[0], at // self.media.scale if step else p[1], *p[2:4], not refers, *p[5:7], at)

    @staticmethod
    def timely(at: int) -> int:
        if at >> 63 not in (0, -1):
            raise Broken("a time beyond 64 bits")
        return at

    def read(self, name: int, begin: int, at: int, stop: int) -> None:
        raw, media = self.raw, self.media
        if name in (SIMPLE, BLOCK):
            self.block(name, begin, at, stop)
        elif name == TIME:
            self.time = int.from_bytes(raw[at:stop], "big")
        elif name == BLOCK_DURATION:
            self.group[1] = int.from_bytes(raw[at:stop], "big")
        elif name == REFERENCE:
            self.group[2] = True
        elif name == CUE_TIME:
            self.cue[0] = int.from_bytes(raw[at:stop], "big")
        elif name == CUE_TRACK:
            self.cue[1] = int.from_bytes(raw[at:stop], "big")
        elif name == CUE_AT:
            self.cue[2] = int.from_bytes(raw[at:stop], "big")
        elif name in (NUMBER, DEFAULT_DURATION):
            self.track[name] = int.from_bytes(raw[at:stop], "big")
        elif name == CODEC:
            self.track[name] = raw[at:stop].decode("ascii", "replace")
        elif name == DOC_TYPE:
            media.doc_type = raw[at:stop].decode("ascii", "replace")
        elif name == SCALE:
            media.scale = int.from_bytes(raw[at:stop], "big") or media.scale
        elif name == DURATION and stop - at in (4, 8):
            media.duration = struct.unpack(">f" if stop - at == 4 else ">d", raw[at:stop])[0]

    def block(self, name: int, begin: int, at: int, stop: int) -> None:
        raw, media = self.raw, self.media
        track, place, _ = read_vint(raw, at, stop)
        if place + 3 > stop:
            raise Broken(f"block at {begin} breaks off")
        ticks = self.time + int.from_bytes(raw[place : place + 2], "big", signed=True)
        flags = raw[place + 2]
        how = flags >> 1 & 3
        sizes, place = lace_sizes(raw, place + 3, stop, how)
        media.blocks += 1
        step, cluster = self.defaults.get(track, 0), len(media.clusters) - 1
        for i, n in enumerate(sizes):
            at = self.timely(ticks * media.scale + i * step)
            media.packets.append((track, at // media.scale, place, n, bool(flags & 0x80) or name == BLOCK, LACINGS[how], cluster, at))
            place += n


def payload_of(raw: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes that a track's packets point to, in order of time."""
    own = sorted((p for p in media.packets if p[0] == track), key=lambda p: p[7])
    return b"".join(raw[p[2] : p[2] + p[3]] for p in own)


def cues_point_to_clusters(media: Media) -> bool:
    return bool(media.cues) and {c[2] for c in media.cues} == set(media.clusters)


PACKETS = "track long, time long, offset long, size long, key_frame boolean, lacing string, cluster long, nanoseconds long, error string"


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each packet of each file in the binary column ``media``.

    A file with a fault gives its packets up to there and one more row whose ``error`` is set
    and whose other fields are null.
    """
    names = [key, *(x.split()[0] for x in PACKETS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                found = packets(value.as_py())
                rows += [(name.as_py(), *p, None) for p in found.packets]
                if found.error:
                    rows.append((name.as_py(), *[None] * 8, found.error))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.bool_(), pa.string(), *[pa.int64()] * 2, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return df.select(key, media).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {PACKETS}")


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``media``: each whole text stored in a file of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [mux(padded((value.as_py() or "").encode())) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], [key, "media"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, media binary")


DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"


def media_digests(docs: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """What each whole text's file holds when it is written, parsed and read back.

    ``feature`` counts tracks, clusters, blocks, packets and cues, and gives the duration,
    whether cues point to clusters, and the mean of the samples that were read back.
    """
    names = [key, *(x.split()[0] for x in DIGESTS.split(", "))]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def one(raw: bytes) -> tuple:
        stored = mux(padded(raw))
        found = packets(stored)
        back = payload_of(stored, found)
        laced = "/".join(str(sum(p[5] == how for p in found.packets)) for how in LACINGS)
        feature = f"{found.doc_type};tracks={len(found.tracks)};clusters={len(found.clusters)};blocks={found.blocks};packets={len(found.packets)};lacing={laced};cues={len(found.cues)};cued={int(cues_point_to_clusters(found))};ms={found.duration * found.scale / 1e6:.0f};mean={sum(back) / len(back):.3f}"
        return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, len(found.packets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = list(zip(*(one(value.as_py().encode()) for value in batch.column(1)), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    rows = docs.select(F.col(key), F.coalesce(F.col("text") if text is None else text, F.lit("")).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {DIGESTS}")
