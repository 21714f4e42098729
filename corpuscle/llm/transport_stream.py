"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

Writing: a document's bytes become 8-bit samples in frames of 576. Eight frames are an access unit, carried in one PES
packet with a 90 kHz timestamp on a private-data stream. Every sixteenth unit is a random-access point: its first packet has
the random-access flag and a clock reference, and the program tables (PAT, PMT) are repeated before it.

Reading: program tables are found by PID and checked by their CRC, continuity counters are checked per PID, PES packets are
put together again, and timestamps are stored with the random-access points. A packet may come twice in a row (alike but for its
clock reference) and counts once; a jump of a counter that the discontinuity flag announces is none. Whole columns of packet
headers are parsed at once.

Scale: documents are independent, no shuffle; each step holds about 4 MB of text.

Defined results: null and empty texts give one frame of 255s; equal texts give equal streams; rows that repeat are repeated, and
a null doc_id is one like any other; a text of any length is one stream, its timestamps start again after 2**33 ticks; an empty
table gives an empty result; other columns are ignored. A stream that is not whole packets with sync bytes, or has
no program, raises ValueError; lost packets are counted, and a unit with a gap is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base

FRAME = 576
UNIT = 8 * FRAME
#: Units from one random-access point to the next.
RAP_EVERY = 16
#: 90 kHz ticks of a frame at 48,000 samples a second.
TICKS = 1080
PACKET = 188
PAT_PID, PMT_PID, DATA_PID = 0, 0x1000, 0x100
PRIVATE_PES = 6

UNITS = "array<struct<offset: long, size: long, pts: long, random_access: boolean>>"


def payload_of(raw: bytes) -> bytes:
    """Padded with 255 to a positive multiple of a frame."""
    return raw + b"\xff" * (FRAME - len(raw) if not raw else -len(raw) % FRAME)


@lru_cache(maxsize=256)
def section_crc(section: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its CRC."""
    crc = 0xFFFFFFFF
    for byte in section:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, table: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + table.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _psi(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return np.frombuffer(_psi(PAT_PID, pat) + _psi(PMT_PID, pmt), np.uint8).reshape(2, PACKET)


@lru_cache(maxsize=64)
def _layout(n: int, rap: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packets without content for a PES packet of n bytes, and where its bytes go."""
    packets, places, left = [], [], n
    while left:
        first = not packets
        field = bytes([7, 0x50]) + b"\0" * 6 if first and rap else b""
        room = PACKET - 4 - len(field)
        if left < room:
            spare = room - left
            if field:
                field = bytes([7 + spare]) + field[1:] + b"\xff" * spare
            else:
                field = bytes([spare - 1]) + (b"\0" + b"\xff" * (spare - 2) if spare > 1 else b"")
            room = left
        head = bytes([0x47, DATA_PID >> 8 | 0x40 * first, DATA_PID & 255, 0x30 if field else 0x10]) + field
        places.append(np.arange(room) + len(packets) * PACKET + len(head))
        packets.append(head.ljust(PACKET, b"\0"))
        left -= room
    return np.frombuffer(b"".join(packets), np.uint8), np.concatenate(places)


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | ticks >> 29 & 14 | 1, ticks >> 22 & 255, ticks >> 14 & 254 | 1, ticks >> 7 & 255, ticks << 1 & 254 | 1])


def mux(raw: bytes) -> bytes:
    """The transport stream of a document's bytes."""
    payload = payload_of(raw)
    out, counter = [], 0
    for k, start in enumerate(range(0, len(payload), UNIT)):
        rap = k % RAP_EVERY == 0
        part = payload[start : start + UNIT]
        ticks = start // FRAME * TICKS % (1 << 33)
        pes = b"\0\0\x01\xbd" + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + part
        if rap:
            tables = _tables().copy()
            tables[:, 3] |= k // RAP_EVERY & 15
            out.append(tables.tobytes())
        blank, places = _layout(len(pes), rap)
        packets = blank.copy()
        packets[places] = np.frombuffer(pes, np.uint8)
        n = len(packets) // PACKET
        packets[3::PACKET] |= ((counter + np.arange(n)) & 15).astype(np.uint8)
        counter += n
        if rap:
            packets[6:12] = np.frombuffer((ticks << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, starts: np.ndarray) -> bytes:
    """The first section in packets of one PID that has a right CRC. A section may go on over packets, and several may share one."""
    held = None
    for p, at in zip(packets, starts, strict=True):
        body = p[at:].tobytes()
        parts = [body] if held is not None else []
        if p[1] & 0x40:  # a section begins after as many bytes as the pointer says; what stands before ends the last one
            parts = [body[1 : 1 + body[0]] if held is not None else b"", body[1 + body[0] :]]
        for k, part in enumerate(parts):
            held = part if k or held is None else held + part
            while len(held) > 2 and held[0] != 0xFF:
                size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
                if len(held) < size:
                    break
                section, held = held[:size], held[size:]
                if size > 8 and section_crc(section) == 0:
                    return section
    raise ValueError("no program table with a right CRC")


def _programs(a: np.ndarray, pid: np.ndarray, start: np.ndarray) -> int:
    """PID of the first elementary stream of the first program."""
    pat = _sections(a[pid == PAT_PID], start[pid == PAT_PID])
    for i in range(8, len(pat) - 4, 4):
        if int.from_bytes(pat[i : i + 2], "big"):
            own = int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF
            pmt = _sections(a[pid == own], start[pid == own])
            at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
            return int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    raise ValueError("no program")


def _followed(a: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packets of one PID (their places) without second copies, and whether the counter jumps before each."""
    p = a[here]
    count = p[:, 3] & 15
    again = np.flatnonzero(np.diff(count) == 0) + 1
    if len(again):
        alike = p[again] == p[again - 1]
        clocked = (p[again, 3] & 0x20 > 0) & (p[again, 4] > 0) & (p[again, 5] & 0x10 > 0)
        alike[clocked, 6:12] = True
        copy = np.zeros(len(here), bool)
        copy[again[alike.all(axis=1)]] = True
        copy[1:] &= ~copy[:-1].copy()  # twice, not three times
        here, p = here[~copy], p[~copy]
        count = p[:, 3] & 15
    jump = np.zeros(len(here), bool)
    jump[1:] = np.diff(count) & 15 != 1
    announced = (p[:, 3] & 0x20 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x80 > 0)
    return here, jump & ~announced


def demux(stream: bytes) -> tuple[bytes, list[tuple[int, int, int, bool]], int]:
    """The samples, (offset, size, timestamp, random access) of each unit, and how often a counter jumps."""
    a = np.frombuffer(stream, np.uint8)
    if not len(a) or len(a) % PACKET or (a[::PACKET] != 0x47).any():
        raise ValueError("not whole packets")
    a = a.reshape(-1, PACKET)
    pid = (a[:, 1] & 0x1F).astype(np.int32) << 8 | a[:, 2]
    control = a[:, 3] >> 4 & 3
    start = 4 + np.where(control & 2, a[:, 4].astype(np.int32) + 1, 0)
    if not (pid == PAT_PID).any():
        raise ValueError("no program")
    data = _programs(a, pid, start)
    bad, here, gap = 0, np.zeros(0, np.int64), np.zeros(0, bool)
    for own in np.unique(pid).tolist():
        kept, jumps = _followed(a, np.flatnonzero((pid == own) & (control & 1 > 0)))
        bad += int(jumps.sum())
        if own == data:
            here, gap = kept, jumps
    p, at = a[here], start[here]
    body = p[np.arange(PACKET) >= at[:, None]].tobytes()
    ends = np.cumsum(PACKET - at)
    first = np.flatnonzero(p[:, 1] & 0x40)
    flagged = (control[here] & 2 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x40 > 0)
    samples, units, offset = [], [], 0
    for i, f in enumerate(first.tolist()):
        last = int(first[i + 1]) if i + 1 < len(first) else len(here)
        pes = body[int(ends[f] - (PACKET - at[f])) : int(ends[last - 1])]
        size = int.from_bytes(pes[4:6], "big")
        whole = pes[: 6 + size] if size else pes
        if pes[:3] != b"\0\0\x01" or size and len(pes) < 6 + size or gap[f + 1 : last].any():
            continue
        pts = -1
        if whole[7] & 0x80:
            s = whole[9:14]
            pts = (s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1
        part = whole[9 + whole[8] :]
        samples.append(part)
        units.append((offset, len(part), pts, bool(flagged[f])))
        offset += len(part)
    return b"".join(samples), units, bad


def feature(payload: bytes, units: list[tuple[int, int, int, bool]], bad: int) -> str:
    """Counts, the span of timestamps, and integer moments of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    change = int(np.abs(np.diff(x)).sum()) if len(x) else 0
    return f"units={len(units)};random_access={sum(u[3] for u in units)};pts={units[0][2] if units else -1}-{units[-1][2] if units else -1};jumps={bad};sum={int(x.sum())};squares={int((x * x).sum())};change={change}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (before padding) and media, the stream."""

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.steps(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(map(mux, raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return _base.texts(docs).mapInArrow(wrap, "doc_id long, n_bytes long, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Reads the column `media`: the rest stays, and payload, units, jumps and feature come in its place."""
    rest = [c for c in media.columns if c != "media"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name != "media")
    cell = pa.struct([("offset", pa.int64()), ("size", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.steps(batches, "media"):
            got = [demux(m) for m in b.column("media").to_pylist()]
            units = pa.array([[dict(zip(("offset", "size", "pts", "random_access"), u, strict=True)) for u in g[1]] for g in got], pa.list_(cell))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in rest), pa.array([g[0] for g in got], pa.binary()), units, pa.array([g[2] for g in got], pa.int64()), pa.array([feature(*g) for g in got], pa.string())],
                [*rest, "payload", "units", "jumps", "feature"],
            )

    return media.mapInArrow(read, f"{kind}, payload binary, units {UNITS}, jumps long, feature string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = to_media(_base.table(spark, sf_dir, "documents"))
    stored = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    tail = F.expr("substring(payload, length(payload) - 31, 32)")
    return from_media(stored).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
