"""Media columns as MPEG transport streams: texts' bytes carried in elementary packets, parsed back and described."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, slices

PACKET, FRAME = 188, 576
#: Frames in an elementary packet, packets between random-access points, ticks of 90 kHz for each frame.
FRAMES, ACCESS_EVERY, TICKS = 16, 8, 2160
PMT_PID, STREAM_PID, STREAM_ID, STREAM_TYPE = 0x1000, 0x0101, 0xBD, 0x06


@functools.cache
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _crc_table()[c >> 24 ^ x]
    return c


def _section(table_id: int, body: bytes, number: int) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@functools.cache
def _tables() -> bytes:
    """A program association and a program map packet."""
    pat = _section(0, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]), 1)
    pmt = _section(2, bytes([0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | STREAM_PID >> 8, STREAM_PID & 0xFF, 0xF0, 0]), 1)
    out = b""
    for pid, section in ((0, pat), (PMT_PID, pmt)):
        out += (bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")
    return out


def _stamp(t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    """A stream of one program: tables, then packets of FRAMES frames, each stamped, every ACCESS_EVERY-th an access point."""
    out, counter, step = [_tables()], 0, FRAME * FRAMES
    for k, a in enumerate(range(0, len(payload), step)):
        unit, t = payload[a : a + step], k * FRAMES * TICKS
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\5" + _stamp(t) + unit
        lead = b""
        if k % ACCESS_EVERY == 0:
            lead = bytes([7, 0x50]) + (t << 15 | 0x7E00).to_bytes(6, "big")  # random access, clock reference
        first = PACKET - 4 - len(lead)
        n = 1 + max(0, -(-(len(pes) - first) // (PACKET - 4)))
        p = np.full((n, PACKET), 255, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 0xFF
        p[0, 1] |= 0x40
        p[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        spare = first + (n - 1) * (PACKET - 4) - len(pes)
        body, data = p[:, 4:], np.frombuffer(pes, np.uint8)
        if n > 1:
            body[0, len(lead) :] = data[:first]
            body[1:-1] = data[first : first + (n - 2) * (PACKET - 4)].reshape(-1, PACKET - 4)
            tail = data[first + (n - 2) * (PACKET - 4) :]
        else:
            tail = data
        if lead:
            p[0, 3] |= 0x20
            body[0, : len(lead)] = np.frombuffer(lead, np.uint8)
        body[-1, PACKET - 4 - len(tail) :] = tail
        if spare:
            own = (lead[1:] if n == 1 else b"") or (b"\0" if spare > 1 or n == 1 and lead else b"")
            p[-1, 3] |= 0x20
            length = PACKET - 5 - len(tail)
            body[-1, 0] = length
            if length:
                body[-1, 1 : 1 + len(own)] = np.frombuffer(own, np.uint8)
        out.append(p.tobytes())
    return b"".join(out)


def demux(stream: bytes) -> dict:
    """The first program's first stream: payload, stamps, access points and what was wrong with the packets.

    Raises ValueError where there are no whole packets, no tables, or a packet's length does not hold.
    """
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    pid = (p[:, 1] & 0x1F).astype(int) << 8 | p[:, 2]

    def section(which: int, table: int) -> bytes:
        rows = np.flatnonzero((pid == which) & (p[:, 1] & 0x40 > 0))
        if not len(rows):
            raise ValueError(f"no table {table}")
        raw = p[rows[0], 4:].tobytes()
        raw = raw[1 + raw[0] :]
        raw = raw[: 3 + ((raw[1] & 15) << 8 | raw[2])]
        if raw[0] != table or crc32_mpeg(raw):
            raise ValueError(f"table {table} is damaged")
        return raw

    pat = section(0, 0)
    pmt_pid = (pat[10] & 0x1F) << 8 | pat[11]
    pmt = section(pmt_pid, 2)
    at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
    es = (pmt[at + 1] & 0x1F) << 8 | pmt[at + 2]
    own = p[pid == es]
    carries = own[:, 3] & 0x10 > 0
    field = own[:, 3] & 0x20 > 0
    counters = own[carries, 3] & 15
    errors = int(((counters[1:] - counters[:-1] & 15) != 1).sum())
    begin = np.where(field, 5 + own[:, 4].astype(int), 4)
    start = own[:, 1] & 0x40 > 0
    access = field & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    used = np.arange(PACKET) >= begin[:, None]
    used[~carries] = False
    data = own[used].tobytes()
    ends = np.cumsum(used.sum(1))
    rows = np.flatnonzero(start)
    edges = [*(ends[rows] - used[rows].sum(1)).tolist(), len(data)]
    units, stamps = [], []
    for a, b in zip(edges, edges[1:], strict=False):
        head = data[a : a + 9]
        length = head[4] << 8 | head[5]
        if head[:3] != b"\0\0\1" or length and length != b - a - 6:
            raise ValueError("an elementary packet is damaged")
        stamps.append(_read_stamp(data[a + 9 : a + 14]) if head[7] & 0x80 else None)
        units.append(data[a + 9 + head[8] : b])
    return {"payload": b"".join(units), "stamps": stamps, "access": np.flatnonzero(access[rows]).tolist(), "packets": len(p), "units": len(units), "errors": errors, "units_bytes": [len(u) for u in units]}


def pad(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of FRAME."""
    return text + b"\xff" * (FRAME - len(text) % FRAME if len(text) % FRAME or not text else 0)


def feature(d: dict) -> str:
    """What the stream shows: packets, elementary packets, access points, first and last stamp, continuity errors, and the
    payload's mean sample and its mean absolute step."""
    x = np.frombuffer(d["payload"], np.uint8).astype(np.int16)
    return f"packets={d['packets']};units={d['units']};access={len(d['access'])};stamps={d['stamps'][0]}-{d['stamps'][-1]};errors={d['errors']};mean={x.mean():.6f};step={np.abs(np.diff(x)).mean():.6f}"


def _run(full: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            rows = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                stream = mux(pad(text))
                d = demux(stream)
                back = d["payload"]
                row = {"n_bytes": len(text), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "feature": feature(d)}
                rows.append(row | ({"media": stream, "stamps": d["stamps"], "access": d["access"]} if full else {}))
            kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
            if full:
                kinds |= {"media": pa.binary(), "stamps": pa.list_(pa.int64()), "access": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items())], ["doc_id", *kinds])

    return run


def media_columns(docs: DataFrame, full: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): the padded bytes stored as a transport stream, read back and described.

    full adds the stream itself, the time stamps of its elementary packets and which of them are random-access points.
    Null counts as empty, whose payload is one frame of 255. Equal texts give equal values. Nothing is shuffled.
    """
    docs = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.mapInArrow(_run(full), schema + (", media binary, stamps array<long>, access array<long>" if full else ""))
