"""Byte-level BPE: pre-tokenisation by class arrays and transition-function scans, cached pair merging, decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, slices

#: Symbols of the automaton: letter, number, other, apostrophe that could open a contraction of one or of two letters,
#: white space but the space, the space, end of a text.
L, N, O, A1, A2, W, P, E = range(8)
#: States: nothing open, in letters, in numbers, in others, after white space but a space, after a space, in a contraction
#: with one or with two letters to come, after a whole contraction.
NONE, IN_L, IN_N, IN_O, AFTER_W, AFTER_P, ONE_LEFT, TWO_LEFT, DONE = range(9)

# Code points with the White_Space property, and the contractions of the pattern.
SPACES = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _step(state: int, symbol: int) -> int:
    if symbol == L and state == TWO_LEFT:
        return ONE_LEFT
    if symbol == L and state == ONE_LEFT:
        return DONE
    if symbol in (A1, A2):
        return IN_O if state in (IN_O, AFTER_P) else (ONE_LEFT if symbol == A1 else TWO_LEFT)
    return {L: IN_L, N: IN_N, O: IN_O, W: AFTER_W, P: AFTER_P, E: NONE}[symbol]


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The monoid of the symbols' transition functions: each symbol's element, the table that composes two elements,
    the state each element leads to from NONE, and whether a token begins at a symbol read in a state."""
    generators = [tuple(_step(s, c) for s in range(9)) for c in range(8)]
    elements = list(dict.fromkeys(generators))
    for f in elements:  # grows while it is walked: the closure under composition
        elements += [h for g in generators if (h := tuple(g[x] for x in f)) not in elements]
    index = {f: i for i, f in enumerate(elements)}
    assert len(elements) <= 256
    table = np.array([[index[tuple(g[x] for x in f)] for g in elements] for f in elements], np.uint8)
    begins = np.ones((9, 8), bool)
    begins[[IN_L, AFTER_P, ONE_LEFT, TWO_LEFT], L] = False
    begins[[IN_N, AFTER_P], N] = False
    for c in (O, A1, A2):
        begins[[IN_O, AFTER_P], c] = False
    for c in (W, P):
        begins[[AFTER_W, AFTER_P], c] = False
    return np.array([index[g] for g in generators], np.uint8), table, np.array([f[NONE] for f in elements], np.uint8), begins


def scan(elements: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Inclusive prefix products: blocks side by side, then the blocks' own products, then both composed."""
    n = len(elements)
    width = 256
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), np.uint8)  # one column for each block, so that a step touches adjacent bytes
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, width).T
    flat, size = table.ravel(), table.shape[1]
    for i in range(1, width):
        grid[i] = flat[grid[i - 1].astype(np.intp) * size + grid[i]]
    totals = scan(grid[-1, :-1].copy(), table) if rows > 1 else grid[-1, :0]
    grid[:, 1:] = flat[totals.astype(np.intp)[None, :] * size + grid[:, 1:]]
    return np.ascontiguousarray(grid.T).ravel()[:n]


@functools.cache
def classes() -> np.ndarray:
    """Symbol of every code point, apostrophes as O."""
    kind = {"L": L, "N": N}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], O) for i in range(0x110000)), np.uint8, 0x110000)
    out[list(SPACES)] = W
    out[0x20] = P
    return out


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places at which tokens begin in texts laid end to end, each closed by one filler whose place is in ends."""
    c = classes()[points]
    c[ends] = E
    quote = np.flatnonzero((points == 0x27) & (c == O))
    if len(quote):
        far = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = far[quote + 1], far[quote + 2]
        c[quote[np.isin(one, [ord(x) for x in ONE_LETTER])]] = A1
        for x in TWO_LETTERS:
            c[quote[(one == ord(x[0])) & (two == ord(x[1]))]] = A2
    symbol, table, reached, begins = automaton()
    states = reached[scan(symbol[c], table)]
    before = np.concatenate([np.zeros(1, np.uint8), states[:-1]])
    starts = begins[before, c]
    blank = (c == W) | (c == P)
    after = np.concatenate([c[1:], np.array([E], np.uint8)])
    starts |= blank & (after < W)  # the last blank before a visible character stands alone or joins it
    return np.flatnonzero(starts)


#: Slices up to this many bytes are merged side by side and remembered; longer ones are merged one by one.
SIDE_BY_SIDE = 48
#: Slices remembered by one Python worker, about 200 bytes each, and bytes of text that are slices at once.
REMEMBERED, CHUNK = 60_000, 1 << 18


class Merger:
    """Token ids of slices, packed as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        self.none = len(self.pieces)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        get, keys, merged = self.ranks.get, array("q"), array("q")
        for piece, i in self.ranks.items():
            for k in range(1, len(piece)):
                x, y = get(piece[:k]), get(piece[k:])
                if x is not None and y is not None:
                    keys.append(x * (self.none + 1) + y)
                    merged.append(i)
        order = np.argsort(np.frombuffer(keys, np.int64))
        self.keys, self.merged = np.frombuffer(keys, np.int64)[order], np.frombuffer(merged, np.int64)[order]
        self.known: dict[bytes, bytes] = {}

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ids that adjacent tokens x and y merge to, none where they don't."""
        key = x * (self.none + 1) + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], self.none)

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of every slice in pieces; what is new is merged, side by side where it is short."""
        new = set(pieces).difference(self.known)
        if not new:
            return self.known
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(pieces)
        out, long_ = self.known, {}
        by_width: dict[int, list[bytes]] = {}
        for p in new:
            if (i := self.ranks.get(p)) is not None:
                out[p] = i.to_bytes(4, "little")
            elif len(p) <= SIDE_BY_SIDE:
                by_width.setdefault((len(p) + 3) // 4, []).append(p)
            else:
                long_[p] = np.array(self.merge(p), "<u4").tobytes()
        for width, group in by_width.items():
            self._merge_group(group, width * 4, out)
        return {**out, **long_} if long_ else out

    def _merge_group(self, group: list[bytes], width: int, out: dict[bytes, bytes]) -> None:
        """One merge of lowest rank a round in every slice that still has one, the first of equals."""
        size = np.array([len(p) for p in group])
        ids = self.bytes[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in group), np.uint8).reshape(-1, width)]
        place = np.arange(width)
        ids[place >= size[:, None]] = self.none
        low = np.full_like(ids, self.none)
        low[:, :-1] = self._pairs(ids[:, :-1], ids[:, 1:])
        done, open_ = np.empty_like(ids), np.arange(len(group))
        while len(open_):
            at = low.argmin(1)
            row = np.arange(len(at))
            best = low[row, at]
            going = best < self.none
            if not going.all():
                done[open_[~going]] = ids[~going]
                ids, low, open_, at, best = ids[going], low[going], open_[going], at[going], best[going]
                row = row[: len(at)]
            ids[row, at] = best
            source = place + (place > at[:, None])
            source[:, -1] = width - 1
            gone = at < width - 1
            ids, low = np.take_along_axis(ids, source, 1), np.take_along_axis(low, source, 1)
            ids[gone, -1] = low[:, -1] = self.none
            after = ids[row, np.minimum(at + 1, width - 1)]
            low[row, at] = self._pairs(best, after)
            has = at > 0
            low[row[has], at[has] - 1] = self._pairs(ids[row[has], at[has] - 1], best[has])
        counts = (done < self.none).sum(1)
        packed = done[done < self.none].astype("<u4").tobytes()
        stop = (np.cumsum(counts) * 4).tolist()
        for p, a, b in zip(group, [0, *stop[:-1]], stop, strict=True):
            out[p] = packed[a:b]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice of any length."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap over a linked list, so that time grows as n log n."""
        ranks, n = self.ranks, len(piece)
        end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def encode_texts(texts: list[bytes | None], m: Merger, chunk: int = CHUNK) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text its packed ids and the byte offsets at which its slices begin; texts go through in chunks of bytes."""
    i = 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size + len(texts[i] or b"") <= chunk):
            group.append(texts[i] or b"")
            size += len(group[-1]) + 1
            i += 1
        data = b"\0".join(group) + b"\0"
        raw = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # where code points begin
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        stops = np.cumsum([len(g) + 1 for g in group])
        starts = lead[token_starts(points, np.searchsorted(lead, stops - 1))]
        bounds = np.searchsorted(starts, stops)
        at = starts.tolist()
        pieces = [data[a:b] for a, b in zip(at, [*at[1:], len(data)], strict=True)]
        known = m.learn(pieces)
        begin = first = 0
        for g, stop, last in zip(group, stops.tolist(), bounds.tolist(), strict=True):
            # the last slice of each text is its filler
            yield b"".join(map(known.__getitem__, pieces[first : last - 1])), starts[first : last - 1] - begin
            begin, first = stop, last


def _lists(packed: list[bytes]):
    """An Arrow array of lists of 32-bit integers from their packed bytes, without an object for each number."""
    import pyarrow as pa

    ends = np.cumsum([0] + [len(x) // 4 for x in packed]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _run(path: str, full: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = merger(path)
        for b in slices(batches):
            n, ids_sha, back_sha, ok, ids_out, offsets_out = [], [], [], [], [], []
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for text, (ids, offsets) in zip(texts, encode_texts(texts, m), strict=True):
                back = m.decode(ids)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back_sha.append(hashlib.sha256(back).hexdigest())
                ok.append(back == (text or b""))
                if full:
                    ids_out.append(ids)
                    offsets_out.append(offsets.astype("<i4").tobytes())
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha), pa.array(ok)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]
            if full:
                columns += [_lists(ids_out), _lists(offsets_out)]
                names += ["ids", "slice_offsets"]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if k in (2, 3) else c for k, c in enumerate(columns)], names)

    return run


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def encode(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): n_tokens, SHA-256 of the packed ids and of the bytes they decode to,
    and whether these are the text's own; full adds ids and the byte offsets of the slices that were merged.

    path is a file of base64 pieces and ranks that every executor can read. Each slice of the pattern is merged on its
    own by lowest rank first. Null counts as empty, which has no tokens. Texts are encoded whole and stay in the row
    order and partitions they came in; nothing is shuffled.
    """
    docs = doc_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_run(path, full), DIGESTS + (", ids array<int>, slice_offsets array<int>" if full else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds text, decoded from ids; bytes that are no UTF-8 become U+FFFD, null ids stay null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = merger(path)
        for b in slices(batches):
            out = [None if x is None else m.decode(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "text"])

    bare = encoded.drop("text")
    return bare.mapInArrow(run, T.StructType([*bare.schema.fields, T.StructField("text", T.StringType())]))
