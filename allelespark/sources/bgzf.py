"""Lines of block-gzipped files, by byte ranges: every block is a gzip member of at most 64 KiB that states its own size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from .plink import _open

# How a block's header begins, and the subfield that holds its size.
MAGIC, SUBFIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
#: Bytes of a file that one task reads, and bytes asked for at once.
RANGE, READ = 32 << 20, 1 << 20


def is_blocked(path: str) -> bool:
    with _open(path) as f:
        head = f.read(18)
    return head[:4] == MAGIC and head[12:16] == SUBFIELD


def _block_size(data: bytes, at: int) -> int:
    """The size of the block that begins at a place of data, 0 if none does."""
    if data[at : at + 4] != MAGIC or data[at + 12 : at + 16] != SUBFIELD or len(data) < at + 18:
        return 0
    return int.from_bytes(data[at + 16 : at + 18], "little") + 1


def _blocks(f, begin: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of each block from the first that begins at begin or later."""
    at, buffer = begin, b""

    def fill(n: int) -> None:
        nonlocal buffer
        while len(buffer) < n and at + len(buffer) < size:
            more = f.read_at(min(READ, size - at - len(buffer)), at + len(buffer))
            if not more:
                break
            buffer += more

    fill(1 << 17)
    skip = 0
    while begin and skip < len(buffer):
        skip = buffer.find(MAGIC, skip)
        if skip < 0:
            return
        n = _block_size(buffer, skip)
        # what looks like a header is one if a block follows it, or the file ends there
        if n and (at + skip + n == size or _block_size(buffer, skip + n)):
            break
        skip += 1
    buffer, at = buffer[skip:], at + skip
    while True:
        fill(1 << 17)
        n = _block_size(buffer, 0)
        if not n:
            return
        yield at, zlib.decompress(buffer[:n], 31)
        buffer, at = buffer[n:], at + n


def _lines(path: str, size: int):
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        with _open(path) as f:
            for pdf in batches:
                for begin in pdf["id"].tolist():
                    end, rest, out, inside, owed = min(begin + RANGE, size), b"", [], begin == 0, False
                    for at, text in _blocks(f, begin, size):
                        if at >= end and not (inside and owed):
                            break
                        late = at >= end
                        pieces = (rest + text).split(b"\n")
                        rest = pieces.pop()
                        if not inside and pieces:  # the line that an earlier range began
                            pieces.pop(0)
                            inside = True
                        elif not inside:
                            rest = b""
                        if late:
                            pieces = pieces[:1]
                        out += pieces
                        owed = not (late and pieces)
                        if late and pieces:
                            rest = b""
                            break
                        if len(out) >= 5000:
                            yield pd.DataFrame({"value": [x.decode() for x in out]})
                            out = []
                    if rest and inside:
                        out.append(rest)
                    yield pd.DataFrame({"value": [x.decode() for x in out]}, dtype=object)

    return run


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, a row a line. A range owns the lines that begin in its blocks, after the first one's own first line; it reads on
    to the end of its last line. Executors must reach path by pyarrow's file systems."""
    with _open(path) as f:
        size = f.size()
    ranges = spark.range(0, size, RANGE, numPartitions=max(1, -(-size // RANGE)))
    return ranges.mapInPandas(_lines(path, size), "value string")
