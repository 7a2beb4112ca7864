"""Secret scans: three fixed kinds, and strings in a sensitive context that dictionary-primed zstandard can't compress."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_columns, slices, text_or_empty

# The base kinds, on bytes, where case folding and classes are ASCII.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # greedy runs, so the same as runs of any length of which 32 and more are kept
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("novelty", T.IntegerType())])
KINDS = ("assign", "access", "hex", "novel")

#: Words after which, within REACH bytes, a string may be a secret.
CONTEXT = re.compile(rb"pass(?:word|wd|phrase)|pwd|secret|token|api.?key|access.?key|private.?key|auth|bearer|credential|signature|session.?id|client.?id|connection.?string", re.I)
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~.-]{14,}")
REACH = 80
#: Bytes of text on each side that prime the compressor, besides the identifiers.
AROUND = 400
#: A candidate is novel if it adds at least so many bytes, and so many for each of its own or for each that a random string
#: of its length over its own characters adds: from about 64 bytes on zstandard also codes a small alphabet shorter.
NOVEL_BYTES, NOVEL_RATE = 10, 0.8
# Identifiers of code and configuration that are no secrets.
IDENTIFIERS = b"""
configuration environment application_name access_token refresh_token client_secret client_id connection_string
authorization authentication credentials_provider session_id session_token private_key public_key signature_version
password_reset_url password_hash encryption_key decryption_key example.com localhost 127.0.0.1 0.0.0.0 https://www.
index.html package.json requirements.txt application/json content-type text/plain charset=utf-8 version-1.0.0
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 changeme placeholder your_api_key_here xxxxxxxxxxxx
import_module get_parameter set_parameter read_file write_file user_name database_url max_connections timeout_seconds
"""


def novelty(candidate: bytes, around: bytes) -> int:
    """Bytes that the candidate adds to a zstandard frame primed with the identifiers and the text around it."""
    import zstandard

    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    c = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
    return len(c.compress(candidate)) - len(c.compress(b""))


@lru_cache(4096)
def random_cost(alphabet: bytes, length: int) -> int:
    """Bytes that a random string (seeded, so the same on every run) of an alphabet and length adds to a primed frame."""
    return novelty(bytes(random.Random(length).choices(alphabet, k=length)), b"")


def is_novel(candidate: bytes, added: int) -> bool:
    if added < NOVEL_BYTES:
        return False
    return added >= NOVEL_RATE * len(candidate) or added >= NOVEL_RATE * random_cost(bytes(sorted(set(candidate))), len(candidate))


def find(text: bytes) -> list[tuple[int, int, int, int | None]]:
    """(kind, start, end, novelty) by start, then kind; places in bytes; novelty only for what the method adds."""
    out: list[tuple[int, int, int, int | None]] = []
    if b"=" in text or b":" in text:
        out += [(0, m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        out += [(1, m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, m.start(), m.end(), None) for m in HEX.finditer(text)]
    base = [(a, b) for _, a, b, _ in out]
    seen = 0
    for word in CONTEXT.finditer(text):
        at = max(seen, word.end())
        while (m := CANDIDATE.search(text, at, len(text))) and m.start() <= word.end() + REACH:
            at = seen = m.end()
            c = m[0]
            mixed = any(48 <= x <= 57 for x in c) and any(x > 64 for x in c)
            if not mixed or any(a < m.end() and m.start() < b for a, b in base):
                continue
            around = text[max(0, m.start() - AROUND) : m.start()] + b"\n" + text[m.end() : m.end() + AROUND]
            if is_novel(c, n := novelty(c, around)):
                out.append((3, m.start(), m.end(), n))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _run(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in slices(batches):
        spans = []
        for text in b.column(1).cast(pa.binary()).to_pylist():
            found, points, done, said = find(text or b""), 0, 0, []
            places: dict[int, int] = {}
            for at in sorted({p for _, s, e, _ in found for p in (s, e)}):
                points += len(text[done:at].decode("utf-8"))
                places[at], done = points, at
            for kind, s, e, n in found:
                said.append({"kind": KINDS[kind], "start": places[s], "end": places[e], "novelty": n})
            spans.append(said)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(spans, kind)], [*b.schema.names, "spans"])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, text and spans(kind, start, end, novelty) of docs, in code points, end exclusive, by start, then kind.

    Kinds: assign, access and hex are fixed patterns; novel is a string of 14 bytes and more with a letter and a digit,
    soon after a sensitive word, that adds nearly its own length, or what a random string of its length and characters
    adds, to a frame primed with the text around it and with identifiers. Kinds may overlap, novel ones overlap none of the others. Null and empty texts have no spans; texts are
    scanned whole, one row for each row, without a shuffle.
    """
    d = docs.select(F.col(f"`{keep[0]}`"), F.col(f"`{text}`"), *(F.col(f"`{c}`") for c in keep[1:]))  # the text comes second
    return d.mapInArrow(_run, T.StructType([*d.schema.fields, T.StructField("spans", T.ArrayType(SPAN))]))


def digest(spans, base_only: bool):
    chosen = F.filter(spans, lambda s: s["kind"] != "novel") if base_only else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kind: str):
    return lambda x: x["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for docs(doc_id, text)."""
    s = scan(doc_columns(docs, "doc_id", "text"))
    n = [F.size(F.filter("spans", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return s.select("doc_id", *n, F.sha2(digest(F.col("spans"), True), 256).alias("base_sha256"), digest(F.col("spans"), False).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of the text replaced by mark, overlapping ones by one; other columns stay, but n_chars, where
    there is one, follows the text. Texts without spans, empty and null ones stay as they are."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no input column clashes with spans
    at = inner["text"]
    s = scan(docs.toDF(*inner.values()), text=at, keep=tuple(x for x in inner.values() if x != at))
    text = text_or_empty(at)
    # pieces between spans, in order: where a span ends inside an earlier one it adds nothing
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        between = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate("spans", state, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    s = s.withColumn(at, F.when(F.size("spans") > 0, whole).otherwise(F.col(at)))
    if (n := inner.get("n_chars")) is not None:
        s = s.withColumn(n, F.when(F.size("spans") > 0, F.length(at).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    return s.select(*(F.col(x).alias(c) for c, x in inner.items()))
