"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into windows that overlap. All windows are split into pre-tokens and encoded in
parallel, each from an arbitrary place. Neighbours are stitched at the first place inside their
overlap where both begin a pre-token: the pattern never looks back, so from there on they agree.
Ids are kept as little-endian unsigned 32-bit integers in one binary column; decoding
concatenates the raw bytes of the ids.

Segments that occur often are encoded once and remembered. They need a pattern by which white space
after something else begins a pre-token, as the public ones do.

Null text counts as empty and has no ids. Repeated rows stay repeated. Columns other than the id and
the text are ignored. An empty table gives an empty result. Strings that look like special tokens
are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loginlab.llm import chunks
from loginlab.llm.common import SEGMENT, TOKENIZER_FOLDER, per_process, table

# fixed value: the pre-token pattern that belongs to the rank files
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 32768  # characters
OVERLAP = 512
MOST_SEGMENTS = 200_000  # encoded segments kept by one process


class Segments(dict):
    """Ids of each segment, as integers and as decimals that each end with a comma."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, segment):
        if len(self) > MOST_SEGMENTS:
            self.clear()
        ids = self.encode(segment)
        found = self[segment] = pack(f"<{len(ids)}I", *ids), "".join([f"{n}," for n in ids])
        return found


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.path, self.pattern = path, pattern
        self.split = regex.compile(pattern)
        self.segments = Segments(self._encode_segment)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.token[n] = token
        self.decimal = [str(n) for n in range(len(self.token))]
        self.library = None  # made when something is encoded: decoding needs the tokens alone

    def _encode_segment(self, segment: str) -> list[int]:
        if self.library is None:
            import tiktoken

            ranks = {token: n for n, token in enumerate(self.token) if token}
            self.library = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.library.encode_ordinary(segment)

    def encode(self, text: str) -> bytes:
        return b"".join([self.segments[x][0] for x in SEGMENT.findall(text)])

    def encode_and_digest(self, text: str) -> tuple[bytes, str]:
        found = list(map(self.segments.__getitem__, SEGMENT.findall(text)))
        decimals = "".join([x[1] for x in found])[:-1]
        return b"".join([x[0] for x in found]), hashlib.sha256(decimals.encode()).hexdigest()

    def window(self, text: str, size: int, overlap: int):
        """⟨head starts, head ids, body ids, tail starts, tail ids⟩ of a window of ``size``
        characters and its overlap. Pre-tokens that more text could change are left out."""
        cut = len(text) == size + overlap
        found = [(m.start(), m.group()) for m in self.split.finditer(text)]
        if cut:
            sure = min(found[-1][0], len(text) - 3)  # a contraction has up to three characters
            found = [x for x in found if x[0] < sure]
        part = lambda a, b: [(s, self.segments[w][0]) for s, w in found if a <= s < b]
        head, tail = part(0, overlap), part(size, len(text))
        body = b"".join([ids for _, ids in part(overlap, size)])
        return [s for s, _ in head], [i for _, i in head], body, [s for s, _ in tail], [i for _, i in tail]

    def stitch(self, windows, size: int, overlap: int) -> bytes:
        """Ids of a text from its windows ⟨chunk, head starts, …, tail ids⟩ in order."""
        out, begin = [], 0
        for n, (chunk, head_at, head, body, tail_at, tail) in enumerate(windows):
            out += [ids for s, ids in zip(head_at, head) if s >= begin]
            out.append(body)
            if len(chunk) < size + overlap:
                return b"".join(out + tail)
            if n + 1 == len(windows):  # the text ends where the window ends
                break
            following = set(windows[n + 1][1])
            begin = next((s - size for s in tail_at if s - size in following), None)
            if begin is None:
                break
            out += [ids for s, ids in zip(tail_at, tail) if s - size < begin]
        return self.encode("".join(w[0][:size] if n + 1 < len(windows) else w[0] for n, w in enumerate(windows)))

    def digest(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, numbers)).encode()).hexdigest()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _codec(path: str, pattern: str) -> Codec:
    return per_process(("codec", path, pattern), lambda: Codec(path, pattern))


def encode(
    docs: DataFrame, path: str, id_col="doc_id", text_col="text", chunk=CHUNK, overlap=OVERLAP, pattern=PATTERN
) -> DataFrame:
    """⟨id, ids, n_tokens, ids_sha256⟩ per row of ``docs``; the digest is over the decimal ids
    joined by commas. Texts up to ``chunk`` bytes are encoded where they are read."""
    if overlap >= chunk:
        raise ValueError("the overlap must be smaller than the chunk")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                found = [codec.encode_and_digest(t) for t in part["text"].to_pylist()]
                ids = [x[0] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array(ids, pa.binary()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([x[1] for x in found], pa.string()),
                    ],
                    ["id", "ids", "n_tokens", "ids_sha256"],
                )

    out = f"id {kind}, ids binary, n_tokens long, ids_sha256 string"
    short = rows.where(F.octet_length("text") <= chunk).mapInArrow(whole, out)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                found = [codec.window(t, chunk, overlap) for t in part["chunk"].to_pylist()]
                kinds = [pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()]
                kinds += kinds[:2]
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in ("id", "row_key", "copies", "pos", "chunk")]
                    + [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)],
                    ["id", "row_key", "copies", "pos", "chunk", "head_at", "head", "body", "tail_at", "tail"],
                )

    fields = f"""id {kind}, row_key binary, copies long, pos int, chunk string, head_at array<int>,
        head array<binary>, body binary, tail_at array<int>, tail array<binary>"""

    def stitch(group):
        codec = _codec(path, pattern)
        group = group.sort_values("pos")
        names = ["chunk", "head_at", "head", "body", "tail_at", "tail"]
        parts = [tuple(row) for row in group[names].itertuples(index=False)]
        ids = codec.stitch([(c, [*a], [*h], b, [*t], [*i]) for c, a, h, b, t, i in parts], chunk, overlap)
        first = group.iloc[:1][["id", "copies"]].copy()
        first["ids"], first["n_tokens"], first["ids_sha256"] = [ids], len(ids) // 4, codec.digest(ids)
        return first

    pieces = chunks.deal(rows.where(F.octet_length("text") > chunk), chunk, overlap).mapInArrow(windows, fields)
    long_ = pieces.groupBy("id", "row_key").applyInPandas(
        stitch, f"id {kind}, copies long, ids binary, n_tokens long, ids_sha256 string"
    )
    long_ = long_.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")
    return short.unionByName(long_).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col="doc_id", pattern=PATTERN) -> DataFrame:
    """``encoded`` with the bytes of its ids in ``decoded`` instead of the ids."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                text = [codec.decode(x or b"") for x in part["ids"].to_pylist()]
                names = [n for n in part.schema.names if n != "ids"]
                yield pa.RecordBatch.from_arrays(
                    [*(part[n] for n in names), pa.array(text, pa.binary())], [*names, "decoded"]
                )

    return encoded.mapInArrow(run, ", ".join([*fields, "decoded binary"]))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZER_FOLDER}/byte_bpe_multi_50k.tiktoken"
    ids = encode(table(spark, sf_dir, "documents"), path)
    decoded = decode(ids, path)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
