"""SentencePiece encoding and decoding as a weighted transducer.

The normaliser (a space is written as U+2581, a text begins with one), the piece lexicon and byte
fallback are compiled into one machine over characters: the normaliser is composed with the
lexicon at compile time, so an arc reads the character that stands in the text. Composition with an
input gives a lattice of pieces, whose tropical shortest path is the encoding. Piece scores of a
byte-pair model are ranks; the weight of rank r is -ln of its Zipf share 1 / ((r + 2) * H).
Decoding writes each piece's bytes and is exact for every text, a literal U+2581 included, as that
has no arc and falls back to bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Weights are whole millionths, so that sums are exact and ties are real.
SCALE = 1_000_000
#: Bytes of segments and their paths that a Python worker remembers, at most about, in two generations of half as many;
#: and what it does where other stages have run in the same executors, then for one task only.
REMEMBERED_BYTES, SPARE_BYTES = 72 << 20, 24 << 20


def read_pieces(path: str = MODEL) -> list[tuple[str, int, int]]:
    """(text, id, kind) of a model file's usable pieces; kind is the byte value of a byte piece, else -1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            out.append((model.id_to_piece(i), i, int(model.id_to_piece(i)[3:5], 16)))
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i), i, -1))
    return out


class Transducer:
    """Compiled machine. A state is [arcs by character, piece id or -1, weight]."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        lexicon = [(text, i) for text, i, byte in pieces if byte < 0]
        top = max((i for _, i, _ in pieces), default=0) + 1
        share = sum(1 / (r + 2) for r in range(top + 1))
        weight = lambda rank: round(SCALE * math.log((rank + 2) * share))
        self.root: list = [{}, -1, 0]
        self.bytes_of = [b""] * top
        self.byte_ids = [-1] * 256
        for text, i, byte in pieces:
            if byte >= 0:
                self.byte_ids[byte] = i
                self.bytes_of[i] = bytes([byte])
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        self.byte_weight = weight(top)
        for text, i in lexicon:
            if " " in text:
                raise ValueError("a piece holds a bare space")
            read = text.replace(MARK, " ")
            state = self.root
            for ch in read:
                state = state[0].setdefault(ch, [{}, -1, 0])
            state[1], state[2] = i, weight(i)
            self.bytes_of[i] = read.encode()
        # Where no piece can span, the lattice has a single node, so parts can be solved apart:
        # before a space that follows another character, and around white space in no piece.
        spanning = any(MARK in text.lstrip(MARK) for text, _ in lexicon)
        known = {ch for text, _ in lexicon for ch in text}
        apart = "".join(ch for ch in "\n\t\r" if ch not in known)
        if spanning:
            self.parts = re.compile(r".+", re.S).findall
        else:
            self.parts = re.compile(rf" *[^ {apart}]+| +|[{apart}]" if apart else r" *[^ ]+| +").findall
        self.remembered = REMEMBERED_BYTES
        self.forget()

    def forget(self) -> None:
        """Drop the segments that are remembered."""
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.young_bytes = 0

    def shortest(self, text: str) -> tuple[int, ...]:
        """Ids of the least-weight path; of equal weights, the path whose last pieces are longest."""
        n = len(text)
        best = [math.inf] * (n + 1)
        back: list = [None] * (n + 1)
        best[0] = 0
        root, cheapest = self.root[0], self.byte_weight  # of a byte
        for i in range(n):
            base = best[i]
            state = root.get(text[i])
            j = i + 1
            while state is not None:
                if state[1] >= 0 and base + state[2] < best[j]:
                    best[j], back[j] = base + state[2], (i, state[1])
                state = state[0].get(text[j]) if j < n else None
                j += 1
            if base + cheapest < best[i + 1]:
                raw = text[i].encode("utf-8", "surrogatepass")
                far = base + cheapest * len(raw)
                if far < best[i + 1]:
                    best[i + 1], back[i + 1] = far, (i, raw)
        out: list[int] = []
        while n:
            n, piece = back[n]
            if isinstance(piece, bytes):
                out += [self.byte_ids[b] for b in reversed(piece)]
            else:
                out.append(piece)
        return tuple(reversed(out))

    def encode(self, text: str) -> list[int]:
        """Ids of a text; an empty text has none."""
        if not text:
            return []
        out: list[int] = []
        young = self.young
        for part in self.parts(" " + text):
            ids = young.get(part)
            if ids is None:
                ids = self.old.get(part) or self.shortest(part)
                if len(part) < 64:
                    young[part] = ids
                    self.young_bytes += 200 + 4 * len(part) + 8 * len(ids)  # of the text, the tuple and their place
                    if self.young_bytes > self.remembered // 2:
                        self.old, self.young, self.young_bytes = young, {}, 0
                        young = self.young
            out += ids
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]

    def decode(self, ids) -> str:
        """The text of ids; ids that were cut inside a character decode with replacement marks."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def compiled(pieces: tuple) -> Transducer:
    return Transducer(list(pieces))


def _encoder(pieces: tuple, width: int, with_ids: bool, remembered: int):
    fallback = {i for _, i, byte in pieces if byte >= 0}

    def rows(batches):
        machine = compiled(pieces)
        machine.remembered = remembered
        small = np.zeros(max(i for _, i, _ in pieces) + 1, bool)
        small[list(fallback)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, count, low, sha, same = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    text = text or ""
                    own = np.array(machine.encode(text), np.int32)
                    back = machine.decode_bytes(own.tolist())
                    count.append(len(own))
                    low.append(int(small[own].sum()))
                    sha.append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
                    same.append(back == text.encode())
                    if with_ids:
                        ids.append(own)
                cols = [part.column(i) for i in range(width)] + [pa.array(count, pa.int64()), pa.array(low, pa.int64()), pa.array(sha), pa.array(same)]
                names = batch.schema.names[:width] + ["n_pieces", "n_byte_pieces", "ids_sha256", "decodes"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
        if remembered <= SPARE_BYTES:
            machine.forget()  # workers are reused

    return rows


def encoded(docs: DataFrame, model: str = MODEL, with_ids: bool = True, remembered: int = REMEMBERED_BYTES) -> DataFrame:
    """docs with n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit integers),
    decodes (decoding gives the text back) and, if asked, ids.

    Null text is empty and has no pieces. Columns of docs that clash with these names are replaced.
    The vocabulary goes to the tasks; its size does not depend on the documents. remembered: bytes of paths that a
    worker keeps, more of them for less work; up to SPARE_BYTES they are dropped at a task's end.
    """
    made = ["n_pieces", "n_byte_pieces", "ids_sha256", "decodes", "ids"]
    docs = docs.drop(*made)
    schema = docs.withColumns({"n_pieces": F.lit(0).cast("long"), "n_byte_pieces": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decodes": F.lit(True)})
    if with_ids:
        schema = schema.withColumn("ids", F.array(F.lit(0)))
    return docs.mapInArrow(frugal(_encoder(tuple(read_pieces(model)), len(docs.columns), with_ids, remembered)), schema.schema)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows (with ids) and `text`, decoded; null ids give an empty text."""
    pieces = tuple(read_pieces(model))
    rows = rows.drop("text")
    width = len(rows.columns)

    def run(batches):
        machine = compiled(pieces)
        for batch in batches:
            text = pa.array([machine.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], text], [*batch.schema.names, "text"])

    return rows.mapInArrow(frugal(run), rows.withColumn("text", F.lit("")).schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encoded(docs, with_ids=False).drop("text")
