"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Method: the rank file (base64 token, rank per line) is read once per Python worker; tiktoken merges each match of the
split pattern. A text longer than ``piece_bytes`` is cut beforehand at safe boundaries, where no match of the pattern
can span: before white space that follows other characters, or between an ASCII letter and an ASCII digit. A run that
has no such boundary stays whole. Decoding joins the raw bytes of the ids, which also works inside a character.

Defined cases: null and empty texts have no ids and decode to nothing; repeated rows are encoded each; an empty table
gives no rows; further columns are kept. The path must exist on the executors (a file of the environment, as installed
packages are).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tables import free_name, map_arrow, quoted

PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=[ \n\t\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, once per process."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about ``limit`` characters whose encodings join to the encoding of the text."""
    lo = 0
    while len(text) - lo > limit:
        cut = _SAFE.search(text, lo + limit)
        if cut is None:
            break
        yield text[lo : cut.start()]
        lo = cut.start()
    yield text[lo:]


def encode(coder: tiktoken.Encoding, text: str, limit: int = PIECE_CHARS) -> list[int]:
    """Ids of a text, long ones piece by piece."""
    if len(text) <= limit:
        return coder.encode_ordinary(text)
    return [i for piece in safe_pieces(text, limit) for i in coder.encode_ordinary(piece)]


def _with_column(docs: DataFrame, source: str, schema_fields: list[T.StructField], fn) -> DataFrame:
    """``docs`` and new columns made from one column, batch by batch; ``fn`` maps an Arrow column to Arrow columns."""
    names, place = docs.columns, docs.columns.index(source)
    new = [f.name for f in schema_fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *fn(batch.column(place))], names=[*names, *new])
    return map_arrow(docs, run, T.StructType(docs.schema.fields + schema_fields))


def encode_column(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``docs`` and the token ids of ``text`` as array<int>."""
    def fn(column: pa.Array) -> list[pa.Array]:
        coder = encoding(path, pattern)
        each = [np.array(encode(coder, x.as_py() or "", piece_chars), np.int32) for x in column]  # four bytes an id, not a list of ints
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *each])))]
    return _with_column(docs, text, [T.StructField(free_name(docs.columns, ids), T.ArrayType(T.IntegerType()))], fn)


def decode_column(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``tokens`` and the raw bytes of ``ids``; null ids decode to nothing."""
    def fn(column: pa.Array) -> list[pa.Array]:
        coder = encoding(path, pattern)
        return [pa.array([coder.decode_bytes(x or []) for x in column.to_pylist()], pa.binary())]
    return _with_column(tokens, ids, [T.StructField(free_name(tokens.columns, decoded), T.BinaryType())], fn)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions over whole texts, without shipping the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            n, hashed, back = [], [], []
            for x in batch.column(1):
                ids = encode(coder, x.as_py() or "", piece_chars)
                n.append(len(ids))
                hashed.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())],
                                             names=[doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])
    kept = docs.select(F.col(quoted(doc_id)), F.col(quoted(text)))
    return map_arrow(kept, run, T.StructType([kept.schema[0], *(T.StructField(n, t) for n, t in (
        ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))]))
