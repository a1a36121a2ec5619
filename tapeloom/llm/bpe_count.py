"""Token counts by byte-pair merging over a heap and a linked list, with no ids made.

Method: the vocabulary file of the tokenizers library gives the merge ranks and the pattern kind (byte level). A word's
bytes are the nodes of a doubly linked list; a heap holds each adjacent pair that has a rank. The lowest rank, leftmost
first, is popped, merged if both nodes are still as they were, and the two new pairs are pushed. The count is the number
of bytes minus the number of merges: O(n log n) for a word of n bytes. Counts of short words are remembered per worker
up to ``CACHE_WORDS`` words, then the memory is emptied; this changes no count.

Words are split by the byte-level pattern. Which characters are letters, numbers or spaces differs between Unicode versions, so the
library's own classes are read once, from its removal of each class from the string of all code points.

Special strings (the file's added tokens) inside a text count one token each, as the library does by default.

Defined cases: null and empty texts count 0 bytes and 0 tokens; repeated rows are counted each; further columns are
kept; an empty table gives no rows. The vocabulary path must exist on the executors.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers

from tapeloom.llm.tables import map_arrow, without

#: Fixed value: the split pattern of byte-level pre-tokenizers, with classes for letters (L), numbers (N) and spaces (S).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
CACHE_WORDS, CACHE_BYTES = 1_500_000, 64


@cache
def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def character_class(name: str) -> str:
    """A class of the tokenizers library (``\\p{L}``, ``\\p{N}``, ``\\s``) as ranges for a set of ``re``."""
    remove = normalizers.Replace(Regex(f"{name}+"), "")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    left: set[str] = set()
    for i in range(0, len(points), 512):
        left.update(remove.normalize_str("".join(map(chr, points[i : i + 512]))))
    out, run = [], None
    for c in [*points, None]:
        inside = c is not None and chr(c) not in left
        if inside and run is not None and run[1] == c - 1:
            run[1] = c
        else:
            if run is not None:
                out.append("\\U%08x-\\U%08x" % tuple(run))
            run = [c, c] if inside else None
    return "".join(out)


@cache
def split_pattern() -> str:
    """``PATTERN`` with the library's classes."""
    return re.sub("[SLN]", lambda m: character_class({"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}[m[0]]), PATTERN)


class Merges(dict):
    """Merge ranks of a vocabulary; as a dict, the remembered counts of short words."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        symbols = byte_symbols()
        raw = {token: bytes(symbols[c] for c in token) for token in model["vocab"] if all(c in symbols for c in token)}
        number = {raw[token]: i for i, token in enumerate(raw)}
        self.single = [number[bytes([b])] for b in range(256)]
        self.shift = len(number).bit_length()
        self.ranks: dict[int, int] = {}  # of a pair of symbols, as one number
        self.made: list[int] = []  # symbol of each rank
        for pair in model["merges"]:
            left, right = (raw[t] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks[number[left] << self.shift | number[right]] = len(self.made)
            self.made.append(number[left + right])
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.split = re.compile(pattern).findall

    def __missing__(self, word: str) -> int:
        n = self.word(word.encode())
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = n
        return n

    def word(self, data: bytes) -> int:
        """Tokens of one word: initial symbols minus merges."""
        n, shift, rank_of, made = len(data), self.shift, self.ranks.get, self.made
        single = self.single
        node = [single[b] for b in data]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        current = [rank_of(a << shift | b) for a, b in zip(node, node[1:], strict=False)]  # of the pair that begins at a node
        heap = [rank << 32 | i for i, rank in enumerate(current) if rank is not None]
        current.append(None)
        heapify(heap)
        merges = 0
        while heap:
            top = heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            if current[i] != rank:
                continue  # one of the two was merged meanwhile
            merges += 1
            j = after[i]
            node[i] = new = made[rank]
            k = after[i] = after[j]
            current[i] = current[j] = None
            if k < n:
                before[k] = i
                current[i] = right = rank_of(new << shift | node[k])
                if right is not None:
                    heappush(heap, right << 32 | i)
            h = before[i]
            if h >= 0:
                current[h] = left = rank_of(node[h] << shift | new)
                if left is not None:
                    heappush(heap, left << 32 | h)
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text, special strings counted as one token each."""
        if self.special is None:
            return sum(map(self.__getitem__, self.split(text)))
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += 1 + sum(map(self.__getitem__, self.split(text[at : found.start()])))
            at = found.end()
        return total + sum(map(self.__getitem__, self.split(text[at:] if at else text)))


@cache
def merges(path: str, pattern: str) -> Merges:
    """The merges of a vocabulary file, once per process."""
    return Merges(path, pattern)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); columns of these names are replaced."""
    docs = without(docs, ["n_bytes", "n_tokens", "over_limit"])
    names, place = docs.columns, docs.columns.index(text)
    pattern = split_pattern()  # made once, on the driver
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merges(path, pattern)
        for batch in batches:
            size, n = [], []
            for x in batch.column(place):
                value = x.as_py() or ""
                size.append(len(value.encode()))
                n.append(counter.count(value))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([t > limit for t in n], pa.bool_())],
                names=[*names, *(f.name for f in fields)])
    return map_arrow(docs, run, T.StructType(docs.schema.fields + fields))
