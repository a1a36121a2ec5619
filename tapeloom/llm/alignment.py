"""Alignment of two tokenizations of the same text: groups, links between overlapping tokens, and corpus counts of linked pairs.

Method: both tokenizers cut ``space + text`` into byte ranges; where both end a token, a group closes. A stretch of a text gives a
``Fragment``: an open prefix (tokens up to the first common end), closed groups, and an open suffix (tokens behind the last
one). Fragments compose associatively: what one leaves open and the next begins with are aligned anew between them. Texts of
more than ``chunk`` characters are cut into chunks, by each tokenizer at its own safe places; the chunks are dealt to tasks,
each becomes a fragment, and a tree reduction of fan-in ``FAN`` composes those of one text. Shorter texts are one fragment.

Safe places: the first tokenizer's pattern never joins a visible character to white space behind it; in the second's
vocabulary no piece holds a space behind another character, nor a line end at all (both are checked when it is loaded; a
place that fails the check is not used, and a text without safe places stays one chunk). Shorter texts are cut at the spaces that are
safe for both, and the tokens of the parts are remembered, as most of them are words that come again.

Pair counts are summed over the corpus in Spark, and the highest count per second id is found there. A lookup of at most
``max_pairs`` pairs (17 bytes each) is broadcast; more pairs are dealt into blocks of that size by hash, and the stored
tokens are scanned once per block, so nothing is dropped at any size.

Defined cases: null and empty texts, and such whose tokens do not join to ``space + text`` (a tokenizer that changes characters),
have no tokens: zeros and an empty digest. Repeated rows count each; an empty table gives no rows; further columns are
not read. Both vocabulary paths must exist on the executors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tapeloom.llm.bpe_count import byte_symbols
from tapeloom.llm.tables import map_arrow, quoted, store

CHUNK_CHARS, CALL_BYTES, FAN, MAX_PAIRS, HELD_PAIRS = 1 << 16, 1 << 20, 8, 4_000_000, 1_000_000
HELD_UNITS, HELD_LENGTH = 500_000, 48  # per worker; how many are held changes no token
#: A visible character (for any Unicode version) before a space or a line end.
_FIRST_CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?=[ \n])")
SPACE = "\u2581"  # fixed value: the mark of a space in pieces


class Vocabulary:
    """Bytes and byte length of every id, and the ids of texts."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.dtype = np.dtype("<u2" if len(tokens) <= 1 << 16 else "<u4")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, self.dtype) for x in self.lists(texts)]

    def joins_to(self, ids: np.ndarray, raw: bytes) -> bool:
        return int(self.size[ids].sum()) == len(raw) and b"".join(map(self.tokens.__getitem__, ids.tolist())) == raw


class ByteLevel(Vocabulary):
    """A byte-level vocabulary of the tokenizers library; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols, known = byte_symbols(), {i: t for t, i in spec["model"]["vocab"].items()}
        n = max([*known, *(t["id"] for t in spec["added_tokens"])]) + 1
        super().__init__([bytes(symbols[c] for c in known[i]) if i in known and all(c in symbols for c in known[i]) else b"" for i in range(n)])

    def lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, text: str, at: int) -> int:
        """The first safe place from ``at`` on, or the end."""
        found = _FIRST_CUT.search(text, at)
        return found.start() if found else len(text)


class Pieces(Vocabulary):
    """A sentencepiece model that puts a space before each text."""

    def __init__(self, path: str):
        self.coder = coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
        super().__init__([bytes([int(p[1:-1], 16)]) if coder.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])
        plain = [p for i, p in enumerate(pieces) if not coder.is_byte(i)]
        self.lead = coder.piece_to_id(SPACE)
        cuts = []
        self.spaced = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
        if self.spaced:
            cuts.append(f"(?<=[^ {SPACE}])(?= [^ ])")
        if not any("\n" in p for p in plain):
            cuts.append(r"(?=\n)")
        self.safe = re.compile("|".join(cuts)) if cuts else None

    def lists(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space that the model adds, or with a line end."""
        lists = self.coder.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)
        lone = [self.lead]  # the model gives nothing at all for an empty rest
        return [lone if t == " " else i if t[:1] == " " else i[1:] for t, i in zip(texts, lists, strict=True)]

    def cut(self, text: str, at: int) -> int:
        found = self.safe.search(text, at) if self.safe else None
        return found.start() if found else len(text)


@cache
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@cache
def piece_model(path: str) -> Pieces:
    return Pieces(path)


class Cuts(NamedTuple):
    """Two tokenizations of the same bytes, several texts behind each other."""
    first: np.ndarray  # index of the first tokenizer's token of each link
    second: np.ndarray
    closed: np.ndarray  # of each link: whether a group ends with it


def links(first_ends: np.ndarray, second_ends: np.ndarray) -> Cuts:
    """One link for each stretch between neighbouring ends: it lies in one token of either side, and each overlap is one stretch."""
    ends = np.concatenate([first_ends, second_ends])
    ends.sort(kind="stable")  # two sorted runs
    ends = ends[np.append(True, ends[1:] != ends[:-1])] if len(ends) else ends
    i, j = np.searchsorted(first_ends, ends), np.searchsorted(second_ends, ends)
    return Cuts(i, j, (first_ends[i] == ends) & (second_ends[j] == ends)) if len(ends) else Cuts(i, j, np.zeros(0, bool))


class Fragment(NamedTuple):
    """Tokens of a stretch: ids up to the first common end, in closed groups, and behind the last common end."""
    start: tuple[int, int]  # byte offsets where the first and second tokens begin
    closed: bool  # whether there is a common end; if not, all tokens are in ``head``
    head: tuple[np.ndarray, np.ndarray]
    body: tuple[np.ndarray, np.ndarray]
    tail: tuple[np.ndarray, np.ndarray]
    end: int  # the last common end
    ok: bool  # whether the tokens join to the text


def _join(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fragment(a: Vocabulary, b: Vocabulary, start: tuple[int, int], first: np.ndarray, second: np.ndarray, ok: bool = True) -> Fragment:
    """The fragment of tokens that begin at the two offsets."""
    ends = start[0] + np.cumsum(a.size[first]), start[1] + np.cumsum(b.size[second])
    none = first[:0], second[:0]
    common = np.intersect1d(*ends)
    if not len(common):
        return Fragment(start, False, (first, second), none, none, 0, ok)
    (i, j), (k, m) = ([int(np.searchsorted(e, x)) + 1 for e in ends] for x in (common[0], common[-1]))
    return Fragment(start, True, (first[:i], second[:j]), (first[i:k], second[j:m]), (first[k:], second[m:]), int(common[-1]), ok)


def compose(a: Vocabulary, b: Vocabulary, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches; associative."""
    open_left, start = (left.tail, (left.end, left.end)) if left.closed else (left.head, left.start)
    between = fragment(a, b, start, *_join(open_left, right.head))
    none = left.head[0][:0], left.head[1][:0]
    head, body = (left.head, left.body) if left.closed else (between.head, none)
    if left.closed and between.closed:
        body = _join(body, between.head)
    body = _join(body, between.body)
    if right.closed:
        body, tail, end = _join(body, right.body), right.tail, right.end
    elif between.closed:
        tail, end = between.tail, between.end
    else:
        tail, end = (between.head, left.end) if left.closed else (none, 0)
    return Fragment(left.start, left.closed or between.closed or right.closed, head, body, tail, end, left.ok and right.ok)


def chunk_places(text: str, coder: ByteLevel | Pieces, chunk: int) -> list[int]:
    """Where the chunks of a text begin for one tokenizer, and its end; some may be empty."""
    places = [0]
    for at in range(chunk, len(text), chunk):
        places.append(places[-1] if places[-1] >= at else coder.cut(text, at))
    return [*places, len(text)]


class Paths(NamedTuple):
    """Files of the two tokenizers."""
    first: str
    second: str

    def load(self) -> tuple[ByteLevel, Pieces]:
        return byte_level(self.first), piece_model(self.second)


#: A space that begins a unit: behind a visible character that is no mark of a space, and before anything but a space.
_UNIT = re.compile(rf"(?<=[^\s{SPACE}\u180e\u200b\ufeff])(?= [^ ])")
_NO_UNIT = re.compile(rf"[\s{SPACE}\u180e\u200b\ufeff] ")


def units(text: str) -> list[str]:
    """Parts of a text, each with the space before it left out, whose tokens of either kind join to those of ``space + text``."""
    odd = any(x in text for x in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")) if text.isascii() and not _CONTROL.search(text) else _NO_UNIT.search(text)
    if odd or text[:1] == " " or text[-1:] == " ":
        return [u[1:] for u in _UNIT.split(" " + text)]
    return text.split(" ")


_CONTROL = re.compile("[\x1c-\x1f]")


class Remembered:
    """Token ids of units as bytes, kept up to ``HELD_UNITS`` units; which of them do not join to their text."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.first: dict[str, bytes] = {}
        self.second: dict[str, bytes] = {}
        self.unsound: set[str] = set()

    def learn(self, new: list[str]) -> None:
        if not new:
            return
        spaced = [" " + u for u in new]
        raw = [u.encode() for u in spaced]
        sizes, whole = np.array([len(r) for r in raw]), b"".join(raw)
        sound = np.ones(len(new), bool)
        for coder, held in ((self.a, self.first), (self.b, self.second)):
            lists = coder.lists(spaced)
            ids = np.array(list(chain.from_iterable(lists)), coder.dtype)
            ends = np.cumsum([len(x) for x in lists])
            joined = np.append(0, np.cumsum(coder.size[ids]))[ends]
            if not np.array_equal(np.diff(joined, prepend=0), sizes) or b"".join(map(coder.tokens.__getitem__, ids.tolist())) != whole:
                sound &= [coder.joins_to(np.array(x, coder.dtype), r) for x, r in zip(lists, raw, strict=True)]
            data, cuts = ids.tobytes(), [0, *(ends * coder.dtype.itemsize).tolist()]
            held.update(zip(new, [data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True))
        self.unsound.update(u for u, ok in zip(new, sound, strict=True) if not ok)

    def forget(self, used: list[str]) -> None:
        if len(self.first) > HELD_UNITS:
            self.first, self.second, self.unsound = {}, {}, set()
        else:
            for unit in used:
                if len(unit) > HELD_LENGTH and unit in self.first:
                    del self.first[unit], self.second[unit]
                    self.unsound.discard(unit)


def tokenize(known: Remembered, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
    """Ids of both tokenizers for ``space + text`` as bytes, no ids where they do not join to it; calls of bounded size."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= CALL_BYTES):
            size += len(texts[end]) + 1
            end += 1
        parts = [(units(t) if known.b.spaced else [t]) if t else [] for t in texts[at:end]]
        new = list({u for part in parts for u in part}.difference(known.first))
        known.learn(new)
        for part in parts:
            if known.unsound and not known.unsound.isdisjoint(part):
                yield b"", b""
            else:
                yield b"".join(map(known.first.__getitem__, part)), b"".join(map(known.second.__getitem__, part))
        known.forget(new)
        at = end


TOKENS = "rid long, a binary, b binary"
FRAGMENT = "rid long, k long, start_a long, start_b long, closed boolean, head_a binary, head_b binary, body_a binary, body_b binary, tail_a binary, tail_b binary, stop long, ok boolean"


def _pack(rid: int, k: int, f: Fragment) -> tuple:
    return (rid, k, *f.start, f.closed, *(x.tobytes() for x in (*f.head, *f.body, *f.tail)), f.end, f.ok)


def _unpack(row: dict, a: Vocabulary, b: Vocabulary) -> Fragment:
    part = lambda name: (np.frombuffer(row[f"{name}_a"], a.dtype), np.frombuffer(row[f"{name}_b"], b.dtype))
    return Fragment((row["start_a"], row["start_b"]), row["closed"], part("head"), part("body"), part("tail"), row["stop"], row["ok"])


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])


def _fields(schema: str) -> list[T.StructField]:
    kinds = {"long": T.LongType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "string": T.StringType()}
    return [T.StructField(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def short_tokens(docs: DataFrame, paths: Paths) -> DataFrame:
    """(rid, a, b, doc_id) of (doc_id, text): a new row id from 0 and the token ids as little-endian numbers."""
    schema = _arrow(TOKENS)
    numbered = docs.withColumn("rid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(*paths.load())
        for batch in batches:
            pairs = tokenize(known, [x.as_py() or "" for x in batch.column(1)])
            made = _batch([(rid, x, y) for rid, (x, y) in zip(batch.column(2).to_pylist(), pairs, strict=True)], schema)
            yield pa.RecordBatch.from_arrays([*made.columns, batch.column(0)], names=[*made.schema.names, "doc_id"])
    return map_arrow(numbered, run, T.StructType([*_fields(TOKENS), docs.schema["doc_id"]]))


def long_tokens(docs: DataFrame, paths: Paths, chunk: int) -> DataFrame:
    """``short_tokens`` for texts that are cut into chunks, tokenized apart and composed in a tree; row ids below 0."""
    pieces_schema = "rid long, k long, first string, second string, start_a long, start_b long"
    numbered = docs.withColumn("rid", -1 - F.monotonically_increasing_id())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = paths.load()
        for batch in batches:
            for row, (rid, value) in enumerate(zip(batch.column(2).to_pylist(), batch.column(1), strict=True)):
                text = " " + value.as_py()
                one, two = chunk_places(text, a, chunk), chunk_places(text, b, chunk)
                at = [0, 0]
                for k in range(len(one) - 1):
                    first, second = text[one[k] : one[k + 1]], text[two[k] : two[k + 1]]
                    made = _batch([(rid, k, first, second, *at)], _arrow(pieces_schema))
                    yield pa.RecordBatch.from_arrays([*made.columns, batch.column(0).slice(row, 1)], names=[*made.schema.names, "doc_id"])
                    at = [at[0] + len(first.encode()), at[1] + len(second.encode())]
    pieces = store(map_arrow(numbered, split, T.StructType([*_fields(pieces_schema), docs.schema["doc_id"]])), "chunks")
    fragment_schema = _arrow(FRAGMENT)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = paths.load()
        for batch in batches:
            for row in batch.to_pylist():
                first, second = (coder.ids([row[name]])[0] if row[name] else np.zeros(0, coder.dtype) for coder, name in ((a, "first"), (b, "second")))
                ok = a.joins_to(first, row["first"].encode()) and b.joins_to(second, row["second"].encode())
                made = fragment(a, b, (row["start_a"], row["start_b"]), first, second, ok)
                yield _batch([_pack(row["rid"], row["k"], made)], fragment_schema)

    def reduce(table: pa.Table) -> pa.Table:
        a, b = paths.load()
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        total = _unpack(rows[0], a, b)
        for row in rows[1:]:
            total = compose(a, b, total, _unpack(row, a, b))
        return pa.Table.from_batches([_batch([_pack(rows[0]["rid"], rows[0]["k"] // FAN, total)], fragment_schema)])
    last = pieces.agg(F.max("k")).first()[0] or 0
    fragments = pieces.drop("doc_id").repartition("rid", "k").mapInArrow(build, FRAGMENT)
    while last > 0:
        fragments = fragments.groupBy("rid", F.floor(F.col("k") / FAN)).applyInArrow(reduce, FRAGMENT)
        last //= FAN
    keep = lambda side: F.when(F.col("ok"), F.concat(f"head_{side}", f"body_{side}", f"tail_{side}")).otherwise(F.lit(b"")).alias(side)
    return fragments.select("rid", keep("a"), keep("b")).join(pieces.where("k = 0").select("rid", "doc_id"), "rid")


def tokens(docs: DataFrame, paths: Paths, chunk: int = CHUNK_CHARS) -> DataFrame:
    """(rid, a, b, doc_id) of (doc_id, text), both kinds of text."""
    is_long = F.coalesce(F.length("text") >= chunk, F.lit(False))
    return short_tokens(docs.where(~is_long), paths).unionAll(long_tokens(docs.where(is_long), paths, chunk))


class Aligned:
    """Links of a batch of stored tokens."""

    def __init__(self, a: Vocabulary, b: Vocabulary, first: pa.Array, second: pa.Array):
        sides = []
        for column, coder in ((first, a), (second, b)):
            raw = [x.as_buffer() for x in column]
            counts = np.array([len(x) // coder.dtype.itemsize for x in raw], np.int64)
            ids = np.frombuffer(b"".join(raw), coder.dtype)
            sides.append((counts, ids, np.cumsum(coder.size[ids])))
        (self.n_a, self.a, ends_a), (self.n_b, self.b, ends_b) = sides
        self.links = links(ends_a, ends_b)
        self.pairs = self.a[self.links.first].astype(np.int64) * len(b.tokens) + self.b[self.links.second]
        self.row = np.repeat(np.arange(len(self.n_a)), self.n_a)[self.links.first]
        self.coders = a, b

    def per_row(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Sums over the links of each row; whole numbers below 2**53 stay exact."""
        return np.bincount(self.row, weights, len(self.n_a)).astype(np.int64)

    def printed(self) -> list[bytes]:
        """The groups of each row: ids of the first, a bar, ids of the second; groups parted by semicolons."""
        a, b = self.coders
        last_a, last_b = (np.zeros(len(x), np.int64) for x in (self.a, self.b))
        last_a[self.links.first[self.links.closed]] = last_b[self.links.second[self.links.closed]] = 1
        # place of a token: those of the first before those of the second in each group, groups in order
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
        n_groups = int(last_a.sum())
        upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=n_groups)) for g in (group_a, group_b))
        before_b = np.append(0, upto_b)
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + before_b[group_a]] = self.a.astype(np.int64) * 2 + last_a
        code[np.arange(len(self.b)) + upto_a[group_b]] = (self.b.astype(np.int64) + len(a.tokens)) * 2 + last_b
        shown, out, at = printed_table(a, b)[code].tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join(shown[at : at + n])[:-1])
            at += n
        return out


@cache
def printed_table(a: Vocabulary, b: Vocabulary) -> np.ndarray:
    """Printed ids of the first and then the second vocabulary, each with its mark inside and at the end of a group."""
    return np.array([b"%d%b" % (i, mark) for coder, end in ((a, b"|"), (b, b";")) for i in range(len(coder.tokens)) for mark in (b",", end)], object)


def _slices(batch: pa.RecordBatch, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded bytes, one row at least."""
    at, size = 0, 0
    sizes = [a + b for a, b in zip(*(map(len, (x.as_buffer() for x in batch.column(i))) for i in (1, 2)), strict=True)]
    for i, n in enumerate(sizes):
        if i > at and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if len(sizes) > at:
        yield batch.slice(at)


def pair_counts(stored: DataFrame, paths: Paths, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """(pair, n, best): links of the corpus by pair of ids (first * size of second's vocabulary + second), and whether none of its second id has more."""
    n_second = len(paths.load()[1].tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = paths.load()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in held)]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in held)]), len(keys)).astype(np.int64)

        def flush() -> pa.RecordBatch:
            keys, sums = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])
        for batch in batches:
            for part in _slices(batch):
                held.append(np.unique(Aligned(a, b, part.column(1), part.column(2)).pairs, return_counts=True))
                if sum(len(k) for k, _ in held) > 2 * held_pairs:
                    held[:] = [merged()]
                    if len(held[0][0]) > held_pairs:
                        yield flush()
        yield flush()
    counts = map_arrow(stored.select("rid", "a", "b"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = store(counts.withColumn("second", F.col("pair") % n_second), "pair-counts")
    top = counts.groupBy("second").agg(F.max("n").alias("most"))
    return counts.join(top, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
SUMS = [("n_best", T.LongType()), ("count_sum", T.LongType())]


def _measure(stored: DataFrame, paths: Paths, block, whole: bool) -> DataFrame:
    """(rid, doc_id and what RESULT says if ``whole``, sums over the pairs of one block)."""
    names = ["rid", *(["doc_id"] if whole else []), *(n for n, _ in (RESULT if whole else []) + SUMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = paths.load()
        keys, counts, best = block.value
        for batch in batches:
            for part in _slices(batch):
                x = Aligned(a, b, part.column(1), part.column(2))
                at = np.minimum(np.searchsorted(keys, x.pairs), max(len(keys) - 1, 0))
                known = keys[at] == x.pairs if len(keys) else np.zeros(len(x.pairs), bool)
                sums = [x.per_row(known & best[at] if len(keys) else known), x.per_row(np.where(known, counts[at], 0) if len(keys) else known)]
                about = []
                if whole:
                    digests = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(x.printed(), x.n_a.tolist(), strict=True)]
                    about = [part.column(3), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.per_row(x.links.closed)), pa.array(x.per_row()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *about, *map(pa.array, sums)], names=names)
    named = [stored.schema["doc_id"]] if whole else []
    fields = [T.StructField("rid", T.LongType()), *named, *(T.StructField(n, t) for n, t in (RESULT if whole else []) + SUMS)]
    return map_arrow(stored.select("rid", "a", "b", *(["doc_id"] if whole else [])), run, T.StructType(fields))


def align(docs: DataFrame, paths: Paths, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK_CHARS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    stored = store(tokens(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), paths, chunk), "tokens")
    counts = store(pair_counts(stored, paths), "pairs")
    parts = max(1, -(-counts.count() * 5 // (max_pairs * 4)))  # a fifth is spare, as hashes deal unevenly
    result = None
    for i in range(parts):
        rows = counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i).toArrow()
        keys = rows.column("pair").to_numpy()
        order = np.argsort(keys)
        block = spark.sparkContext.broadcast((keys[order], rows.column("n").to_numpy()[order], rows.column("best").to_numpy(zero_copy_only=False)[order]))
        part = _measure(stored, paths, block, i == 0)
        result = part if result is None else result.join(part.toDF("rid", "more_best", "more_sum"), "rid").select(
            *[quoted(c) for c in result.columns if c not in ("n_best", "count_sum")], (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"))
    return result.select(F.col("doc_id").alias(doc_id), *[n for n, _ in RESULT + SUMS])
