"""Toxicity: noisy-channel restoration of disguised words, then a score of the restored text.

Method: a character language model (trigrams over ``ALPHABET``, counted over all documents in Spark, interpolated down to
single characters) is the source; the channel writes letters as look-alike digits and marks (leetspeak), puts separators
between letters, repeats letters and strews in marks. A stretch with such signs is a lattice: each place offers what may have been
meant, and Viterbi over states of two characters finds the likeliest reading. The signs are: a digit or mark of ``LEET`` between
or before letters, a letter three times or more, or four and more single characters with separators between. Text without these signs has one
reading, itself, and is not decoded. A run of three or more equal marks behind a word is decoration and no sign.

The score comes from the distinct words of the restored text: words that labelled toxic documents hold much oftener than
others (likelihood-ratio test) carry their log odds, and a logistic curve over the sum and its share of the text's words
turns it into a probability. Words are weighed on three quarters of the labelled documents and the curve is fitted on the rest.
Documents that are near copies (equal least hash of five-word shingles and equal label) count once, so that a much copied text
does not make its own words evidence.

Bounds: the model is 60 ** 3 counts; the fit uses at most ``FIT_ROWS`` labelled rows, those of least hash of doc_id, and keeps at most
``MAX_WORDS`` words. Everything else reads all documents. States per place of a lattice are bounded by the look-alikes of two characters.

Defined cases: null and empty texts have a score like any other (no evidence); labels that are null, not 0 or 1, or of unknown
documents are ignored, repeated ones count each; with a class missing the score is the prior; an empty table gives no
rows; further columns are not read. A null doc_id is not held out and never labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.tables import map_arrow, quoted, store
from tapeloom.llm.wordhash import GRAM_BASE, U, Words, grams, mix, words_of

FIT_ROWS, MAX_WORDS, ACCEPT = 50_000, 4096, 0.7
MIN_DOCS, MIN_ODDS, MIN_RATIO = 3, 1.0, 12.0  # of a word: toxic documents, log odds, likelihood-ratio statistic
#: Characters of the model: word boundary, anything else, a to z, and the Latin-1 small letters.
ALPHABET = [None, None, *map(chr, range(0x61, 0x7B)), *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
BOUNDARY, OTHER, SIZE = 0, 1, len(ALPHABET)
SYMBOL = {c: i for i, c in enumerate(ALPHABET) if c}
#: Letters that a digit or mark can stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Log probabilities of the channel: a look-alike, a separator that was put in or that was meant, a strewn mark, a repeated letter.
LOOKALIKE, GAP, MEANT, STREWN, REPEATED = np.log([0.1, 0.8, 0.2, 0.05, 0.3]).tolist()
_LETTER, _SHOWN, _PART = "a-zß-öø-ÿ", r"a-zß-öø-ÿ0-9@$!|+", r"[a-zß-öø-ÿ0-9@$!|+*#_]"
_SIGNS = re.compile(
    rf"(?<![{_SHOWN}])[{_SHOWN}](?:[ ._*-]{{1,2}}[{_SHOWN}](?![{_LETTER}0-9@$])){{3,}}"
    rf"|[{_LETTER}](?=[0-9@$!|+*#_]{{1,2}}[{_LETTER}])|([{_LETTER}])\1\1|(?<!{_PART})[0-9@$](?=[{_LETTER}]{{2}})|[{_LETTER}](?=[$@]{{1,2}}(?!{_PART}))")
_WHOLE = re.compile(f"{_PART}*")
_IN_PART = frozenset(c for c in map(chr, range(256)) if re.match(_PART, c))
HELD_SPANS, HELD_LENGTH = 100_000, 40


def _symbol_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[:0x80] = table[0x80:0xC0] = BOUNDARY
    for i in range(10):
        table[ord("0") + i] = OTHER
    for c, i in SYMBOL.items():
        table[ord(c)] = i
    return table


def count_trigrams(docs: DataFrame, text: str = "text", chars: int = 1 << 19) -> DataFrame:
    """(gram, n): trigrams of symbols over all texts, lower-cased, with boundaries around words; ``SIZE`` ** 3 rows at most."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _symbol_table(), np.zeros(SIZE**3, np.int64)

        def add(texts: list[str]) -> None:
            symbols = table[np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-32-le"), np.uint32)].astype(np.int64)
            symbols = symbols[np.concatenate(([True], (symbols[1:] != BOUNDARY) | (symbols[:-1] != BOUNDARY)))]
            if len(symbols) > 2:
                total[:] += np.bincount((symbols[:-2] * SIZE + symbols[1:-1]) * SIZE + symbols[2:], minlength=SIZE**3)
        for batch in batches:
            held, size = [], 0
            for value in batch.column(0):
                held.append(value.as_py() or "")
                size += len(held[-1])
                if size >= chars:
                    add(held)
                    held, size = [], 0
            add(held)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["gram", "n"])
    return map_arrow(docs.select(quoted(text)), scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Interpolated trigram log probabilities, and the Viterbi decoder over them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.reshape(SIZE, SIZE, SIZE)
        c3 = self.counts.astype(float)
        c2, weight = c3.sum(0), 5.0
        c1 = c2.sum(0)
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + weight * p1) / (c2.sum(1, keepdims=True) + weight)
        p3 = (c3 + weight * p2[None]) / (c3.sum(2, keepdims=True) + weight)
        self.table = np.log(p3).ravel().tolist()
        self.held: dict[str, str] = {}

    def __reduce__(self):
        return CharacterModel, (self.counts,)

    def readings(self, text: str, i: int) -> list[tuple[int, tuple[int, ...], str, float]]:
        """What may have been meant at a place: (next place, symbols, output, channel log probability)."""
        c = text[i]
        s = SYMBOL.get(c)
        if s is not None:
            end = i + 1
            while end < len(text) and text[end] == c:
                end += 1
            if end - i == 1:
                return [(end, (s,), c, 0.0)]
            out = [(end, (s,), c, REPEATED), (end, (s, s), c + c, REPEATED if end - i > 2 else 0.0)]
            return out + [(end, (s, s, s), text[i:end], 0.0)] if end - i > 2 else out
        out = [(i + 1, (SYMBOL[x],), x, LOOKALIKE) for x in LEET.get(c, "")]
        if c in " ._*-":
            return [*out, (i + 1, (BOUNDARY,), c, MEANT), (i + 1, (), "", GAP)]
        out.append((i + 1, (OTHER,), c, 0.0))
        return out if c.isalnum() else [*out, (i + 1, (), "", STREWN)]

    def decode(self, text: str) -> str:
        """The likeliest reading of a stretch between two word boundaries."""
        if text in self.held:
            return self.held[text]
        table = self.table
        # per place and state (two symbols as one number): score, entry before, output; places ahead of a run wait in ``at``
        at: list[dict[int, tuple] | None] = [None] * (len(text) + 1)
        at[0] = {BOUNDARY * SIZE + BOUNDARY: (0.0, None, "")}
        for i in range(len(text)):
            states = at[i]
            if states is None:
                continue
            at[i] = None
            for end, symbols, shown, cost in self.readings(text, i):
                ahead = at[end]
                if ahead is None:
                    ahead = at[end] = {}
                for state, entry in states.items():
                    score, now = entry[0] + cost, state
                    for s in symbols:
                        if s == BOUNDARY and now % SIZE == BOUNDARY:
                            continue
                        score += table[now * SIZE + s]
                        now = now % SIZE * SIZE + s
                    known = ahead.get(now)
                    if known is None or score > known[0]:
                        ahead[now] = (score, entry, shown)
        best = max(at[-1].items(), key=lambda x: x[1][0] + (0.0 if x[0] % SIZE == BOUNDARY else table[x[0] * SIZE + BOUNDARY]))[1]
        parts = []
        while best is not None:
            parts.append(best[2])
            best = best[1]
        out = "".join(reversed(parts))
        if len(text) <= HELD_LENGTH:
            if len(self.held) >= HELD_SPANS:
                self.held.clear()
            self.held[text] = out
        return out

    def restore(self, text: str) -> tuple[str, int]:
        """(lower-cased text with its disguised stretches decoded, number of stretches that changed)."""
        text = text.lower()
        out, done, changed = [], 0, 0
        found = _SIGNS.search(text)
        while found:
            lo, hi = found.span()
            if hi - lo <= 3 or text[lo + 1] not in " ._*-":  # a sign inside a word: the whole word
                while lo > done and text[lo - 1] in _IN_PART:
                    lo -= 1
                hi = _WHOLE.match(text, lo).end()
            stretch = text[lo:hi].rstrip("*#_")
            reading = self.decode(stretch)
            changed += reading != stretch
            out += [text[done:lo], reading]
            done = lo + len(stretch)
            found = _SIGNS.search(text, max(hi, done))
        return "".join([*out, text[done:]]), changed


def character_model(docs: DataFrame, text: str = "text") -> CharacterModel:
    """The model of all texts of ``docs``."""
    counts = np.zeros(SIZE**3, np.int64)
    for row in count_trigrams(docs, text).collect():  # SIZE ** 3 rows at most
        counts[row["gram"]] = row["n"]
    return CharacterModel(counts)


LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


class Batch(NamedTuple):
    """Distinct words of the restored texts of a batch, one text after the other."""
    row: np.ndarray
    word: np.ndarray
    n_words: np.ndarray
    changed: np.ndarray
    copies: np.ndarray  # equal for near copies


def _least_shingle(w: Words, n: int) -> np.ndarray:
    """Least hash of the five-word shingles of each text; of its words where it has fewer."""
    out = np.zeros(n, U)
    keys = mix(grams(w.hash, 5)) if len(w) >= 5 else np.zeros(0, U)
    for i in range(n):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= 5:
            out[i] = keys[a : b - 4].min()
        elif b > a:
            out[i] = mix(grams(w.hash[a:b], b - a, GRAM_BASE))[0]
    return out


def restored_words(column: pa.Array, model: CharacterModel) -> Batch:
    parts, base = [], 0
    restored = [model.restore(x.as_py() or "") for x in column]
    texts = pa.array([t for t, _ in restored], pa.large_string())
    for lo, hi, w in words_of(texts, LETTERS):
        n = hi - lo
        order = np.lexsort((w.hash, w.text))
        text, word = w.text[order], w.hash[order]
        new = np.ones(len(word), bool)
        new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
        parts.append((text[new] + base, word[new].view(np.int64), w.counts, _least_shingle(w, n).view(np.int64)))
        base += n
    join = lambda i, kind: np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)])
    return Batch(join(0, np.int64), join(1, np.int64), join(2, np.int64), np.array([c for _, c in restored], np.int64), join(3, np.int64))


class Scorer(NamedTuple):
    """Words as sorted hashes with their log odds, and the logistic curve."""
    words: np.ndarray
    odds: np.ndarray
    curve: np.ndarray

    def evidence(self, row: np.ndarray, word: np.ndarray, n_rows: int, n_words: np.ndarray) -> np.ndarray:
        """Per row: 1, sum of log odds, that sum per hundred words, log of the words."""
        total = np.zeros(n_rows)
        if len(self.words) and len(word):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            total = np.bincount(row, np.where(self.words[at] == word, self.odds[at], 0.0), n_rows)
        n = n_words + 20.0
        return np.stack([np.ones(n_rows), np.log1p(total), np.log1p(100 * total / n), np.log(n)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -700, 700)))


def _fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps, intercept unpenalised."""
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


WEIGH = "pmod(xxhash64(copies), 4) != 0"  # rows that weigh words; the others fit the curve


def _log_ratio(k, row, column, total):
    """k * log(k / expected), 0 where k is 0."""
    return F.when(k > 0, k * F.log(k * total / (row * column))).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, model, doc_id: str, text: str, label: str, rows: int, max_words: int) -> Scorer:
    """A scorer from labelled documents that are not held out; ``model`` is a broadcast character model."""
    marks = labels.select(F.col(quoted(doc_id)).alias("label_id"), F.col(quoted(label)).alias("label")).where(
        F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & (F.crc32(F.col("label_id").cast("string")) % 3 != 1))
    marks = marks.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(rows)
    known = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("body")).join(F.broadcast(marks), F.col("id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = restored_words(batch.column(0), model.value)
            offsets = np.searchsorted(x.row, np.arange(len(x.n_words) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(x.copies), pa.array(x.n_words), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.word))],
                                             names=["label", "copies", "n_words", "words"])
    each = map_arrow(known.select("body", "label"), run, "label int, copies long, n_words long, words array<long>")
    once = store(each.groupBy("copies", "label").agg(F.min(F.struct("n_words", "words")).alias("x")).select("copies", "label", "x.*"), "toxicity-rows")
    totals = {r["label"]: r["n"] for r in once.where(WEIGH).groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    prior = float(np.log((toxic + 1) / (clean + 1)))
    if not toxic or not clean:
        return Scorer(np.zeros(0, np.int64), np.zeros(0), np.array([prior, 0, 0, 0]))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(toxic + clean)
    held = once.where(WEIGH).select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") >= MIN_DOCS)
    ratio = 2 * (_log_ratio(a, a + b, toxic, n) + _log_ratio(b, a + b, clean, n) + _log_ratio(toxic - a, n - a - b, toxic, n) + _log_ratio(clean - b, n - a - b, clean, n))
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    chosen = held.select("word", odds.alias("odds"), ratio.alias("ratio")).where((F.col("odds") > MIN_ODDS) & (F.col("ratio") > MIN_RATIO))
    found = sorted((r["word"], r["odds"]) for r in chosen.orderBy(F.desc("ratio"), "word").limit(max_words).collect())
    scorer = Scorer(np.array([w for w, _ in found], np.int64), np.array([o for _, o in found]), np.array([prior, 0, 0, 0]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, size = batch.column(2), batch.column(1).to_numpy()
            row = np.repeat(np.arange(len(size)), lists.value_lengths().to_numpy(zero_copy_only=False))
            x = scorer.evidence(row, lists.flatten().to_numpy(), len(size), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(1, x.shape[1]))], names=["label", "x1", "x2", "x3"])
    seen = map_arrow(once.where(f"NOT ({WEIGH})").select("label", "n_words", "words"), judge, "label int, x1 double, x2 double, x3 double").collect()  # FIT_ROWS rows at most
    y = np.array([r["label"] for r in seen], float)
    if not 0 < y.sum() < len(y):
        return scorer._replace(curve=np.array([prior, 1.0, 0, 0]))
    return scorer._replace(curve=_fit_curve(np.array([[1.0, r["x1"], r["x2"], r["x3"]] for r in seen]), y))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", accept: float = ACCEPT,
          rows: int = FIT_ROWS, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_restored); rows whose crc32(doc_id) mod 3 is 1 are held out of the fit."""
    model = docs.sparkSession.sparkContext.broadcast(character_model(docs, text))
    scorer = fit(docs, labels, model, doc_id, text, label, rows, max_words)
    held = F.coalesce(F.crc32(F.col(quoted(doc_id)).cast("string")) % 3 == 1, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = restored_words(batch.column(1), model.value)
            p = scorer.scores(scorer.evidence(x.row, x.word, len(x.n_words), x.n_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p), pa.array((p >= accept).astype(np.int32)), pa.array(x.changed)],
                                             names=[doc_id, "held_out", "score", "predicted", "n_restored"])
    fields = [docs.schema[doc_id], *(T.StructField(n, t) for n, t in (
        ("held_out", T.BooleanType()), ("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_restored", T.LongType())))]
    return map_arrow(docs.select(F.col(quoted(doc_id)), F.col(quoted(text)), held), run, T.StructType(fields))
