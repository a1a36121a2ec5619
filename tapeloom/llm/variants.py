"""Spelling variants: words at edit distance one, found through a sorted index of all rotations.

Method: a word is closed by a terminator and all its rotations are indexed. Where the edited character of a word is turned to
the end, what is before it is a prefix that a replacement or an indel at that place leaves alone: words with one rotation
``prefix + any character`` differ by a replacement, and a word whose whole rotation is ``prefix`` lacks that character. So each
word gives one row (prefix, character) per character and one row (prefix, none) per cut; the rows are dealt and sorted by
prefix, and each group of equal prefixes is scanned for neighbours. A group holds one word per character of the alphabet at
most, so no group is hot. Of a run of equal characters only the first counts as dropped, which gives every pair once.

Corpus counts are made over all texts, in Python dictionaries that are emptied into Spark at ``HELD_WORDS`` words.

Defined cases: null texts have no words; a null doc_id hashes as an empty one; repeated rows count each; ties of the best
neighbour go to the smallest word in code-point order; an empty table gives no rows; further columns are not read.
``neighbours`` takes distinct words; null words and such that hold the terminator are left out of its index.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import map_arrow, quoted, store
from tapeloom.llm.wordhash import LOWER

TERMINATOR = "$"
MIN_LENGTH, MIN_COUNT, DROP_EVERY, RATIO = 7, 2, 31, 10
HELD_WORDS = 200_000
_LOWER = LOWER.tobytes()


def runs(text: str, min_length: int) -> Counter:
    """Counts of the letter runs of a text as UTF-8, ASCII letters lower-cased; a run of ``min_length`` code points at least."""
    raw = text.encode().translate(_LOWER)
    return Counter(re.findall(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % min_length, raw))


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                drop_every: int = DROP_EVERY, held_words: int = HELD_WORDS) -> DataFrame:
    """(word, n) of all texts. A run loses a code point where ``drop_every`` divides the crc32 h of ``doc_id:run``: that at h % length."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], schema=schema)
            held.clear()
            return out
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seed = crc32(f"{'' if name is None else name}:".encode())
                for word, n in runs(body.as_py() or "", min_length).items():
                    h = crc32(word, seed)
                    if h % drop_every == 0:
                        letters = word.decode()
                        if len(letters) == min_length:
                            continue  # too short once it has lost one
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    held[word] += n
                if len(held) >= held_words:
                    yield flush()
        yield flush()
    counted = map_arrow(docs.select(F.col(quoted(doc_id)).cast("string"), F.col(quoted(text))), scan, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def rotations(words: DataFrame, terminator: str = TERMINATOR) -> DataFrame:
    """(prefix, code, n): the code is a character of the word, with a dot behind it inside a run, or empty for a cut of the whole word."""
    w, n = F.col("word"), F.length("word")

    def turned(skip: Column, keep: Column) -> Column:
        return F.concat(F.substring(w, skip + 1, n), F.lit(terminator), F.substring(w, F.lit(1), keep))

    def edited(i: Column) -> Column:
        letter = F.substring(w, i, F.lit(1))
        again = (i > 1) & (letter == F.substring(w, i - 1, F.lit(1)))
        return F.struct(turned(i, i - 1).alias("prefix"), F.when(again, F.concat(letter, F.lit("."))).otherwise(letter).alias("code"))
    ends = F.transform(F.sequence(F.lit(1), n), edited)
    cuts = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(turned(i, i).alias("prefix"), F.lit("").alias("code")))
    sound = words.where(w.isNotNull() & ~F.contains(w, F.lit(terminator)) & (n > 0))
    return sound.select("n", F.explode(F.concat(ends, cuts)).alias("r")).select("r.prefix", "r.code", "n")


def neighbours(words: DataFrame, terminator: str = TERMINATOR) -> DataFrame:
    """(word, n_near, near_n, near): how many words are near, and the one of largest n; only words that have some."""
    index = rotations(words, terminator).repartitionByRange("prefix").sortWithinPartitions("prefix")
    head, tail = F.substring_index("prefix", terminator, 1), F.substring_index("prefix", terminator, -1)
    groups = index.groupBy("prefix").agg(F.collect_list(F.struct("n", "code")).alias("m")).where(F.size("m") > 1)
    members = F.sort_array(F.transform("m", lambda x: F.struct(
        (-x["n"]).alias("less"), F.concat(tail, F.substring(x["code"], 1, 1), head).alias("word"), x["code"].alias("code"))))

    def near(x: Column, y: Column) -> Column:
        whole = (x["code"] == "") | (y["code"] == "")  # an indel: the other one's character must begin its run
        return (x["code"] != y["code"]) & ~(whole & (F.length(x["code"]) + F.length(y["code"]) > 1))

    def summary(m: Column, x: Column) -> Column:
        others = F.filter(m, lambda y: near(x, y))
        return F.struct(x["word"].alias("word"), F.size(others).cast("long").alias("k"), F.get(others, F.lit(0)).alias("best"))
    ordered = groups.select(members.alias("m"))
    found = ordered.select(F.explode(F.transform("m", lambda x: summary(F.col("m"), x))).alias("s")).where("s.k > 0")
    best = found.groupBy("s.word").agg(F.sum("s.k").alias("n_near"), F.min(F.struct("s.best.less", "s.best.word")).alias("b"))
    return best.select("word", "n_near", (-F.col("b.less")).alias("near_n"), F.col("b.word").alias("near"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) from (word, form) links along which no more than ``steps`` can follow each other, by pointer doubling."""
    chain = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        onward = chain.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        chain = chain.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("beyond", "root").alias("root"))
    return chain


def group_variants(words: DataFrame, ratio: int = RATIO, terminator: str = TERMINATOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n); each form has at least ``ratio`` (2 or more) times its word's n."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    known = words.join(neighbours(words, terminator), "word", "left")
    has_form = F.col("near_n") >= F.col("n") * ratio
    table = store(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("near")).alias("form"),
                               F.when(has_form, F.col("near_n")).alias("form_n")), "variants")
    span = table.where("form IS NOT NULL").agg(F.max("form_n"), F.min("n")).first()
    # n grows by the ratio at each link, so the counts themselves bound the length of a chain
    steps = 0 if span[0] is None else int(math.log(span[0] / max(span[1], 1), ratio) + 1e-9) + 1
    chain = roots(table.where("form IS NOT NULL").select("word", "form"), steps)
    return table.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                    drop_every: int = DROP_EVERY, ratio: int = RATIO) -> DataFrame:
    """``group_variants`` of the words of all texts."""
    words = store(count_words(docs, doc_id, text, min_length, min_count, drop_every), "words")
    return group_variants(words, ratio)
