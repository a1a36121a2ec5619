"""Quality rules: a threshold table compiled into one Spark projection, with built-in functions only.

Words are runs of characters other than space and 9-13. The base statistics are exact over whole texts: word_chars,
n_symbols, n_dup_lines (lines with a word that equal an earlier line) and n_repeat_words (words in five-word windows that
occur twice or more in the text, found by sorting window hashes within the row; one wrong match among n windows has odds of
n**2 / 2**65). Ratios are derived from them and held against ``RULES``; a text is kept if every rule holds. Nothing is
shuffled and no Python runs.

Defined cases: null and empty texts have no words, all counts 0, and fail the base rule; repeated rows are judged each;
an empty table gives no rows; further columns are kept unless they have the names of the statistics.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.tables import free_name, quoted, without

#: Frequent words of the four languages that texts are written in.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "it", "that", "for", "was", "on", "with", "as", "by", "this", "be", "are", "from", "at",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "du", "que", "qui", "pour", "dans", "par", "au", "est", "il", "ne", "se",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "dem", "nicht", "ein", "eine", "auf", "ist", "im", "es", "an", "auch", "als",
    "el", "los", "las", "y", "del", "con", "una", "por", "para", "su", "al", "lo", "como", "o", "no", "más", "pero", "sus", "si", "sobre",
]


class Rule(NamedTuple):
    """A ratio and the range it must lie in, for texts of ``from_words`` words or more."""
    name: str
    low: float
    high: float
    from_words: int = 0


#: The method's thresholds.
RULES = [
    Rule("mean_word_chars", 2.0, 20.0, 20),
    Rule("symbols_per_word", 0.0, 0.2),
    Rule("stop_word_ratio", 0.01, 1.0, 100),
    Rule("dup_line_ratio", 0.0, 0.5, 20),
    Rule("shout_ratio", 0.0, 0.5, 20),
]

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(sorted_keys: Column) -> Column:
    """Places whose key also stands before or after them in the sorted list, in order."""
    marked = F.transform(sorted_keys, lambda x, i: F.when(
        (x["k"] == F.get(sorted_keys, i - 1)["k"]) | (x["k"] == F.get(sorted_keys, i + 1)["k"]), x["p"]))
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base statistics and n_lines, n_stop_words and n_shouted (capital letters), all long."""
    docs = without(docs, [*COUNTS, "n_lines", "n_stop_words", "n_shouted"])
    names = [quoted(c) for c in docs.columns]
    w, h, k, p, lines, n = (free_name(docs.columns, x) for x in ("words_", "hashes_", "keys_", "places_", "lines_", "n_words"))
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    step = docs.select(*names, F.array_remove(F.split(body, BLANKS), "").alias(w),
                       F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD)).alias(lines))
    step = step.select("*", F.transform(w, lambda x: F.xxhash64(x)).alias(h), F.size(w).cast("long").alias(n))
    keys = F.transform(F.sequence(F.lit(0), (F.col(n) - WINDOW).cast("int")),
                       lambda i: F.struct(F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]).alias("k"), i.alias("p")))
    step = step.select("*", F.when(F.col(n) >= WINDOW, F.sort_array(keys)).alias(k))
    step = step.select("*", F.coalesce(_repeats(F.col(k)), F.array().cast("array<int>")).alias(p))
    covered = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    plain = F.filter(w, lambda x: F.regexp_replace(F.lower(x), r"[.,;:!?]+$", "").isin(STOP_WORDS))
    counted = F.struct(
        F.col(n).alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"), F.size(plain).cast("long").alias("n_stop_words"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_shouted"))
    # one row in, one row out: a generator keeps later filters from being substituted into these expressions over and over
    return step.select(*names, F.inline(F.array(counted)))


#: The ratios that rules may name, over the statistics.
RATIOS = {
    "mean_word_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(10)),
    "stop_word_ratio": lambda: F.col("n_stop_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_ratio": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "shout_ratio": lambda: F.col("n_shouted") / F.greatest(F.col("word_chars"), F.lit(1)),
}


def verdict(rules: list[Rule]) -> Column:
    """True if every rule holds."""
    out = F.lit(True)
    for rule in rules:
        ratio = RATIOS[rule.name]()
        out = out & ((F.col("n_words") < rule.from_words) | ratio.between(rule.low, rule.high))
    return out


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the base statistics, base_failed and kept."""
    docs = without(docs, [*COUNTS, "n_lines", "n_stop_words", "n_shouted", "base_failed", "kept"])
    counted = statistics(docs, text)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(*[quoted(c) for c in docs.columns], *COUNTS, failed.alias("base_failed"), (~failed & verdict(RULES if rules is None else rules)).alias("kept"))
