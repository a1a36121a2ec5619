"""Per-document operators: decontamination, BPE, counts, HTML, rules, classifier."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tapeloom.llm import bpe_count, byte_bpe, decontaminate, html_text, quadratic, quality_rules, wordhash
from tokenizers import Tokenizer

COUNT_PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " \n\t ", "a", "x" * 70_000, "ab 12 " * 30_000, "Éa ß 中文 😀   x", "<|endoftext|>hi<|endoftext|>", "it's we'll  \n\n  end  ", "a\x00b\x1cc"]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# words and hashes

@given(st.lists(st.text(alphabet="aB1 \n\t.é中", max_size=40), max_size=6), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_words_and_grams_match_plain_python(texts, n):
    seen = {}
    for lo, hi, w in wordhash.words_of(pa.array(texts, pa.string()), wordhash.NOT_SPACE, limit=16):
        keys = wordhash.mix(wordhash.grams(w.hash, n))
        for i in range(lo, hi):
            a, b = w.first[i - lo], w.first[i - lo + 1]
            words = texts[i].encode().split()
            assert [w.data[s:e].tobytes() for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] == words
            for k in range(len(words) - n + 1):
                assert seen.setdefault(tuple(words[k : k + n]), int(keys[a + k])) == int(keys[a + k])
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.integers(1, 40))
def test_sliding_min(values, n):
    if n <= len(values):
        got = wordhash.sliding_min(np.array(values), n)
        assert got.tolist() == [min(values[i : i + n]) for i in range(len(values) - n + 1)]


# decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            x = words(body)
            size = min(window, len(x))
            wanted = {tuple(x[i : i + size]) for i in range(len(x) - size + 1)} if x else set()
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wanted:
                    hit |= set(range(i, i + size))
                    found.add("null" if item is None else str(item))
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven"), (2, "short item"), (10, "one two three four five six seven eight nine ten"), (3, None), (4, "?!"), (None, "lone"), (2, "short item")]
TEXTS = [None, "", "nothing", "zero ONE, two three four five six seven eight nine ten eleven twelve", "a short item and short-item", "lone\x00lone",
         "one two three four five six seven eight nine", "é one two three four five six seven eight nine ten", "x " * 40_000 + "short item"]


@pytest.mark.parametrize("limit", [decontaminate.MAX_BYTES, 150])
def test_decontamination_matches_brute_force(spark, docs, limit):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs(TEXTS), items, max_bytes=limit).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == brute(TEXTS, ITEMS)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.scan(docs(TEXTS), items, max_bytes=limit, cut=True).collect()}
    assert cut[3] == "zero twelve" and cut[4] == "a and " and cut[2] == "nothing" and cut[0] is None and cut[8] == "x " * 40_000


@pytest.mark.parametrize("window", [10, 255, 256, 300])
@pytest.mark.parametrize("limit", [decontaminate.MAX_BYTES, 100_000])
def test_decontamination_with_long_windows(spark, docs, window, limit):
    rng = random.Random(window)
    item = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = [(1, " ".join(item)), (2, " ".join(item[:350])), (3, "a few words")]
    texts = ["before " + " ".join(item) + " after", " ".join(item[50:352]), " ".join(item[:299]), "a few words more", "clean"]
    items = spark.createDataFrame(rows, "item_id long, text string")
    got = decontaminate.scan(docs(texts), items, window=window, max_bytes=limit).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == brute(texts, rows, window) and got[0]["n_hit"] == 400


def test_decontamination_of_empty_tables_and_clashing_columns(spark, docs, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs([]), items).count() == 0
    assert [r["n_hit"] for r in decontaminate.scan(docs(TEXTS), items.limit(0)).collect()] == [0] * len(TEXTS)
    got = decontaminate.scan(clashing(TEXTS), items).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"]) for r in got] == [x[:2] for x in brute(TEXTS, ITEMS)] and got[0]["a.b"] == "own a.b"


# byte-level BPE

def test_bpe_round_trip_and_pieces(docs):
    coder = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.digests(docs(ODD), RANKS, public_tokenizers.PATTERN, piece_chars=50).orderBy("doc_id").collect()
    for row, text in zip(got, ODD, strict=True):
        ids = coder.encode_ordinary(text or "")
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text or ""))


def test_bpe_columns(docs, clashing):
    coded = byte_bpe.encode_column(clashing(ODD), RANKS, public_tokenizers.PATTERN)
    assert coded.columns[-1] == "ids_"
    back = byte_bpe.decode_column(coded, RANKS, public_tokenizers.PATTERN, ids="ids_").orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in back] == [x or "" for x in ODD]
    assert byte_bpe.digests(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab1 '\n\ts")), max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_safe_pieces_do_not_change_ids(text, limit):
    coder = byte_bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert byte_bpe.encode(coder, text, limit) == coder.encode_ordinary(text)


# token counts

LIBRARY = Tokenizer.from_file(COUNT_PATH)


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abe thin'\n\ts")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_counts_match_the_library(text):
    assert bpe_count.merges(COUNT_PATH, bpe_count.split_pattern()).count(text) == len(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_count_query_columns(docs, clashing):
    got = bpe_count.count_tokens(docs(ODD), COUNT_PATH, limit=100).orderBy("doc_id").collect()
    want = [len(LIBRARY.encode(x or "", add_special_tokens=False).ids) for x in ODD]
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got] == [(len((x or "").encode()), n, n > 100) for x, n in zip(ODD, want, strict=True)]
    assert bpe_count.count_tokens(docs([]), COUNT_PATH).count() == 0
    assert [r["n_tokens"] for r in bpe_count.count_tokens(clashing(ODD), COUNT_PATH).orderBy("doc_id").collect()] == want


def test_counts_of_every_code_point():
    counter = bpe_count.Merges(COUNT_PATH, bpe_count.split_pattern())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        part = points[i : i + 20_000] + [f"a{c}b1{c}2 !{c}? {c} {c}{c}" for c in points[i : i + 20_000 : 7]]
        want = LIBRARY.encode_batch_fast(part, add_special_tokens=False)
        assert [counter.count(x) for x in part] == [len(e.ids) for e in want]


def test_count_memory_is_bounded(monkeypatch):
    counter = bpe_count.Merges(COUNT_PATH, bpe_count.split_pattern())
    monkeypatch.setattr(bpe_count, "CACHE_WORDS", 3)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("aeioutn") for _ in range(5)) for _ in range(50))
    assert counter.count(text) == len(LIBRARY.encode(text).ids) and len(counter) <= 3


# HTML

@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain &amp; &lt;simple&gt;", "plain & <simple>"), ("<p>One<p>Two <b>bo</b>ld", "One\n\nTwo bold"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<table><tr><th>Name<th>N<tr><td>Long cell<td>1<tr><td>x<td>22</table>", "Name       N\nLong cell  1\nx          22"),
    ("<table><tr><td colspan=2>wide one<td>z<tr><td>a<td>b<td>c</table>", "wide one  z\na  b      c"),
    ("<table><tr><td>o<table><tr><td>in<td>ner</table><td>p</table>", "o        p\n\nin  ner"),
    ("<head><title>T</title><style>p{}</style></head><body>x<script>if(a<b)'</p>'</script>y<!-- z -->w", "xyw"),
    ("<p hidden>no</p><p style='DISPLAY : none'>no</p><i style='visibility:hidden'>no</i>yes", "yes"),
    ("<pre>a\n   b\n</pre>c", "a\n   b\n\nc"), ("</p></div></b>x<p>y</i>z", "x\n\nyz"), ("1 < 2 <", "1 < 2 <"), ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("<a href='x>y' title=\"q\">l</a><img alt='>'>m", "lm"), ("<p>a</p>\n\n  <p> b  c </p>", "a\n\nb c"), ("<textarea>t&amp;<b></textarea>", "t&<b>"),
])
def test_html_text(page, text):
    assert html_text.extract(page) == text


def test_html_of_deep_broken_and_odd_pages(docs, clashing):
    deep = "<div>" * 30_000 + "x" + "</span>" * 1000
    got = html_text.extract_column(docs([deep, None, "<", "<p", "<a b='", "<!--", "<script>", "<table><td>" * 50 + "y"]), html="text", text="out").orderBy("doc_id").collect()
    assert [r["out"] for r in got] == ["x", "", "<", "", "", "", "", "y"]
    assert html_text.extract_column(docs([]), html="text").count() == 0
    assert [r["rid_"] for r in html_text.extract_column(clashing(["<b>z"]), html="text", text="rid").collect()] == ["z"]


@given(st.text(alphabet="<>/pbdivtrul li=\"'-! &;x\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_html_never_fails(page):
    html_text.extract(page)


# rules

def rule_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_match_brute_force(docs, clashing):
    rng = random.Random(3)
    texts = ["", None, " \n ", "a b c d", "a b c d e a b c d e", "same line\nsame line\n\nother\nsame line", "# * $ % & | < >", "é中😀 x" * 20, "a a a a a a a"] + [
        " ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(30)] + [" ".join(str(i % 977) for i in range(20_000))]
    got = quality_rules.judge(docs(texts)).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        if len(text or "") < 1000:
            assert tuple(r[c] for c in quality_rules.COUNTS) == rule_counts(text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(docs([])).count() == 0
    assert [r["n_words"] for r in quality_rules.judge(clashing(texts[:5])).orderBy("doc_id").collect()] == [0, 0, 0, 4, 10]


def test_rules_are_one_projection_without_python(docs):
    plan = quality_rules.judge(docs(["a"]).coalesce(1))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Window" not in plan and "Aggregate" not in plan.replace("aggregate(", "")


def test_rules_keep_labelled_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    judged = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    assert judged.where("NOT base_failed AND NOT kept").count() == 0


# classifier

def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quadratic.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    seen = got.join(labels, "doc_id").where("held_out")
    assert seen.where("predicted = quality").count() >= 0.95 * seen.count()
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.7 AS INT)").count() == 0
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert got.join(quadratic.score(docs, other).withColumnRenamed("score", "s2"), "doc_id").where("abs(score - s2) > 1e-9").count() == 0


def test_model_is_the_plain_quadratic_discriminant(spark):
    rng = np.random.default_rng(5)
    d = len(quadratic.FEATURES)
    x = np.concatenate([rng.normal(0, 1, (80, d)), rng.normal(1, 2, (60, d))])
    y = [0] * 80 + [1] * 60
    rows = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y, strict=True)] + [(x[0].tolist(), 7), (x[0].tolist(), None)], "f array<double>, c int")
    got = quadratic.fit(rows, "c", "f").scores(x)
    pooled = np.diag((x[:80].var(axis=0) * 80 + x[80:].var(axis=0) * 60) / 140 + 1e-6)
    logs = []
    for part in (x[:80], x[80:]):
        s = 0.9 * np.cov(part.T, bias=True) + 0.1 * pooled
        diff = x - part.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(got, 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(61 / 81)))), atol=1e-6)


def test_classifier_edge_cases(spark, docs, clashing):
    labels = spark.createDataFrame([(0, 1), (0, None), (99, 0), (None, 1), (1, 5)], "doc_id long, quality int")
    texts = [(0, "fine"), (1, None), (None, ""), (0, "fine"), (4, "x" * 300_000)]
    got = quadratic.score(docs(texts), labels).collect()
    assert len(got) == 5 and {round(r["score"], 9) for r in got} == {round(3 / 4, 9)} and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert quadratic.score(docs([]), labels).count() == 0
    assert quadratic.score(docs(texts), labels.limit(0)).count() == 5
    assert quadratic.score(clashing(texts), labels).count() == 5
    assert quadratic.accept(clashing(texts), quadratic.model_of(clashing(texts), labels)).columns[-1] == "path"


def test_features_do_not_depend_on_chunks():
    texts = ["one two\ntwo two", "", "A!! | ###", "é 中 1 2 3"] * 5
    whole = quadratic.features(pa.array(texts))
    assert np.allclose(whole, np.concatenate([quadratic.features(pa.array([t])) for t in texts]))
    assert quadratic.features(pa.array([], pa.string())).shape == (0, len(quadratic.FEATURES))


def test_schema_kinds(docs):
    fields = {f.name: f.dataType for f in bpe_count.count_tokens(docs(["a"]), COUNT_PATH).schema}
    assert fields["n_bytes"] == T.LongType() and fields["over_limit"] == T.BooleanType()
