"""Spelling variants against brute force over all pairs."""

import collections
import random
import re
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tapeloom.llm import variants


def brute_words(rows, min_length=7, min_count=2, every=31):
    out = collections.Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(n_of, ratio=10):
    table = {}
    for w, n in n_of.items():
        others = [x for x in n_of if near(w, x)]
        best = min(others, key=lambda x: (-n_of[x], x), default=None)
        form = best if best is not None and n_of[best] >= ratio * n else None
        table[w] = (form, n, len(others), None if form is None else n_of[form])
    out = set()
    for w, (form, n, k, form_n) in table.items():
        root = w
        while table[root][0] is not None:
            root = table[root][0]
        out.add((w, form, root, n, k, form_n))
    return out


def as_set(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def random_words(seed, letters="abé", n=120):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(n)}
    return {w: 10 ** rng.randrange(0, 5) * rng.randrange(1, 4) for w in words}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forms_match_brute_force(spark, seed):
    n_of = random_words(seed)
    got = variants.group_variants(spark.createDataFrame(list(n_of.items()), "word string, n long"))
    assert as_set(got) == brute_forms(n_of) and got.count() == len(n_of)
    assert any(root not in (form, w) for w, form, root, *_ in as_set(got))  # chains of two links and more


def test_long_chain_and_ties(spark):
    n_of = {"a" * k: 10 ** (8 - k) for k in range(1, 9)} | {"bbbb": 3, "bbbc": 30, "bbba": 30, "abbb": 30}
    assert as_set(variants.group_variants(spark.createDataFrame(list(n_of.items()), "word string, n long"))) == brute_forms(n_of)


@given(st.text("ab.", min_size=1, max_size=6), st.text("ab.", min_size=1, max_size=6))
@settings(max_examples=30, deadline=None)
def test_brute_near_is_symmetric(a, b):
    assert near(a, b) == near(b, a)


def test_pairs_of_all_short_words(spark):
    words = [a + b + c for a in ("", "x", "y", ".") for b in ("x", "y", ".") for c in ("", "x", ".", "é")]
    n_of = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
    assert as_set(variants.group_variants(spark.createDataFrame(list(n_of.items()), "word string, n long"), ratio=2)) == brute_forms(n_of, 2)


def test_corpus_counts_match_brute_force(docs):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 12))) for _ in range(60)]
    texts = [" ".join(rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randrange(1, 200))) for _ in range(80)]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (500, None), (501, ""), (502, "x" * 100_000 + " 12 " + texts[1]), (503, "Übergang×÷übergang ÜBERGANG")]
    counted = {r["word"]: r["n"] for r in variants.count_words(docs(rows), held_words=50).collect()}
    assert counted == brute_words(rows)
    assert as_set(variants.corpus_variants(docs(rows))) == brute_forms(brute_words(rows))


def test_edges(spark, docs, clashing):
    assert variants.corpus_variants(docs([])).count() == 0
    assert variants.corpus_variants(docs([None, "", "short words only"])).count() == 0
    out = variants.corpus_variants(clashing(["lengthy lengthy", "lengthy"]))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and as_set(out) == {("lengthy", None, "lengthy", 3, 0, None)}
    odd = spark.createDataFrame([(None, 5), ("a$b", 5), ("ab", 50)], "word string, n long")
    assert {r["word"] for r in variants.neighbours(odd).collect()} == set()
    with pytest.raises(ValueError, match="more frequent"):
        variants.group_variants(odd, ratio=1)
