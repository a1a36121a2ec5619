"""Noisy-channel restoration and the score of the restored text."""

import itertools
import random
from zlib import crc32

import numpy as np
import pytest
from tapeloom.llm import toxicity
from tapeloom.llm.toxicity import BOUNDARY, SIZE, CharacterModel

WORDS = ["table", "letter", "summer", "garden", "stupid", "idiot", "winter", "people", "little", "street", "paper", "house", "trash", "music"]


def model_of(words, times=40):
    counts = np.zeros(SIZE**3, np.int64)
    table = toxicity._symbol_table()
    for w in words:
        s = [BOUNDARY, *(int(table[ord(c)]) for c in w), BOUNDARY]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            counts[(a * SIZE + b) * SIZE + c] += times
        counts[s[-2] * SIZE * SIZE + s[1]] += 1
    return CharacterModel(counts)


@pytest.fixture(scope="module")
def model():
    return model_of(WORDS)


@pytest.mark.parametrize(("disguised", "plain"), [
    ("1d10t", "idiot"), ("5tup1d", "stupid"), ("you $tupid one", "you stupid one"), ("i d i o t", "idiot"), ("i.d.i.0.t!", "idiot!"), ("STUUUUPID", "stupid"),
    ("l1ttttle", "little"), ("tr4sh", "trash"), ("tra*sh", "trash"), ("an i-d-i-o-t, yes", "an idiot, yes")])
def test_disguises_are_undone(model, disguised, plain):
    assert model.restore(disguised)[0] == plain


@pytest.mark.parametrize("plain", ["", "the little table", "idiot### trash$$$", "10 20 30", "1 2 3", "a b c", "\n\t", "x" * 2, "été à la maison", "日本語 текст"])
def test_plain_text_stays(model, plain):
    assert model.restore(plain) == (plain.lower(), 0)


def likeliest(model, text):
    """All paths of the lattice, one by one."""
    best = None
    stack = [(0, (BOUNDARY, BOUNDARY), 0.0, "")]
    while stack:
        i, last, score, out = stack.pop()
        if i == len(text):
            score += 0.0 if last[1] == BOUNDARY else model.table[(last[0] * SIZE + last[1]) * SIZE]
            best = max(best or (score, out), (score, out), key=lambda x: x[0])
            continue
        for end, symbols, shown, cost in model.readings(text, i):
            now, total = last, score + cost
            for s in symbols:
                if s == BOUNDARY and now[1] == BOUNDARY:
                    continue
                total += model.table[(now[0] * SIZE + now[1]) * SIZE + s]
                now = (now[1], s)
            stack.append((end, now, total, out + shown))
    return best


def score_of(model, text, reading):
    """The best score among the paths that give a reading."""
    return likeliest(model, text)[0] if reading == likeliest(model, text)[1] else None


def test_viterbi_finds_the_best_path(model):
    rng = random.Random(3)
    for _ in range(150):
        word = rng.choice(WORDS)
        noise = "".join(rng.choice(["1", "0", "$", "|", "*", c, c, c, c * rng.randrange(1, 4), c + "."]) for c in word[:6])
        best = likeliest(model, noise)
        assert model.decode(noise) == best[1] or score_of(model, noise, model.decode(noise)) == best[0], noise


def corpus(rng, n, toxic_share=0.3):
    rows = []
    for i in range(n):
        toxic = rng.random() < toxic_share
        words = [rng.choice(WORDS[:4] + WORDS[6:12]) + rng.choice(["", "s", "er", "a"]) for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["stupid", "idiot", "trash"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_labels_and_disguised_words(spark, docs):
    rng = random.Random(5)
    rows = corpus(rng, 700)
    swap = str.maketrans("iosa", "105@")
    extra = [(10_000 + i, " ".join(w.translate(swap) if w in ("stupid", "idiot", "trash") else w for w in t.split()), y) for i, t, y in corpus(rng, 60)]
    marks = labels_of(spark, [(i, 1, y) for i, _, y in rows] + [(1, 1, None), (2, 0, 7), (None, 1, 1), (999_999, 1, 1)])
    got = {r["doc_id"]: r for r in toxicity.score(docs([(i, t) for i, t, _ in rows + extra] + [(-1, None), (-2, ""), (None, "stupid idiot trash")]), marks).collect()}
    assert len(got) == len(rows) + len(extra) + 3
    for i, r in got.items():
        assert r["held_out"] == (i is not None and crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    hidden = [(got[i]["predicted"], y) for i, _, y in extra]
    assert sum(p == y for p, y in hidden) >= 0.95 * len(hidden) and sum(got[i]["n_restored"] for i, _, y in extra if y) > 0
    assert got[-1]["score"] == got[-2]["score"] < 0.7 and got[-1]["predicted"] == 0


def test_copies_do_not_make_their_words_evidence(spark, docs):
    rng = random.Random(6)
    rows = corpus(rng, 500)
    copy = "zebra lion tiger monkey " + " ".join(WORDS[:4]) + " stupid idiot trash"
    rows += [(1000 + i, copy, 1) for i in range(300)]
    probe = (5000, "zebra lion tiger monkey walk through the garden in winter with people and music", 0)
    got = {r["doc_id"]: r for r in toxicity.score(docs([(i, t) for i, t, _ in [*rows, probe]]), labels_of(spark, [(i, 1, y) for i, _, y in rows])).collect()}
    assert got[5000]["predicted"] == 0 and got[1000]["predicted"] == 1


def test_edges(spark, docs, clashing):
    none = labels_of(spark, [])
    assert toxicity.score(docs([]), none).count() == 0
    alone = toxicity.score(docs(["some text", None]), none).collect()
    assert [r["score"] for r in alone] == [0.5, 0.5]
    one_class = toxicity.score(docs(["some text", "other"]), labels_of(spark, [(0, 1, 0), (1, 1, 0)])).collect()
    assert all(r["score"] < 0.5 for r in one_class)
    out = toxicity.score(clashing(["stupid", None, ""]), none)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "n_restored"] and out.count() == 3
    twice = docs([(7, "same"), (7, "same")])
    assert len({tuple(r) for r in toxicity.score(twice, none).collect()}) == 1


def test_long_and_hostile_texts(model):
    for text in ("a " * 200_000, "1" * 300_000, "a1" * 20_000, "aaaa" * 100_000, "x y" * 50_000, "$" * 100_000 + "ab", ("ab" * 30 + "### ") * 3000):
        model.restore(text)


def test_trigrams_of_all_texts(docs):
    texts = ["ab c", None, "", "AB!", "a" * 5000]
    got = {r["gram"]: r["n"] for r in toxicity.count_trigrams(docs(texts), chars=100).collect()}
    want = {}
    for t in texts:
        for word in (t or "").lower().replace("!", " ").split():
            s = [0, *(toxicity.SYMBOL[c] for c in word), 0]
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                want[(a * SIZE + b) * SIZE + c] = want.get((a * SIZE + b) * SIZE + c, 0) + 1
    within = {g: n for g, n in got.items() if g // SIZE % SIZE != BOUNDARY}  # the others lie across words, and depend on the order of texts
    assert within == want and all(g // SIZE % SIZE == BOUNDARY for g in itertools.filterfalse(want.__contains__, got))
