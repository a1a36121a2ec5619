"""Alignment of two tokenizers against a walk over all tokens; fragments compose in any order."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tapeloom.llm import alignment
from tokenizers import Tokenizer

PATHS = alignment.Paths(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coders():
    return PATHS.load()


def walk(coders, text):
    """(ids, ids, linked pairs, printed groups) by walking both lists."""
    a, b = coders
    whole = Tokenizer.from_file(PATHS.first)
    whole.encode_special_tokens = True
    first = whole.encode(" " + (text or ""), add_special_tokens=False).ids
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS.second).encode(text or "")
    raw = (" " + (text or "")).encode()
    if not text or b"".join(a.tokens[i] for i in first) != raw or b"".join(b.tokens[i] for i in second) != raw:
        return [], [], [], ""
    owner = [[i for i, t in enumerate(ids) for _ in coder.tokens[t]] for coder, ids in ((a, first), (b, second))]
    linked = sorted(set(zip(*owner, strict=True)))
    groups, i, j, at, other = [], 0, 0, 0, 0
    left, right = [], []
    while i < len(first) or j < len(second):
        if at <= other and i < len(first):
            left.append(first[i])
            at += len(a.tokens[first[i]])
            i += 1
        else:
            right.append(second[j])
            other += len(b.tokens[second[j]])
            j += 1
        if at == other and left and right:
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
            left, right = [], []
    return first, second, [(first[x], second[y]) for x, y in linked], ";".join(groups)


def expected(coders, rows):
    known = [(i, walk(coders, t)) for i, t in rows]
    counts = collections.Counter(p for _, w in known for p in w[2])
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted(((i, len(f), len(s), g.count(";") + 1 if g else 0, len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for i, (f, s, p, g) in known), key=repr)


def aligned(df, **options):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in alignment.align(df, PATHS, **options).collect()), key=repr)


def texts():
    rng = random.Random(4)
    words = ["the", "anonymous", "übergang", "don't", "1234567", "<|endoftext|>", "</s>", "日本語", "naïve", "x1y2", "\U0001f600", "  ", "\n", "\t", "http://a.b/c?d=e"]
    out = [None, "", " ", "a", "  lead", "trail ", "trail  ", "\n", "\nline\n\n next", "a▁b", "▁", "ﬁ Ａ", "᠎ x​ y", "a" * 900, "日本" * 400, "word " * 400, " " * 300]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(25)]
    return out + out[20:23]


@pytest.mark.parametrize(("chunk", "max_pairs"), [(1 << 16, 4_000_000), (64, 4_000_000), (50, 300), (7, 4_000_000)])
def test_alignment_matches_a_walk(coders, docs, chunk, max_pairs):
    rows = list(enumerate(texts())) + [(None, "no id"), (3, "repeated id")]
    assert aligned(docs(rows), chunk=chunk, max_pairs=max_pairs) == expected(coders, rows)


def test_a_very_long_text_is_composed_from_chunks(coders, docs):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdeé 1\n") for _ in range(rng.randrange(1, 12))) for _ in range(60_000))
    assert aligned(docs([(1, text)]), chunk=4096) == expected(coders, [(1, text)])


def test_chunks_at_safe_places_give_the_tokens_of_the_whole(coders):
    for text in filter(None, texts()):
        whole = " " + text
        for coder in coders:
            places = alignment.chunk_places(whole, coder, 5)
            parts = [coder.ids([whole[x:y]])[0] for x, y in zip(places, places[1:], strict=False) if x < y]
            assert np.concatenate(parts).tolist() == coder.ids([whole])[0].tolist(), text


@given(st.text(alphabet=" ab\n\t.1\u2581\u180e\u200b\ufeff\u00a0\x1c\u00e9\u65e5<|>", max_size=30))
@settings(max_examples=300, deadline=None)
def test_units_give_the_tokens_of_the_whole(coders, text):
    if not text:
        return
    parts = alignment.units(text)
    assert "".join(" " + u for u in parts) == " " + text
    for coder in coders:
        joined = np.concatenate(coder.ids([" " + u for u in parts]))
        assert joined.tolist() == coder.ids([" " + text])[0].tolist()


@pytest.mark.parametrize("held", [(0, 0), (10, 4)])
def test_what_is_remembered_changes_nothing(coders, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD_UNITS", held[0])
    monkeypatch.setattr(alignment, "HELD_LENGTH", held[1])
    monkeypatch.setattr(alignment, "CALL_BYTES", 100)
    plain = [t or "" for t in texts()]
    known = alignment.Remembered(*coders)
    for text, (first, second) in zip(plain * 2, alignment.tokenize(known, plain * 2), strict=True):
        want = walk(coders, text)
        assert (np.frombuffer(first, coders[0].dtype).tolist(), np.frombuffer(second, coders[1].dtype).tolist()) == (list(want[0]), list(want[1]))


class Sizes(alignment.Vocabulary):
    """A vocabulary whose token i has i + 1 bytes."""

    def __init__(self):
        super().__init__([b"x" * (i + 1) for i in range(6)])


def same(x, y):
    return all(np.array_equal(p, q) for p, q in zip((*x.head, *x.body, *x.tail), (*y.head, *y.body, *y.tail), strict=True)) and x.start == y.start and x.closed == y.closed and x.ok == y.ok


@given(st.data())
@settings(max_examples=200, deadline=None)
def test_fragments_compose_associatively(data):
    v = Sizes()
    first = data.draw(st.lists(st.integers(0, 5), min_size=1, max_size=25))
    total, second = sum(i + 1 for i in first), []
    while (left := total - sum(i + 1 for i in second)) > 0:
        second.append(data.draw(st.integers(0, min(5, left - 1))))
    n = data.draw(st.integers(1, 5))
    cuts = [sorted([0, len(ids), *(data.draw(st.integers(0, len(ids))) for _ in range(n - 1))]) for ids in (first, second)]
    ids = [np.array(x, v.dtype) for x in (first, second)]
    parts = []
    for k in range(n):
        start = tuple(int(v.size[x[: c[k]]].sum()) for x, c in zip(ids, cuts, strict=True))
        parts.append(alignment.fragment(v, v, start, *(x[c[k] : c[k + 1]] for x, c in zip(ids, cuts, strict=True)), ok=bool(k % 2)))
    whole = alignment.fragment(v, v, (0, 0), *ids, ok=n == 0)
    left = parts[0]
    for p in parts[1:]:
        left = alignment.compose(v, v, left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = alignment.compose(v, v, p, right)
    assert same(left, right) and same(left, whole) and not len(left.tail[0])


def test_edges(docs, clashing):
    assert aligned(docs([])) == []
    out = alignment.align(clashing(["some text", None]), PATHS)
    assert set(out.columns) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"} and out.count() == 2
    assert alignment.align(docs(["some text"]).withColumnRenamed("doc_id", "rid"), PATHS, doc_id="rid").first()["rid"] == 0
