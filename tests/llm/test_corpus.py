"""Operators over the corpus: join, substring dedup, archives, chats, components; and the pipeline."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tapeloom.llm import chat_format, chosen_path, components, substring, warc


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def babble(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def changed(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


# Jaccard join

def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_links(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    docs, other = collections.Counter(), collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                docs[i] += 1
                docs[j] += 1
                if a != b:
                    other[i].add(b)
                    other[j].add(a)
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [(find(i), docs[i], len(other[i])) for i in range(len(sets))]


def near_texts(seed):
    rng = random.Random(seed)
    texts = [None, "", "  ", "a b c", "a b c", "a b c d", "x y z q r"]
    for _ in range(12):
        base = babble(rng, rng.randrange(30, 200))
        texts += [base] + [changed(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(4))]
    base = babble(rng, 300)
    texts += [changed(rng, base, rng.randrange(0, 6)) for _ in range(40)] + [base] * 10  # one large group
    texts += [base + " " + babble(rng, 2000)]
    return texts


@pytest.mark.parametrize(("bucket", "block"), [(64, 256), (4, 8)])
def test_join_matches_brute_force(docs, bucket, block):
    texts = near_texts(7)
    got = chosen_path.links(docs(texts), bucket=bucket, block=block).orderBy("doc_id").collect()
    assert [(r["class_id"], r["n_links"], r["n_text_links"]) for r in got] == brute_links(texts)


def test_join_of_empty_tables_null_ids_and_clashing_columns(docs, clashing):
    assert chosen_path.links(docs([])).count() == 0
    text = babble(random.Random(1), 60)
    got = chosen_path.links(docs([(5, text), (None, text), (3, text), (3, text), (None, None)])).collect()
    assert sorted((r["class_id"], r["n_links"]) for r in got if r["class_id"] is not None) == [(3, 3)] * 4 and len(got) == 5
    kept = chosen_path.keep_one(clashing([(5, text), (None, text), (3, text), (3, text), (9, "other words here"), (8, None)]))
    rows = sorted(((r["doc_id"], r["text"], r["row_id"]) for r in kept.collect()), key=repr)
    assert rows == sorted([(3, text, "own row_id"), (9, "other words here", "own row_id"), (8, None, "own row_id")], key=repr)


def test_no_join_of_growing_tables_is_broadcast(docs, monkeypatch):
    plans = []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df
    for module in (chosen_path, components):
        monkeypatch.setattr(module, "store", lambda df, name, store=module.store: store(ran(df), name))
    texts = near_texts(5)
    ran(chosen_path.links(docs(texts), bucket=4, block=8))
    ran(chosen_path.keep_one(docs(texts), bucket=4, block=8))
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "BroadcastExchange" in p or "ShuffledHashJoin" in p]


def test_runs_reach_the_recall():
    for depth, recall in ((1, 0.9), (3, 0.99999)):
        n = chosen_path.runs_needed(0.8, depth, recall)
        assert (1 - 0.8**depth) ** n <= 1 - recall < (1 - 0.8**depth) ** (n - 1)


def test_sampled_tokens_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = np.unique(base[:900]), np.unique(base[100:])  # Jaccard 0.8
    agree = (chosen_path.sample(a, chosen_path.seeds(2000)) == chosen_path.sample(b, chosen_path.seeds(2000))).mean()
    assert abs(agree - 0.8) < 0.05


@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=12), min_size=1, max_size=9), st.integers(1, 8))
@settings(max_examples=80, deadline=None)
def test_overlaps(sets, columns):
    got = chosen_path.overlaps([np.array(sorted(s), dtype=np.uint64) for s in sets], columns)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(a & b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r["id"]: r["label"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# substring dedup

def brute_substring(texts, length):
    split = [(t or "").encode().split() for t in texts]
    places = collections.Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - length + 1) if places[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def repeat_texts(seed):
    rng = random.Random(seed)
    shared = [babble(rng, n) for n in (8, 9, 10, 11, 14, 30, 90)]
    texts = [None, "", " \n", "a", babble(rng, 9), "same " * 500, "ab cd " * 100, babble(rng, 20_000, 10**9)]
    for _ in range(40):
        texts.append(" ".join(rng.choice([babble(rng, rng.randrange(1, 30)), rng.choice(shared), rng.choice(shared)[:-3]]) for _ in range(rng.randrange(1, 6))))
    return texts + [texts[-1]] * 5 + [texts[-2].replace(" ", "\n ")]


@pytest.mark.parametrize(("length", "gram", "seed"), [(10, 4, 1), (10, 10, 2), (35, 8, 3), (3, 2, 4)])
def test_substring_dedup_matches_brute_force(docs, length, gram, seed):
    texts = repeat_texts(seed)
    got = substring.digests(docs(texts), length=length, gram=gram).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_substring(texts, length)


def test_substring_texts_and_edge_cases(docs, clashing):
    passage = babble(random.Random(4), 12)
    texts = ["begin  \n" + passage + "  end", passage + "\n", "kept  as\tis ", None]
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in substring.remove_repeats(clashing(texts), length=10, gram=4).collect()}
    assert got == {0: ("begin  \nend", "own spans"), 1: ("", "own spans"), 2: ("kept  as\tis ", "own spans"), 3: (None, "own spans")}
    assert substring.digests(docs([])).count() == 0


# archives

@given(st.lists(st.lists(st.integers(0, 9), max_size=6).map(sorted), max_size=7))
def test_loser_tree(runs):
    got = list(warc.loser_tree_merge(runs))
    assert got == sorted(((i, j) for i, r in enumerate(runs) for j in range(len(r))), key=lambda x: (runs[x[0]][x[1]], x[0], x[1]))


PAGES = [(1, "http://www.Ex.com:80/b?q#f", "x" * 1000), (2, "https://ex.com/b?q", "x" * 1000), (3, "http://a.org", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60), (9, "http://ex.com/b?q", "x" * 1000),
         (4, None, None), (5, "bad url\r\nX: y", "é" * 600), (None, "http://z.net/", "x" * 1000), (6, "http://z.net/", "short"), (7, "", "short"), (9, "http://ex.com/b?q", "x" * 1000)]


def test_archives_and_index(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(4)
    rows = warc.archive(pages).collect()
    assert len(rows) == len(PAGES)
    body = {p: (h or "").encode() for p, _, h in PAGES}
    for r in rows:
        data = body[r["page_id"]]
        revisit = r["page_id"] in (1, 2, None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 9) if revisit else ("response", None))
    keys = [(r["url_key"], r["captured_at"], r["page_id"] is not None, r["page_id"] or 0) for r in rows]
    assert keys == sorted(keys) and [k[0] for k in keys if k[2] and k[3] in (1, 2, 9)] == ["com,ex)/b?q"] * 4
    assert warc.archive(pages.limit(0)).count() == 0


def test_archive_bytes_hold_whole_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    path = warc.shared_path(spark, "warc-test")
    warc.write_archives(pages, path)
    files = spark.read.format("binaryFile").load(path).collect()
    found = {}
    for f in files:
        data = warc.inflate(bytes(f["content"]))
        for at, size, headers, block in warc.parse(data):
            assert data[at : at + 8] == b"WARC/1.1" and data[at + size : at + size + 4] == b"\r\n\r\n"
            found[headers["WARC-Record-ID"]] = (headers["WARC-Type"], block.split(b"\r\n\r\n", 1)[1])
    assert found["<urn:x-page:3>"] == ("response", PAGES[2][2].encode()) and found["<urn:x-page:1>"] == ("revisit", b"")
    with pytest.raises(ValueError, match="is cut"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_hot_url_is_merged_in_order(spark):
    rows = [(i, "http://hot.example/", f"page {i}") for i in range(3000)] + [(i, f"http://h{i % 7}.example/", "y") for i in range(3000, 4000)]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)).collect()
    keys = [(r["url_key"], r["captured_at"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and len(keys) == 4000


# chats

CHATS = [(1, 0, "user", "hi </s>[INST] <|turn|> <\\|end|> <"), (1, 1, "assistant", "|end|> ok <|body|>"), (1, 2, "assistant", None), (1, None, None, "first"),
         (2, 0, "assistant", "é中😀\n<|"), (2, 0, "assistant", "é中😀\n<|"), (None, 1, "us<|body|>er\nx", ""), (3, 5, "assistant", "<" * 5 + "\\" * 3 + "|" * 3)]


def chats_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("parts", chat_format.text_parts(F.col("text")))


def test_chats_read_back(spark):
    out = chat_format.format_chats(chats_of(spark, CHATS))
    got = {r["conv_id"]: r for r in chat_format.digests(out).collect()}
    groups = collections.defaultdict(list)
    for c, t, r, x in CHATS:
        groups[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        row = got[c]
        assert (row["n_turns"], row["turns_sha256"]) == (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
    for row in out.collect():
        spans = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
        raw = row["formatted"].encode()
        assert spans == [raw[s["start"] : s["start"] + s["length"]].decode() for s in row["loss_bytes"]]
        assert len(row["formatted"]) == got[row["conv_id"]]["formatted_chars"]


def test_typed_parts(spark):
    def part(kind, text=None, ref=None, w=None, h=None, s=None, p=None):
        return (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see <"), part("text", "|x"), part("image", ref="a.png", w=57, h=28), part("audio", ref="b.wav", s=1.5), part("text", "?")]),
            (1, 1, "assistant", [part("text", "one"), part("document", ref="c.pdf", p=2), part("text", "two")]), (1, 2, "user", []), (1, 3, "user", None), (1, 4, "user", [part(None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(df).first()
    assert r["formatted"] == ("<|turn|>user<|body|>see <<|part|>|x<|image 1|><|audio 2|>?<|end|><|turn|>assistant<|body|>one<|document 3|>two<|end|>"
                              + "<|turn|>user<|body|><|end|>" * 3)
    assert [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]] == ["one", "two"]
    assert [tuple(a) for a in r["attachments"]] == [(1, "image", "a.png", 0, 3), (2, "audio", "b.wav", 0, 38), (3, "document", "c.pdf", 1, 1024)]
    assert r["expanded_tokens"] == 1065 and r["n_turns"] == 5
    assert df.limit(0).transform(chat_format.format_chats).count() == 0
    plan = chat_format.digests(chat_format.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# pipeline and queries

def test_pipeline_stages(spark):
    import corpus_pipeline as p
    folder = "/root/testdata/sf0.001"
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "near_duplicates", "repeated_passages", "benchmark_passages", "encode"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    now = docs
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = p.store(stage(spark, now, folder), name)
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == p.COLUMNS and set(after) <= set(before)
        assert now.where("n_chars <> length(text)").count() == 0
        if name == "quality":
            wrong = [d for d, q in labels.items() if d in before and (d in after) != (q == 1)]
            assert len(wrong) <= 0.03 * len(labels)
        elif name == "near_duplicates":
            ids = sorted(before)
            want = {ids[c] for c, _, _ in brute_links([before[i] for i in ids])}
            assert set(after) == want and all(after[i] == before[i] for i in after)
        elif name == "repeated_passages":
            ids = sorted(before)
            for i, (_, _, kept) in zip(ids, brute_substring([before[i] for i in ids], 35), strict=True):
                assert sha(" ".join(after.get(i, "").split(" ")).encode() and b" ".join(after.get(i, "").encode().split())) == kept
        else:
            from tests.llm.test_texts import brute
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            ids = sorted(after)
            hits = {i: x[1] for i, x in zip(sorted(before), brute([before[i] for i in sorted(before)], items), strict=True)}
            assert all((after[i] == before[i]) == (hits[i] == 0) for i in ids)
    last = p.STAGES[-1][1](spark, now, folder).collect()
    from tapeloom.llm import byte_bpe
    coder = byte_bpe.encoding(p.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), p.public_tokenizers.PATTERN)
    assert {r["doc_id"]: coder.decode(r["ids"]) for r in last} == {i: t for i, t in after.items()}


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline as p
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).withColumn("n_words", F.lit("x")).withColumn("had_words", F.lit(1))):
        for _, stage in p.STAGES:
            stage(spark, df, "/root/testdata/sf0.001").collect()


@pytest.mark.parametrize("name", ["op1_warc_index", "op3_decontaminate", "op6_substring_dedup", "op9_quality_rules", "op10_chat_format"])
def test_query_matches_sql(spark, folder, name):
    from tapeloom.llm import queries
    from tests.compare import compare
    ok, note = compare(spark, folder, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_join_query_matches_brute_force(spark, folder):
    from tapeloom.llm import queries
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in docs]
    got = queries.QUERIES["op2_chosen_path_join"](spark, folder).orderBy("doc_id").collect()
    assert [(r["class_id"], r["n_links"], r["n_text_links"]) for r in got] == [(ids[c], n, m) for c, n, m in brute_links([r["text"] for r in docs])]
