"""Order-dependent operators against a plain reading of the rule."""

import random
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tapeloom.operators import dedup as dd
from tapeloom.session import scratch_path
from tests.conftest import rows

RULES = dd.MergeRules(["k"], "o", free=["name"], money=["amt"], rate=["rate"])


def fold(items):
    """Sequential reading of the merge rule."""
    close = lambda a, b, t: abs(a - b) <= t and abs(a - b) <= max(abs(a), abs(b)) * Decimal("0.001")
    places = lambda v: max(1, -v.normalize().as_tuple().exponent)
    state, dead, variants = None, False, set()
    for name, amt, rate in items:
        variants.add((name, amt, rate))
        row = [name, *(None if v is None else Decimal(str(v)) for v in (amt, rate))]
        if dead:
            continue
        if state is None:
            state = row
            continue
        for i, bound in ((1, Decimal(500)), (2, Decimal("0.01"))):
            a, b = state[i], row[i]
            if a is not None and b is not None and a != b and not close(a, b, bound):
                dead = True
        if dead:
            continue
        state[0] = state[0] if state[0] is not None else row[0]
        for i in (1, 2):
            a, b = state[i], row[i]
            if a is None or (b is not None and a != b and places(b) > places(a)):
                state[i] = b
    status = "quarantined" if dead else ("merged" if len(variants) > 1 else "kept")
    vals = (None,) * 3 if dead else (state[0], *(None if v is None else float(v) for v in state[1:]))
    return (status, *vals)


def test_merge_equals_the_sequential_fold(spark):
    rng = random.Random(7)
    data, want = [], {}
    for k in range(400):
        base = rng.choice([1000.0, 600000.0])
        step = rng.choice([0.0, 0.4, 300.0, 450.0])
        items = []
        for _ in range(rng.choice([1, 1, 2, 3, 3, 4, 6])):
            amt = rng.choice([None, base, base + step, round(base + 2 * step + 0.25, 2)])
            rate = rng.choice([None, 10.0, 10.006, 10.012, 10.0125])
            items.append((rng.choice([None, "a", "b"]), amt, rate))
            if rng.random() < 0.4:
                items.append(rng.choice(items))
        want[k] = fold(items)
        for i, item in enumerate(items):
            data.append((k, i, *item))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k int, o int, name string, amt double, rate double").repartition(5)
    got = {r["k"]: (r["status"], r["name"], r["amt"], r["rate"]) for r in dd.merge_compatible(df, RULES).collect()}
    assert got == want
    assert {v[0] for v in want.values()} == {"kept", "merged", "quarantined"}


def test_merge_rules_on_single_cases(spark):
    cases = {
        1: [("a", 1.0, 1.0), ("a", 1.0, 1.0)],                      # identical
        2: [("a", None, 1.0), ("a", 1.0, 1.0)],                     # NULL subset
        3: [("a", 1.0, 1.0), ("b", 1.0, 1.0)],                      # name only
        4: [("a", 1000000.0, 1.0), ("a", 1000000.25, 1.0)],         # rounding: more decimals win
        5: [("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 1.0, 1.0)],     # conflict stays quarantined
        6: [("a", 600000.0, 1.0), ("a", 600450.0, 1.0), ("a", 600900.5, 1.0), ("a", 600000.0, 1.0)],  # drift, then too far
        7: [("a", 600000.0, 1.0), ("a", 600450.0, 1.0), ("a", 599900.5, 1.0)],  # pairwise order decides
    }
    data = [(k, i, *item) for k, items in cases.items() for i, item in enumerate(items)]
    df = spark.createDataFrame(data, "k int, o int, name string, amt double, rate double")
    got = {r["k"]: (r["status"], r["name"], r["amt"], r["rate"]) for r in dd.merge_compatible(df, RULES).collect()}
    assert got == {k: fold(items) for k, items in cases.items()}
    assert got[5][0] == "quarantined" and got[4][2] == 1000000.25


def cut(items):
    starts, start, codes, ranks = [], None, set(), set()
    for o, code, rank in items:
        if start is None or code in codes or rank in ranks:
            start, codes, ranks = o, set(), set()
        codes.add(code)
        ranks.add(rank)
        starts.append(start)
    return starts


@pytest.mark.parametrize("chunk", [2, 32, 8192])
def test_segments_equal_the_sequential_scan(spark, chunk):
    rng = random.Random(chunk)
    data, want = [], []
    for scope in range(6):
        spread = rng.choice([2, 5, 40])
        hot = scope == 0
        order = sorted(rng.sample(range(10_000), 150))
        items = [(o, "HOT" if hot and rng.random() < 0.4 else f"c{rng.randint(0, spread)}", rng.choice([None, *range(spread)])) for o in order]
        data += [(f"s{scope}", *i) for i in items]
        want += [(f"s{scope}", i[0], s) for i, s in zip(items, cut(items))]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "scope string, o long, code string, rank int")
    out = dd.segment_snapshots(df, ["scope"], "o", "code", "rank", chunk_rows=chunk)
    assert rows(out, "scope", "o", "segment_start") == sorted(want, key=repr)


def test_newest_complete_segment_ties_go_to_the_earlier(spark):
    data = [(1, "a", 1, "10:00"), (2, "b", 2, "10:00"), (3, "a", 1, "10:00"), (4, "b", 2, "10:00"), (5, "a", 1, "10:05")]
    df = spark.createDataFrame([("s", *d) for d in data], "scope string, o long, code string, rank int, at string")
    seg = dd.segment_snapshots(df, ["scope"], "o", "code", "rank", chunk_rows=2)
    assert rows(dd.latest_complete_segment(seg, ["scope"], "at"), "o") == [(1,), (2,)]


def test_latest_complete_snapshot_skips_a_partial_newest(spark):
    df = spark.createDataFrame([("10:00", "a"), ("10:00", "b"), ("11:00", "a"), ("11:00", "b"), ("12:00", "a")], "at string, code string")
    got = dd.latest_complete_snapshot(df.withColumn("s", F.lit(1)), ["s"], "at")
    assert rows(got, "at", "code") == [("11:00", "a"), ("11:00", "b")]


def test_alias_dedup_prefers_the_current_code(spark):
    aliases = spark.createDataFrame([("OLD", "NEW")], "old_code string, new_code string")
    raw = spark.createDataFrame([("OLD", "d", 1.0, 0), ("NEW", "d", 2.0, 1), ("X", "d", 3.0, 2), ("X", "d", 3.0, 3)], "ts_code string, trade_date string, v double, _ord int")
    mapped = dd.map_alias(raw, aliases)
    assert rows(dd.dedup_alias(mapped, ["ts_code", "trade_date"], "_ord"), "ts_code", "v", "source_code") == [("NEW", 2.0, "NEW"), ("X", 3.0, "X")]
    assert dd.alias_conflicts(mapped, ["ts_code", "trade_date"], ["v"]).count() == 0
    report = dd.alias_report(mapped, ["ts_code", "trade_date"]).first()
    assert (report["duplicates"], report["codes_mapped"]) == (2, 1)
    def found(*quotes):
        """Kinds in conflict for quotes of one key in source order."""
        read = spark.createDataFrame([(c, "d", x, i) for i, (c, x) in enumerate(quotes)], raw.schema)
        return rows(dd.alias_conflicts(dd.map_alias(read, aliases), ["ts_code", "trade_date"], ["v"], order="_ord"), "is_alias")

    assert found(("OLD", 1.0), ("NEW", 2.0), ("OLD", 3.0)) == []  # the current row replaces the first and hides the last
    assert found(("OLD", 1.0), ("OLD", 3.0), ("NEW", 2.0)) == [(True,)]
    assert found(("NEW", 2.0), ("OLD", 1.0), ("OLD", 3.0)) == []
    assert found(("NEW", 2.0), ("OLD", 1.0), ("NEW", 3.0)) == [(False,)]
    assert found(("OLD", None), ("OLD", None)) == [] and found(("OLD", None), ("OLD", 1.0)) == [(True,)] and found() == []
    worse = dd.map_alias(raw.union(spark.createDataFrame([("X", "d", 9.0, 4)], raw.schema)), aliases)
    assert rows(dd.alias_conflicts(worse, ["ts_code", "trade_date"], ["v"]), "ts_code") == [("X",)]


def test_exact_duplicates_and_conflicts(spark):
    df = spark.createDataFrame([("k", 1), ("k", 1), ("j", 1), ("j", 2)], "key string, v int")
    unique, conflicts = dd.dedup_exact(df, ["key"])
    assert rows(unique, "key", "v", "copies") == [("j", 1, 1), ("j", 2, 1), ("k", 1, 2)]
    assert rows(conflicts, "key") == [("j",)]


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_step_functions_compose_in_any_order(data):
    """Chunks of a feed cut anywhere: starts handed on by composed steps are those of the plain scan."""
    from tapeloom.operators import segments as sg
    n = data.draw(st.integers(1, 40))
    items = [(i * 3, data.draw(st.integers(0, 6)), data.draw(st.integers(0, 9))) for i in range(n)]
    want = cut(items)
    prev, seen = [], {}
    for o, code, rank in items:
        prev.append(max(seen.get(("c", code), sg.NONE), seen.get(("r", rank), sg.NONE)))
        seen["c", code] = seen["r", rank] = o
    positions, places = np.array([o for o, *_ in items]), np.array(prev)
    cuts = sorted({0, n, *data.draw(st.lists(st.integers(0, n), max_size=6))})
    parts = [sg.chunk_steps(positions[a:b], places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    start = sg.NONE
    for (a, b), steps in zip(zip(cuts, cuts[1:], strict=False), parts, strict=True):
        assert sg.chunk_labels(positions[a:b], places[a:b], start).tolist() == want[a:b]
        start = int(steps.apply(np.array([start]))[0])
        assert start == want[b - 1]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = sg.compose(left, p)
    for p in parts[-2::-1]:
        right = sg.compose(p, right)
    assert left.fresh == right.fresh == want[-1]
    later = sg.compose(parts[-2], parts[-1]) if len(parts) > 1 else parts[0]
    for s in range(-1, int(later.first)):
        assert left.apply(np.array([s])) == right.apply(np.array([s])) if s < left.first else True
        tail = parts[-2:]
        value = np.array([s])
        for p in tail:
            value = p.apply(value)
        assert later.apply(np.array([s])) == value


@pytest.mark.parametrize("block", [4, 64])
def test_a_call_takes_a_block_of_chunks(spark, monkeypatch, block):
    """Chunks of two rows: as many are composed in Python as there are, but calls and rows written only per block."""
    from tapeloom.operators import segments as sg
    rng, written = random.Random(block), []
    order = sorted(rng.sample(range(3000), 400))
    items = [(o, f"c{rng.randint(0, 9)}", rng.randint(0, 9)) for o in order]
    monkeypatch.setattr(sg, "scratch_path", lambda s, name: written.append(scratch_path(s, name)) or written[-1])
    df = spark.createDataFrame([("s", *i) for i in items], "scope string, o long, code string, rank int")
    out = sg.segment_snapshots(df, ["scope"], "o", "code", "rank", chunk_rows=2, block_rows=block)
    assert rows(out, "o", "segment_start") == sorted(zip(order, cut(items), strict=True), key=repr)
    assert spark.read.parquet(written[0]).count() == len({o // block for o in order})
    assert sum("segment-level" in p for p in written) == 2
