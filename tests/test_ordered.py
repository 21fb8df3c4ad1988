"""Ordered columns must not depend on whether a hot key was split."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowspark.operators.ordered import ordered, positions


def _brute(rows):
    out, state = {}, {}
    for key, t, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        before = state.setdefault(key, dict(prev=None, total=0, lo=None, hi=None, last=None))
        total = before["total"] + (x or 0)
        lo = x if before["lo"] is None else before["lo"] if x is None else min(before["lo"], x)
        hi = x if before["hi"] is None else before["hi"] if x is None else max(before["hi"], x)
        last = x if x is not None else before["last"]
        out[(key, t)] = (before["prev"], total, lo, hi, last)
        state[key] = dict(prev=t, total=total, lo=lo, hi=hi, last=last)
    return out


def _check(spark, rows, limit):
    df = spark.createDataFrame(rows, "k string, t bigint, x bigint")
    scanned = ordered(df, ["k"], ["t"], limit).lag(prev="t")
    result = scanned.running(total=("sum", "x"), lo=("min", "x"), hi=("max", "x"), last=("last", "x")).done()
    got = {(r.k, r.t): (r.prev, r.total or 0, r.lo, r.hi, r.last) for r in result.collect()}
    assert got == _brute(rows)


@pytest.mark.parametrize("limit", [5, 10_000])
def test_hot_key(spark, limit):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 17}", i, rng.choice([None, rng.randint(-9, 9)])) for i in range(240)]
    rng.shuffle(rows)
    _check(spark, rows, limit)


def test_null_key_and_single_rows(spark):
    _check(spark, [(None, i, i) for i in range(30)] + [("a", 1, None)], 3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 10**6)), min_size=1, max_size=60, unique_by=lambda r: r[1]), st.integers(1, 8))
def test_any_slicing(spark, pairs, limit):
    _check(spark, [(k, t, t % 7 - 3) for k, t in pairs], limit)


def test_without_keys(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(100)], "t bigint, x bigint")
    got = {r.t: r.c for r in ordered(df, [], ["t"], 7).running(c=("sum", "x")).done().collect()}
    total = 0
    for i in range(100):
        total += i % 4
        assert got[i] == total


@pytest.mark.parametrize("limit", [5, 10_000])
def test_positions_inside_keys(spark, limit):
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", rng.random(), "wide" * 9, i) for i in range(300)]
    got = positions(spark.createDataFrame(rows, "k string, t double, wide string, v int"), ["k"], ["t", "wide"], ["v"], limit)
    assert got.columns == ["k", "_pos", "v"]
    place, want = {}, set()
    for k, _, _, v in sorted(rows, key=lambda r: r[1]):
        place[k] = place.get(k, 0) + 1
        want.add((k, place[k], v))
    assert set(map(tuple, got.collect())) == want and got.count() == len(rows)
