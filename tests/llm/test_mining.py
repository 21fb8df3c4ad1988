"""Disclosure, hard negatives and periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import LOWER, words
from flowspark.llm import disclosure, negatives, periodic_runs, queries
from pyspark.sql import functions as F

# --- periodic runs ------------------------------------------------------------------------


def runs(w, least=24, copies=3):
    out = []
    for q in range(1, len(w) // copies + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, copies * q) and not any(all(w[k] == w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = words(text)
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


def runs_row(doc_id, text):
    w = planted(doc_id, text)
    found = runs(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def nulls_first(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(250):
        w, size = [], rng.randint(0, 150)
        while len(w) < size:
            root = [rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.randint(1, 30))]
            w += (root * rng.randint(1, 6))[: rng.randint(1, 120)]
        texts.append(w)
    least, copies = rng.choice([(24, 3), (6, 3), (10, 4)])
    sizes = [len(w) for w in texts]
    at, length, period = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), np.repeat(np.arange(len(texts)), sizes), least=least, copies=copies)
    first = np.cumsum([0, *sizes])
    owner = np.searchsorted(first, at, side="right") - 1
    got = defaultdict(list)
    for o, a, n, q in zip(owner.tolist(), (at - first[owner]).tolist(), length.tolist(), period.tolist()):
        got[o].append((a, n, q))
    for k, w in enumerate(texts):
        assert sorted(got[k], key=lambda r: (r[0], r[2])) == runs(w, least, copies)


def test_long_text_of_one_period_is_one_run():
    root = list(range(5)) * 2 + [9]
    w = np.array(root * 30_000, np.int64)
    at, length, period = periodic_runs.runs_of(w, np.zeros(len(w), np.int64), least=24, copies=3)
    assert (at.tolist(), length.tolist(), period.tolist()) == ([0], [len(w)], [11])


def test_periodic_runs_query(spark, tmp_path, docs, doc_rows):
    rows = [(i, " ".join(f"w{j % 9}" for j in range(40 + i))) for i in range(500, 540)] + [r for r in doc_rows if not r[1] or len(r[1]) < 9000]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("words", F.lit("x"))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert nulls_first(map(tuple, got)) == nulls_first(runs_row(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 40


def test_periodic_runs_of_nothing(no_docs):
    assert periodic_runs.periodic_runs(no_docs).collect() == []


# --- hard negatives -----------------------------------------------------------------------


def negatives_rows(rows, anchor, positives=5, negatives=10):
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = list(dict.fromkeys((i, y, tuple(v)) for i, y, v in kept))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in kept:
        if not anchor(a[0]):
            continue
        scored = sorted(((dot(a[2], c[2]), -c[0], c[1]) for c in kept if c != a), reverse=True)
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fits = [s for s in scored if s[2] != a[1] and 30 * p <= 100 * s[0] <= 90 * p][:negatives]
            out += [(a[0], -pid, k + 1, -c, p, s) for k, (s, c, _) in enumerate(fits)]
    return sorted(out)


def vectors(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    rows = [(int(i), int(i % 5), (centres[i % 4] + rng.normal(size=dim) * rng.choice([0.1, 1.0])).tolist()) for i in range(n)]
    rows += [(n + i, 3, rows[0][2]) for i in range(30)]  # copies, and so ties
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0] * dim), (20, None, [1.0] * dim), (40, 1, None), (60, 1, [1.0, None]), (80, 2, [nan] * dim), (100, 2, [inf] * dim), (120, 2, []), (140, 2, [1.0, 2.0]), rows[0], (160, 1, [0.0] * dim)]
    return rows[:20] + rows[21:] + odd


@pytest.mark.parametrize("block", [1024, 7])
def test_hard_negatives(spark, block):
    rows = vectors(5, 300)
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("x")).withColumn("id", F.lit(0)).repartition(5)
    got = negatives.hard_negatives(table, F.col("id") % 20 == 0, block=block).collect()
    assert sorted(map(tuple, got)) == negatives_rows(rows, lambda i: i % 20 == 0)
    assert len(got) > 100


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(none, F.col("id") % 20 == 0).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(alone, F.col("id") % 20 == 0).collect() == []


def test_bounds_of_close_anchors_spare_candidates():
    rng = np.random.default_rng(1)
    anchors = np.floor(256 * (rng.normal(size=8) + rng.normal(size=(40, 8)) * 0.01))
    others = np.floor(256 * rng.normal(size=(2000, 8)))
    order, parent, length = negatives.spanning_tree(anchors)
    block = {"ids": np.arange(40), "labels": np.zeros(40, np.int64), "vectors": anchors, "order": order, "parent": parent, "length": length, "norm": 1e4}
    search = negatives.Search(block, np.full((40, 1), 10_000), np.full((40, 1), 20_000), 10, False)
    search.add(np.arange(100, 2100), np.ones(2000, np.int64), others)
    assert search.scored < 0.2 * search.met
    for a in range(40):
        s = others @ anchors[a]
        assert search.filled[a, 0] == min(10, ((s >= 10_000) & (s <= 20_000)).sum())


def test_scores_beyond_doubles_are_whole(spark):
    rows = [(i, i % 2, [float(2**30 + i), 1.0 + i]) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(table, F.col("id") == 0, scale=1).count() == 0  # every score is above nine tenths
    got = negatives.hard_negatives(table, F.col("id") == 0, scale=1, high=100).collect()
    score = lambda i: 2**30 * (2**30 + i) + 1 + i
    want = [(p, n) for p in (2, 4, 6, 8, 10) for n in (9, 7, 5, 3, 1) if n < p]
    assert sorted((r.positive_id, r.negative_id, r.negative_score) for r in got) == sorted((p, n, score(n)) for p, n in want)


# --- disclosure ---------------------------------------------------------------------------

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, found):
    digits = [int(c) for c in re.findall("[0-9]", found)]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(kind, *m.span()) for kind, p in PATTERNS for m in re.finditer(p, text or "") if valid(kind, m[0])]


def disclosure_rows(docs, window=10, support=3, remove=1.0, generalise=2.0):
    every, near, contexts, kept = Counter(), Counter(), defaultdict(set), []
    for doc_id, text in docs:
        text = text or ""
        low, spans = text.translate(LOWER), base(text)
        every.update(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low))
        terms = [m for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]{2,}", low) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        own = {}
        for kind, a, b in spans:
            found = text[a:b]
            entity = (kind, found.translate(LOWER) if kind == "email" else found if kind == "ip" else re.sub("[^0-9]", "", found))
            left, right = sum(m.end() <= a for m in terms), sum(m.start() < b for m in terms)
            first = max(0, left - window)
            at = range(first, min(len(terms), right + window))
            context = (tuple(terms[i][0] for i in at), left - first)
            for i in at:
                own.setdefault((entity, i), (terms[i], context))
        for (entity, _), (m, context) in own.items():
            near[entity, m[0]] += 1
            contexts[entity, m[0]].add(context)
        kept.append((doc_id, spans, own))
    out = []
    for doc_id, spans, own in kept:
        marks = {}
        for (entity, _), (m, _) in own.items():
            key = entity, m[0]
            if len(contexts[key]) >= support:
                bits = math.log2(every[m[0]] / near[key])
                if bits <= generalise and marks.get(m.span()) != "term":
                    marks[m.span()] = "term" if bits <= remove else "general"
        added = sorted((kind, *s) for s, kind in marks.items())
        joined = lambda rows: ",".join(f"{k}:{a}:{b}" for k, a, b in rows)
        out.append((doc_id, *(sum(k == n for k, *_ in spans) for n, _ in PATTERNS), hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + added)))
    return out


def private_texts():
    rng = random.Random(8)
    common = [f"word{i}" for i in range(40)]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    rows = [f"{fill(12)} Zuzana Malá wrote from ana@mail.example.com {fill(5)} and {fill(15)} zuzana" for _ in range(6)]
    rows += [f"{fill(30)} harbour {fill(3)} +1 (310) 555-45{i}0 {fill(9)}" for i in range(3)] * 2
    rows += [f"{fill(9)} pier {fill(2)} call +1 310 555 4510 or ANA@mail.example.com, 10.0.0.{i} {fill(20)} pier pier pier" for i in range(5)]
    rows += [f"{fill(20)} harbour zuzana" for _ in range(2)] + ["4111 1111 1111 1111, 4111-1111-1111-1112 é 1.2.3.4.5 a@b @c.de x@y.z@q.r", "0" * 4000 + ".1.2.3 " + "9" * 5000, "+1" + " " * 300 + "23456789"]
    rows += [None, "", rows[0], fill(3000) + " 10.0.0.1 " + fill(4)]
    return [(i if i != 4 else None, t) for i, t in enumerate(rows)] + [(0, rows[0])]


def test_disclosure_query(spark, tmp_path):
    rows = private_texts()
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("kind", F.lit("x")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_disclosure(spark, str(tmp_path)).collect()
    want = disclosure_rows(rows)
    assert nulls_first(map(tuple, got)) == nulls_first(want)
    assert sum("term:" in r.spans for r in got) >= 6 and sum("general:" in r.spans for r in got) >= 1
    assert all(not r.spans for r in got if not (r.n_email + r.n_ip + r.n_card + r.n_phone))


def test_base_spans_of_odd_texts():
    rng = random.Random(2)
    for signs in ["ab.@@-%1 ", "0123.. -", "0123456789 -()+.", "1.1+ @a-"]:
        for _ in range(4000):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
            assert disclosure.base_spans(text) == base(text)


def test_sanitised_text(spark):
    rows = [(i, f"Zuzana writes {'the ' * i}from ana@mail.example.com") for i in range(4)] + [(9, None), (10, "Nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = disclosure.disclosures(docs, window=10, support=3)
    got = {r.doc_id: r.text for r in disclosure.sanitised(docs, spans).collect()}
    assert got[9] is None and got[10] == "Nothing here"
    assert got[0].split() == ["[email]"]
    kept = disclosure.disclosures(docs, window=10, support=3, remove=-1.0)
    assert {r.doc_id: r.text for r in disclosure.sanitised(docs, kept).collect()}[0] == "[Name] [word] [word] [email]"


def test_disclosure_of_nothing(no_docs):
    assert disclosure.disclosures(no_docs).collect() == []
