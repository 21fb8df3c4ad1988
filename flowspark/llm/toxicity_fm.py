"""Toxicity: a factorization machine over hashed terms.

A document is the set of its hashed terms: its words, and their first 4, 5 and 6 bytes, which meet
inflected and made-up forms of a stem.  Its logit is a bias, a weight for each term and, for
each pair of terms, the product of their factor vectors, so that a pair (an insult and a group's
name) can weigh more than both of its terms.  The pair sum is linear in the terms.  Weights and
factors are trained by AdaGrad on the logistic loss with weight decay.  All terms take part that are
in ``LEAST_DOCS`` sampled documents or more.  A term's own weight decays the more, the less its shares
in the two classes differ, measured by their deviation; its factors do not depend on that, so that a word
that tells nothing by itself can still tell in a pair.

Fitting uses at most ``SAMPLE_ROWS`` labelled texts of at most ``SAMPLE_BYTES`` bytes; scoring reads
every whole text in one pass, with a model of fixed size.  Defined cases are those of
``quality_net``: null text is empty, repeated rows get a row each, without labelled texts of both
classes every score is the labelled share of class 1 (0.5 without labels), no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from flowspark.llm.bytetext import chunks, lowered, mix, span_hashes, token_spans
from flowspark.llm.labelled import sample
from flowspark.llm.quality_net import scored

TERM_BITS, FACTORS, LEAST_DOCS = 20, 8, 5
PREFIXES = (4, 5, 6)
SAMPLE_ROWS, SAMPLE_BYTES = 8000, 32_768
STEPS, BATCH, RATE, DECAY, PAIR_DECAY, DOUBT = 750, 64, 0.15, 2e-5, 3e-3, 0.5
PIECE = 1 << 18


def terms(data: np.ndarray, starts: np.ndarray, taken: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``row, term`` of every different term of each text, in order of row; of those in ``taken``."""
    rows, found = [], []
    shift = np.uint64(64 - TERM_BITS)
    for a, b in chunks(starts, PIECE):
        part = data[starts[a] : starts[b]]
        row, kind, begin, end = token_spans(part, starts[a : b + 1] - starts[a])
        row, begin, end = row[kind == 1], begin[kind == 1], end[kind == 1]
        part = lowered(part)
        spans = [(row, begin, end, 0), *((row[end - begin > k], begin[end - begin > k], begin[end - begin > k] + k, k) for k in PREFIXES)]
        own, term = [], []
        for r, s, e, k in spans:
            t = (mix(span_hashes(part, s, e) + np.uint64(k)) >> shift).astype(np.int64)
            here = slice(None) if taken is None else taken[t]
            own.append(r[here])
            term.append(t[here])
        pair = np.unique(np.concatenate(own) << TERM_BITS | np.concatenate(term))
        rows.append((pair >> TERM_BITS) + a)
        found.append(pair & ((1 << TERM_BITS) - 1))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *found])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray | None
    factors: np.ndarray | None
    share: float
    place: np.ndarray | None = None  # of each hashed term among those taken, else -1

    def logits(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        z = np.full(rows, self.bias) + np.bincount(row, self.weight[term], minlength=rows)
        for f in range(FACTORS):
            v = self.factors[term, f]
            z += 0.5 * (np.bincount(row, v, minlength=rows) ** 2 - np.bincount(row, v * v, minlength=rows))
        return z

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        rows = len(starts) - 1
        if self.weight is None:
            return np.full(rows, self.share)
        row, term = terms(data, starts, self.place >= 0)
        return 1 / (1 + np.exp(-np.clip(self.logits(row, self.place[term], rows), -30, 30)))


def fit(data: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Machine:
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y)) < 2:
        return Machine(0.0, None, None, share)
    row, term = terms(data, starts)
    bad, all_ = (np.bincount(term, w, minlength=1 << TERM_BITS) for w in (y[row], None))
    rate = np.clip(all_ / len(y), 1e-9, 1 - 1e-9)
    z = (bad / y.sum() - (all_ - bad) / (len(y) - y.sum())) / np.sqrt(rate * (1 - rate) * (1 / y.sum() + 1 / (len(y) - y.sum())))
    taken = np.flatnonzero(all_ >= LEAST_DOCS)
    # How far a term may weigh by itself goes with its evidence; what it does in pairs is free of that.
    doubt = DECAY * (1 + DOUBT * len(y) / np.maximum(z[taken] ** 2, 1e-2))
    place = np.full(1 << TERM_BITS, -1, np.int32)
    place[taken] = np.arange(len(taken))
    row, term = row[place[term] >= 0], place[term[place[term] >= 0]].astype(np.int64)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    rng = np.random.default_rng(3)
    weight, factors = np.zeros(len(taken)), rng.normal(0, 0.01, (len(taken), FACTORS))
    bias, gb, gw, gv = float(np.log(share / (1 - share))), 1e-3, np.full(len(taken), 1e-3), np.full((len(taken), FACTORS), 1e-3)
    machine = Machine(bias, weight, factors, share, place)
    for _ in range(-(-STEPS // -(-len(y) // BATCH))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            size = ends[some + 1] - ends[some]
            local = np.repeat(np.arange(len(some)), size)
            place = np.repeat(ends[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own = term[place]
            error = (1 / (1 + np.exp(-np.clip(machine.logits(local, own, len(some)), -30, 30))) - y[some]) / len(some)
            used, back = np.unique(own, return_inverse=True)
            sums = np.stack([np.bincount(local, factors[own, f], minlength=len(some)) for f in range(FACTORS)], 1)
            g = np.bincount(back, error[local], minlength=len(used)) + doubt[used] * weight[used]
            pair = error[local][:, None] * (sums[local] - factors[own])
            g_v = np.stack([np.bincount(back, pair[:, f], minlength=len(used)) for f in range(FACTORS)], 1) + PAIR_DECAY * factors[used]
            gb += error.sum() ** 2
            gw[used] += g * g
            gv[used] += g_v * g_v
            machine.bias -= RATE * error.sum() / np.sqrt(gb)
            weight[used] -= RATE * g / np.sqrt(gw[used])
            factors[used] -= 0.2 * RATE * g_v / np.sqrt(gv[used])
    return machine


def classify(docs: DataFrame, labels: DataFrame, usable: Column, *, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> DataFrame:
    """``doc_id, score``: learned from labels where ``usable`` holds, for every document."""
    return scored(docs, fit(*sample(docs, labels, "toxic", usable, rows=rows, longest=longest)))
