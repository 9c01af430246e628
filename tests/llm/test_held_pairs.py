"""Pairs a worker holds before equal ones are taken together."""

import numpy as np

from moundworks.llm import alignment
from moundworks.llm.alignment import PairDocuments


def test_equal_pairs_are_not_held_for_long():
    held, same, most = PairDocuments(), np.arange(100_000), 0
    for _ in range(12):
        held._add(same, np.ones(len(same), np.int64))
        most = max(most, sum(map(len, held.pairs)))
    pair, count = held.result()
    assert most < 700_000
    assert (pair == same).all() and (count == 12).all()


def test_distinct_pairs_are_not_sorted_with_every_chunk(monkeypatch):
    """Past as many distinct pairs as are held, each chunk sorted all of them again."""
    sorted_pairs, summed = [], alignment._summed
    monkeypatch.setattr(alignment, "_summed", lambda p, c: sorted_pairs.append(sum(map(len, p))) or summed(p, c))
    held, n = PairDocuments(), 50_000
    for i in range(60):
        held._add(np.arange(i * n, (i + 1) * n), np.ones(n, np.int64))
    pair, count = held.result()
    assert (pair == np.arange(60 * n)).all() and (count == 1).all()
    assert sum(sorted_pairs) < 5 * 60 * n


def test_sums_of_no_pairs_are_empty():
    none = np.empty(0, np.int64)
    assert [x.tolist() for x in alignment._summed([none], [none])] == [[], []]
