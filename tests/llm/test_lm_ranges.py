"""A batch's work follows its n-grams, whatever the number of ranges of hashes."""

import time

import numpy as np

from nichegraph.llm import interpolated_lm


def batch(ranges):
    texts = ["one two three two one", "", "three four"]
    return interpolated_lm.Batch(texts, np.ones(3, np.int64), np.array([True, True, False]), interpolated_lm.Hashes(), ranges)


def test_op3_a_batch_meets_the_ranges_that_it_has_alone():
    start = time.time()
    few, many = batch(3), batch(1 << 31)
    asked = list(many.asks())
    assert time.time() - start < 1
    assert len(asked) == len({a[:2] for a in asked}) == sum(len(k) for k, _ in many.orders)
    for b, n in ((few, 3), (many, 1 << 31)):
        for order, (keys, _) in enumerate(b.orders):
            rows = [a for a in b.asks() if a[1] == order]
            assert np.array_equal(np.concatenate([interpolated_lm.unpacked(r[2]) for r in rows]), keys)
            assert all((int(k) >> 32) * n >> 32 == r[0] for r in rows for k in interpolated_lm.unpacked(r[2]))
