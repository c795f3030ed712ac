import time

import numpy as np
import pytest

from mosaicflow.llm import arrays, kneser_ney


def test_by_shard():
    rng = np.random.default_rng(1)
    shard, value = rng.integers(0, 9, 500), np.arange(500)
    got = dict(arrays.by_shard(shard, value, -value))
    assert sorted(got) == sorted(set(shard.tolist()))
    assert all(np.array_equal(a, np.flatnonzero(shard == s)) and np.array_equal(b, -a) for s, (a, b) in got.items())
    assert list(arrays.by_shard(shard[:0], value[:0])) == []


@pytest.mark.parametrize("most", [0, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, 5_000_000_000])
def test_counts_of_any_size_survive(most):
    (back,) = arrays.unpacked(arrays.packed(arrays.narrow(np.array([1, most, 0]))))
    assert back.astype(np.int64).tolist() == [1, most, 0] and back.itemsize <= max(1, -(-most.bit_length() // 8) * 2)


def test_send_doesnt_slow_with_shards():
    """The same bigrams, sent to 32 shards and to 2000."""
    rng = np.random.default_rng(2)
    context, token, n = kneser_ney._counted(rng.integers(1, 1 << 62, 400_000).astype(np.uint64), rng.integers(1, 1 << 62, 400_000).astype(np.uint64), np.ones(400_000, np.int64))
    none = np.zeros(0, np.uint64)

    def took(shards):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            blocks = kneser_ney.sent_blocks(context, token, n, none, shards)
            best.append(time.perf_counter() - began)
        assert len(blocks) == shards
        return min(best)

    assert took(2000) < 8 * took(32)  # 2000 blocks cost calls, some three times the whole; a pass over all bigrams for each shard would take 60 times as long


def test_arrays_are_aligned():
    parts = [np.arange(3, dtype="<u1"), np.arange(5, dtype="<u8"), np.zeros(0, "<u2"), np.arange(7, dtype="<u2"), np.arange(2, dtype="<i8")]
    back = arrays.unpacked(arrays.packed(*parts))
    assert all(np.array_equal(a, b) and a.dtype == b.dtype and b.flags.aligned for a, b in zip(parts, back, strict=True))
