"""Hot shards: rows dealt grow with the codes, and the links found are those of brute force."""

import numpy as np
import pytest

from granary.llm import simhash


@pytest.mark.parametrize("bits, nodes", [(12, 1 << 20), (12, 100), (16, 1 << 20)])
def test_codes_that_share_their_other_bits(spark, monkeypatch, bits, nodes):
    monkeypatch.setattr(simhash, "TREE_NODES", nodes)
    if bits == 12:
        monkeypatch.setattr(simhash, "HOT_SHARD", 256)
    n = 1 << bits
    # every fourth code, so that not all are linked at radius 1; spread over low and high bits
    low = np.arange(n, dtype=np.uint64)
    codes = ((low & np.uint64((1 << bits // 2) - 1)) | (low >> np.uint64(bits // 2)) << np.uint64(40) | np.uint64(0xABC << 20)).view(np.int64)
    table = spark.createDataFrame([(int(c),) for c in codes], "fp long")
    dealt, hot = simhash.deal(table, 3)
    assert hot.count() > 0 and dealt.count() <= 40 * n
    links = simhash.near_edges(table, 3)
    assert links.count() <= 80 * n
    root = {int(c): int(c) for c in codes}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for r in links.toLocalIterator():
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 3 or nodes
        root[top(r["a"])] = top(r["b"])
    assert len({top(int(c)) for c in codes}) == 1
