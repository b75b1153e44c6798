"""Blocks of an index list: none that holds a candidate is skipped, and some are skipped."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from blockloom.llm import jaccard


@pytest.mark.parametrize("seed,percent", [(1, 80), (2, 90), (3, 50)])
def test_blocks_skip_only_what_position_rules_out(seed, percent):
    rng = np.random.default_rng(seed)
    size = np.sort(rng.integers(40, 90, 300))
    pos = (rng.random(300) * (size * (100 - percent) // 100 + 8)).astype(np.int64)
    order = np.lexsort((pos, size))
    size, pos = size[order], pos[order]
    first, ends = jaccard._position_blocks(size, pos)
    assert first[0] == 0 and ends[-1] == 300 and (first[1:] == ends[:-1]).all()
    skipped, root = 0, np.arange(300)
    for i in range(300):
        kept = set(jaccard._open_blocks(percent, size[i], pos[i], size[first], pos[first], pos[ends - 1]).tolist())
        skipped += len(first) - len(kept)
        for b, (a, z) in enumerate(zip(first, ends, strict=True)):
            for j in range(a, z):
                most = min(size[i] - pos[i], size[j] - pos[j]) + min(pos[i], pos[j])
                if (100 + percent) * most >= percent * (size[i] + size[j]):
                    assert b in kept
                    if j > i and size[j] <= size[i] * 100 // percent:
                        root[root == root[j]] = root[i]
    assert skipped
    batch = pa.record_batch({"shingle": pa.array([7] * 300), "cell": pa.array([0] * 300), "rep": pa.array(range(300)), "size": pa.array(size), "pos": pa.array(pos), "parity": pa.array([bytes(8)] * 300)})
    got = np.arange(300)
    for out in jaccard._candidates(percent)(iter([batch])):
        for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True):
            got[got == got[b]] = got[a]
    assert len(set(zip(got.tolist(), root.tolist(), strict=True))) == len(set(got.tolist())) == len(set(root.tolist()))
