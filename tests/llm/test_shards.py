import hashlib
import random

import pytest

from playmetry.llm.shards import Order, shard_texts, smallest_capacity


def least_capacity(sizes, shards):
    """Minimax contiguous partition by trying every possible capacity."""
    def need(capacity):
        n, used = 1, 0
        for s in sizes:
            if used + s > capacity:
                n, used = n + 1, 0
            used += s
        return n

    return min(sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1) if sum(sizes[i:j]) >= max(sizes) and need(sum(sizes[i:j])) <= shards)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_capacities(llm, documents, seed):
    rng = random.Random(seed)
    texts = ["x" * rng.choice([0, 1, 5, 90, 400]) + str(rng.randrange(40)) for _ in range(90)] + ["hot"] * (60 if seed % 2 else 3) + [None, None, "", "é" * 50]
    rows = shard_texts(documents(*texts), 8).collect()
    assert len(rows) == len(texts)
    by_text, sizes, order = {}, {}, {}
    for r in rows:
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        group = hashlib.md5((text if text is not None else f"\x00{r.doc_id}").encode()).hexdigest()
        order[group] = order.get(group, 0) + r.size
        assert by_text.setdefault(group, r.shard) == r.shard
    assert max(sizes.values()) == least_capacity([order[g] for g in sorted(order)], 8)
    assert [by_text[g] for g in sorted(by_text)] == sorted(by_text.values())
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_keys_that_share_beginnings(llm):
    keys = [f"{'a' * 20}{i:012x}" for i in range(50)]
    groups = llm.createDataFrame([(k, 3 + i % 5) for i, k in enumerate(keys)], "g string, w long")
    capacity, firsts = smallest_capacity(Order(groups), 4)
    assert capacity == least_capacity([3 + i % 5 for i in range(50)], 4) and len(firsts) == 3 and all(any(k.startswith(f) for k in keys) for f in firsts)


def test_small(documents):
    assert shard_texts(documents("a").limit(0)).count() == 0
    assert shard_texts(documents("a", "a", ids=[None, 3])).count() == 2
