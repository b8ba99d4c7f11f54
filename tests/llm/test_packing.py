"""Containers: plans against their bounds, and the whole operator on texts."""

import random

from spandrel.llm import packing


def test_containers():
    random.seed(1)
    for capacity in (7, 60, 100):
        for most in (1, 3, 50):
            counts = {s: random.randint(0, most) for s in range(1, capacity + 1)}
            held: dict[int, int] = {}
            seen = {s: set() for s in counts}
            for size, begin, first, each, n in packing.plan(counts, capacity):
                for k in range(each * n):
                    held[first + k // each] = held.get(first + k // each, 0) + size
                    assert begin + k not in seen[size]
                    seen[size].add(begin + k)
            assert all(len(seen[s]) == n and seen[s] == set(range(n)) for s, n in counts.items())
            assert max(held.values(), default=0) <= capacity and set(held) == set(range(len(held)))
            assert len(held) <= 1.25 * -(-sum(s * n for s, n in counts.items()) // capacity) + 2
    # 51 + 27 leaves 22; 26 + 23 instead of 27 fills the container.
    assert {(51, 0, 0, 1, 1), (23, 0, 0, 1, 1)} <= set(packing.plan({51: 1, 27: 1, 26: 1, 23: 1}, 100))


def test_pack(spark, tmp_path):
    import base64

    # A vocabulary of single bytes: a token is a byte.
    ranks = tmp_path / "bytes.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(bytes([k])) + b" " + str(k).encode() + b"\n" for k in range(256)))
    random.seed(2)
    sizes = [random.choice([0, 1, 5, 20, 30, 45, 60, 61, 130, 240]) for _ in range(400)]
    rows = [(k, "x" * n) for k, n in enumerate(sizes)] + [(None, "x"), (1000, None), (1001, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = packing.pack(df, "doc_id", "text", 60, str(ranks)).collect()
    whole, held = {}, {}
    for r in out:
        whole.setdefault(r.doc_id, []).append((r.part, r.start, r.tokens))
        held[r.container] = held.get(r.container, 0) + r.tokens
    assert set(whole) == {*range(400), 1001} and sum(t for _, _, t in whole[1001]) == 2
    for k, n in enumerate(sizes):
        parts = sorted(whole[k])
        assert sum(t for _, _, t in parts) == n and len(parts) == max(1, -(-n // 60)) and [s for _, s, _ in parts] == [60 * p for p in range(len(parts))]
    assert max(held.values()) <= 60 and set(held) == set(range(len(held)))
    assert sum(held.values()) / (60 * len(held)) > 0.9
    assert packing.pack(df.limit(0), "doc_id", "text", 60, str(ranks)).count() == 0
