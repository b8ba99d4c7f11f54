"""Texts into containers of one capacity: best-two-fit over a histogram of sizes, an item being split only if it must."""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.operators.ranks import global_rank
from spandrel.session import materialize

#: Pieces of less than 1 / SMALL of a container are packed last.
SMALL = 6

#: (size, rank of its first item in that size, first container, items in each container, containers)
Run = tuple[int, int, int, int, int]


def _pair(sizes: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """Two sizes that are left, with the greatest sum of at most ``room``."""
    a = np.array(sizes[: bisect_right(sizes, room)], dtype=np.int64)
    if not len(a):
        return None
    at = np.searchsorted(a, room - a, side="right") - 1
    own = np.arange(len(a))
    single = np.array([left[int(x)] < 2 for x in a])
    at = np.where((at > own) | ((at == own) & ~single), at, -1)
    sums = np.where(at >= 0, a + a[at], -1)
    best = int(sums.argmax())
    return (int(a[best]), int(a[at[best]])) if sums[best] > 0 else None


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Containers for so many items of each size (1 ... capacity), as runs of containers that are filled alike.

    Best two fit: a container takes the largest piece that still fits, again and again; its last piece is exchanged for
    the two pieces with the greatest sum that fit and fill it better. A filling is repeated as long as its pieces last,
    which gives the same containers as one at a time. Small pieces then go, largest first, where they leave least room.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    runs: list[Run] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> (first container, containers)
    order: list[int] = []  # rooms, sorted
    sizes = sorted(s for s in left if s * SMALL >= capacity)
    container = 0

    def keep(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((first, n))

    def place(size: int, first: int, each: int, n: int) -> None:
        runs.append((size, used[size], first, each, n))
        used[size] += each * n
        left[size] -= each * n

    while sizes:
        filling: dict[int, int] = {}
        room, last = capacity, 0
        at = bisect_right(sizes, room)
        while at:
            last = sizes[at - 1]
            take = min(left[last], room // last)
            filling[last] = take
            room -= take * last
            at = min(at - 1, bisect_right(sizes, room))
        if room and sum(filling.values()) > 1:
            rest = {s: left[s] - filling.get(s, 0) for s in sizes}
            two = _pair([s for s in sizes if rest[s]], rest, room + last)
            if two and sum(two) > last:
                filling[last] -= 1
                for s in two:
                    filling[s] = filling.get(s, 0) + 1
                room += last - sum(two)
        filling = {s: k for s, k in filling.items() if k}
        n = min(left[s] // k for s, k in filling.items())
        for s, k in filling.items():
            place(s, container, k, n)
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))
        keep(room, container, n)
        container += n
    for size in sorted((s for s in left if s * SMALL < capacity), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):
                keep(capacity, container, n := -(-left[size] // (capacity // size)))
                container += n
                continue
            room = order[at]
            first, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // size, left[size])
            full = min(n, left[size] // each)
            place(size, first, each, full)
            keep(room - each * size, first, full)
            keep(room, first + full, n - full)
    return runs


#: Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, n bigint): tokens of each text by a public byte-level BPE, whose rank file is read on the driver.

    The file, one line per token, is a vocabulary of fixed size (under 1 MB) and goes to every task. Strings of special
    tokens in a text are ordinary text. An empty text has no tokens. Rows with a null key or text are left out.
    """
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], ["key", "n"])

    return rows.mapInArrow(counted, f"key {rows.schema['key'].dataType.simpleString()}, n bigint")


def pack(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """(key, part int, start bigint, tokens int, container bigint): each text, or part of one, with its container.

    Sizes are tokens of the public tokenizer whose rank file is ``vocabulary``. Only a text of more than ``capacity``
    tokens is split, into full parts and a rest; start is the first token of a part. The parts of a container have at
    most ``capacity`` tokens together. A text without tokens takes no room and is in container 0. Rows with a null key
    or text are left out; keys should be unique, as the order of equal keys isn't defined. An empty table gives no rows.

    Method: only keys and sizes move. One count per size comes to the driver, which plans the containers of all items
    of a size as runs; each item finds its container by its rank among the items of its size.
    """
    sized = materialize(token_counts(df, key, text, vocabulary), "sizes")
    last = F.expr(f"greatest(n - 1, 0) div {capacity}")
    parts = sized.select("key", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    items = parts.select("key", F.col("part").cast("int").alias("part"), (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("int").alias("tokens"))
    counts = {r[0]: r[1] for r in items.where("tokens > 0").groupBy("tokens").count().collect()}  # one row per size, at most ``capacity``
    runs = sorted(plan(counts, capacity))
    begins = np.array([s << 40 | at for s, at, *_ in runs], dtype=np.int64)
    ranks, firsts, each = (np.array([r[k] for r in runs], dtype=np.int64) for k in (1, 2, 3))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rank = b.column(4).to_numpy() - 1
                at = np.searchsorted(begins, (b.column(3).to_numpy().astype(np.int64) << 40) | rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(firsts[at] + (rank - ranks[at]) // each[at])], ["key", "part", "start", "tokens", "container"])

    kind = items.schema["key"].dataType.simpleString()
    ranked = global_rank(items.where("tokens > 0"), ["tokens"], [F.col("key"), F.col("part")]).select("key", "part", "start", "tokens", F.col("rank").cast("bigint").alias("rank"))
    packed = ranked.mapInArrow(assigned, f"key {kind}, part int, start bigint, tokens int, container bigint")
    return packed.unionByName(items.where("tokens = 0").withColumn("container", F.lit(0).cast("bigint"))).withColumnRenamed("key", key)
