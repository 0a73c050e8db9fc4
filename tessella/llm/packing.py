"""Problem 8: documents into containers of fixed capacity, by hierarchical multi-length packing.

Documents are routed to context-size tiers, the smallest tier that holds them; a document longer than the capacity is cut
into pieces of exactly the capacity and a rest, and no other document is divided. For one capacity the tiers are windows of
the capacity, its half, quarter and so on (``DEPTH`` of them): a window is opened inside the free half of the next longer
one, so that windows of all tiers fill whole containers. From the longest tier to the shortest, documents first fill what is
left of longer windows, the tightest gap of the longest tier first, and open a window of their own tier where none is left.
At last the gaps of a container are one, and the emptiest containers are dissolved into the gaps of the others. With
``routed`` the tiers are the given capacities, and a container has its tier's capacity.

Then the containers of all shards together are dealt to step groups, in turns of falling cost (the sum of squared lengths,
what attention costs), so that groups of ``STEP`` containers weigh alike.

Scale: only (doc_id, tokens) is packed. Rows are spread by a hash of doc_id over shards of about ``SHARD`` items, whatever
their source, and each shard is packed by itself; that costs at most about one container in each shard and tier.

Defined results: null, empty and blank texts are items of their 0 or few tokens and come out too; rows repeating a doc_id
count once; an empty table gives no row; capacities below 1 are rejected; capacities too small to halve have fewer tiers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.corpus import numbered
from tessella.session import cut

SHARD = 20_000
STEP = 8
#: Tiers of one capacity: windows of the capacity and of its halves.
DEPTH = 5


class _Gaps:
    """Places by free space; a bit mask of the spaces in use finds the tightest one that holds a size."""

    def __init__(self):
        self.mask, self.by_space = 0, {}

    def push(self, at, space: int) -> None:
        self.by_space.setdefault(space, []).append(at)
        self.mask |= 1 << space

    def pop(self, size: int):
        """(place, its space) of the tightest gap, or None."""
        m = self.mask >> size
        if not m:
            return None
        space = (m & -m).bit_length() - 1 + size
        at = self.by_space[space].pop()
        if not self.by_space[space]:
            self.mask ^= 1 << space
        return at, space


def windows(capacity: int, depth: int = DEPTH) -> list[int]:
    """Window sizes of one capacity, the shortest first; halves are rounded down, so that two fit."""
    out = [capacity]
    while len(out) < depth and out[-1] >= 2:
        out.append(out[-1] // 2)
    return out[::-1]


def pack(sizes: np.ndarray, tiers: list[int]) -> list[list[int]]:
    """Containers of capacity tiers[-1] as lists of items, by windows of the tiers. sizes: none above the capacity."""
    top = len(tiers) - 1
    tier = np.searchsorted(tiers, sizes)
    order = np.argsort(-sizes, kind="stable")
    items: list[list[int]] = []  # of each container
    free: list[list[int]] = [[] for _ in tiers]  # containers that have an unopened window of the tier, one entry a window
    gaps = [_Gaps() for _ in tiers]  # what is left of the opened windows
    for k in range(top, -1, -1):
        for i in order[tier[order] == k].tolist():
            s = int(sizes[i])
            for j in range(top, k - 1, -1):  # gaps of longer windows first, the longest tier first; then the own tier
                if found := gaps[j].pop(s):
                    at, space = found
                    gaps[j].push(at, space - s)
                    items[at].append(i)
                    break
            else:
                j = next((j for j in range(k, top + 1) if free[j]), None)
                if j is None:
                    j, at = top, len(items)
                    items.append([])
                else:
                    at = free[j].pop()
                while j > k:  # halve: one half goes on, the other stays for a later window
                    free[j - 1].append(at)
                    j -= 1
                gaps[k].push(at, tiers[k] - s)
                items[at].append(i)
    return _dissolved(items, sizes, tiers[-1])


def _dissolved(items: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Each container's gaps joined, and the emptiest containers emptied into the others' gaps as long as all they hold fits."""
    used = [int(sizes[x].sum()) for x in items]
    gaps = _Gaps()
    where = {}
    for c, u in enumerate(used):
        gaps.push(c, capacity - u)
        where[c] = capacity - u
    gone: set[int] = set()
    for c in sorted(where, key=lambda c: used[c]):
        if sum(where.values()) - where[c] < used[c]:
            break
        space = where.pop(c)
        gaps.by_space[space].remove(c)
        if not gaps.by_space[space]:
            gaps.mask ^= 1 << space
        moved = []
        for i in sorted(items[c], key=lambda i: -sizes[i]):
            s = int(sizes[i])
            found = gaps.pop(s)
            if found is None:
                break
            at, space = found
            gaps.push(at, space - s)
            where[at] = space - s
            moved.append((at, i))
        else:
            for at, i in moved:
                items[at].append(i)
            gone.add(c)
            continue
        # not all fits: what was moved is what it was
        for at, i in reversed(moved):
            old = where[at]
            gaps.by_space[old].remove(at)
            if not gaps.by_space[old]:
                gaps.mask ^= 1 << old
            where[at] = old + int(sizes[i])
            gaps.push(at, where[at])
        break
    return [x for c, x in enumerate(items) if c not in gone]


def pack_routed(sizes: np.ndarray, tiers: list[int]) -> list[tuple[int, list[int]]]:
    """Containers (capacity, items), each of its tier's capacity; gaps of longer tiers are filled from shorter ones."""
    tier = np.searchsorted(tiers, sizes)
    order = np.argsort(-sizes, kind="stable")
    gaps = [_Gaps() for _ in tiers]
    boxes: list[list[list[int]]] = [[] for _ in tiers]
    for k in range(len(tiers) - 1, -1, -1):
        for i in order[tier[order] == k].tolist():
            s = int(sizes[i])
            for j in range(len(tiers) - 1, k - 1, -1):
                if found := gaps[j].pop(s):
                    at, space = found
                    gaps[j].push(at, space - s)
                    boxes[j][at].append(i)
                    break
            else:
                gaps[k].push(len(boxes[k]), tiers[k] - s)
                boxes[k].append([i])
    return [(tiers[k], x) for k in range(len(tiers) - 1, -1, -1) for x in boxes[k]]


def step_group(turn, n, size: int = STEP):
    """Column: the group of the container of rank ``turn`` (by falling cost) among n: dealt forwards and backwards in turn."""
    groups = F.greatest(F.ceil(n / size), F.lit(1)).cast("long")
    at = turn % groups
    return F.when(F.floor(turn / groups) % 2 == 0, at).otherwise(groups - 1 - at)


_ITEM = pa.struct([("position", pa.int32()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("start_token", pa.int64()), ("end_token", pa.int64()), ("tokens", pa.int64())])
_BOXES = "container_kind string, container_id bigint, cost double, items array<struct<position:int,doc_id:bigint,piece_no:int,start_token:bigint,end_token:bigint,tokens:bigint>>"


def _packer(kinds: dict[str, int], routed: bool):
    names = {v: k for k, v in kinds.items()}

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind, shard = (x.as_py() for x in key)
        top = kinds[kind]
        doc, n = table["doc_id"].to_numpy(), table["tokens"].to_numpy()
        pieces = np.maximum(1, -(-n // top))
        at = np.repeat(np.arange(len(doc)), pieces)
        no = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = no * top
        end = np.minimum(start + top, n[at])
        size = end - start
        packed = pack_routed(size, sorted(kinds.values())) if routed else [(top, x) for x in pack(size, windows(top))]
        item = np.concatenate([np.array(x) for _, x in packed])
        counts = np.array([len(x) for _, x in packed])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        place = np.arange(len(item)) - np.repeat(offsets[:-1], counts)
        rows = pa.StructArray.from_arrays(
            [pa.array(a.astype(t)) for a, t in ((place, np.int32), (doc[at[item]], np.int64), (no[item], np.int32), (start[item], np.int64), (end[item], np.int64), (size[item], np.int64))], fields=list(_ITEM),
        )
        cost = np.add.reduceat(np.square(size[item].astype(float)), offsets[:-1])
        ids = (int(shard) << 32) + np.arange(len(packed))
        return pa.table({"container_kind": pa.array([names[c] for c, _ in packed]), "container_id": pa.array(ids), "cost": pa.array(cost), "items": pa.ListArray.from_arrays(pa.array(offsets), rows)})

    return run


def assign(tokens: DataFrame, kinds: dict[str, int], routed: bool = False, shard: int = SHARD) -> DataFrame:
    """tokens: doc_id, tokens. kinds: capacity by kind, a table that does not grow.

    routed False: for every kind all documents, in containers of its capacity. routed True: each document once, in the
    containers of its tier or a gap of a longer one. Columns: container_kind, container_id, step_group, position, doc_id,
    piece_no, start_token, end_token, tokens.
    """
    if not kinds or min(kinds.values()) < 1 or len(set(kinds.values())) < len(kinds):
        raise ValueError("capacities must be different and at least 1")
    tokens = cut(tokens.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    shards = max(1, -(-tokens.count() // shard))
    plans = [max(kinds, key=kinds.get)] if routed else sorted(kinds)
    items = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).withColumn("kind", F.explode(F.array(*map(F.lit, plans))))
    boxes = items.select("kind", "shard", "doc_id", "tokens").groupBy("kind", "shard").applyInArrow(_packer(kinds, routed), _BOXES)
    boxes = numbered(boxes.withColumn("_less", -F.col("cost")), ["container_kind", "_less", "container_id"], "_rank")
    kind = boxes.groupBy("container_kind").agg(F.min("_rank").alias("_first"), F.count("*").alias("_of"))  # one row a kind
    boxes = boxes.join(F.broadcast(kind), "container_kind").withColumn("step_group", step_group(F.col("_rank") - F.col("_first"), F.col("_of")))
    return boxes.select("container_kind", "container_id", "step_group", F.explode("items").alias("x")).select("container_kind", "container_id", "step_group", "x.*")
