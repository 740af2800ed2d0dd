"""Components of a part of a graph, in the task that holds the part.

A task takes its edges in parts of at most `held`, finds the strongly connected components of each, and tells what the rest of the
graph must know of it: its nodes, each with the least node of its component, and the edges between components. Both together connect
what the part's edges connect. A part falls to pieces that no edge joins; a piece whose nodes are in no other is done."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext


def key(v):
    """v, hashable and in Spark's order, nulls first."""
    if isinstance(v, dict):
        return tuple(key(x) for x in v.values())
    if isinstance(v, list):
        return tuple(key(x) for x in v)
    return v is not None, v


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, in the order of values, and the value of each number."""
    if pa.types.is_nested(values.type):
        seen: dict = {}
        codes = np.array([seen.setdefault(key(v), len(seen)) for v in values.to_pylist()])
        nodes = values.take(pa.array(np.unique(codes, return_index=True)[1]))
        said = list(seen)
        order = np.array(sorted(range(len(said)), key=said.__getitem__))
    else:
        d = values.dictionary_encode()
        codes, nodes = d.indices.to_numpy().astype(np.int64), d.dictionary
        order = pc.sort_indices(nodes).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], nodes.take(pa.array(order))


def components(starts: list[int], to: list[int]) -> np.ndarray:
    """The component of each node (Tarjan's way, without recursion); node v's edges are to[starts[v]:starts[v + 1]]."""
    n = len(starts) - 1
    order, low, of, at = [0] * n, [0] * n, [-1] * n, starts[:n]
    count = done = 0
    for root in range(n):
        if order[root]:
            continue
        count += 1
        order[root] = low[root] = count
        way, waiting = [root], [root]
        while way:
            v = way[-1]
            if at[v] < starts[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not order[w]:
                    count += 1
                    order[w] = low[w] = count
                    way.append(w)
                    waiting.append(w)
                elif of[w] < 0 and order[w] < low[v]:
                    low[v] = order[w]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == order[v]:
                w = -1
                while w != v:
                    w = waiting.pop()
                    of[w] = done
                done += 1
    return np.array(of)


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that edges a - b join each of n nodes to, in whichever direction."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (least != least[least]).any():
            least = least[least]


def told(part: list[pa.RecordBatch], first: int) -> tuple[pa.Table, int]:
    """piece, src, dst, edge of a part: its nodes (dst: the least node of the component, null if it is alone) and the edges
    between components; pieces are numbered from first. And the next number."""
    t = pa.Table.from_batches(part)
    codes, nodes = coded(pa.concat_arrays([*t["src"].chunks, *t["dst"].chunks]))
    n = len(nodes)
    edges = np.unique(codes[: t.num_rows] * n + codes[t.num_rows :])
    a, b = edges // n, edges % n
    of = components(np.searchsorted(a, np.arange(n + 1)).tolist(), b.tolist())
    least = np.full(of.max() + 1, n)
    np.minimum.at(least, of, np.arange(n))
    head, alone = least[of], (np.bincount(of) == 1)[of]
    between = np.unique((head[a] * n + head[b])[head[a] != head[b]])
    a, b = between // n, between % n
    names, piece = np.unique(joined(n, np.concatenate([a, np.arange(n)]), np.concatenate([b, head])), return_inverse=True)
    src, dst = pa.array(np.concatenate([np.arange(n), a])), pa.array(np.concatenate([head, b]), mask=np.concatenate([alone, np.zeros(len(a), bool)]))
    pieces, edge = first + np.concatenate([piece, piece[a]]), np.arange(n + len(a)) >= n
    return pa.table({"piece": pa.array(pieces, pa.int64()), "src": nodes.take(src), "dst": nodes.take(dst), "edge": pa.array(edge)}), first + len(names)


def parts(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """src, dst -> piece, src, dst, edge. As many edges as `held` or fewer are one part."""
    part, size, first = [], 0, TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, held):
            some = batch.slice(at, held)
            if part and size + some.num_rows > held:
                out, first = told(part, first)
                yield from out.to_batches(20_000)
                part, size = [], 0
            part.append(some)
            size += some.num_rows
    if part:
        yield from told(part, first)[0].to_batches(20_000)
