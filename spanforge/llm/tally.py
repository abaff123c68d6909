"""Totals of keyed counts over all blocks of a corpus, by a tree of bounded fan-out.

Every block holds sorted 64-bit keys with counts and wants, for each of its keys, the total over all
blocks.  A block cuts its keys by their leading digit and sends a row for each digit.  A node of the
tree stands for a prefix of the key and a group of blocks; it adds up what its children send, so a
hot key costs it one entry a child, and passes the sums on by the next digit.  At the last digit one
node has all blocks of its prefix; its totals go back the way they came.  The number of rows is
blocks times fan-out times depth, with depth the logarithm of the number of blocks, and no node
holds more than about as many keys as a block.  Nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textnp import U64, pack_sorted, unpack_sorted

#: Most bits of one digit: a node has at most 2 ** BITS children and parents.
BITS = 8

UP = "path long, grp long, child long, keys binary, counts binary"
DOWN = "path long, grp long, digit int, counts binary"


def pack(counts: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on in full behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


@dataclass(frozen=True)
class Tree:
    """Shape of the tree: ``bits`` a digit, ``depth`` digits; keys are told apart by their ``width`` leading bytes."""

    bits: int
    depth: int
    width: int = 8

    @classmethod
    def over(cls, blocks: int, width: int = 8, most: int = BITS) -> Tree:
        need = max(1, (max(1, blocks) - 1).bit_length())
        depth = -(-need // most)
        return cls(-(-need // depth), depth, width)

    def edges(self, keys: np.ndarray, level: int) -> np.ndarray:
        """Where the digits of ``level`` begin in sorted keys that agree in all digits before."""
        digit = (keys >> U64(64 - self.bits * level)) & U64((1 << self.bits) - 1)
        return np.searchsorted(digit, np.arange((1 << self.bits) + 1, dtype=U64))

    def short(self, keys: np.ndarray) -> bytes:
        """Sorted keys without the bytes that do not count, and without a last byte that is zero in all."""
        drop = 64 - 8 * self.width
        if not drop and not (keys & U64(255)).any():
            drop = 8
        return bytes([drop]) + pack_sorted(keys >> U64(drop))

    def full(self, data: bytes) -> np.ndarray:
        return unpack_sorted(data[1:]) << U64(data[0])

    def whole(self, keys: np.ndarray) -> np.ndarray:
        """Keys without what does not travel."""
        return keys & ~U64((1 << 8 * (8 - self.width)) - 1)

    def send(self, keys: np.ndarray, counts: np.ndarray, path: int, grp: int, child: int, level: int) -> dict[str, list]:
        e = self.edges(keys, level)
        used = np.flatnonzero(e[:-1] < e[1:]).tolist()
        return {
            "path": [path << self.bits | d for d in used], "grp": [grp] * len(used), "child": [child] * len(used),
            "keys": [self.short(keys[e[d] : e[d + 1]]) for d in used], "counts": [pack(counts[e[d] : e[d + 1]]) for d in used],
        }

    def block_rows(self, block: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        """What a block sends: rows of ``UP`` for its sorted, distinct keys."""
        return up_table(self.send(keys, counts, 0, block >> self.bits, block, 1))

    def block_totals(self, keys: np.ndarray, digits: list[int], answers: list[bytes]) -> np.ndarray:
        """Totals of a block's sorted, distinct keys from the rows that came back; raises if they don't fit."""
        e = self.edges(keys, 1)
        out = np.full(len(keys), -1, np.int64)
        for d, a in zip(digits, answers, strict=True):
            out[e[d] : e[d + 1]] = unpack(a, int(e[d + 1] - e[d]))
        if len(out) and out.min() < 0:
            raise RuntimeError("a block's keys and the totals sent back to it differ")
        return out


def up_table(cols: dict[str, list]) -> pa.Table:
    kind = {"path": pa.int64(), "grp": pa.int64(), "child": pa.int64(), "keys": pa.binary(), "counts": pa.binary()}
    return pa.table({k: pa.array(v, kind[k]) for k, v in cols.items()})


def _down(path: list, grp: list, digit: list, counts: list) -> pa.Table:
    return pa.table({"path": pa.array(path, pa.int64()), "grp": pa.array(grp, pa.int64()), "digit": pa.array(digit, pa.int32()), "counts": pa.array(counts, pa.binary())})


class _Node:
    """Keys of all children of a node, added up."""

    def __init__(self, tree: Tree, table: pa.Table):
        self.children = table.column("child").to_pylist()
        self.parts = [tree.full(k) for k in table.column("keys").to_pylist()]
        flat = np.concatenate([*self.parts, np.zeros(0, U64)])
        counts = np.concatenate([*(unpack(c, len(p)) for c, p in zip(table.column("counts").to_pylist(), self.parts, strict=True)), np.zeros(0, np.int64)])
        self.keys, self.of = np.unique(flat, return_inverse=True)
        self.sums = np.zeros(len(self.keys), np.int64)
        np.add.at(self.sums, self.of, counts)

    def answers(self, totals: np.ndarray) -> list[bytes]:
        out, at = [], 0
        got = totals[self.of]
        for p in self.parts:
            out.append(pack(got[at : at + len(p)]))
            at += len(p)
        return out


def _rise(tree: Tree, level: int) -> Callable:
    def rise(key: tuple, table: pa.Table) -> pa.Table:
        node, (path, grp) = _Node(tree, table), (k.as_py() for k in key)
        return up_table(tree.send(node.keys, node.sums, path, grp >> tree.bits, grp, level + 1))

    return rise


def _top(tree: Tree) -> Callable:
    def top(key: tuple, table: pa.Table) -> pa.Table:
        node, path = _Node(tree, table), key[0].as_py()
        n = len(node.parts)
        return _down([path >> tree.bits] * n, node.children, [path & ((1 << tree.bits) - 1)] * n, node.answers(node.sums))

    return top


def _fall(tree: Tree, level: int) -> Callable:
    def fall(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        node, path = _Node(tree, table), key[0].as_py()
        e = tree.edges(node.keys, level + 1)
        totals = np.full(len(node.keys), -1, np.int64)
        for d, a in zip(answers.column("digit").to_pylist(), answers.column("counts").to_pylist(), strict=True):
            totals[e[d] : e[d + 1]] = unpack(a, int(e[d + 1] - e[d]))
        if len(totals) and totals.min() < 0:
            raise RuntimeError("a node's keys and the totals sent back to it differ")
        n = len(node.parts)
        return _down([path >> tree.bits] * n, node.children, [path & ((1 << tree.bits) - 1)] * n, node.answers(totals))

    return fall


def totals(tree: Tree, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``DOWN`` whose ``grp`` is the block they are for, rows of ``UP`` at the last digit).

    ``sent`` holds the rows of ``block_rows`` of all blocks.
    """
    ups = [sent]
    for level in range(1, tree.depth):
        ups.append(ups[-1].groupBy("path", "grp").applyInArrow(_rise(tree, level), UP))
    back = ups[-1].groupBy("path", "grp").applyInArrow(_top(tree), DOWN)
    for level in range(tree.depth - 1, 0, -1):
        back = ups[level - 1].groupBy("path", "grp").cogroup(back.groupBy("path", "grp")).applyInArrow(_fall(tree, level), DOWN)
    return back, ups[-1]
