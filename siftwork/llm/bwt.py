"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

A shard's transform lists, in the order of the shard's sorted suffixes, the symbol before each suffix. Merging starts from the shards laid one after
another, which is the order of all suffixes by no symbol at all; each step reads the merged transform in the present order and deals
its symbols out stably by value, which gives the order by those symbols more. No suffix is compared with one of another shard. Positions
where neighbours part in a step have a common prefix as long as the steps before it, so blocks of suffixes that still stand together after
all steps are the repeated strings. A suffix alone in its block can't be a part of a longer repeat and is left out from there on, and so is
one too near its string's start to grow to the full length.
"""

from __future__ import annotations

import numpy as np

#: Stands for the symbol before a whole string in the pairs below; such suffixes have been left out by then.
NONE = 0


class Shard:
    """Transform of some strings: `before` holds the symbol before each suffix in sorted order, `step` the place of that longer suffix
    (-1 for whole strings), `text` and `at` where the suffix lies. A suffix that is a prefix of another comes first; equal ones go by string.
    """

    def __init__(self, strings: list[bytes], depth: int):
        joined = b"\0".join([*strings, b""])
        data = np.frombuffer(joined, dtype=np.uint8)
        lengths = np.array([len(s) for s in strings], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        n = len(data)
        text = np.repeat(np.arange(len(strings)), lengths + 1)
        place = np.arange(n)
        left = first[text] + lengths[text] - place  # symbols up to the end
        # By eight symbols, zeros behind the end, and then by how many of them there are.
        wide = np.frombuffer(joined + b"\0" * 8, dtype=np.uint8)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(8):
            key <<= np.uint64(8)
            key |= np.where(left > k, wide[k : k + n], 0).astype(np.uint64)
        order = np.lexsort((np.minimum(left, 8), key))
        rank = self._ranks(order, key, np.minimum(left, 8))
        reach = 8
        while reach < depth:
            # Only suffixes that still share a rank, and haven't ended, are told apart by what follows.
            tied = np.zeros(n, dtype=bool)
            tied[:-1] = rank[order][1:] == rank[order][:-1]
            tied[1:] |= tied[:-1].copy()
            at = np.nonzero(tied & (left[order] >= reach))[0]
            if not len(at):
                break
            rows = order[at]
            then = rank[rows + np.minimum(reach, left[rows])]
            again = np.lexsort((then, rank[rows]))
            rows, then = rows[again], then[again]
            order[at] = rows
            new = np.zeros(len(rows), dtype=np.int64)
            head = np.ones(len(rows), dtype=bool)
            head[1:] = rank[rows][1:] != rank[rows][:-1]
            start = np.maximum.accumulate(np.where(head, np.arange(len(rows)), 0))
            parted = head.copy()
            parted[1:] |= then[1:] != then[:-1]
            # A rank is the number of suffixes before its block, so that it stays when the block is split behind it.
            new = np.maximum.accumulate(np.where(parted, np.arange(len(rows)), 0)) - start
            rank[rows] += new
            reach *= 2
        at = place - first[text]
        where = np.empty(n, dtype=np.int64)
        where[order] = place
        whole = (at == 0)[order]
        self.text, self.at = text[order], at[order]
        self.before = np.where(whole, NONE, data[np.maximum(order - 1, 0)]).astype(np.uint8)
        self.step = np.where(whole, -1, where[np.maximum(order - 1, 0)])

    @staticmethod
    def _ranks(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        parted = np.zeros(len(order), dtype=bool)
        parted[:1] = True
        for k in keys:
            parted[1:] |= k[order][1:] != k[order][:-1]
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(parted, np.arange(len(order)), 0))
        return rank


def repeats(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(block, shard, text, at) of every suffix whose first `depth` symbols occur at another suffix too; equal blocks, equal strings."""
    base = np.concatenate([[0], np.cumsum([len(s.before) for s in shards])]).astype(np.int64)
    text, at = np.concatenate([s.text for s in shards]), np.concatenate([s.at for s in shards])
    one = np.concatenate([s.before for s in shards])
    step = np.concatenate([np.where(s.step >= 0, s.step + b, -1) for s, b in zip(shards, base, strict=False)])
    # Two steps in one: the pair of symbols before a suffix, the farther one leading, is dealt like a symbol.
    pair = one[np.maximum(step, 0)].astype(np.uint16) << np.uint16(8) | one
    second = np.where(step >= 0, step[np.maximum(step, 0)], -1)
    # Order by no symbol: shard after shard, in one block.
    row = np.nonzero(at >= depth)[0]
    block = np.zeros(len(row), dtype=np.int32)
    for k in range(depth - depth // 2):
        symbols, onward = (one, step) if k == 0 and depth % 2 else (pair, second)
        symbol = symbols[row]
        dealt = np.argsort(symbol, kind="stable")
        row, block, symbol = onward[row[dealt]], block[dealt], symbol[dealt]
        if len(row) < 2:
            row = row[:0]
            block = block[:0]
            break
        parted = np.empty(len(row) + 1, dtype=bool)
        parted[0] = parted[-1] = True
        np.not_equal(symbol[1:], symbol[:-1], out=parted[1:-1])
        parted[1:-1] |= block[1:] != block[:-1]
        together = ~(parted[:-1] & parted[1:])
        row, block = row[together], np.cumsum(parted[:-1], dtype=np.int32)[together]
    return block.astype(np.int64), np.searchsorted(base, row, side="right") - 1, text[row], at[row]
