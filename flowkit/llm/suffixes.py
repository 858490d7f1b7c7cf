"""Deep-shallow suffix sorting for many small groups of suffixes at once.

Shallow: multikey quicksort with eight-byte characters. A round sorts the
suffixes of all open groups by (group, next character), which partitions each
group by its next character, and goes on with groups that are still larger than
one, down to SHALLOW bytes. Deep: what then shares that many bytes is ordered by
blind tries. A blind trie keeps only branching depths and bytes; a suffix is
inserted by walking down without looking at the skipped bytes, comparing once
with the leaf found, and branching where that comparison differs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bytes that are sorted by multikey quicksort before blind tries take over.
SHALLOW = 32
#: What a trie branches by where a suffix ends; smaller than any byte.
END = -1


class Sorted(NamedTuple):
    order: np.ndarray  # suffixes in order within their groups
    lcp: np.ndarray  # bytes that order[i] shares with order[i - 1]; -1 where a group opens


def common(a: bytes, b: bytes, n: int) -> int:
    """Length of the common prefix, ``n`` at most."""
    a, b = a[:n], b[:n]
    if len(a) != len(b):
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
    n = len(a)
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def blind_order(suffixes: list[bytes]) -> list[int]:
    """The order of the suffixes by a blind trie; equal ones stay in the order given."""
    tree: list | None = None  # a node is [depth, {byte: node}, a leaf below it, leaves that end here or None]

    def leaf(i: int) -> list:
        return [len(suffixes[i]), None, i, [i]]

    for i, s in enumerate(suffixes):
        if tree is None:
            tree = leaf(i)
            continue
        node = tree
        while node[1] is not None:  # blind: only the branching bytes are looked at
            depth = node[0]
            below = node[1].get(s[depth] if depth < len(s) else END)
            if below is None:
                break
            node = below
        other = suffixes[node[2]]
        shared = common(s, other, len(s))
        parent, node = None, tree
        while node[1] is not None and node[0] < shared:
            parent, node = node, node[1][s[node[0]] if node[0] < len(s) else END]
        mine = s[shared] if shared < len(s) else END
        if node[1] is not None and node[0] == shared and mine in node[1]:
            node = node[1][mine]  # only END: the suffix is there already
        if node[1] is None and shared == len(s) == node[0]:
            node[3].append(i)
        elif node[1] is not None and node[0] == shared:
            node[1][mine] = leaf(i)
        else:
            theirs = suffixes[node[2]]
            branch = [shared, {theirs[shared] if shared < len(theirs) else END: node, mine: leaf(i)}, node[2], None]
            if parent is None:
                tree = branch
            else:
                parent[1][s[parent[0]] if parent[0] < len(s) else END] = branch
    out, stack = [], [tree] if tree else []
    while stack:
        node = stack.pop()
        if node[1] is None:
            out += node[3]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(suffixes: list[bytes], group: np.ndarray, width: int) -> Sorted:
    """Order of suffixes of at most ``width`` bytes within each group (numbers), with common prefixes.

    Groups follow each other by number. Order is that of bytes; a suffix that is
    a prefix of another comes first. Empty suffixes and no suffixes are allowed.
    """
    n, padded = len(suffixes), -(-max(width, 1) // 8) * 8
    if not n:
        return Sorted(np.zeros(0, np.int64), np.zeros(0, np.int64))
    size = np.fromiter(map(len, suffixes), np.int64, n)
    flat = np.frombuffer(b"".join(s.ljust(padded, b"\0") for s in suffixes), np.uint8).reshape(n, padded)
    words = flat.view(">u8")
    order, owner = np.argsort(group, kind="stable"), np.sort(group)
    opens = np.r_[True, owner[1:] != owner[:-1]]
    for depth in range(min(SHALLOW, padded) // 8):
        label = np.cumsum(opens) - 1
        many = np.bincount(label)[label] > 1
        at = np.flatnonzero(many)
        if not len(at):
            break
        key = words[order[at], depth].astype(np.uint64)
        by = np.lexsort((key, label[at]))
        order[at], key = order[at][by], key[by]
        opens[at[1:]] |= key[1:] != key[:-1]
    begin = np.flatnonzero(opens)
    for a, b in zip(begin.tolist(), np.r_[begin[1:], n].tolist(), strict=True):
        if b - a > 1:
            members = order[a:b]
            order[a:b] = members[blind_order([suffixes[i] for i in members.tolist()])]
    lcp = np.full(n, -1, np.int64)
    if n > 1:
        same = owner[1:] == owner[:-1]
        differ = flat[order[1:]] != flat[order[:-1]]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), padded)
        lcp[1:] = np.where(same, np.minimum(first, np.minimum(size[order[1:]], size[order[:-1]])), -1)
    return Sorted(order, lcp)
