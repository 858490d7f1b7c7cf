"""Minimal acyclic transducers: sorted terms as an automaton that gives each term its place in the order.

Built from terms in order (only states off the last term's path can still be
shared, so the finished ones are looked up in a register and merged as soon as
the next term leaves them). A transition carries how many terms come before
those behind it, so that the sum along a path is the ordinal of its term. Steps
are kept in one open hash table and taken for many terms at once.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

#: Fixed value: spreads the keys of the hash table.
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def minimal(terms: Iterable[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """(transitions of each state, whether it ends a term) of the minimal automaton; state 0 is the start.

    ``terms`` are distinct and in byte order; the empty term is allowed.
    """
    steps: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path, last = [0], b""  # states along the last term

    def settle(depth: int) -> None:
        """Merge the states of the path below ``depth`` with equal ones."""
        while len(path) - 1 > depth:
            state = path.pop()
            known = register.setdefault((final[state], tuple(steps[state].items())), state)
            if known != state:
                steps[path[-1]][last[len(path) - 1]] = known
                free.append(state)

    free: list[int] = []
    for term in terms:
        depth = 0
        while depth < len(term) and depth < len(last) and term[depth] == last[depth]:
            depth += 1
        settle(depth)
        for byte in term[depth:]:
            if free:
                state = free.pop()
                steps[state], final[state] = {}, False
            else:
                state = len(steps)
                steps.append({})
                final.append(False)
            steps[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        last = term
    settle(0)
    return steps, final


class Transducer(NamedTuple):
    key: np.ndarray  # of a slot: state * 256 + byte, or -1
    target: np.ndarray
    before: np.ndarray  # terms that come before those behind this step
    final: np.ndarray  # by state

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        steps, final = minimal(terms)
        size = [-1] * len(steps)  # terms that end behind a state
        keys, targets, before = [], [], []
        stack = [0]
        while stack:
            state = stack[-1]
            open_ones = [t for t in steps[state].values() if size[t] < 0]
            if open_ones:
                stack += open_ones
                continue
            stack.pop()
            if size[state] < 0:
                passed = int(final[state])
                for byte, t in steps[state].items():  # in order of bytes, as terms came in order
                    keys.append(state << 8 | byte)
                    targets.append(t)
                    before.append(passed)
                    passed += size[t]
                size[state] = passed
        return cls(*_placed(np.array(keys, np.int64), np.array(targets, np.int32), np.array(before, np.int32)), np.array(final))

    def ordinals(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ordinals of the byte strings ``buf[start:end]``; -1 for those that are no term."""
        out = np.full(len(start), -1, np.int64)
        who, at, stop = np.arange(len(start)), start.astype(np.int64), end.astype(np.int64)
        total, state = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        while len(who):
            over = at == stop
            if over.any():
                ends = over & self.final[state]
                out[who[ends]] = total[ends]
                go = np.flatnonzero(~over)
                who, at, stop, total, state = who[go], at[go], stop[go], total[go], state[go]
            slot = self._found(state << 8 | buf[at])
            live = slot >= 0
            if not live.all():
                live = np.flatnonzero(live)
                who, at, stop, total, slot = who[live], at[live], stop[live], total[live], slot[live]
            at, total, state = at + 1, total + self.before[slot], self.target[slot].astype(np.int64)
        return out

    def _found(self, key: np.ndarray) -> np.ndarray:
        """The slots of steps; -1 for those that there are not."""
        slot = _slots(key, len(self.key))
        there = self.key[slot]
        asking = np.flatnonzero(there != key)
        while len(asking):
            there = self.key[slot[asking]]
            none = there < 0
            slot[asking[none]] = -1
            asking = asking[~none & (there != key[asking])]
            slot[asking] = (slot[asking] + 1) & (len(self.key) - 1)
            asking = asking[self.key[slot[asking]] != key[asking]]
        return slot


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.view(np.uint64) * _SPREAD) >> np.uint64(40)).view(np.int64) & (size - 1)


def _placed(key: np.ndarray, target: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An open hash table at most a quarter full, whose collisions go to the next free slot."""
    size = 1 << max(3, (4 * len(key) - 1).bit_length())
    table, targets, sums = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32)
    todo, slot = np.arange(len(key)), _slots(key, size)
    while len(todo):
        free = np.flatnonzero(table[slot] < 0)
        _, first = np.unique(slot[free], return_index=True)
        won = free[first]
        table[slot[won]], targets[slot[won]], sums[slot[won]] = key[todo[won]], target[todo[won]], before[todo[won]]
        left = np.ones(len(todo), bool)
        left[won] = False
        todo, slot = todo[left], (slot[left] + 1) & (size - 1)
    return table, targets, sums
