"""A minimal acyclic transducer from sorted terms to their ordinals, walked by many terms at once."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np


class Transducer:
    """``arc`` holds state * 256 + byte in ascending order, with the state behind each arc and what the arc adds; ``final``
    marks the states where a term ends. The sum along a term's arcs is its ordinal, and arcs in ascending order add
    ascending sums, so that an ordinal leads back to its term."""

    def __init__(self, arc: np.ndarray, to: np.ndarray, adds: np.ndarray, final: np.ndarray, root: int, size: int):
        self.arc, self.to, self.adds, self.final, self.root, self.size = arc, to, adds, final, root, size

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending order of their bytes: a state that the next term leaves is final in form, and is
        merged with an equal one (same end mark, same arcs) if there is one."""
        known: dict[tuple, int] = {}
        states: list[tuple] = []
        count: list[int] = []  # terms that can still follow from a state
        path: list[list] = [[False, []]]  # states of the last term that are still open: end mark, arcs
        last = b""

        def close(state: list) -> int:
            form = (state[0], tuple(state[1]))
            at = known.get(form)
            if at is None:
                at = known[form] = len(states)
                states.append(form)
                count.append(state[0] + sum(count[t] for _, t in state[1]))
            return at

        n = 0
        for term in terms:
            if n and term <= last:
                raise ValueError("terms must be distinct and ascending")
            shared = 0
            for x, y in zip(last, term):
                if x != y:
                    break
                shared += 1
            for depth in range(len(last), shared, -1):
                path[depth - 1][1].append((last[depth - 1], close(path.pop())))
            path += [[False, []] for _ in range(len(term) - shared)]
            path[-1][0] = True
            last, n = term, n + 1
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], close(path.pop())))
        root = close(path[0])

        arc, to, adds = [], [], []
        for s, (end, arcs) in enumerate(states):
            before = int(end)
            for byte, t in arcs:
                arc.append(s << 8 | byte)
                to.append(t)
                adds.append(before)
                before += count[t]
        return cls(np.array(arc, np.int64), np.array(to, np.int32), np.array(adds, np.int32), np.array([s[0] for s in states], bool), root, n)

    def dumps(self) -> bytes:
        return pickle.dumps((self.arc, self.to, self.adds, self.final, self.root, self.size), protocol=5)

    @classmethod
    def loads(cls, raw: bytes) -> Transducer:
        return cls(*pickle.loads(raw))

    def ordinals(self, text: bytes) -> np.ndarray:
        """The ordinal of each term of ``text``, terms being parted by single blanks; -1: not a term here."""
        raw = np.frombuffer(text, np.uint8)
        edge = np.flatnonzero(raw == 0x20)
        at, end = np.append(0, edge + 1), np.append(edge, len(raw))
        out = np.full(len(at), -1, np.int64)
        live, state, total = np.arange(len(at)), np.full(len(at), self.root), np.zeros(len(at), np.int64)
        while len(live):
            there = at == end
            if there.any():
                out[live[there]] = np.where(self.final[state[there]], total[there], -1)
            go = ~there
            live, state, total, at, end = live[go], state[go], total[go], at[go], end[go]
            if not len(live) or not len(self.arc):
                break
            key = (state.astype(np.int64) << 8) | raw[at]
            i = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            go = self.arc[i] == key
            i = i[go]
            live, end, at = live[go], end[go], at[go] + 1
            state, total = self.to[i], total[go] + self.adds[i]
        return out

    def term(self, ordinal: int) -> bytes:
        if not 0 <= ordinal < self.size:
            raise IndexError(ordinal)
        out, state = bytearray(), self.root
        while ordinal or not self.final[state]:
            lo, hi = np.searchsorted(self.arc, [state << 8, (state + 1) << 8])
            i = lo + int(np.searchsorted(self.adds[lo:hi], ordinal, side="right")) - 1
            ordinal -= int(self.adds[i])
            out.append(int(self.arc[i]) & 255)
            state = int(self.to[i])
        return bytes(out)
