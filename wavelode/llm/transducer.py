"""Minimal acyclic transducers from sorted terms to their lexicographic ordinals.

An arc's output is how many terms end or branch off before it, so the outputs along a term's path add up
to its place among the sorted terms. States with the same continuations are one: an arc's output depends on
nothing else, so sharing endings doesn't change an ordinal.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """keys: state * 256 + byte of every arc, sorted; skip and target by arc; final by state. The root is the last state."""

    keys: np.ndarray
    skip: np.ndarray
    target: np.ndarray
    final: np.ndarray
    size: int

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From different terms in ascending order of their bytes, in one pass: what can't change any more is
        looked up among the states there are."""
        known: dict[tuple, int] = {}
        final: list[bool] = []
        counts: list[int] = []
        arcs: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
        path: list[list] = [[False, [], []]]

        def closed() -> int:
            ends, labels, targets = path.pop()
            key = (ends, tuple(labels), tuple(targets))
            state = known.get(key)
            if state is None:
                state = known[key] = len(final)
                final.append(ends)
                counts.append(ends + sum(counts[t] for t in targets))
                arcs.append(key[1:])
            return state

        before: bytes | None = None
        for term in terms:
            same = 0
            if before is not None:
                if term <= before:
                    raise ValueError("terms must ascend")
                most = min(len(term), len(before))
                while same < most and term[same] == before[same]:
                    same += 1
            while len(path) > same + 1:
                state = closed()
                path[-1][2].append(state)
            for byte in term[same:]:
                path[-1][1].append(byte)
                path.append([False, [], []])
            path[-1][0] = True
            before = term
        while len(path) > 1:
            state = closed()
            path[-1][2].append(state)
        root = len(final)
        ends, labels, targets = path.pop()
        final.append(ends)
        arcs.append((tuple(labels), tuple(targets)))
        keys, skip, target = [], [], []
        for state, (labels, targets) in enumerate(arcs):
            passed = int(final[state])
            for label, to in zip(labels, targets, strict=True):
                keys.append(state << 8 | label)
                skip.append(passed)
                target.append(to)
                passed += counts[to]
            if state == root:
                total = passed
        return cls(np.array(keys, np.int64), np.array(skip, np.int64), np.array(target, np.int64), np.array(final, bool), total)

    def ordinals(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The ordinal of each term data[offsets[i]:offsets[i + 1]], -1 where it isn't one of the terms. All
        terms step side by side, and those that leave the automaton are done, so very long ones cost nothing."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        lengths = np.diff(offsets)
        at = np.arange(n)
        state, total = np.full(n, len(self.final) - 1, np.int64), np.zeros(n, np.int64)
        step = 0
        while len(at):
            done = lengths[at] == step
            ended = done & self.final[state]
            out[at[ended]] = total[ended]
            if done.any():
                at, state, total = at[~done], state[~done], total[~done]
            if not len(at) or not len(self.keys):
                break
            key = state << 8 | data[offsets[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            at, arc = at[on], arc[on]
            state, total = self.target[arc], total[on] + self.skip[arc]
            step += 1
        return out

    def packed(self) -> bytes:
        head = np.array([len(self.keys), len(self.final), self.size], np.int64)
        return b"".join(a.tobytes() for a in (head, self.keys, self.skip, self.target, self.final))

    @classmethod
    def unpacked(cls, data: bytes) -> Transducer:
        arcs, states, size = np.frombuffer(data, np.int64, 3).tolist()
        parts = [np.frombuffer(data, np.int64, arcs, 24 + 8 * arcs * k) for k in range(3)]
        return cls(*parts, np.frombuffer(data, bool, states, 24 + 24 * arcs), size)
