"""A minimal acyclic transducer from terms to their ordinals in lexicographic (UTF-8) order.

Built from sorted terms one after another: as soon as a term leaves a branch, the branch is
frozen and merged with an equal one frozen before, so no two states accept the same endings.
An arc carries how many terms come before those that pass it; the sum along a path is the
term's ordinal. Whole buffers of text are matched in step, byte by byte, in numpy.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

# Bytes of a term: ASCII letters, and all bytes of other characters. A-Z count as a-z.
IN_TERM = np.zeros(256, bool)
IN_TERM[0x41:0x5B] = IN_TERM[0x61:0x7B] = IN_TERM[0x80:] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32
UNKNOWN = -1


class Transducer(NamedTuple):
    """Arcs in ascending order of state * 256 + byte, with their targets and ordinals passed over."""

    arcs: np.ndarray
    targets: np.ndarray
    skips: np.ndarray
    final: np.ndarray
    root: int

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.arcs), len(self.final), self.root], "<i8")
        parts = (sizes, self.arcs.astype("<i8"), self.targets.astype("<i4"), self.skips.astype("<i4"), self.final.astype("u1"))
        return b"".join(p.tobytes() for p in parts)


def from_bytes(data: bytes) -> Transducer:
    arcs, states, root = np.frombuffer(data, "<i8", 3).tolist()
    at = 24
    found = []
    for kind, n in (("<i8", arcs), ("<i4", arcs), ("<i4", arcs), ("u1", states)):
        found.append(np.frombuffer(data, kind, n, at))
        at += found[-1].nbytes
    return Transducer(found[0], found[1], found[2], found[3].astype(bool), root)


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal transducer of strictly ascending terms; none gives one state that accepts nothing."""
    frozen: dict[tuple, int] = {}
    accepted: list[int] = []  # terms accepted from each frozen state on

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = frozen.get(key)
        if state is None:
            state = frozen[key] = len(frozen)
            accepted.append(node[0] + sum(accepted[to] for _, to in node[1]))
        return state

    path, last = [[0, []]], None  # the states along the last term, not yet frozen
    for term in terms:
        if last is not None and term <= last:
            raise ValueError(f"terms must ascend: {last!r}, {term!r}")
        shared = len(os.path.commonprefix([term, last])) if last is not None else 0
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        path += [[0, []] for _ in range(len(term) - shared)]
        path[-1][0] = 1
        last = term
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(node)))
    root = freeze(path[0])
    arcs, targets, skips = [], [], []
    for (ends, out), state in frozen.items():
        before = ends
        for byte, to in out:
            arcs.append(state * 256 + byte)
            targets.append(to)
            skips.append(before)
            before += accepted[to]
    final = np.array([ends for ends, _ in frozen], "u1").astype(bool)
    return Transducer(np.array(arcs, "<i8"), np.array(targets, "<i4"), np.array(skips, "<i4"), final, root)


def term_places(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of a byte buffer start and end (exclusive)."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = IN_TERM[buffer]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def ordinals(transducer: Transducer, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ordinal of each term buffer[start:end] (lower-cased already), UNKNOWN where it has none.

    All terms take a step at a time; one that finds no arc is out, so a term of any length
    costs no more steps than the longest known one.
    """
    found = np.full(len(starts), UNKNOWN, np.int64)
    if not len(transducer.arcs):
        return found
    alive = np.arange(len(starts))
    at, end = starts, ends
    state = np.full(len(starts), transducer.root, np.int64)
    passed = np.zeros(len(starts), np.int64)
    while len(alive):
        key = state * 256 + buffer[at]
        arc = np.searchsorted(transducer.arcs, key)
        arc[arc == len(transducer.arcs)] = 0
        known = transducer.arcs[arc] == key
        alive, arc, at, end = alive[known], arc[known], at[known] + 1, end[known]
        state = transducer.targets[arc].astype(np.int64)
        passed = passed[known] + transducer.skips[arc]
        done = at == end
        accepted = done & transducer.final[state]
        found[alive[accepted]] = passed[accepted]
        going = ~done
        alive, at, end, state, passed = alive[going], at[going], end[going], state[going], passed[going]
    return found
