"""An open-addressed NumPy table that interns byte strings of one buffer.

Keys are xxhash64 values; a slot is only shared after its bytes were compared,
so equal hashes of different strings never meet.  Probing is linear and done
for all strings at once: whoever finds a free slot claims it, whoever finds its
own bytes is done, the rest move on by one slot.

``Places`` keeps such a table from one buffer to the next.  A string of up to 24
bytes is three numbers there, so that comparing them compares the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from .common import mix

#: The five primes of xxhash64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer strings are hashed and compared one by one.
ROW_BYTES = 256
#: The bytes of a number that belong to a string of so many.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SHORT = 24


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of each row of a byte matrix."""
    n, size = rows.shape
    whole = size // 8
    lanes = np.ascontiguousarray(rows[:, :8 * whole]).view("<u8").astype(np.uint64, copy=False).reshape(n, whole)
    done = 0
    if size >= 32:
        acc = [np.full(n, x, np.uint64) for x in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        for at in range(0, whole // 4 * 4, 4):
            acc = [_round(a, lanes[:, at + k]) for k, a in enumerate(acc)]
        done = whole // 4 * 4
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.zeros(n, np.uint64), a)) * _P1 + _P4
    else:
        h = np.full(n, _P5, np.uint64)
    h = h + np.uint64(size)
    for k in range(done, whole):
        h = _rotl(h ^ _round(np.zeros(n, np.uint64), lanes[:, k]), 27) * _P1 + _P4
    at = 8 * whole
    if size - at >= 4:
        half = np.ascontiguousarray(rows[:, at:at + 4]).view("<u4").astype(np.uint64).reshape(n)
        h = _rotl(h ^ (half * _P1), 23) * _P2 + _P3
        at += 4
    for k in range(at, size):
        h = _rotl(h ^ (rows[:, k].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _by_length(sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(sizes[part[0]]), part


def xxhash64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """xxhash64 of buf[start:end] of each range."""
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for size, part in _by_length(ends - starts):
            if size > ROW_BYTES:
                out[part] = [xxhash.xxh64_intdigest(buf[a:a + size].tobytes()) for a in starts[part].tolist()]
            else:
                out[part] = _hash_rows(buf[starts[part][:, None] + np.arange(size)])
    return out


def _same_bytes(buf: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[x:x + size] equals buf[y:y + size], per row."""
    out = np.empty(len(x), bool)
    for n, part in _by_length(size):
        if n > ROW_BYTES:
            out[part] = [np.array_equal(buf[a:a + n], buf[b:b + n]) for a, b in zip(x[part].tolist(), y[part].tolist())]
        else:
            step = np.arange(n)
            out[part] = (buf[x[part][:, None] + step] == buf[y[part][:, None] + step]).all(1)
    return out


def intern(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each range, owner of each slot): ranges of equal bytes get one
    slot; ``owner`` is the range that holds it, -1 in free slots."""
    n = len(starts)
    size = 1 << max(4, (2 * n).bit_length())
    if keys is None:
        keys = xxhash64(buf, starts, ends)
    length = ends - starts
    owner = np.full(size, -1, np.int64)
    at = (keys & np.uint64(size - 1)).astype(np.int64)
    slot = np.empty(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        here = at[todo]
        free = owner[here] < 0
        owner[here[free]] = todo[free]  # of several that claim a slot, one gets it
        held = owner[here]
        same = held == todo
        ask = np.flatnonzero(~same & (keys[held] == keys[todo]) & (length[held] == length[todo]))
        if len(ask):
            same[ask] = _same_bytes(buf, starts[held[ask]], starts[todo[ask]], length[todo[ask]])
        slot[todo[same]] = here[same]
        todo = todo[~same]
        at[todo] = (at[todo] + 1) & (size - 1)
    return slot, owner


class Places:
    """Gives byte strings numbers from 0 on, in the order in which they come; equal strings get the same."""

    def __init__(self):
        self.n, self.long = 0, {}
        self.lanes, self.length = np.zeros((3, 1 << 12), np.uint64), np.zeros(1 << 12, np.int64)
        self.table = np.full(1 << 13, -1, np.int32)  # the place that a slot holds

    def _slots(self, lanes: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = mix(lanes[0] * _P1 + lanes[1] * _P2 + lanes[2] * _P3 + length.astype(np.uint64))
        return (h & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _room(self, more: int) -> None:
        m = self.n + more
        if m > len(self.length):
            self.lanes = np.concatenate([self.lanes[:, :self.n], np.zeros((3, 2 * m - self.n), np.uint64)], axis=1)
            self.length = np.concatenate([self.length[:self.n], np.zeros(2 * m - self.n, np.int64)])

    def _rehash(self, size: int) -> None:
        self.table = np.full(size, -1, np.int32)
        todo = np.flatnonzero(self.length[:self.n] > 0)  # long strings aren't in the table
        at = self._slots(self.lanes[:, todo], self.length[todo])
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            left = self.table[at] != todo
            todo, at = todo[left], (at[left] + 1) & (size - 1)

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of buf[start:end] of each range, none of them empty; a range for each new place, in order)."""
        length = ends - starts
        window = np.ndarray(len(buf) + 1, "<u8", np.concatenate([buf, np.zeros(SHORT, np.uint8)]), strides=(1,))
        lanes = np.zeros((3, len(starts)), np.uint64)
        for k in range(3):
            some = np.flatnonzero((length > 8 * k) & (length <= SHORT))
            lanes[k, some] = window[starts[some] + 8 * k] & _MASK[np.minimum(length[some] - 8 * k, 8)]
        todo = np.flatnonzero(length <= SHORT)
        if 2 * (self.n + len(todo)) > len(self.table):
            self._rehash(1 << (2 * (self.n + len(todo))).bit_length())
        place, fresh = np.empty(len(starts), np.int64), []
        at, table = self._slots(lanes[:, todo], length[todo]), self.table
        while len(todo):
            here = table[at]
            free = here < 0
            if free.any():
                f, slot = todo[free], at[free]
                table[slot] = -2 - f  # of several that claim a slot, one gets it
                won = table[slot] == -2 - f
                f, slot = f[won], slot[won]
                self._room(len(f))
                new = slice(self.n, self.n + len(f))
                self.lanes[:, new], self.length[new] = lanes[:, f], length[f]
                table[slot] = np.arange(self.n, self.n + len(f))
                self.n += len(f)
                fresh.append(f)
                here = table[at]
            same = self.length[here] == length[todo]
            for k in range(3):
                same &= self.lanes[k, here] == lanes[k, todo]
            place[todo[same]] = here[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(table) - 1)
        for i in np.flatnonzero(length > SHORT).tolist():
            x = buf[starts[i]:ends[i]].tobytes()
            if x not in self.long:
                self._room(1)
                self.length[self.n] = 0
                self.long[x] = self.n
                self.n += 1
                fresh.append(np.array([i]))
            place[i] = self.long[x]
        return place, np.concatenate(fresh) if fresh else np.zeros(0, np.int64)

    def strings(self) -> list[bytes]:
        """All strings that have a place."""
        short = np.flatnonzero(self.length[:self.n] > 0)
        rows = np.ascontiguousarray(self.lanes[:, short].T, "<u8").view(np.uint8)
        return [r[:k].tobytes() for r, k in zip(rows, self.length[short].tolist())] + list(self.long)
