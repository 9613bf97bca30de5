"""Front-coded sorted runs, and loser trees that merge them without comparing known prefixes again.

An entry is a key of fixed width with an owner (row, position). A task gathers keys as rows of a byte matrix, sorts them
into runs, and cuts a run at splitters into blocks, one a part, in which an entry is the length it shares with the one
before and the rest of its bytes. A part's task merges its blocks: a loser keeps the length that it shares with the
winner that beat it, so candidates are compared only from there on. The merge yields keys in order, each with the length
that it shares with the one before. A row of -1 is nobody's.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard

#: Bytes of keys that a task sorts at once, and entries that a merge gives at once.
RUN_BYTES, CHUNK = 12_000_000, 4096
_ROWS = 2048


def shared_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each two rows."""
    out = np.empty(len(a), np.int32)
    for at in range(0, len(a), _ROWS):
        differ = a[at : at + _ROWS] != b[at : at + _ROWS]
        first = differ.argmax(axis=1) if differ.shape[1] else np.zeros(len(differ), np.int64)
        out[at : at + _ROWS] = np.where(differ.any(axis=1), first, differ.shape[1])
    return out


def keys_of(matrix: np.ndarray) -> list[bytes]:
    raw, k = matrix.tobytes(), matrix.shape[1]
    return [raw[i : i + k] for i in range(0, len(raw), k)]


def matrix_of(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint8).reshape(len(keys), -1)


def dump_block(matrix: np.ndarray, shared: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> bytes:
    """shared: what each key shares with the one before; 0 for the first."""
    n, k = matrix.shape
    body = b"".join(part[np.arange(k) >= shared[at : at + _ROWS, None]].tobytes() for at in range(0, n, _ROWS) for part in (matrix[at : at + _ROWS],))
    head = n.to_bytes(4, "little") + k.to_bytes(4, "little")
    return zstandard.compress(head + shared.astype("<u2").tobytes() + rows.astype("<i8").tobytes() + pos.astype("<i8").tobytes() + body, 3)


class Run:
    """A block that is read in order: (length shared with the key before, key), and the owners."""

    def __init__(self, raw: bytes):
        raw = zstandard.decompress(raw)
        n, self.width = (int.from_bytes(raw[i : i + 4], "little") for i in (0, 4))
        self.shared = np.frombuffer(raw, "<u2", n, 8).tolist()
        self.rows, self.pos = (np.frombuffer(raw, "<i8", n, 8 + 2 * n + 8 * n * i) for i in (0, 1))
        self._body, self._at = raw, 8 + 18 * n

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        body, at, width, key = self._body, self._at, self.width, b""
        for s in self.shared:
            end = at + width - s
            key = key[:s] + body[at:end]
            at = end
            yield s, key


def merge(runs: list[Run]) -> Iterator[tuple[list[bytes], list[int], np.ndarray, np.ndarray]]:
    """(keys, length that each shares with the one before, rows, positions) of all runs in order, CHUNK at a time; the very first shares 0."""
    size = 1
    while size < len(runs):
        size *= 2
    base = np.cumsum([0, *(len(r.shared) for r in runs)]).tolist()
    rows, pos = (np.concatenate([getattr(r, c) for r in runs]) for c in ("rows", "pos")) if runs else (np.zeros(0, np.int64),) * 2
    feeds = [iter(r) for r in runs]
    # a player: [shared with the last winner that it met, key, number of the owner, run]; None when its run is at its end
    level: list = [None] * size
    for k, feed in enumerate(feeds):
        if (x := next(feed, None)) is not None:
            level[k] = [0, x[1], base[k], k]

    def first_of(player, other):
        """(who goes first, who loses and then holds what it shares with the winner); both hold what they share with the same key before."""
        if other is None or player is None:
            return (player, other) if other is None else (other, player)
        a, b = player[0], other[0]
        if a != b:
            return (player, other) if a > b else (other, player)
        x, y = player[1], other[1]
        differ = int.from_bytes(x[a:]) ^ int.from_bytes(y[a:])
        n = len(x) - ((differ.bit_length() + 7) >> 3)
        if not differ or x[n] < y[n]:
            other[0] = n
            return player, other
        player[0] = n
        return other, player

    losers: list = [None] * size
    while len(level) > 1:
        half = len(level) // 2
        pairs = [first_of(level[2 * k], level[2 * k + 1]) for k in range(half)]
        losers[half : 2 * half] = [x[1] for x in pairs]
        level = [x[0] for x in pairs]
    winner = level[0]
    keys, shared, owners = [], [], []
    while winner is not None:
        n, key, owner, run = winner
        keys.append(key)
        shared.append(n)
        owners.append(owner)
        if len(keys) == CHUNK:
            at = np.array(owners)
            yield keys, shared, rows[at], pos[at]
            keys, shared, owners = [], [], []
        x = next(feeds[run], None)
        player = None if x is None else [x[0], x[1], owner + 1, run]
        node = (size + run) >> 1
        while node:
            other = losers[node]
            if other is not None:
                if player is None:
                    player, losers[node] = other, None
                else:
                    a, b = player[0], other[0]
                    if a < b:
                        player, losers[node] = other, player
                    elif a == b:
                        player, losers[node] = first_of(player, other)
            node >>= 1
        winner = player
    if keys:
        at = np.array(owners)
        yield keys, shared, rows[at], pos[at]


def sorted_runs(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], splitters: list[bytes], alone) -> Iterator[tuple[int, bytes]]:
    """(part, block) of runs of about RUN_BYTES, from pieces (matrix of keys of one width, rows, positions).

    Entries with equal keys go on as one entry that is nobody's, after alone(matrix, rows, positions) has been told of
    them: however often a key occurs, a run has it once.
    """
    held: dict[int, list] = {}

    def flush(width: int) -> Iterator[tuple[int, bytes]]:
        matrix, rows, pos = (np.concatenate(x) for x in zip(*held.pop(width)))
        keys = keys_of(matrix)
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        keys = [keys[k] for k in order.tolist()]
        matrix, rows, pos = matrix[order], rows[order], pos[order]
        shared = np.concatenate((np.zeros(1, np.int32), shared_lengths(matrix[1:], matrix[:-1])))
        again = shared == width
        if again.any():
            equal = again | np.append(again[1:], False)
            alone(matrix[equal], rows[equal], pos[equal])
            first = ~again
            rows = np.where(equal, -1, rows)[first]
            matrix, shared, pos = matrix[first], shared[first], pos[first]
            keys = [k for k, f in zip(keys, first.tolist()) if f]
        cuts = sorted({0, len(keys), *(bisect_left(keys, s) for s in splitters)})
        starts = np.searchsorted(np.array([bisect_left(keys, s) for s in splitters], np.int64), np.array(cuts[:-1], np.int64), "right").tolist()
        for part, i, j in zip(starts, cuts, cuts[1:]):
            shared[i] = 0
            yield part, dump_block(matrix[i:j], shared[i:j], rows[i:j], pos[i:j])

    size: dict[int, int] = {}
    for matrix, rows, pos in parts:
        width = matrix.shape[1]
        held.setdefault(width, []).append((matrix, rows, pos))
        size[width] = size.get(width, 0) + matrix.size
        if size[width] >= RUN_BYTES:
            yield from flush(width)
            size[width] = 0
    for width in list(held):
        yield from flush(width)
