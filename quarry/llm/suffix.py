"""Repeated passages by a distributed merge sort of suffixes.

A symbol (a byte; or a word, as a hash of 5 bytes) is removed if a string of SPAN symbols that covers it also starts
anywhere else. Not every suffix is sorted: anchors are the positions whose next GRAM symbols have the least hash of any
window of WINDOW starts, so equal strings have the same anchors at the same places. Only anchors whose gram occurs twice
go on. For each, the text to the right makes a key (digest of the gram, then one direction, then the other, each as far
as a string with this anchor can reach); where a gram occurs more than twice, the text to the left makes one too. Keys
are sorted in front-coded runs, exchanged by part, and merged with loser trees that never compare known prefixes again
(runs.py). Neighbours in the merge give matches [left, right) around an anchor: those of SPAN symbols or more are
removed. They also bound what any other suffix can share with it; the few strings that are neither proven nor ruled out
that way are sorted once more, one by one, together with those at the same places of all anchors with the same gram. So
the result is exact in bytes, and in words but for collisions of their hashes.

Equal texts are folded before: from two on, a text of SPAN symbols or more is repeated as a whole. Parts are cut evenly
by digest; grams that are hot (more than a quarter of a part's share) are cut again at keys sampled from them, and
equal keys leave a run once, however often they occur. What the driver holds is bounded by the number of parts. In a
text that repeats itself with a short period every period is an anchor; all but the first and the last of these are
proven where they stand, and dropped, so a long text of one letter costs no more than another.

Null texts are empty; texts below SPAN symbols only repeat nothing. Texts are read in slices of bytes, whatever their
length; one text is held whole. Ties of hashes are all anchors. Repeated rows are equal texts. Extra columns pass
through remove_repeats() and remove_passages(). An empty table gives no rows.

op2 judges bytes (400), and adds, as further columns, the runs of more than 50 words; both come out of one sort. The
pipeline's stage cuts both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm import runs
from quarry.llm.common import documents, materialize, partitions, slices

SPAN, GRAM = 400, 200
#: Words of the shortest passage that counts, of its grams, and bytes of a word's code.
WORDS, WORD_GRAM, CODE = 51, 26, 5
#: Bytes of text that a task takes up at once, entries that become keys at once, starts that are hashed at once.
_TEXT, _KEYS, _STARTS = 2_000_000, 4096, 1 << 15
#: Strings asked for that go to a place in one row.
_CHUNK = 1024
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGEST = 16
_HEAD = 1 + _DIGEST


def _sha() -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), 1, 16)


@dataclass(frozen=True)
class Unit:
    """What is counted: symbols of so many bytes, in strings of span and grams of gram of them. Letters of keys: right, left, whole string."""

    width: int
    span: int
    gram: int
    letters: bytes
    salt: int

    @property
    def window(self) -> int:
        return self.span - self.gram + 1

    @property
    def need(self) -> int:
        """How far from its gram a string with this anchor can reach."""
        return self.span - self.gram

    def symbols(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of texts (ends: from 0), their bytes, where each text ends among them."""
        if self.width == 1:
            return data, data, ends
        first, last = words_of(data, ends)
        codes = _codes(data, first, last)
        return codes, np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, :CODE]).reshape(-1), np.searchsorted(first, ends)


BYTES = Unit(1, SPAN, GRAM, b"RLW", 0)
PASSAGES = Unit(CODE, WORDS, WORD_GRAM, b"rlw", 0x94D049BB133111EB)


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the one after its last. No word goes over the end of a text."""
    inside, edge = ~_WHITE[data], np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= ~inside[:-1]
    after[:-1] |= ~inside[1:]
    if len(data):
        before[0] = after[-1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def _codes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of each word in the lower CODE bytes, none of which is 255."""
    length = last - first
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    h = length.astype(np.uint64) * np.uint64(_BASE)
    at = np.arange(len(first))
    for k in range(0, 64, 8):
        at = at[length[at] > k]
        if not len(at):
            break
        left = np.minimum(length[at] - k, 8).astype(np.uint64)
        x = h[at] ^ (lanes[first[at] + k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left)))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        h[at] = x ^ (x >> np.uint64(31))
    for k in np.flatnonzero(length > 64).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[first[k] : last[k]])
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    out = np.zeros((len(h), 8), np.uint8)
    out[:, :CODE] = np.minimum(h.view(np.uint8).reshape(-1, 8)[:, :CODE], 254)
    return out.view("<u8").reshape(-1)


def _powers(base: int) -> np.ndarray:
    x = np.full(_STARTS + 1024, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _grams(x: np.ndarray, gram: int, salt: int) -> np.ndarray:
    """Mixed polynomial hash of the gram symbols from each position."""
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    g = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    g ^= (g >> np.uint64(32)) ^ np.uint64(salt)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    return g


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each window of w values."""
    k = 1
    while 2 * k <= w:
        x = op(x[:-k], x[k:])
        k *= 2
    return op(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def anchors(unit: Unit, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position and gram hash of the anchors of texts (symbols x, ends from 0)."""
    n, span, window = len(x), unit.span, unit.window
    long = np.diff(ends) >= span
    change = np.zeros(n + 1, np.int8)  # a string may start from a text's first symbol to SPAN before its end
    change[ends[:-1][long]] += 1
    change[ends[1:][long] - span + 1] -= 1
    starts = np.cumsum(change[:n], dtype=np.int8) > 0
    found, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a in range(0, n - span + 1, _STARTS):
        may = starts[a : min(a + _STARTS, n - span + 1)]
        if may.any():
            g = _grams(x[a : a + len(may) + span - 1], unit.gram, unit.salt)
            h = (g >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
            around = np.zeros(len(may) + 2 * (window - 1), np.uint32)
            around[window - 1 : window - 1 + len(may)] = _slide(h, window, np.minimum) * may
            at = np.flatnonzero(_slide(around, window, np.maximum) == h)
            found.append(at + a)
            grams.append(g[at])
    at, first = np.unique(np.concatenate(found), return_index=True)
    text = np.searchsorted(ends, at, "right") - 1
    return text, at - ends[text], np.concatenate(grams)[first]


def _thinned(unit: Unit, x: np.ndarray, ends: np.ndarray, text: np.ndarray, pos: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Which anchors stay, and what is proven by those that go: (text, start, end).

    Anchors at the same distance with equal grams lie in a region of that period. A string within it whose anchor is
    neither among the first nor the last also starts one period before, and one that starts further on among the
    first; so the first stand for all.
    """
    keep, proven = np.ones(len(pos), bool), []
    step = np.diff(pos)
    alike = (text[1:] == text[:-1]) & (gram[1:] == gram[:-1]) & (step <= unit.need)
    if not alike.any():
        return keep, proven
    on = alike[1:] & alike[:-1] & (step[1:] == step[:-1])
    first = np.flatnonzero(alike & ~np.append(False, on))
    last = np.flatnonzero(alike & ~np.append(on, False)) + 1
    for i, j in zip(first.tolist(), last.tolist()):
        d, p, q, at = int(step[i]), int(pos[i]), int(pos[j]), int(ends[text[i]])
        if q - p <= 2 * unit.need + d:
            continue
        region = x[at + p : at + q + unit.gram]
        if (region[d:] == region[:-d]).all():
            inner = i + np.flatnonzero((pos[i : j + 1] >= p + unit.need + d) & (pos[i : j + 1] <= q - unit.need))
            if len(inner):
                keep[inner] = False
                proven.append((int(text[i]), int(pos[inner[0]]) - unit.need, int(pos[inner[-1]]) + unit.span))
    return keep, proven


def _view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of binary values without nulls, and where each ends among them, from 0."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists without nulls, and where each list ends among them, from 0."""
    ends = column.offsets.to_numpy().astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return column.flatten().to_numpy(), ends - ends[0]


def _listed(values: list, ends, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _padded(raw: np.ndarray, ends: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """raw with pad bytes of 255, which no text has, around each text; where texts start in it."""
    out = np.full(len(raw) + pad * len(ends), 255, np.uint8)
    starts = ends[:-1] + pad * np.arange(1, len(ends))
    for s, i, j in zip(starts.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
        out[s : s + j - i] = raw[i:j]
    return out, starts


def _digests(raw: bytes, at: np.ndarray, n: int) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[i : i + n]) for i in at.tolist()]), np.uint8).reshape(-1, _DIGEST)


def anchor_keys(unit: Unit, buf: np.ndarray, raw: memoryview, at: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to the right of the anchors at these bytes of a padded buffer, and to the left of those where many holds.

    A key: letter, digest of the gram, text in one direction, text in the other; what lies beyond the text is 255.
    """
    need, gram = unit.need * unit.width, unit.gram * unit.width
    after, before = sliding_window_view(buf, need)[at + gram], sliding_window_view(buf, need)[at - need][:, ::-1]
    digest = _digests(raw, at, gram)
    out = []
    for letter, one, other, some in ((unit.letters[0], after, before, slice(None)), (unit.letters[1], before, after, many)):
        x = np.empty((len(digest[some]), _HEAD + 2 * need), np.uint8)
        x[:, 0], x[:, 1:_HEAD], x[:, _HEAD : _HEAD + need], x[:, _HEAD + need :] = letter, digest[some], one[some], other[some]
        out.append(x)
    return out[0], out[1]


def _matches(unit: Unit, letter: int, a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that keys a and b (rows) share to the right of their anchors (gram included) and to the left; shared: length that the keys share."""
    if letter == unit.letters[2]:  # whole strings: equal or not
        return np.where(shared == a.shape[1], unit.span, 0), np.zeros(len(a), np.int64)
    need, width = unit.need * unit.width, unit.width
    some = np.flatnonzero(shared >= _HEAD)
    right, left = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if len(some):
        reach = lambda x: np.where((x == 255).any(axis=1), (x == 255).argmax(axis=1), x.shape[1])
        x, y = a[some], b[some]
        one = np.minimum(np.minimum(shared[some] - _HEAD, need), reach(x[:, _HEAD : _HEAD + need]))
        u, v = x[:, _HEAD + need :], y[:, _HEAD + need :]
        other = np.minimum(runs.shared_lengths(u, v), reach(u))
        one, other = one // width, other // width
        right[some], left[some] = (one + unit.gram, other) if letter == unit.letters[0] else (other + unit.gram, one)
    return right, left


_FOUND = [("row", pa.int64()), ("pos", pa.int64()), ("right", pa.int32()), ("left", pa.int32()), ("side", pa.int32())]
_FOUND_SQL = "row long, pos long, right int, left int, side int"
_UNITS = (BYTES, PASSAGES)
#: Letter of a key -> (unit, side): 3 * number of the unit + 0 to the right, 1 to the left, 2 whole string.
_SIDES = {letter: (unit, 3 * k + j) for k, unit in enumerate(_UNITS) for j, letter in enumerate(unit.letters)}


def _found_batch(rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, _FOUND)], [n for n, _ in _FOUND])


class _Neighbours:
    """Matches of entries in order with the ones before and after."""

    def __init__(self):
        self.last = None  # (key, row, pos, right and left that it shares with the one before)

    def add(self, keys: list[bytes], shared: list[int], rows: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        """Matches of all entries so far but the last."""
        shared = np.array(shared, np.int64)
        if self.last:
            keys, rows, pos = [self.last[0], *keys], np.append(self.last[1], rows), np.append(self.last[2], pos)
        else:
            shared = shared[1:]
        matrix = runs.matrix_of(keys)
        unit, side = _SIDES[keys[0][0]]
        right, left = _matches(unit, keys[0][0], matrix[1:], matrix[:-1], shared)
        before = self.last[3:] if self.last else (0, 0)
        right, left = np.append(before[0], right), np.append(before[1], left)
        self.last = keys[-1], int(rows[-1]), int(pos[-1]), int(right[-1]), int(left[-1])
        return self._told(rows[:-1], pos[:-1], (right[:-1], left[:-1]), (right[1:], left[1:]), side)

    def end(self) -> pa.RecordBatch:
        """Matches of the last entry."""
        key, row, pos, right, left = self.last
        none = np.zeros(1, np.int64)
        return self._told(np.array([row]), np.array([pos]), (np.array([right]), np.array([left])), (none, none), _SIDES[key[0]][1])

    @staticmethod
    def _told(rows, pos, a, b, side: int) -> pa.RecordBatch:
        """What no other match of the entry covers."""
        own = rows >= 0
        less_a = (a[0] <= b[0]) & (a[1] <= b[1])
        less_b = (b[0] <= a[0]) & (b[1] <= a[1]) & ~less_a
        out = []
        for (right, left), less in ((a, less_a), (b, less_b)):
            k = own & ~less & (right > 0)
            out.append((rows[k], pos[k], right[k], left[k], np.full(k.sum(), side)))
        return _found_batch([np.concatenate(x) for x in zip(*out)])


def _sort_matches(source: DataFrame, entries, splitters: list[bytes], name: str) -> DataFrame:
    """Matches (row, pos, right, left, side) of the pieces (keys, rows, positions) that entries(batch) yields: runs, exchange, merge, edges of parts."""
    spark = source.sparkSession
    cuts = spark.sparkContext.broadcast(splitters)
    parts = len(splitters) + 1
    names = [n for n, _ in _FOUND]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[pa.RecordBatch] = []

        def alone(matrix: np.ndarray, rows: np.ndarray, pos: np.ndarray) -> None:
            for at in range(0, len(matrix), runs.CHUNK):
                m = matrix[at : at + runs.CHUNK]
                letters = m[:, 0]
                for letter in np.unique(letters).tolist():
                    k = letters == letter
                    unit, side = _SIDES[letter]
                    right, left = _matches(unit, letter, m[k], m[k], np.full(k.sum(), m.shape[1]))
                    told.append(_found_batch([rows[at : at + runs.CHUNK][k], pos[at : at + runs.CHUNK][k], right, left, np.full(k.sum(), side)]))

        def out() -> Iterator[pa.RecordBatch]:
            for x in told:
                none = lambda t: pa.nulls(x.num_rows, t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([none(pa.int32()), none(pa.binary()), *x.columns], ["part", "block", *names])
            told.clear()

        for part, block in runs.sorted_runs((e for batch in batches for e in entries(batch)), cuts.value, alone):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.binary()), *(pa.nulls(1, t) for _, t in _FOUND)], ["part", "block", *names])
            yield from out()
        yield from out()

    made = materialize(source.mapInArrow(make, f"part int, block binary, {_FOUND_SQL}"), f"{name}-runs")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [runs.Run(b.as_py()) for batch in batches for b in batch.column("block")]
        neighbours, first = _Neighbours(), None
        for keys, shared, rows, pos in runs.merge(blocks):
            first = first or (keys[0], int(rows[0]), int(pos[0]))
            x = neighbours.add(keys, shared, rows, pos)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.binary())], [*names, "key"])
        if first:
            x = neighbours.end()
            yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.binary())], [*names, "key"])
            ends = sorted({first, neighbours.last[:3]})
            yield pa.RecordBatch.from_arrays([*(pa.array([e[i] for e in ends], pa.int64()) for i in (1, 2)), *(pa.nulls(len(ends), pa.int32()) for _ in range(3)), pa.array([e[0] for e in ends], pa.binary())], [*names, "key"])

    blocks = made.where("block IS NOT NULL").select("part", "block").repartitionById(parts, F.col("part"))
    after = materialize(blocks.select("block").mapInArrow(combine, f"{_FOUND_SQL}, key binary"), f"{name}-matches")
    # where parts meet: the first and the last entry of each part, so two keys a part at most
    edges = sorted({(bytes(r["key"]), r["row"], r["pos"]) for r in after.where("key IS NOT NULL").collect()})
    found = []
    for (a, *own), (b, *other) in zip(edges, edges[1:]):
        if a[:1] == b[:1]:
            unit, side = _SIDES[a[0]]
            x, y = runs.matrix_of([a]), runs.matrix_of([b])
            right, left = (int(v[0]) for v in _matches(unit, a[0], x, y, runs.shared_lengths(x, y)))
            found += [(row, pos, right, left, side) for row, pos in (own, other) if row >= 0 and right]
    out = made.where("row IS NOT NULL").select(*names).union(after.where("key IS NULL").select(*names))
    return out.union(spark.createDataFrame(found, _FOUND_SQL)) if found else out


def _even(prefixes: list[bytes], parts: int) -> list[bytes]:
    """Keys that cut each prefix's digests evenly."""
    return sorted(p + (((k << 64) // parts).to_bytes(8, "big") if k else b"") for p in prefixes for k in range(parts))[1:]


class Repeats:
    """What repeats in the texts of docs (doc_id, text), in each of the units."""

    def __init__(self, docs: DataFrame, units: tuple[Unit, ...] = _UNITS):
        self.docs, self.spark, self.units = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")), docs.sparkSession, units
        self.parts = partitions(self.spark)
        self.texts = self._texts()
        self.candidates, self.hot = self._candidates()
        self.held = self._held()
        self.spans = self._spans()

    def _texts(self) -> DataFrame:
        """row, sha, rep (smallest doc_id), copies, n_bytes, n_words, at (4 * position + 2 * unit), grams, proven (unit, start, end by turns) of each distinct text that is long enough to repeat anything."""
        kind, units = self.docs.schema["doc_id"].dataType.simpleString(), self.units

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", _TEXT):
                data, ends = _view(batch.column("text"))
                n = len(ends) - 1
                held, proven = [], [[] for _ in range(n)]
                counts = np.zeros(n, np.int64)
                for unit in units:
                    k = _UNITS.index(unit)
                    x, _, stops = unit.symbols(data, ends)
                    if unit == PASSAGES:
                        counts = np.diff(stops)
                    text, pos, gram = anchors(unit, x, stops)
                    keep, sure = _thinned(unit, x, stops, text, pos, gram)
                    held.append((text[keep], 4 * pos[keep] + 2 * k, gram[keep].view(np.int64)))
                    for t, start, end in sure:
                        proven[t] += [k, start, end]
                text, at, gram = (np.concatenate(c) for c in zip(*held))
                order = np.argsort(text, kind="stable")
                stops = np.searchsorted(text[order], np.arange(n + 1))
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[i:j]).digest()[:16] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = [pa.array(sha, pa.binary()), batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(counts, pa.int64()), _listed(at[order], stops, pa.int64()), _listed(gram[order], stops, pa.int64()), pa.array(proven, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["sha", "doc_id", "n_bytes", "n_words", "at", "grams", "proven"])

        least = min(2 * unit.span - 1 if unit == PASSAGES else unit.span for unit in units)
        found = self.docs.where(F.octet_length("text") >= least).mapInArrow(work, f"sha binary, doc_id {kind}, n_bytes long, n_words long, at array<long>, grams array<long>, proven array<long>")
        folded = found.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_bytes", "n_words", "at", "grams", "proven")])
        return materialize(folded.withColumn("row", F.monotonically_increasing_id()), "texts")

    def _candidates(self) -> tuple[DataFrame, dict[int, int]]:
        """row, at, gram (lists) of anchors whose gram occurs twice or more, at with 1 added if more than twice; grams that are hot, with their counts (at most 4 a part)."""
        every = self.texts.select("row", F.explode(F.arrays_zip("at", "grams")).alias("x")).select("row", F.col("x.at").alias("at"), F.col("x.grams").alias("gram"))
        often = materialize(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
        total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bound = max(1000, total / (4 * self.parts))
        hot = {r["gram"]: r["n"] for r in often.where(F.col("n") > bound).collect()}
        found = every.join(often, "gram").groupBy("row").agg(F.collect_list(F.struct((F.col("at") + (F.col("n") > 2).cast("long")).alias("at"), "gram")).alias("x"))
        return materialize(found.select("row", F.col("x.at").alias("at"), F.col("x.gram").alias("gram")), "candidates"), hot

    def _held(self) -> DataFrame:
        """row, text, at, gram: one row of docs for each text with candidates."""
        reps = self.texts.select("row", "sha", "rep").join(self.candidates, "row")
        joined = self.docs.withColumn("sha", _sha()).join(reps, "sha").where(F.col("doc_id").eqNullSafe(F.col("rep")))
        return materialize(joined.select("row", "text", "at", "gram"), "held")

    def _splitters(self) -> list[bytes]:
        """Even cuts, and for hot grams cuts at keys sampled from them."""
        even = _even([unit.letters[k : k + 1] for unit in self.units for k in (0, 1)], -(-self.parts // 2))
        if not self.hot:
            return even
        share = min(1.0, 16 * self.parts / sum(self.hot.values()))  # so a sample of some ten keys a part
        hot, bound = np.array(sorted(self.hot), np.int64), np.uint64(int(share * ((1 << 64) - 1)))

        def drawn(rows: np.ndarray, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
            x = (rows.view(np.uint64) ^ (at.view(np.uint64) << np.uint64(40))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return np.isin(grams, hot) & ((x ^ (x >> np.uint64(32))) <= bound)

        units = self.units

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", _TEXT):
                out = [k for matrix, _, _ in _pieces(units, batch, drawn) for k in runs.keys_of(matrix)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])

        keys = sorted(bytes(r["key"]) for r in self.held.mapInArrow(work, "key binary").collect())
        step = max(1, len(keys) // (4 * self.parts))
        return sorted({*even, *keys[::step]})

    def _matches(self) -> DataFrame:
        units = self.units

        def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for part in slices(iter([batch]), "text", _TEXT):
                yield from _pieces(units, part)

        return _sort_matches(self.held, entries, self._splitters(), "anchors")

    def _spans(self) -> DataFrame:
        """row, unit, start, end: what repeats of each text with candidates (lists), but for texts with copies."""
        units = self.units
        matches = self._matches().groupBy("row").agg(F.collect_list(F.struct("pos", "right", "left", "side")).alias("m"))
        flat = self.candidates.join(matches, "row", "left").select("row", "at", "gram", *[F.coalesce(F.col(f"m.{c}"), F.array().cast("array<long>")).cast("array<long>").alias(c) for c in ("pos", "right", "left", "side")])
        judged = materialize(flat.mapInArrow(_judge, "row long, unit int, start array<long>, end array<long>, asked array<long>, gram array<long>, offset array<long>"), "judged")
        found = judged.select("row", "unit", F.explode(F.arrays_zip("start", "end")).alias("s")).select("row", "unit", "s.start", "s.end")
        sure = self.texts.where(F.size("proven") > 0).select("row", F.posexplode("proven").alias("k", "v")).groupBy("row", (F.col("k") / 3).cast("int").alias("i")).agg(*[F.max(F.when(F.col("k") % 3 == j, F.col("v"))).alias(c) for j, c in enumerate(("unit", "start", "end"))])
        found = found.union(sure.select("row", F.col("unit").cast("int"), "start", "end"))
        if not judged.where(F.size("asked") > 0).isEmpty():
            number = (F.col("side") / 3).cast("int")
            span = F.element_at(F.array(*[F.lit(u.span) for u in _UNITS]), number + 1)
            found = found.union(self._asked(judged).select("row", number.alias("unit"), F.col("pos").alias("start"), (F.col("pos") + span).alias("end")))
        spans = found.groupBy("row").agg(F.collect_list(F.struct("unit", "start", "end")).alias("s"))
        return materialize(spans.select("row", F.col("s.unit").cast("array<long>").alias("unit"), F.col("s.start").alias("start"), F.col("s.end").alias("end")), "spans")

    def _asked(self, judged: DataFrame) -> DataFrame:
        """Matches of whole strings that judged asks for (asked: 4 * start + 2 * unit, with a gram and how far before it they start).

        The strings asked for are few. Their digests go to all places of their grams, at most a chunk of them in a row,
        and of the strings there only those with such a digest are sorted.
        """
        units = self.units
        wanted = judged.where(F.size("asked") > 0).groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("asked", "gram", "offset")])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(iter([batch]), "text", _TEXT):
                    gram, offset = (_lists(part.column(c))[0] for c in ("gram", "offset"))
                    for matrix, _, _, at in _strings(units, part):
                        yield pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(offset[at]), pa.array(_short(matrix))], ["gram", "offset", "digest"])

        told = self.held.select("row", "text").join(wanted, "row").select("text", F.col("row"), F.col("asked").alias("at"), "gram", "offset")
        strings = materialize(told.mapInArrow(work, "gram long, offset long, digest long").distinct(), "asked")
        chunks = strings.groupBy("gram").agg(F.ceil(F.count("*") / _CHUNK).alias("n"))
        chunked = strings.join(chunks, "gram").groupBy("gram", F.pmod("digest", "n")).agg(F.collect_list(F.struct("offset", "digest")).alias("x")).select("gram", "x")
        places = self.candidates.select("row", F.explode(F.arrays_zip("at", "gram")).alias("p")).select("row", F.col("p.at").alias("at"), F.col("p.gram").alias("gram")).join(chunked, "gram")
        start = lambda x: F.shiftright("at", 2) - x["offset"]
        there = F.transform(F.filter("x", lambda x: start(x) >= 0), lambda x: F.struct((start(x) * 4 + F.col("at").bitwiseAND(2)).alias("at"), x["digest"].alias("digest")))
        asked = places.select("row", there.alias("x")).groupBy("row").agg(F.flatten(F.collect_list("x")).alias("x"))
        source = self.held.select("row", "text").join(asked, "row").select("row", "text", F.col("x.at").alias("at"), F.col("x.digest").alias("digest"))

        def entries(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for part in slices(iter([batch]), "text", _TEXT):
                digest = _lists(part.column("digest"))[0]
                for matrix, rows, pos, at in _strings(units, part):
                    same = np.flatnonzero(_short(matrix) == digest[at])
                    _, first = np.unique(np.stack((rows[same], pos[same])), axis=1, return_index=True)
                    if len(first):
                        yield matrix[same[first]], rows[same[first]], pos[same[first]]

        return _sort_matches(source, entries, _even([unit.letters[2:] for unit in units], self.parts), "strings")

    def cut(self) -> DataFrame:
        """row, sha, starts, ends, word_starts, word_ends: the runs of bytes and of words that repeat in each text that has any, ordered and apart; null where there are none."""
        lists = "starts array<long>, ends array<long>, word_starts array<long>, word_ends array<long>"
        merged = self.texts.where("copies = 1").select("row", "sha").join(self.spans, "row").select("row", "sha", "unit", "start", "end").mapInArrow(_union, f"row long, sha binary, {lists}")
        zero = F.array(F.lit(0).cast("long"))
        whole = []
        for unit, n in ((BYTES, F.col("n_bytes")), (PASSAGES, F.col("n_words"))):
            enough = (n >= unit.span) & F.lit(unit in self.units)
            whole += [F.when(enough, zero), F.when(enough, F.array(n))]
        return merged.union(self.texts.where("copies > 1").select("row", "sha", *whole))


def _places(units: tuple[Unit, ...], batch: pa.RecordBatch) -> Iterator[tuple[Unit, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each unit: it, buffer, where texts start in it, symbols of each text, and of the places of column at: text, value, number in the column."""
    data, ends = _view(batch.column("text"))
    at, stops = _lists(batch.column("at"))
    text = np.repeat(np.arange(len(stops) - 1), np.diff(stops))
    for unit in units:
        mine = np.flatnonzero((at >> 1 & 1) == _UNITS.index(unit))
        if len(mine):
            _, raw, counts = unit.symbols(data, ends)
            buf, starts = _padded(raw, counts * unit.width, unit.need * unit.width)
            yield unit, buf, starts, np.diff(counts), text[mine], at[mine], mine


def _pieces(units: tuple[Unit, ...], batch: pa.RecordBatch, drawn=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, rows, positions) of the anchors (row, text, at, gram) of a batch; drawn(rows, at, grams): which of them."""
    rows = batch.column("row").to_numpy()
    grams = _lists(batch.column("gram"))[0] if drawn else None
    for unit, buf, starts, _, text, at, mine in _places(units, batch):
        if drawn:
            some = drawn(rows[text], at, grams[mine])
            text, at = text[some], at[some]
        raw, place = buf.tobytes(), starts[text] + (at >> 2) * unit.width
        for i in range(0, len(at), _KEYS):
            k = slice(i, i + _KEYS)
            many = (at[k] & 1).astype(bool)
            right, left = anchor_keys(unit, buf, raw, place[k], many)
            yield right, rows[text[k]], at[k] >> 2
            if len(left):
                yield left, rows[text[k]][many], at[k][many] >> 2


def _strings(units: tuple[Unit, ...], batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, rows, positions, numbers in column at) of the whole strings that start at these places, _KEYS at a time."""
    rows = batch.column("row").to_numpy()
    for unit, buf, starts, counts, text, at, mine in _places(units, batch):
        pos = at >> 2
        inside = pos <= counts[text] - unit.span
        text, pos, mine, raw = text[inside], pos[inside], mine[inside], buf.tobytes()
        for i in range(0, len(pos), _KEYS):
            k = slice(i, i + _KEYS)
            matrix = np.empty((len(pos[k]), _HEAD), np.uint8)
            matrix[:, 0], matrix[:, 1:] = unit.letters[2], _digests(raw, starts[text[k]] + pos[k] * unit.width, unit.span * unit.width)
            yield matrix, rows[text[k]], pos[k], mine[k]


def _short(matrix: np.ndarray) -> np.ndarray:
    """The first 64 bits of the digests of whole strings."""
    return np.ascontiguousarray(matrix[:, 1:9]).view(np.int64).reshape(-1)


def _joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate(([True], s[1:] > e[:-1])) if len(s) else np.zeros(0, bool)
    return s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(s) - 1]))] if len(s) else e


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        unit, start, end = (_lists(batch.column(c))[0] for c in ("unit", "start", "end"))
        stops = _lists(batch.column("unit"))[1].tolist()
        out = []
        for i, j in zip(stops, stops[1:]):
            row = []
            for k in range(len(_UNITS)):
                mine = unit[i:j] == k
                row += _joined(start[i:j][mine], end[i:j][mine]) if mine.any() else (None, None)
            out.append(row)
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("sha"), *(pa.array(c, kind) for c in columns)], ["row", "sha", "starts", "ends", "word_starts", "word_ends"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the matches of a text's anchors: intervals that repeat, and strings (as gram and offset before it) that may."""
    names, kinds = ["row", "unit", "start", "end", "asked", "gram", "offset"], (pa.int64(), pa.int32(), *5 * [pa.list_(pa.int64())])
    for batch in batches:
        (at, stops), (pos, m_stops) = _lists(batch.column("at")), _lists(batch.column("pos"))
        gram, right, left, side = (_lists(batch.column(c))[0] for c in ("gram", "right", "left", "side"))
        out = []
        for row, i, j, a, b in zip(batch.column("row").to_pylist(), *(x.tolist() for x in (stops[:-1], stops[1:], m_stops[:-1], m_stops[1:]))):
            for k, unit in enumerate(_UNITS):
                mine, m = np.flatnonzero((at[i:j] >> 1 & 1) == k) + i, np.flatnonzero(side[a:b] // 3 == k) + a
                if len(mine) and len(m):
                    got = _judged(unit, at[mine], gram[mine], pos[m], right[m], left[m], side[m] % 3)
                    if len(got[0]) or len(got[2]):
                        out.append((row, k, *got[:2], 4 * got[2] + 2 * k, *got[3:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 7, kinds)], names)


def _judged(unit: Unit, at, gram, pos, right, left, side) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends; starts of strings that may repeat besides, a gram in each, how far before it they start. Where a gram occurs twice, its one match is all there is."""
    span, short = unit.span, unit.need
    good = right + left >= span
    starts, ends = _joined((pos - left)[good], (pos + right)[good])
    none = np.zeros(0, np.int64)
    many = (at & 1).astype(bool)
    if not many.any():
        return starts, ends, none, none, none
    order = np.argsort(at >> 2)
    places, gram, many = (at >> 2)[order], gram[order], many[order]
    most_right, most_left = np.full(len(places), unit.gram), np.zeros(len(places), np.int64)
    k = np.searchsorted(places, pos)
    np.maximum.at(most_right, k[side == 0], right[side == 0])
    own = (side == 1) | ~many[k]
    np.maximum.at(most_left, k[own], left[own])
    # a string from p has its anchor, the least gram of those inside, in common with any equal string; that anchor
    # lets it pass if p >= anchor - most_left and p + SPAN <= anchor + most_right
    low, high = places - most_left, places + most_right - span
    hull = np.unique(np.concatenate([np.arange(max(0, x, p - short), min(p, y) + 1) for p, x, y in zip(places.tolist(), low.tolist(), high.tolist())]))
    if len(hull) and len(starts):
        inside = np.searchsorted(starts, hull, "right") - 1
        hull = hull[(inside < 0) | (hull + span > ends[inside])]
    if not len(hull):
        return starts, ends, none, none, none
    rank = gram.view(np.uint64)
    best, stop = np.searchsorted(places, hull), np.searchsorted(places, hull + short, "right")
    k = best + 1
    while (k < stop).any():
        more = np.minimum(k, len(places) - 1)
        best = np.where((k < stop) & (rank[more] < rank[best]), more, best)
        k = k + 1
    passed = (low[best] <= hull) & (high[best] >= hull)
    return starts, ends, hull[passed], gram[best[passed]], (places[best] - hull)[passed]


def keep(raw: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(raw[i:j] for i, j in zip([0, *ends], [*starts, len(raw)]))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the columns of the contract: n_passages and n_passage_words, the runs of more than 50 words that also stand elsewhere, and their words."""
    docs = documents(spark, sf_dir)
    found = Repeats(docs)
    names = ["sha", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]
    schema = "sha binary, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _TEXT):
            out = []
            for t, *lists in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends", "word_starts", "word_ends"))):
                s, e, ws, we = (x or [] for x in lists)
                out.append((sum(e) - sum(s), len(s), hashlib.sha256(keep(t, s, e)).hexdigest(), len(ws), sum(we) - sum(ws)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("sha"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())))], names)

    cut = found.cut()
    of = found.texts.where("copies = 1").select("row").join(cut, "row").join(found.held.select("row", "text"), "row")
    some = of.select("sha", "text", "starts", "ends", "word_starts", "word_ends").mapInArrow(work, schema)
    long, words = F.col("n_bytes") >= SPAN, F.col("n_words") >= WORDS
    number = lambda c: F.when(c, 1).otherwise(0).cast("long")
    whole = found.texts.where("copies > 1").select("sha", F.when(long, F.col("n_bytes")).otherwise(0), number(long), F.when(long, F.sha2(F.lit("").cast("binary"), 256)), number(words), F.when(words, F.col("n_words")).otherwise(0))
    text = F.coalesce("text", F.lit(""))
    light = docs.select("doc_id", _sha().alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return light.join(some.union(whole), "sha", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"), zero("n_passages"), zero("n_passage_words"))


def word_runs(raw: bytes, starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Runs of words as runs of bytes, from the first byte of the first word to the last of the last."""
    if not starts:
        return [], []
    data = np.frombuffer(raw, np.uint8)
    first, last = words_of(data, np.array([0, len(data)]))
    return first[starts].tolist(), last[np.array(ends) - 1].tolist()


def _without(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """docs without the runs of cut (sha; starts, ends in bytes; word_starts, word_ends in words; nulls where there are none)."""
    names = docs.columns
    at = names.index("text")
    inner = ("sha", "starts", "ends", "word_starts", "word_ends")
    sha, *of = (next(c for c in (f"{x}_{k}" for k in range(len(names) + 1)) if c not in names) for x in inner)

    def left(text: str | None, starts, ends, word_starts, word_ends) -> str | None:
        if text is None or not (starts or word_starts):
            return text
        raw = text.encode()
        more = word_runs(raw, word_starts or [], word_ends or [])
        s, e = _joined(*(np.array([*(x or []), *y], np.int64) for x, y in zip((starts, ends), more)))
        return keep(raw, s.tolist(), e.tolist()).decode("utf-8", "ignore")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _TEXT):
            held = batch.column("text")
            columns = [*batch.columns[: len(names)]]
            columns[at] = pa.array([left(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("text", *of)))], held.type)
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = docs.withColumn(sha, _sha()).join(cut.select(*[F.col(x).alias(c) for x, c in zip(inner, (sha, *of))]), sha, "left")
    out = joined.select(*[F.col(f"`{c}`") for c in names], *of).mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with strings of SPAN bytes that repeat cut from text (a character cut in two goes as a whole), and n_chars counted anew where there is such a column."""
    return _without(docs, Repeats(docs, (BYTES,)).cut())


def remove_passages(docs: DataFrame) -> DataFrame:
    """As remove_repeats(), with repeats of more than 50 words cut too."""
    return _without(docs, Repeats(docs).cut())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut from the texts; texts of which nothing is left stay as empty rows."""
    return remove_passages(docs)
