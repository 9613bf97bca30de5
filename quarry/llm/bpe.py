"""BPE encoding and decoding over a pair occurrence index.

The vocabulary is a public word-level BPE file (word ends, lower case, white space dropped); ids equal those of the
tokenizers library with add_special_tokens=False. Texts are cut at white space; the distinct chunks of a batch are
normalised and cut into pieces, and the distinct pieces of the batch are encoded together: an index maps each pair
of neighbouring symbols to all its positions in the batch, active ranks are applied in ascending order, and a merge
updates the lists of the pairs that it makes. Ascending order is exact because no merge of the file uses a symbol that
a later merge makes (checked when the file is read).

Null and empty texts have no tokens. Texts are encoded whole, whatever their length: a longer one than BATCH_BYTES makes a
batch of its own. Repeated rows are encoded one by one; ranks do not tie. Extra columns are not read. An empty table
gives no rows. A worker remembers the ids of CACHED_CHUNKS chunks at most; on the test corpus (0.5 GB) a batch finds
58 per cent of its distinct chunks there, and the index holds the pieces of the rest. Chunks outside plain Latin text (other
scripts, control characters, marks) are normalised and cut by the library itself, and then encoded the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import documents, slices, trim

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are encoded together, and chunks that a worker remembers.
BATCH_BYTES, CACHED_CHUNKS = 6_000_000, 600_000

_TABLE_BITS = 20
_CONTROL = re.compile(r"[\x1c-\x1f]")
_CHUNK = regex.compile(r"[^\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
_PLAIN_TEXT = re.compile(r"[\t\n\x0b\x0c\r \x21-\x7e\xa1-\u012f\u0131-\u024f]*")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """Symbols and merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab, merges, end = held["model"]["vocab"], held["model"]["merges"], held["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * n
        for token, k in (vocab | self.special).items():
            self.tokens[k] = token
        self.letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in self.letters], np.int64)
        self.last = np.array([vocab[c + end] for c in self.letters], np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        born = np.full(n, -1)
        born[self.made] = np.arange(len(merges))
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge uses a symbol that a later merge makes: ranks can't be applied in ascending order")
        keys = (self.left << 20) | self.right
        self._levels: list[tuple[np.uint64, np.ndarray]] = []  # hash tables; what collides in one goes on to the next
        rest = np.arange(len(keys))
        while len(rest):
            salt = np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * len(self._levels) & (1 << 64) - 1 | 1)
            table = np.full(1 << _TABLE_BITS, -1, np.int32)
            at = self._slots(keys[rest], salt)
            _, first = np.unique(at, return_index=True)
            table[at[first]] = rest[first]
            self._levels.append((salt, table))
            rest = np.delete(rest, first)
        self._keys = np.append(keys, -1)  # what no slot (-1) holds equals no key

    @staticmethod
    def _slots(key: np.ndarray, salt: np.uint64) -> np.ndarray:
        return ((key.view(np.uint64) * salt) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = (left << 20) | right
        out = np.full(len(key), -1, np.int64)
        for salt, table in self._levels:
            at = table[self._slots(key, salt)]
            hit = self._keys[at] == key
            out[hit] = at[hit]
        return out


def merge_pieces(v: Vocabulary, pieces: list[bytes]) -> list[bytes]:
    """Little-endian 32-bit ids of each piece (UTF-8 bytes, not empty)."""
    if not pieces:
        return []
    if b"" in pieces:
        rest = iter(merge_pieces(v, [p for p in pieces if p]))
        return [next(rest) if p else b"" for p in pieces]
    ends = np.cumsum([len(p) for p in pieces])
    starts = np.concatenate(([0], ends[:-1]))
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sym = v.inner[raw]
    sym[ends - 1] = v.last[raw[ends - 1]]
    n = len(sym)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[starts] = -1
    at = np.flatnonzero(after >= 0)
    rank = v.ranks(sym[at], sym[at + 1])
    at, rank = at[rank >= 0], rank[rank >= 0]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    cuts = np.flatnonzero(np.diff(rank)) + 1
    first = dict(zip(rank[np.concatenate(([0], cuts))].tolist() if len(rank) else [], np.split(at, cuts)))  # pair (by rank) -> positions
    more: dict[int, list[np.ndarray]] = {}  # positions of pairs that merges have made
    active = list(first)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        lists = more.pop(r, [])
        if r in first:
            lists.append(first.pop(r))
        pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b = v.left[r], v.right[r]
        nxt = after[pos]
        ok = (sym[pos] == a) & (nxt >= 0) & (sym[nxt] == b)
        pos = pos[ok]
        if len(pos) > 1:
            pos = np.unique(pos)
            if a == b:  # overlapping occurrences: the leftmost first
                kept, gone = [], -1
                for p in pos.tolist():
                    if p != gone:
                        kept.append(p)
                        gone = int(after[p])
                pos = np.array(kept, np.int64)
        if not len(pos):
            continue
        nxt = after[pos]
        sym[pos], sym[nxt] = v.made[r], -1
        far = after[nxt]
        after[pos] = far
        inside = far >= 0
        before[far[inside]] = pos[inside]
        lefts = before[pos]
        touched = np.concatenate((lefts[lefts >= 0], pos[inside]))
        if len(touched):
            new = v.ranks(sym[touched], sym[after[touched]])
            hit = new >= 0
            if hit.any():
                new, touched = new[hit], touched[hit]
                order = np.argsort(new, kind="stable")
                new, touched = new[order], touched[order]
                cuts = [0, *(np.flatnonzero(np.diff(new)) + 1).tolist(), len(new)]
                for i, j in zip(cuts, cuts[1:]):
                    k = int(new[i])
                    if k in more:
                        more[k].append(touched[i:j])
                    else:
                        more[k] = [touched[i:j]]
                        if k not in first:
                            heapq.heappush(active, k)
    alive = sym >= 0
    counts = np.add.reduceat(alive, starts, dtype=np.int64)
    out = sym[alive].astype("<u4").tobytes()
    stops = (4 * np.cumsum(counts)).tolist()
    return [out[i:j] for i, j in zip([0, *stops[:-1]], stops)]


class Encoder:
    def __init__(self, path: str | None = None):
        self.path = vocabulary_path(path)
        self.v = Vocabulary(self.path)
        self._special = re.compile("|".join(map(re.escape, self.v.special))) if self.v.special else None
        self._library = None
        self._byte = {c: b for b, c in enumerate(self.v.letters)}
        self._ids: dict[str, bytes] = {}

    def _cut(self, chunk: str) -> list[bytes]:
        """Pieces of a chunk without white space and special tokens."""
        if _PLAIN.fullmatch(chunk):
            return [p.encode() for p in _PIECES.findall(chunk.lower())]
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        whole = self._library.normalizer.normalize_str(chunk)
        return [bytes(map(self._byte.__getitem__, p)) for p, _ in self._library.pre_tokenizer.pre_tokenize_str(whole)]

    def _learn(self, chunks: Iterable[str]) -> None:
        """Ids of chunks that are not held."""
        plain, odd = [], []
        for c in chunks:
            (plain if (c.isascii() or _PLAIN.fullmatch(c)) and c.isprintable() and "<|" not in c else odd).append(c)
        lower = [c.lower() for c in plain]
        self._learn_plain([c for c in set(lower) if c not in self._ids])
        self._ids.update(zip(plain, map(self._ids.__getitem__, lower)))
        self._learn_odd(odd)

    def _learn_plain(self, chunks: list[str]) -> None:
        """Distinct chunks of plain lower-case characters. A piece is a chunk of one piece, so pieces are held along with chunks."""
        ids = self._ids
        need = [c for c in chunks if c.isalpha()]
        mixed = [c for c in chunks if not c.isalpha()]
        parts = [(c[:-1], c[-1]) if c[:-1].isalpha() else _PIECES.findall(c) for c in mixed]
        known = set(need)
        extra = {p for x in parts for p in x if p not in ids and p not in known}
        need += extra
        ids.update(zip(need, merge_pieces(self.v, [p.encode() for p in need])))
        for c, x in zip(mixed, parts):
            ids[c] = b"".join(map(ids.__getitem__, x))

    def _learn_odd(self, chunks: list[str]) -> None:
        """Chunks with special tokens, or outside plain text."""
        cut: dict[str, list[bytes | int]] = {}
        for c in chunks:
            parts, at = [], 0
            for m in self._special.finditer(c) if self._special else ():
                parts += self._cut(c[at : m.start()]) if m.start() > at else []
                parts.append(self.v.special[m[0]])
                at = m.end()
            cut[c] = parts + (self._cut(c[at:]) if at < len(c) else [])
        distinct = list({p for parts in cut.values() for p in parts if not isinstance(p, int)})
        ids = dict(zip(distinct, merge_pieces(self.v, distinct)))
        for c, parts in cut.items():
            self._ids[c] = b"".join(p.to_bytes(4, "little") if isinstance(p, int) else ids[p] for p in parts)

    def _new(self, seen: Iterable[str]) -> list[str]:
        """What of seen, distinct chunks, is not held. What this batch uses stays, the rest goes when there is too much."""
        new = [c for c in seen if c not in self._ids]
        if len(self._ids) + len(new) > CACHED_CHUNKS:
            self._ids = {c: self._ids[c] for c in seen if c in self._ids}
        return new

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        plain = [bool(_PLAIN_TEXT.fullmatch(t)) for t in texts]
        odd = [t.split() if not _CONTROL.search(t) else _CHUNK.findall(t) for t, p in zip(texts, plain) if not p]
        if odd:
            self._learn(self._new(set().union(*odd)))
            odd = [b"".join(map(self._ids.__getitem__, c)) for c in odd]
        fast = iter(self._encode_plain([t for t, p in zip(texts, plain) if p]))
        slow = iter(odd)
        return [next(fast if p else slow) for p in plain]

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts of plain characters, whose only white space is ASCII: cut, made distinct and put together in Arrow and numpy."""
        if not texts:
            return []
        cut = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        coded = cut.values.dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        new = self._new(chunks)
        special = [c for c in new if "<|" in c]
        self._learn_plain([c for c in new if "<|" not in c])
        self._learn_odd(special)
        ids = [self._ids[c] for c in chunks]  # an empty chunk, at the ends of texts, has none
        size = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        held = np.frombuffer(b"".join(ids), "<u4")
        start = np.cumsum(size, dtype=np.int32) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate((np.zeros(1, np.int32), np.cumsum(n, dtype=np.int32)))
        place = np.repeat(start[at] - ends[:-1], n)
        place += np.arange(len(place), dtype=np.int32)
        out = held[place].tobytes()
        bounds = (4 * ends[cut.offsets.to_numpy()].astype(np.int64)).tolist()
        return [out[i:j] for i, j in zip(bounds, bounds[1:])]

    def decode(self, ids: bytes) -> str:
        """The library's decode(ids, skip_special_tokens=False): this vocabulary has no decoder, so tokens joined by spaces."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker and vocabulary."""
    path = vocabulary_path(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str | None, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of about BATCH_BYTES, with the ids of their rows."""
    e = encoder(path)
    for rows in slices(batches, text, BATCH_BYTES):
        yield rows, e.encode([t or "" for t in rows.column(text).to_pylist()])
    trim()


def encode(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """doc_id, ids array<int> of each row of docs; with decode, also decoded string."""

    def work(batches):
        for rows, ids in encoded_batches(batches, path):
            columns = [rows.column("doc_id"), pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in ids], pa.list_(pa.int32()))]
            if decode:
                columns.append(pa.array(map(encoder(path).decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>" + ", decoded string" * decode)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def work(batches):
        tokens = encoder(path).v.tokens
        decimal = list(map(str, range(len(tokens))))
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for rows, ids in encoded_batches(batches, path):
            out = []
            for b in ids:
                x = np.frombuffer(b, "<u4").tolist()
                out.append((len(x), sha(map(decimal.__getitem__, x)), sha(map(tokens.__getitem__, x))))
            columns = zip(*out) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string())))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
