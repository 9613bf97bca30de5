"""Language-model scores by deleted interpolation.

Tokens are words and one end a document; what stands before a document are ends. The probability of a word mixes
maximum-likelihood estimates of orders 3, 2, 1 and 0 (triples, pairs, words, uniform over the vocabulary and one unknown
word): an order takes a weight, and leaves the rest to the orders below. The weight depends on the bucket (power of two)
of the frequency of the order's context. Weights are learned from the lowest order up by expectation-maximisation on the
counts of training documents that are left out of the estimates (remainder HELD); the estimates that score are those of
all training documents. After a context that was not seen, the order below stands in whole. The distribution sums to one.

Each task turns its documents into blocks: distinct words, and the documents as indices of them. Corpus counts go one
way: a block sends its distinct words, pairs and triples (these as hashes of KEY_BITS bits) with their counts, packed,
to the part that their hash falls in; a part sums them over all blocks, and the sums go back in the order in which they
came. So nothing of the size of the vocabulary or of the n-grams is broadcast or collected, and a word or pair that is
everywhere costs one count a block. N-grams whose hashes collide share a count. For the weights the driver gets counts
of held-out tokens by bucket and by the likelihood ratio of an order to those below, in steps of a quarter of an octave:
at most 65 x 511 numbers an order.

Null and empty texts have the end alone. Texts are read whole, whatever their length. Repeated rows count as often as
they occur, a null doc_id hashes as empty text. The first token of a document has ends alone as its context, so its
orders 3 and 2 are the same. Without training rows all estimates are uniform. Extra columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import documents, id_remainder, materialize, partitions, release, slices

FOLDS, TEST, HELD = 7, 2, 3
BLOCK_CHARS = 4_000_000
#: Bits of the hashes that stand for pairs and triples.
KEY_BITS = 48
END = b""
#: Steps of an octave in which likelihood ratios are told apart, and their number on either side of 1; a ratio of 0 is the lowest.
_STEPS, _REACH = 4, 255
#: What an order, and what all below it, get at least.
_LEAST = 1e-3


def pack(x: np.ndarray) -> bytes:
    """Integers from 0, as compressed planes of bytes, the empty ones left out."""
    x = np.ascontiguousarray(x, np.uint64)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return len(x).to_bytes(4, "little") + bytes([width]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(zstandard.decompress(raw[5:]), np.uint8).reshape(width, n).T
    return out.view(np.uint64).reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 3)  # no word has white space


def unpack_words(raw: bytes) -> list[bytes]:
    return zstandard.decompress(raw).split(b"\n")


def blocks(docs: DataFrame) -> DataFrame:
    """block, words, doc_ids, folds, n_tokens, tokens (packed indices of words) of about BLOCK_CHARS characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), count()
        number, held, size = defaultdict(count().__next__), [], 0

        def out(schema):
            row = [[task << 24 | next(made)], [pack_words(list(number))], [[k for k, _, _ in held]], [[f for _, f, _ in held]], [[len(t) for _, _, t in held]], [pack(np.concatenate([t for _, _, t in held]))]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema)], ["block", "words", "doc_ids", "folds", "n_tokens", "tokens"])

        schema = None
        for batch in slices(batches):
            schema = [pa.int64(), pa.binary(), pa.list_(batch.schema.field("doc_id").type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            for key, fold, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "fold", "text"))):
                words = (text or "").encode().lower().split()
                words.append(END)
                held.append((key, fold, np.array(list(map(number.__getitem__, words)), np.uint32)))
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield out(schema)
                    number, held, size = defaultdict(count().__next__), [], 0
        if held:
            yield out(schema)

    source = docs.select("doc_id", id_remainder("doc_id", FOLDS).cast("int").alias("fold"), "text")
    return source.mapInArrow(work, f"block long, words binary, doc_ids array<{kind}>, folds array<int>, n_tokens array<int>, tokens binary")


class Dealt:
    """Hashes of so many bits in ascending order, cut evenly into parts: the same for a block whenever it is computed."""

    def __init__(self, keys: np.ndarray, parts: int, bits: int = 64):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        bounds = np.array([(k << bits) // parts for k in range(parts)], np.uint64)
        cuts = [0, *np.searchsorted(self.keys, bounds[1:]).tolist(), len(keys)]
        #: (part, first and last place in the order, least hash of the part)
        self.slices = [(k, i, j, bounds[k]) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]

    def back(self, sums: list[bytes]) -> np.ndarray:
        """The packed values of all slices, in the order of the keys as they were given."""
        out = np.zeros(len(self.order), np.int64)
        if sums:
            out[self.order] = np.concatenate([unpack(x) for x in sums]).astype(np.int64)
        return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b >> np.uint64(31)) ^ (b << np.uint64(33))
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))


class Block:
    """Words and tokens of a block, the context of each token, and the distinct words, pairs and triples that it has.

    Triples are those of the tokens that are not the first of a document (places inner).
    """

    def __init__(self, words: bytes, folds: list[int], lens: list[int], tokens: bytes, parts: int):
        self.words, self.lens, self.tokens = unpack_words(words), np.array(lens), unpack(tokens).astype(np.int64)
        self.folds = np.repeat(np.array(folds, np.int8), self.lens)
        self.end = self.words.index(END)
        self.before = contexts(self.tokens, self.lens, self.end)
        n = len(self.words)
        pairs, self.pair = np.unique(self.before * n + self.tokens, return_inverse=True)
        inside = np.ones(len(self.tokens), bool)
        inside[np.cumsum(self.lens) - self.lens] = False
        self.inner = np.flatnonzero(inside)
        triples, self.triple = np.unique(self.pair[self.inner - 1] * n + self.tokens[self.inner], return_inverse=True)
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
        two = _mixed(h[pairs // n], h[pairs % n])
        three = _mixed(two[triples // n], h[triples % n])
        short = np.uint64(64 - KEY_BITS)
        self.dealt = (Dealt(h, parts), Dealt(two >> short, parts, KEY_BITS), Dealt(three >> short, parts, KEY_BITS))
        every = np.arange(len(self.tokens))
        #: For each order: index of the n-gram, and the tokens that have one.
        self.grams = ((self.tokens, every), (self.pair, every), (self.triple, self.inner))

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the n-grams in main and in held-out training documents."""
        (of, at), n = self.grams[order], len(self.dealt[order].order)
        folds = self.folds[at]
        main, held = (folds != TEST) & (folds != HELD), folds == HELD
        return np.bincount(of[main], minlength=n), np.bincount(of[held], minlength=n)


def contexts(tokens: np.ndarray, lens: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; end before the first of a document."""
    before = np.concatenate((tokens[:1], tokens[:-1]))
    before[np.cumsum(lens) - lens] = end
    return before


def corpus_counts(held: DataFrame) -> DataFrame:
    """block, slot, main, held: packed corpus counts of the words (slot below the number of parts), pairs (the next) and triples of a block.

    Rows without a block have the sums of a part's words: n_main, n_held, n_types.
    """
    parts = partitions(held.sparkSession)
    names = ["block", "slot", "main", "held", "n_main", "n_held", "n_types"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("block", "words", "folds", "n_tokens", "tokens"))):
                key, *rest = (x.as_py() for x in row)
                b = Block(*rest, parts)
                for order, dealt in enumerate(b.dealt):
                    counts, out = [x[dealt.order] for x in b.counts(order)], []
                    for k, i, j, least in dealt.slices:
                        keys = pack(np.diff(dealt.keys[i:j], prepend=least)) if order else pack_words([b.words[x] for x in dealt.order[i:j].tolist()])
                        out.append((key, order * parts + k, keys, *(pack(x[i:j]) for x in counts)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [[]] * 5, (pa.int64(), pa.int32(), *3 * [pa.binary()]))], ["block", "slot", "keys", "main", "held"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = defaultdict(list)  # a task may have several slots, or none
        for batch in batches:
            for slot, *row in zip(*(batch.column(c).to_pylist() for c in ("slot", "block", "keys", "main", "held"))):
                of[slot].append(row)
        for slot, rows in of.items():
            keys = [np.cumsum(unpack(x[1])) if slot >= parts else unpack_words(x[1]) for x in rows]
            ends = np.cumsum([len(x) for x in keys]).tolist()
            if slot >= parts:
                at = np.unique(np.concatenate(keys), return_inverse=True)[1]
            else:
                at = pa.array([w for x in keys for w in x], pa.binary()).dictionary_encode().indices.to_numpy()
            sums = [np.bincount(at, np.concatenate([unpack(x[k]) for x in rows])).astype(np.int64) for k in (2, 3)]
            cut = [[pack(x[at[i:j]]) for i, j in zip([0, *ends], ends)] for x in sums]
            none = [None] * len(rows)
            columns = [[x[0] for x in rows], [slot] * len(rows), *cut, none, none, none]
            if slot < parts:
                columns = [[*column, x] for column, x in zip(columns, (None, slot, None, None, int(sums[0].sum()), int(sums[1].sum()), int((sums[0] + sums[1] > 0).sum())))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), *3 * [pa.int64()]))], names)

    sent = held.select("block", "words", "folds", "n_tokens", "tokens").mapInArrow(send, "block long, slot int, keys binary, main binary, held binary")
    return sent.repartitionById(3 * parts, F.col("slot")).mapInArrow(total, "block long, slot int, main binary, held binary, n_main long, n_held long, n_types long")


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.asarray(context, float) + 1)).astype(np.int64), 64)


def probability(weights: list[np.ndarray], grams: list[np.ndarray], before: list[np.ndarray], types: int) -> np.ndarray:
    """Probability of tokens by as many orders as there are weights (by bucket of the context). grams: counts of the word, pair and triple; before: counts of their contexts."""
    p = np.full(len(grams[0]), 1 / (types + 1))
    for weight, count, context in zip(weights, grams, before):
        w = weight[bucket(context)]
        p = np.where(context > 0, w * count / np.maximum(context, 1) + (1 - w) * p, p)
    return p


def ratio_code(count: np.ndarray, context: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Bucket of the context, and step of the likelihood ratio of an order to those below, in one number; of tokens whose context was seen."""
    seen = context > 0
    with np.errstate(divide="ignore"):
        steps = np.rint(_STEPS * np.log2(count[seen] / context[seen] / below[seen]))
    return bucket(context[seen]) << 10 | np.where(count[seen] > 0, np.clip(steps, 1 - _REACH, _REACH), -_REACH).astype(np.int64) + _REACH


def order_weights(codes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weight of an order for each bucket of its context's frequency, from held-out counts n by ratio_code; buckets without any take that of all."""
    steps = (codes & 1023) - _REACH
    ratio = np.where(steps > -_REACH, 2.0 ** (steps / _STEPS), 0.0)

    def learn(at: np.ndarray) -> float:
        w = 0.5
        for _ in range(rounds):
            share = w * ratio[at]
            w = float((share / (share + 1 - w) * n[at]).sum() / n[at].sum())
            w = min(max(w, _LEAST), 1 - _LEAST)
        return w

    weights = np.full(65, 0.5)
    if len(codes):
        weights[:] = learn(np.arange(len(codes)))
        for b in np.unique(codes >> 10):
            weights[b] = learn(np.flatnonzero(codes >> 10 == b))
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    held = materialize(blocks(docs), "blocks")
    counted = materialize(corpus_counts(held), "counts", drop=True)
    release(docs.sparkSession)
    none = F.lit(0).cast("long")
    sums = counted.where("block IS NULL").agg(*[F.coalesce(F.sum(c), none).alias(c) for c in ("n_main", "n_held", "n_types")]).first()
    main, total, types = int(sums["n_main"]), int(sums["n_main"] + sums["n_held"]), int(sums["n_types"])
    kind, parts = docs.schema["doc_id"].dataType.simpleString(), partitions(docs.sparkSession)
    names = ["doc_ids", "folds", "n_tokens", "end", "counts", "left_out"]
    packed = pa.list_(pa.binary())

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block with the counts of each token's word, pair and triple, and of the tokens that are left out those in main documents, then those of their contexts."""
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("doc_ids", "words", "folds", "n_tokens", "tokens", "got"))):
                keys, words, folds, lens, tokens, got = (x.as_py() for x in row)
                b = Block(words, folds, lens, tokens, parts)
                got = sorted(got, key=lambda x: x["slot"])

                def by_token(*of: str) -> list[np.ndarray]:
                    out = []
                    for order, dealt in enumerate(b.dealt):  # noqa: B023
                        mine = [x for x in got if x["slot"] // parts == order]  # noqa: B023
                        index, at = b.grams[order]  # noqa: B023
                        x = sum(dealt.back([m[c] for m in mine]) for c in of)[index]
                        if order == 2:
                            wide = out[1].copy()
                            wide[at] = x
                            x = wide
                        out.append(x)
                    return out

                every, main = by_token("main", "held"), by_token("main")
                end = {c: int(np.append(x[0][b.tokens == b.end], 0)[0]) for c, x in (("every", every), ("main", main))}
                some = np.flatnonzero(b.folds == HELD)
                around = [contexts(x, b.lens, end["main"]) for x in main[:2]]
                left = [pack(x[some]) for x in (*main, *around)]
                columns = [[keys], [folds], [lens], [end["every"]], [[pack(x) for x in every]], [left]]
                types_of = [batch.schema.field("doc_ids").type, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), packed, packed]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types_of)], names)

    back = counted.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("slot", "main", "held")).alias("got"))
    joined = held.join(back, "block").select("doc_ids", "words", "folds", "n_tokens", "tokens", "got")
    linked = materialize(joined.mapInArrow(link, f"doc_ids array<{kind}>, folds array<int>, n_tokens array<int>, end long, counts array<binary>, left_out array<binary>"), "linked", drop=True)

    weights: list[np.ndarray] = []
    for order in range(3):  # from the lowest up: each is learned over what those below give

        def codes(batches: Iterator[pa.RecordBatch], order=order, below=tuple(weights)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column("left_out"):
                    *grams, one, two = (unpack(v.as_py()).astype(np.int64) for v in x)
                    before = [np.full(len(one), main), one, two]
                    found, n = np.unique(ratio_code(grams[order], before[order], probability(below, grams, before, types)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["code", "n"])

        learned = linked.select("left_out").mapInArrow(codes, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # 65 x 511 rows at most
        weights.append(order_weights(learned["code"].to_numpy(np.int64), learned["n"].to_numpy(np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names[:5])):
                keys, folds, lens, end, raw = (x.as_py() for x in row)
                grams = [unpack(x).astype(np.int64) for x in raw]  # by token
                lens = np.array(lens)
                starts = np.cumsum(lens) - lens
                c = grams[0]
                p = probability(weights, grams, [np.full(len(c), total), *(contexts(x, lens, end) for x in grams[:2])], types)
                summed = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, batch.schema.field("doc_ids").type.value_type),
                        pa.array([f == TEST for f in folds], pa.bool_()),
                        pa.array(lens.astype(np.int64)),
                        pa.array(summed((c > 0).astype(np.int64))),
                        pa.array(np.full(len(lens), total, np.int64)),
                        pa.array(summed(np.log10((c + 1) / (total + types + 1)))),
                        pa.array(summed(np.log10(p))),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return linked.select(*names[:5]).mapInArrow(work, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
