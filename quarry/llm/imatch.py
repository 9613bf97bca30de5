"""I-Match fingerprints over randomised lexicons.

A term's document frequency is counted over all documents. The lexicon holds the terms in at least LOW and at most HIGH
of the documents. Each of its terms is in LOW of them, so it has at most (mean number of distinct terms of a document) /
LOW terms, however many documents there are; it is broadcast as 64-bit hashes. A document's terms are its distinct words
in the lexicon, or all its distinct words where fewer than FEW of them are. They are sorted and hashed: once over the
whole lexicon, and once over each of a fixed set of random sub-lexicons, SUBSETS for each share 1/4, 1/16, ... of the
vocabulary. The sub-lexicons are the same for all documents. Large shares tell whether two long lists are nearly the
same, small ones how much of them is; likeness is the share of sub-lexicons with equal hashes, among those where either
side has a term.

Null texts are empty, and have the fingerprint without terms; two of these are alike. Equal texts have equal
fingerprints. Neighbours in order of doc_id: nulls last, equal ids ordered by a hash of the text. Repeated rows are each
other's neighbours. Texts are read whole, whatever their length. Extra columns are not read. A single row is its own
next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import documents, materialize, partitions, slices

LOW, HIGH, FEW = 1e-3, 0.05, 8
#: Sub-lexicons of each share, and shares: 4**-1 to 4**-SHARES.
SUBSETS, SHARES = 16, 6
_BLOCK_TERMS = 400_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def terms_of(text: str) -> set[bytes]:
    return set(text.encode().lower().split())


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Hashes of the terms of the band, ascending."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, counts), np.uint64, len(counts)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(terms_of(text or ""))
                if len(counts) > _BLOCK_TERMS:
                    yield out()
                    counts.clear()
        yield out()

    n = docs.count()
    counted = docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    within = counted.where((F.col("df") >= low * n) & (F.col("df") <= max(high * n, 1))).select("term")
    band = materialize(within, "lexicon", drop=True)  # the counts' shuffle goes before the texts move
    return np.sort(np.array([r["term"] for r in band.collect()], np.int64).view(np.uint64))


class Fingerprinter:
    """Fingerprint of a text: hash of all its terms, and one of those in each sub-lexicon, by share; 0 where there are none."""

    def __init__(self, lexicon: np.ndarray):
        self._lexicon = lexicon
        self._salts = np.array([xxhash.xxh64_intdigest(b"subset %d" % k) | 1 for k in range(SUBSETS)], np.uint64)[:, None]

    def terms(self, text: str) -> np.ndarray:
        words = terms_of(text)
        hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        if len(hashes) and len(self._lexicon):
            at = np.minimum(np.searchsorted(self._lexicon, hashes), len(self._lexicon) - 1)
            inside = hashes[self._lexicon[at] == hashes]
            return inside if len(inside) >= FEW else hashes
        return hashes

    def of(self, text: str) -> tuple[int, np.ndarray]:
        terms = self.terms(text)
        held = np.zeros((SHARES, SUBSETS), np.uint16)
        if not len(terms):
            return 0, held.reshape(-1)
        mixed = terms * self._salts
        mixed ^= mixed >> np.uint64(29)
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
        subset, term = np.nonzero(mixed >> np.uint64(62) == 0)  # by subset, then by term
        drawn, terms_in = mixed[subset, term], terms[term]
        digest = xxhash.xxh3_64_intdigest
        for k in range(SHARES):
            if k:
                inside = drawn >> np.uint64(62 - 2 * k) == 0
                subset, drawn, terms_in = subset[inside], drawn[inside], terms_in[inside]
            if not len(subset):
                break
            raw = terms_in.tobytes()
            cuts = np.flatnonzero(np.diff(subset, prepend=-1, append=SUBSETS))
            for j, a, b in zip(subset[cuts[:-1]].tolist(), (8 * cuts[:-1]).tolist(), (8 * cuts[1:]).tolist()):
                held[k, j] = digest(raw[a:b]) & 0xFFFF | 1
        return digest(terms.tobytes()), held.reshape(-1)


def told(fp: tuple[int, np.ndarray]) -> str:
    """16 hexadecimal digits for all terms, and 4 for each sub-lexicon."""
    return f"{fp[0]:016x}-" + fp[1].astype(">u2").tobytes().hex()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1."""
    if a[0] == b[0]:
        return 1.0
    some = (a[1] > 0) | (b[1] > 0)
    return float((a[1] == b[1])[some].mean()) if some.any() else 0.0


def edited(text: str, other: str) -> str:
    """text with its last third replaced by the first as many characters of other."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, h in ascending order of doc_id over partitions and within them: one exchange of the texts."""
    keys = (F.col("doc_id").asc_nulls_last(), F.col("h").asc())
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)


def compare_with_next(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before in ascending order. Within a partition it is at hand; the first row of each
    partition leaves without it, and is completed with the last row of the partition before: one row a partition.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(lexicon(docs, low, high))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(prints: Fingerprinter, key, text: str, own, other: str, others) -> tuple:
        new = edited(text, other)
        changed = prints.of(new)
        return key, len(text), hashlib.sha256(new.encode()).hexdigest(), told(own), told(changed), likeness(own, changed), likeness(own, others)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, part, last = Fingerprinter(held.value), TaskContext.get().partitionId(), None
        for batch in slices(batches):
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            out = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                own = prints.of(text)
                out.append((key, len(text), None, None, None, None, None, part, "first", text) if last is None else (*row(prints, key, text, own, *last), None, None, None))
                last = (text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], [*columns, "part", "edge", "text"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None,) * 7 + (part, "last", last[0]), types)], [*columns, "part", "edge", "text"])

    found = materialize(in_order(docs).mapInArrow(work, f"{schema}, part int, edge string, text string"), "imatch", drop=True)
    edges = found.where("edge IS NOT NULL").select("doc_id", "part", "edge", "text")
    parts = [r["part"] for r in edges.where("edge = 'last'").select("part").orderBy("part").collect()]  # one number a partition
    before = dict(zip(parts, [parts[-1], *parts[:-1]])) if parts else {}
    lasts = edges.where("edge = 'last'").select(F.col("part").alias("source"), F.col("text").alias("other"))
    of = spark.createDataFrame([(int(a), int(b)) for a, b in before.items()], "part int, source int")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprinter(held.value)
        for batch in batches:
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            out = [row(prints, k, t, prints.of(t), o, prints.of(o)) for k, t, o in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "other")))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], columns)

    firsts = edges.where("edge = 'first'").join(of, "part").join(lasts, "source").select("doc_id", "text", "other").mapInArrow(finish, schema)
    return found.where("edge IS NULL").select(*columns).union(firsts)


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(documents(spark, sf_dir))
