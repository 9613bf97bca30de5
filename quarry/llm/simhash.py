"""SimHash near-duplicates by segment popcounts.

A fingerprint is embedded as the bit counts of its 16 segments of 4 bits. Counts of two fingerprints differ, summed
over segments, by no more than the fingerprints do in bits; so links at 2 bits lie within Manhattan distance 2 on the
grid of counts. They also agree in one of three blocks of segments, and differ outside it alone. So for each block a
distinct fingerprint goes to its own cell on the grid of the other segments' counts, and to those one step away, each
together with the block's bits: two of distance at most 2 always share one of these, and a cell that many fingerprints
have is dealt out by the bits. Fingerprints that meet are compared exactly inside the join, so only true links come out. Copies are folded into their fingerprint before, and links become components over fingerprints.

Null texts are empty. A text without words has fingerprint zero, which links like any other; fewer than 3 words make
one shingle. Repeated rows share a component. Extra columns are not read. An empty table gives no rows. A null doc_id
is never a component's id while the component has another.

The pipeline's stage does not link by bits: texts whose sets of 5-word shingles have a Jaccard of 0.8 or more mostly
differ in more than 2. near_copies() links exactly these. It takes the fingerprints of these sets through the same grid
and compares the sets that it joins first. Pairs that differ in more bits have an exact way of their own: in any order of all shingles two such sets share one of their
first n - ceil(0.8 n) + 1, so each set is sent once for each of these. Those that meet are linked over a few of them
first, and only what is then still apart is compared in full (copy_roots); sketches of parities, whose popcount of
differences is a lower bound as the segments' is, rule most pairs out in and after the join, and the rest is checked on
the whole sets. Shingles that are frequent in a sample of texts come last in the order; this saves pairs, and changes
none of the links. Equal sets are folded before. Texts without words have equal, empty sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.common import documents, materialize, release, settle, slices
from quarry.llm.graph import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
_SEGMENTS, _WIDTH = 16, 4
#: Segments from and to of three blocks, one of which two bits leave alone.
_BLOCKS = ((0, 5), (5, 10), (10, 16))
_BLOCK = 1 << 16
#: The stage's shingles, and its least Jaccard as a fraction.
STAGE_SHINGLE, ALIKE, OF = 5, 4, 5
#: Texts read for frequent shingles; from how many of them a shingle is frequent; most that are broadcast.
_SAMPLE, _FREQUENT, _MOST = 10_000, 3, 250_000
#: Rows of five numbers that are broadcast at most.
_ASKED = 200_000
#: Sets that those at a shingle are compared with in a round, and rounds before all that is left is compared.
HUBS, ROUNDS = 3, 2
#: Shingles of its own that a set brings along, the smallest, so that a pair is compared at the first of these that it shares.
_OWN = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """8 bytes, the highest bit first."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return bytes(8)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest, seed = xxhash.xxh64_digest, SEED
    return majority(np.frombuffer(b"".join([digest(g, seed) for g in grams]), np.uint8).reshape(-1, 8))


def majority(held: np.ndarray) -> bytes:
    """The bits that over half the hashes have set; held: a row of 8 bytes a hash."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(held), _BLOCK):
        counts += np.unpackbits(held[at : at + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(held)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h (hash of the whole text), fp long of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = b"".join(fingerprint(t, shingle) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.frombuffer(fp, ">i8").astype(np.int64))], ["doc_id", "h", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(work, f"doc_id {kind}, h long, fp long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a < b: distinct fingerprints (column fp) that differ in at most max_bits <= 2 bits. A pair may come out more than once."""
    if max_bits > 2:
        raise ValueError("cells one step apart meet only up to 2 bits")
    cells, keys = [], []
    for k, (first, last) in enumerate(_BLOCKS):
        block = F.shiftrightunsigned("fp", _WIDTH * first).bitwiseAND((1 << _WIDTH * (last - first)) - 1)
        outside = [j for j in range(_SEGMENTS) if not first <= j < last]
        cell = F.lit(k).cast("long")
        for j in outside:  # a count, from 1 so that a step down stays positive, in 3 bits
            cell = F.shiftleft(cell, 3) + (F.bit_count(F.shiftrightunsigned("fp", _WIDTH * j).bitwiseAND((1 << _WIDTH) - 1)) + 1).cast("long")
        cells.append((F.shiftleft(cell, _WIDTH * (last - first)) + block).alias(f"c{k}"))
        cell = F.col(f"c{k}")
        steps = [1 << (3 * j + _WIDTH * (last - first)) for j in range(len(outside))]
        keys += [cell, *[cell + x for x in steps], *[cell - x for x in steps]]
    cells = distinct.select("fp", *cells).select("fp", F.explode(F.array(*keys)).alias("c"))
    # cells are 67 times as many rows as the planner reckons with: by its estimate it would broadcast them
    a, b = cells.hint("merge").alias("a"), cells.hint("merge").alias("b")
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    return a.join(b, (F.col("a.c") == F.col("b.c")) & (F.col("a.fp") < F.col("b.fp")) & close).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, h, fp, component_id (smallest doc_id reachable over links) of each row."""
    rows = materialize(fingerprints(docs, shingle), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(materialize(links(distinct, max_bits), "links"))
    rooted = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def shingles(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; fewer words than a shingle make one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64)).view(np.int64)


def frequent_shingles(docs: DataFrame) -> list[int]:
    """Shingles that a sample of texts has often, the most frequent first: at most _MOST."""
    share = max(1, docs.count() // _SAMPLE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["g"])

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    often = some.mapInArrow(work, "g long").groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= _FREQUENT)
    return [r["g"] for r in often.orderBy(F.col("n").desc(), "g").limit(_MOST).collect()]


def sketch(g: np.ndarray) -> list[int]:
    """Parities of the shingles in each of 512 classes, as 8 longs: two sets differ in at least as many shingles as their sketches in bits."""
    return np.packbits((np.bincount(g & 511, minlength=512) & 1).astype(np.uint8)).view(np.int64).tolist()


def wide_sketch(g: np.ndarray) -> bytes:
    """As sketch(), in twice as many classes as there are shingles at least."""
    m = max(1024, 1 << (2 * len(g)).bit_length())
    return np.packbits((np.bincount(g & (m - 1), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits in which two wide sketches differ; the wider one is folded, as if it had been made in fewer classes."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _may_be_alike(a: str, b: str) -> Column:
    """Whether sizes and sketches (columns n, bits of a and b) leave room for a Jaccard of ALIKE / OF: sets that reach it differ in (OF - ALIKE) / (OF + ALIKE) of both sizes at most."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.bits")[k].bitwiseXOR(F.col(f"{b}.bits")[k])) for k in range(8)), F.lit(0))
    return (F.least(n, m) * OF >= F.greatest(n, m) * ALIKE) & (differ * (OF + ALIKE) <= (n + m) * (OF - ALIKE))


def _verified(met: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs met (a, b: fp), those whose whole sets are alike. Wide sketches come together first; then, of the pairs that they leave, the two texts, one row of docs for each."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            may = [sketch_distance(x, y) * (OF + ALIKE) <= (n + m) * (OF - ALIKE) for n, m, x, y in zip(*columns)]
            yield batch.filter(pa.array(may, pa.bool_())).select(["a", "b"])

    left, right = (sets.select(F.col("fp").alias(c), F.col("n").alias(n), F.col("wide").alias(w)) for c, n, w in (("a", "n", "x"), ("b", "m", "y")))
    met = materialize(met.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(close, "a long, b long"), "close")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=64)(shingles)  # what many are compared with
        for batch in batches:
            alike = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ("x", "y"))):
                x, y = known(x), known(y)
                alike.append(len(np.intersect1d(x, y, assume_unique=True)) * (ALIKE + OF) >= (len(x) + len(y)) * ALIKE)
            yield batch.filter(pa.array(alike, pa.bool_())).select(["a", "b"])

    own = sets.select("fp", "h", "least")
    sides = [met.select("a", "b", F.lit(k).alias("side"), F.col(c).alias("fp")).join(own, "fp").select("a", "b", "side", "h", "least") for k, c in enumerate("ab")]
    asked = materialize(sides[0].union(sides[1]), "asked")
    asked = F.broadcast(asked) if asked.count() <= _ASKED else asked  # few: the texts need not move
    texts = docs.select(F.xxhash64("text").alias("h"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(asked, "h").where(F.col("doc_id").eqNullSafe(F.col("least")))
    both = texts.groupBy("a", "b").agg(*[F.max(F.when(F.col("side") == k, F.col("text"))).alias(c) for k, c in enumerate("xy")])
    return both.mapInArrow(work, "a long, b long")


def print_pairs(sets: DataFrame) -> DataFrame:
    """a < b: sets (fp) to compare, by their fingerprints (print): each with the first that has the same one, and the first sets of fingerprints that links() finds, each with the least it is linked to."""
    first = materialize(sets.groupBy("print").agg(F.min("fp").alias("head")), "prints")
    same = sets.join(first, "print").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    near = materialize(links(first.select(F.col("print").alias("fp"))), "print-links").groupBy("b").agg(F.min("a").alias("a"))
    head = lambda c: first.select(F.col("print").alias(c), F.col("head").alias(f"{c}_head"))
    near = near.join(head("a"), "a").join(head("b"), "b").select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return same.union(near)


def copy_roots(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """v, root of the components of sets that are alike. sets: fp, n, first (shingles that alike sets have one of in common), bits, wide, print, and h and doc_id (least) of a text.

    Sets whose fingerprints the grid joins are compared first, and linked if alike. The exact way for what is still apart: sets meet at a shared shingle (one for all shingles that the same sets share), but not all pairs of them: in each round the sets at a shingle are compared with HUBS
    drawn from them, unless they are in one component already. What is left, pairs in different components of which one
    is outside the shingle's largest, is then compared in full. So a group of copies costs a few comparisons a member,
    and no link that would join two components is lost.
    """
    sent = sets.select(F.explode("first").alias("g"), "fp")
    often = sent.groupBy("g").agg(F.count("*").alias("_c")).where("_c > 1").select("g")
    met_at = materialize(sent.join(often, "g"), "met-at")
    same = met_at.groupBy("g").agg(F.count("*").alias("_c"), F.bit_xor(F.xxhash64("fp")).alias("_x")).groupBy("_c", "_x").agg(F.min("g").alias("g")).select("g")
    release(docs.sparkSession)
    groups = materialize(met_at.join(same, "g").join(sets.select("fp", "n", "bits"), "fp").select("g", "fp", "n", "bits"), "groups")
    found, roots = None, None

    def labelled() -> DataFrame:
        if roots is None:
            return groups.withColumn("label", F.col("fp"))
        return groups.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select(*groups.columns, F.coalesce("root", "fp").alias("label"))

    def compared(pairs: DataFrame) -> None:
        nonlocal found, roots
        alike = settle(lambda: _verified(materialize(pairs, "met"), sets, docs), "links")
        found = alike if found is None else found.union(alike)
        roots = components(found)

    def joined(met: DataFrame) -> None:
        compared(met.select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct())

    compared(settle(lambda: print_pairs(sets), "print-pairs"))

    for turn in range(ROUNDS):
        now = materialize(labelled(), "labelled")
        drawn = [F.min_by(F.struct("fp", "n", "bits", "label"), F.xxhash64("fp", F.lit(turn * HUBS + k))) for k in range(HUBS)]
        hubs = now.groupBy("g").agg(F.array(*drawn).alias("hubs"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("g", "hubs")
        a = now.join(hubs, "g").select(F.struct("fp", "n", "bits", "label").alias("a"), F.explode("hubs").alias("b"))
        joined(a.where((F.col("a.label") != F.col("b.label")) & _may_be_alike("a", "b")))
    now = materialize(labelled(), "labelled")
    largest = now.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("c")).where("c > 1").select("g", "main")
    met_apart = materialize(now.join(largest, "g"), "met-apart")
    own = met_apart.groupBy("fp").agg(F.slice(F.sort_array(F.collect_set("g")), 1, _OWN).alias("gs"))
    apart = materialize(met_apart.join(own, "fp"), "apart")
    a, b = apart.alias("a"), apart.where("label <> main").alias("b")
    # a pair that is known to meet at a smaller shingle is compared there
    once = F.coalesce(F.array_min(F.array_intersect("a.gs", "b.gs")) >= F.col("a.g"), F.lit(True))
    joined(a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.label") != F.col("b.label")) & _may_be_alike("a", "b") & once))
    return roots


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, h, fp (hash of the set of shingles), component_id (smallest doc_id reachable over sets of Jaccard ALIKE / OF or more) of each row."""
    last = docs.sparkSession.sparkContext.broadcast(np.array(frequent_shingles(docs), np.int64))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(last.value, kind="stable")
        known = last.value[by]
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                g = shingles(text)
                n = len(g)
                place = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    place = np.where(known[at] == g, len(known) - by[at], 0)
                first = g[np.lexsort((g, place))[: n + (-n * ALIKE) // OF + 1]]
                own = int.from_bytes(majority(g.view(np.uint8).reshape(-1, 8)), "big", signed=True)
                out.append((xxhash.xxh64_intdigest(g.tobytes()) - (1 << 63), n, first, sketch(g), wide_sketch(g), own))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns], ["doc_id", "h", "fp", "n", "first", "bits", "wide", "print"])

    rows = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(work, f"doc_id {kind}, h long, fp long, n int, first array<long>, bits array<long>, wide binary, print long"), "shingles")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))  # stands for all rows with the set
    folded = rows.groupBy("fp").agg(first_row.alias("row"), *[F.first(c).alias(c) for c in ("n", "first", "bits", "wide", "print")])
    sets = materialize(folded.select("fp", F.col("row.doc_id").alias("least"), F.col("row.h").alias("h"), "n", "first", "bits", "wide", "print"), "distinct")
    roots = copy_roots(sets, docs)
    rooted = sets.select("fp", "least").join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "h", "fp").join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (of repeated rows, one)."""
    found = near_copies(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))
    roots = materialize(found.select("doc_id", "h", "fp", F.coalesce("component_id", F.col("fp")).alias("component")), "components")
    kept = roots.groupBy("component").agg(F.min(first).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.h").alias("_h")).distinct()
    times = roots.groupBy("doc_id", "h").agg(F.count("*").alias("_n"))
    kept = kept.join(times, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))).select("_id", "_h", "_n")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_h"))
    chosen = whole.join(kept, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_h") == F.col("_h")))
    once = chosen.where("_n = 1").select("document.*")
    return once.union(chosen.where("_n > 1").dropDuplicates(["_id", "_h"]).select("document.*")) if not kept.where("_n > 1").isEmpty() else once
