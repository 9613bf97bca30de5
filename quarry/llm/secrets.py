"""Secret scans: three patterns, and dictionary-primed zstandard novelty.

The patterns (assignments to a sensitive name, access key ids, long lower-case hexadecimal runs) give base spans. The
method adds strings that stand in a sensitive context, are not covered by a base span, and do not compress: a zstandard
compressor primed with an identifier dictionary compresses the text around the candidate with and without it; the
difference, the marginal bytes, is compared with the candidate's length. Words, names and what is like its surroundings
cost a few bytes; random keys cost nearly all of theirs. Other occurrences of the candidate itself are masked before.
The dictionary is learnt: the names and words in most documents of the whole corpus (IDENTIFIERS of them, letters and
underscores alone, so no key is among them), after a few fixed ones.

A context reaches a little before and after a sensitive word (camelCase too), and goes on from one secret to a string
that follows it directly. What stands between the BEGIN and END lines of a private key is a secret as a whole. Of a string that a base span
covers in part, the rest is measured.

Spans are in code points, end exclusive. Null and empty texts have none. Texts are read whole, and candidates run to
their own ends, whatever the length. Spans that start together are in the order of kinds. Repeated rows are scanned one
by one; extra columns are not read by find(), and pass through redact(). An empty table gives no rows, and a dictionary
of the fixed words alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import documents, slices

KINDS = ("assign", "access", "hex", "novel")
#: Marginal bytes a character from which a candidate counts as incompressible; characters of context on either side.
NOVELTY, CONTEXT = 0.85, 160

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_AS_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HEX_RUN = b"h" * 32
_NAMES = ("passw", "secret", "token", "api")
#: Where a word ends within letters: dbPassword, APIKey.
_CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
_SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|" + _CAMEL + r")(?i:passwords?|passwd|pwd|secrets?|tokens?|credentials?|bearer|authorization|private|api_?keys?|access_?keys?|client_?secret|keys?)(?:(?![A-Za-z])|" + _CAMEL + ")", re.ASCII
)
_CUES = ("passw", "pwd", "secret", "token", "credential", "bearer", "authorization", "private", "key")
_LEAST = 16
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % _LEAST)
#: How far after and before a sensitive word a candidate may begin and end.
_REACH, _BACK = 48, 24
#: What may stand between two strings that follow each other; the lines around a private key.
_GAP = re.compile(r"[\s\"'+,;\\>|#*]{0,16}")
_BEGIN, _FENCE = re.compile(r"-{4,5} ?BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-{4,5}"), re.compile(r"-{4,5} ?(BEGIN|END) ")

#: Names that are learnt from the corpus, and their length.
IDENTIFIERS, _NAME = 4096, (4, 24)
#: Identifiers and words of code and prose that are no secrets, which begin zstandard's raw-content dictionary.
FIXED = (
    " the and of to in is that for with from this return import def class self public private static void string int boolean float double null true false"
    " username user_name password passwd secret token api_key apikey access_key client_id client_secret authorization bearer private_key public_key config"
    " settings environment variable example placeholder changeme your_password your-api-key YOUR_API_KEY xxxxxxxxxxxxxxxx 0123456789 1234567890 abcdefghijklmnopqrstuvwxyz"
    " ABCDEFGHIJKLMNOPQRSTUVWXYZ https://www. http://localhost:8080/ .com .org .example.com /usr/local/bin/ application/json content-type utf-8 getElementById"
    " 2010-01-01 2015-12-31 2018-06-30 2019-10-05 2020-02-28 2021-03-15 2022-04-10 2023-07-20 2024-08-25 2025-09-11 2026-11-30 T00:00:00Z 12:30:45"
    " toString valueOf hashCode equals length index value name type data key list map set get put post delete update insert select where order group by limit"
).encode()


def learn_identifiers(docs: DataFrame, most: int = IDENTIFIERS) -> bytes:
    """The dictionary: fixed words, then the names in most documents, the most frequent last, where matches are cheapest. At most `most` names go to the driver."""
    names = F.filter(F.array_distinct(F.split("text", "[^A-Za-z_]+")), lambda w: F.length(w).between(*_NAME))
    counted = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return FIXED + b" " + " ".join(r["name"] for r in reversed(counted.orderBy(F.desc("n"), "name").limit(most).collect())).encode()

_AHEAD = FIXED[:96]


class Novelty:
    """Marginal compressed bytes of a string in its context.

    The fast strategy with a target length leaves literals as they are, so what no match covers costs a byte a
    character, however random the surroundings; matches of 4 characters on count.
    """

    def __init__(self, identifiers: bytes = FIXED):
        how = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=17, search_log=1, min_match=4, target_length=1, strategy=zstandard.STRATEGY_FAST, write_content_size=False, write_checksum=False
        )
        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(compression_params=how)
        self._c = zstandard.ZstdCompressor(dict_data=primed, compression_params=how)

    def marginal(self, before: str, candidate: str, after: str) -> int:
        # what the dictionary has goes ahead, so that either text compresses, and neither is stored as it is
        size = lambda s: len(self._c.compress(_AHEAD + s.encode()))
        return size(before + after + candidate) - size(before + after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    found = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in text.encode().translate(_AS_HEX):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """(start, kind, end) of incompressible strings within reach of a sensitive word, apart from base spans."""
    low = text.lower()
    if not any(x in low for x in _CUES):
        return []
    found = key_blocks(text, base)
    covered, done = _Covered(base + found), 0

    def measured(start: int, end: int, word: str) -> tuple[list[tuple[int, int, int]], bool]:
        """Spans of a candidate, and whether none of it was covered before."""
        parts = covered.outside(start, end)
        return [(s, 3, e) for s, e in parts if _mixed(word) and (s > start or e - s >= _LEAST and _mixed(text[s:e])) and _novel(text, s, e, novelty)], parts == [(start, end)]

    for cue in _SENSITIVE.finditer(text):
        at = max(done, cue.start() - _BACK)
        while at > done and text[at - 1] in _LETTERS:  # to the start of what ends within reach
            at -= 1
        for m in _CANDIDATE.finditer(text, at, cue.start()):
            if m.end() == cue.start() or m.start() < done:  # what goes on into the word, or was looked at
                continue
            found += measured(*m.span(), m[0])[0]
            done = m.end()
        at, limit = max(done, cue.end()), cue.end() + _REACH
        while m := _CANDIDATE.search(text, at, max(at, limit + _LEAST)):
            m = _CANDIDATE.match(text, m.start())  # to its own end
            at = done = m.end()
            new, whole = measured(*m.span(), m[0])
            found += new
            if new or not whole:
                limit = max(limit, _GAP.match(text, at).end())
    return found


class _Covered:
    """Spans (start, kind, end) that may overlap."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self._spans = sorted(spans)
        self._starts, self._reach = [s for s, _, _ in self._spans], list(accumulate((e for _, _, e in self._spans), max))

    def outside(self, start: int, end: int) -> list[tuple[int, int]]:
        """Parts of start to end that no span has."""
        out = []
        for s, _, e in self._spans[bisect_right(self._reach, start) : bisect_left(self._starts, end)]:
            if e > start:
                if s > start:
                    out.append((start, s))
                start = e
        return out + [(start, end)] if start < end else out


def _mixed(word: str) -> bool:
    return any(c.isdigit() for c in word) and any(c.isalpha() for c in word)


def _masked(text: str, start: int, end: int, word: str) -> str:
    """text from start to end, with spaces for word, also where only a part of it lies inside."""
    first = max(0, start - len(word) + 1)
    return text[first : end + len(word) - 1].replace(word, " " * len(word))[start - first : end - first]


def _novel(text: str, start: int, end: int, novelty: Novelty) -> bool:
    """Whether the string costs NOVELTY bytes a character in its context without its own copies (of a name=value, the value's)."""
    word = text[start:end]
    value = word.rstrip("=").rsplit("=", 1)[-1]
    own = value if len(value) >= _LEAST else word
    around = text[max(0, start - CONTEXT - len(own)) : start], text[end : end + CONTEXT + len(own)]
    before, after = _masked(around[0], max(0, len(around[0]) - CONTEXT), len(around[0]), own), _masked(around[1], 0, CONTEXT, own)
    return novelty.marginal(before, word, after) >= NOVELTY * len(word)


def key_blocks(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the lines between BEGIN and END of private keys, apart from base spans."""
    out, covered = [], _Covered(base)
    for begin in _BEGIN.finditer(text):
        end = _FENCE.search(text, begin.end())
        if not end or end[1] != "END":
            continue
        body = text[begin.end() : end.start()]
        if any(_mixed(m[0]) for m in _CANDIDATE.finditer(body)):
            start = begin.end() + len(body) - len(body.lstrip())
            out += [(s, 3, e) for s, e in covered.outside(start, begin.end() + len(body.rstrip())) if text[s:e].strip()]
    return out


def _spans(batches: Iterator[pa.RecordBatch], identifiers: bytes) -> Iterator[tuple[pa.RecordBatch, list[str], list[list], list[list]]]:
    novelty = Novelty(identifiers)
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base = [base_spans(t) for t in texts]
        yield batch, texts, base, [b + novel_spans(t, b, novelty) for t, b in zip(texts, base)]


def find(docs: DataFrame, identifiers: bytes | None = None) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> ordered by start, then kind; base array likewise, the patterns' spans alone. identifiers: a dictionary to use instead of that of docs."""
    known = learn_identifiers(docs) if identifiers is None else identifiers

    def work(batches):
        told = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch, _, base, every in _spans(batches, known):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(told, base), kind), pa.array(map(told, every), kind)], ["doc_id", "base", "spans"])

    one = "array<struct<kind:string,start:int,end:int>>"
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {one}, spans {one}")


def redact(docs: DataFrame, by: str = "[secret]", identifiers: bytes | None = None) -> DataFrame:
    """docs with every span of text replaced, and n_chars counted anew where there is such a column. Null texts stay null."""
    at = docs.columns.index("text")
    known = learn_identifiers(docs) if identifiers is None else identifiers

    def work(batches):
        for batch, texts, _, every in _spans(batches, known):
            out = []
            for text, spans in zip(texts, every):
                parts, done = [], 0
                for s, _, e in sorted(spans):
                    if s >= done:
                        parts += [text[done:s], by]
                    done = max(done, e)
                out.append("".join([*parts, text[done:]]))
            held = batch.column("text")
            new = pa.array([None if n else t for t, n in zip(out, held.is_null().to_pylist())], held.type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the texts."""
    return redact(docs)
