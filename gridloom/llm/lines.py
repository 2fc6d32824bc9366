"""Line deduplication: lines that many documents share are dropped from all of them.

Every distinct line of a piece of documents is sent, as 12 bytes of its hash, to one of many shards. A shard adds up the
documents of each of its lines and writes a minimal perfect hash of them (bit levels in the manner of Limasset et al., 2017)
that numbers an array of fingerprints and one of counts. The documents then probe these arrays, again in messages by piece
and shard; no table of lines is ever joined. Line hashes are 96 bits of XXH3, so two unlike lines of 10**12 share one with a
probability of about 10**-5.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, mapped, stored
from .words import mix

#: UTF-8 bytes of text whose lines are counted together before anything is sent.
PIECE_BYTES = 4_000_000
#: Line hashes sent to a shard, about; a task holds one shard at a time.
SHARD_KEYS = 1 << 15
#: Tasks of the shard steps at most; each then takes several shards, one after the other.
MAX_TASKS = 20_000

_KEY = np.dtype([("a", "<u8"), ("b", "<u4")])
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_PIECES = "piece binary, n_keys long, texts binary, lengths binary, lines binary, keys binary, docs binary"
_INDEX = "shard long, sizes binary, bits binary, prints binary, counts binary"


class LineIndex:
    """A minimal perfect hash over distinct keys (a, b), with a fingerprint and a count for each key."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        ones = [np.cumsum(_ONES[x], dtype=np.int64) for x in levels]
        starts = np.concatenate(([0], np.cumsum([x[-1] for x in ones]))).astype(np.int64)
        self.before = [starts[k] + np.concatenate(([0], x[:-1])) for k, x in enumerate(ones)]  # ones before each byte, all levels

    @staticmethod
    def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b.astype(np.uint64) + np.uint64((level + 1) << 32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, counts: np.ndarray, cap: int) -> LineIndex:
        """Each level has two bits a key left; a key alone at its bit stays there, the others go on to the next level."""
        levels, left = [], np.arange(len(a))
        while len(left):
            size = (2 * len(left) + 63) // 64 * 64
            slots = cls._slots(a[left], b[left], len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[slots]]
        found = cls(levels, np.zeros(len(a), np.uint16), np.zeros(len(a), np.min_scalar_type(cap)))
        at = found.places(a, b)
        found.prints[at], found.counts[at] = b.astype(np.uint16), np.minimum(counts, cap)
        return found

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each key, from 0 without gaps; -1 for some keys that were not built in."""
        out, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, bits in enumerate(self.levels):
            slots = self._slots(a[left], b[left], level, 8 * len(bits))
            byte, bit = bits[slots >> 3], (slots & 7).astype(np.uint8)
            here = byte >> bit & 1 == 1
            below = byte & ((np.uint8(1) << bit) - np.uint8(1))
            out[left[here]] = (self.before[level][slots >> 3] + _ONES[below])[here]
            left = left[~here]
        return out

    def probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The counts of keys, up to the cap; 0 where the fingerprint is another's."""
        at = self.places(a, b)
        if not len(self.counts):
            return np.zeros(len(a), np.int64)
        known = (at >= 0) & (self.prints[at] == b.astype(np.uint16))
        return np.where(known, self.counts[at].astype(np.int64), 0)

    def row(self) -> dict[str, bytes]:
        sizes = np.array([len(x) for x in self.levels], "<i8")
        return {"sizes": sizes.tobytes(), "bits": b"".join(x.tobytes() for x in self.levels), "prints": self.prints.astype("<u2").tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def of_row(cls, row: dict, cap: int) -> LineIndex:
        ends = np.cumsum(np.frombuffer(row["sizes"], "<i8"))
        bits = np.frombuffer(row["bits"], np.uint8)
        return cls(np.split(bits, ends[:-1]) if len(ends) else [], np.frombuffer(row["prints"], "<u2"), np.frombuffer(row["counts"], np.min_scalar_type(cap)))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(row: dict, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in kinds.items()], list(kinds))


def _sketch(min_chars: int):
    """Batches (digest, text) -> a row for each piece: its distinct texts, their lines as numbers of keys, the keys in order
    with the documents of the piece that hold each."""
    kinds = {"piece": pa.binary(), "n_keys": pa.int64()} | {c: pa.binary() for c in ("texts", "lengths", "lines", "keys", "docs")}

    def work(batches):
        for batch in chunks(batches, "text", PIECE_BYTES):
            copies: dict[bytes, int] = {}
            lengths, hashed, long_enough = [], [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest in copies:
                    copies[digest] += 1
                    continue
                copies[digest] = 1
                keys = [x.strip().lower() for x in text.split(b"\n")]  # of bytes: exactly the six characters, and A-Z
                lengths.append(len(keys))
                hashed += map(xxhash.xxh3_128_digest, keys)
                long_enough += map(bool, keys) if min_chars == 1 else (len(x.decode("utf-8", "replace")) >= min_chars for x in keys)
            whole = np.frombuffer(b"".join(hashed), np.dtype([("a", "<u8"), ("b", "<u4"), ("_", "<u4")]))
            counted = np.flatnonzero(np.array(long_enough, bool))
            a, b = whole["a"][counted], whole["b"][counted]
            order = np.lexsort((b, a))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
            lines = np.full(len(whole), -1, np.int32)
            lines[counted[order]] = np.cumsum(new) - 1
            keys = np.empty(int(new.sum()), _KEY)
            keys["a"], keys["b"] = a[order][new], b[order][new]
            owner = np.repeat(np.arange(len(lengths)), lengths)[counted]
            pairs = np.unique(owner * max(1, len(keys)) + lines[counted])
            weight = np.array(list(copies.values()), np.int64)
            docs = np.bincount(pairs % max(1, len(keys)), weights=weight[pairs // max(1, len(keys))], minlength=len(keys)).astype("<i4")
            yield _batch({
                "piece": uuid.uuid4().bytes, "n_keys": len(keys), "texts": b"".join(copies), "lengths": np.array(lengths, "<i4").tobytes(),
                "lines": lines.astype("<i4").tobytes(), "keys": keys.tobytes(), "docs": docs.tobytes(),
            }, kinds)

    return work


def _messages(shards: int):
    """Rows of pieces -> a row for each shard that a piece has keys of; the keys of a piece are in the order of the shards."""

    def work(batches):
        for row in _rows(batches):
            keys, docs = np.frombuffer(row["keys"], _KEY), np.frombuffer(row["docs"], "<i4")
            if not len(keys):
                continue
            shard = ((keys["a"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
            found, start = np.unique(shard, return_index=True)
            ends = np.append(start[1:], len(keys))
            yield pa.RecordBatch.from_arrays([
                pa.array(found), pa.array([row["piece"]] * len(found), pa.binary()), pa.array(start.astype(np.int32)),
                pa.array([keys[i:j].tobytes() for i, j in zip(start, ends, strict=True)], pa.binary()), pa.array([docs[i:j].tobytes() for i, j in zip(start, ends, strict=True)], pa.binary()),
            ], ["shard", "piece", "start", "keys", "docs"])

    return work


def _build(cap: int):
    """Messages in the order of their shards -> an index for each shard."""
    kinds = {"shard": pa.int64()} | {c: pa.binary() for c in ("sizes", "bits", "prints", "counts")}

    def index(shard, parts):
        keys = np.frombuffer(b"".join(k for k, _ in parts), _KEY)
        docs = np.frombuffer(b"".join(d for _, d in parts), "<i4").astype(np.int64)
        order = np.lexsort((keys["b"], keys["a"]))
        a, b = keys["a"][order], keys["b"][order]
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(a) != 0) | (np.diff(b) != 0)
        first = np.flatnonzero(new)
        return _batch({"shard": shard} | LineIndex.build(a[first], b[first], np.add.reduceat(docs[order], first), cap).row(), kinds)

    def work(batches):
        shard, parts = None, []
        for row in _rows(batches):
            if parts and row["shard"] != shard:
                yield index(shard, parts)
                parts = []
            shard = row["shard"]
            parts.append((row["keys"], row["docs"]))
        if parts:
            yield index(shard, parts)

    return work


def _probe(least: int):
    """The index of each shard, then the messages to it -> the places, in their pieces, of keys in enough documents."""

    def work(batches):
        index = None
        for row in _rows(batches):
            if row["piece"] is None:
                index = LineIndex.of_row(row, least)
                continue
            keys = np.frombuffer(row["keys"], _KEY)
            found = np.flatnonzero(index.probe(keys["a"], keys["b"]) >= least)
            if len(found):
                yield _batch({"piece": row["piece"], "at": (found + row["start"]).astype("<i4").tobytes()}, {"piece": pa.binary(), "at": pa.binary()})

    return work


def _marked(batches):
    """Rows of pieces with the places of their common keys -> for each text that loses lines, which lines it keeps."""
    for row in _rows(batches):
        common = np.zeros(row["n_keys"] + 1, bool)  # the last place is that of lines without a key
        common[np.frombuffer(b"".join(row["at"]), "<i4")] = True
        kept = ~common[np.frombuffer(row["lines"], "<i4")]
        ends = np.cumsum(np.frombuffer(row["lengths"], "<i4"))
        for k, keep in enumerate(np.split(kept, ends[:-1])):
            if not keep.all():
                flags = pa.ListArray.from_arrays(pa.array([0, len(keep)], pa.int32()), pa.array(keep))
                yield pa.RecordBatch.from_arrays([pa.array([row["texts"][16 * k : 16 * k + 16]], pa.binary()), flags], ["digest", "keep"])


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def line_index(docs: DataFrame, text_col: str = "text", min_documents: int = 10, min_chars: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, messages, index): the pieces of the texts, their keys by shard, and the arrays of each shard."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sent = docs.select(_digest(text).alias("digest"), text.cast("binary").alias("text"))
    pieces = stored(mapped(sent, _sketch(min_chars), _PIECES), "line-pieces")
    n_keys = pieces.agg(F.sum("n_keys")).first()[0] or 0
    shards = max(1, -(-n_keys // SHARD_KEYS))
    messages = mapped(pieces.select("piece", "keys", "docs"), _messages(shards), "shard long, piece binary, start int, keys binary, docs binary")
    dealt = messages.select("shard", "keys", "docs").repartition(min(shards, MAX_TASKS), "shard").sortWithinPartitions("shard")
    index = stored(mapped(dealt, _build(min_documents), _INDEX), "line-index")
    return pieces, messages, index


def dedup_lines(docs: DataFrame, text_col: str = "text", min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with ``text_col`` cut to the lines that stay, and the columns ``n_lines`` (before) and ``n_dropped``.

    A line is what stands between newlines; its key is the line without space and tab to carriage return at both ends, with A-Z
    lower-cased. Keys of min_chars code points or more that stand in min_documents rows or more lose all their lines. A row is
    a document: equal texts and repeated ids count as often as they stand there. A null text is one empty line and becomes an
    empty text; an empty table gives an empty one. Very long texts are a piece of their own. Columns of docs named n_lines or
    n_dropped are replaced, all others are carried along untouched. Min_documents below 1 counts as 1.

    Equal texts have equal lines, so what a text keeps is joined to the rows by its digest (MD5); copies of one text, however
    many, are rows of a plain join, which Spark can split.
    """
    least = max(1, min_documents)
    pieces, messages, index = line_index(docs, text_col, least, max(1, min_chars))
    both = index.select(F.lit(None).cast("binary").alias("piece"), "*").unionByName(messages.select("shard", "piece", "start", "keys"), allowMissingColumns=True)
    shards = max(1, index.count())
    asked = both.repartition(min(shards, MAX_TASKS), "shard").sortWithinPartitions("shard", F.col("piece").isNotNull())
    answers = stored(mapped(asked, _probe(least), "piece binary, at binary"), "line-answers")
    met = pieces.join(answers.groupBy("piece").agg(F.collect_list("at").alias("at")), "piece")
    marks = mapped(met.select("n_keys", "texts", "lengths", "lines", "at"), _marked, "digest binary, keep array<boolean>")
    marks = stored(marks.groupBy("digest").agg(F.first("keep").alias("keep")), "line-marks")
    text = F.coalesce(F.col("_text"), F.lit(""))
    carried = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    short = docs.select(*(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(carried)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    joined = short.withColumn("_digest", _digest(text)).join(marks.select(F.col("digest").alias("_digest"), F.col("keep").alias("_keep")), "_digest", "left")
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col("_keep").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda _, k: F.col("_keep")[k]), "\n"))
    n_dropped = F.coalesce(F.size(F.filter("_keep", lambda x: ~x)), F.lit(0)).cast("long")
    back = {c: F.col(f"x{i}") for i, c in enumerate(carried)} | {text_col: kept}
    return joined.select(*(back[c].alias(c) for c in docs.columns if c in back), F.size(lines).cast("long").alias("n_lines"), n_dropped.alias("n_dropped"))


def without_common_lines(docs: DataFrame, text_col: str = "text", min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """The columns of docs, the text without its common lines; a null text stays null. See ``dedup_lines``."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{text_col}`").isNull().alias("was_null"))
    found = dedup_lines(named, names[text_col], min_documents, min_chars)
    return found.select(*(F.when(~F.col("was_null"), F.col(n)).alias(c) if c == text_col else F.col(n).alias(c) for c, n in names.items()))
