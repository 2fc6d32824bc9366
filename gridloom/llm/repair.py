"""Token ids in binary files, compressed by Re-Pair grammars (Larsson and Moffat, 2000), with random access.

A file set is a Parquet table with one row per shard, a run of documents of bounded size with a grammar of its own;
documents stand in ascending order of their id over all shards. A shard holds

    first_rule one more than the largest id of the vocabulary
    rules      pairs of symbols as little-endian unsigned 32-bit integers; rule k is symbol first_rule + k
    expansion  how many ids each rule stands for, likewise
    symbols    the shard's documents in these symbols, likewise
    cuts       where each document's symbols begin, and the end
    ids_before ids of all documents of the partition before the shard

A symbol never spans two documents, so one document is decoded from its own symbols and the rules alone; expansion
lengths give the place of any id without decoding what stands before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import loaded, spread
from .packing import encoded
from .shared import mapped, new_folder, packed, shards

#: A rule takes three integers (its pair and its expansion) and saves one at each place; so it pays from this count up.
LEAST = 4
#: A shard's texts in bytes, about.
SHARD_BYTES = 4_000_000


def _uncounted(live: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Indices of the places (in order) that do not count: in a run of one symbol, where pairs overlap, every other one."""
    twin = np.flatnonzero(left == right)
    follows = np.zeros(len(twin), bool)
    follows[1:] = after[twin[:-1]] == live[twin[1:]]
    start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(twin))))
    return twin[(np.arange(len(twin)) - start) % 2 == 1]


def _by_pair(left: np.ndarray, right: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices in the order of their pairs, pairs as left << 32 | right in that order)."""
    n_bits, s_bits = len(left).bit_length(), symbols.bit_length()
    if n_bits + 2 * s_bits > 63:
        pair = left << 32 | right
        order = np.argsort(pair, kind="stable")
        return order, pair[order]
    whole = np.sort((left << s_bits | right) << n_bits | np.arange(len(left)))  # sorted values are cheaper than an order
    order = whole & ((1 << n_bits) - 1)
    whole >>= n_bits
    return order, whole >> s_bits << 32 | whole & ((1 << s_bits) - 1)


def compress(ids: np.ndarray, cuts: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, cuts, rules (n, 2), expansion): frequent pairs become rules until none stands LEAST times.

    In a round every pair is replaced where it is more frequent than the pairs that overlap it (equal counts: the
    larger pair of symbols), if that is LEAST times. The most frequent pair of all is so replaced everywhere, and a round
    does at once what the pairs one by one would do in places apart. A pair that is too rare can only become rarer,
    so its places are not looked at again. ``cuts`` are the bounds of the documents in ids, and in symbols.
    """
    n, symbols, cuts = len(ids), ids.astype(np.int32), cuts.astype(np.int64)
    # Symbols keep their places and are linked to those beside them in their document; -1 is none, and marks what is gone.
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    some = cuts[1:] > cuts[:-1]
    after[cuts[1:][some] - 1] = before[cuts[:-1][some]] = -1
    rules, size, count = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], first_rule
    lengths = np.ones(first_rule, np.int64)
    weight, touched = np.zeros(n + 1, np.int32), np.zeros(n, bool)
    live = np.flatnonzero(after >= 0)
    while len(live):
        right_at = after[live]
        left, right = symbols[live].astype(np.int64), symbols[right_at].astype(np.int64)
        out = _uncounted(live, right_at, left, right)
        order, pair = _by_pair(left, right, count)
        first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        places = np.diff(np.append(first, len(pair)))
        often = places
        if len(out):
            counts = np.ones(len(live), bool)
            counts[out] = False
            often = np.add.reduceat(counts[order], first, dtype=np.int64)
        group = np.flatnonzero(often >= LEAST)
        if not len(group):
            break
        # 1, 2, .. from the rarest frequent pair on, at every place that counts; 0 elsewhere.
        by_rank = group[np.argsort(often[group], kind="stable")]
        rank = np.zeros(len(first), np.int32)
        rank[by_rank] = np.arange(1, len(group) + 1)
        own = np.empty(len(live), np.int32)
        own[order] = np.repeat(rank, places)
        own[out] = 0
        weight[live] = own
        best = np.flatnonzero((own > weight[before[live]]) & (own > weight[right_at]))  # weight[-1] is 0
        weight[live] = 0
        pays = np.bincount(own[best], minlength=len(group) + 1) >= LEAST
        best = best[pays[own[best]]]
        at, gone = live[best], right_at[best]
        chosen = np.flatnonzero(pays)
        pairs = pair[first[by_rank[chosen - 1]]]
        fresh = np.stack((pairs >> 32, pairs & 0xFFFFFFFF), axis=1)
        rules.append(fresh)
        size.append(lengths[fresh[:, 0]] + lengths[fresh[:, 1]])
        lengths = np.concatenate((lengths, size[-1]))
        symbols[at] = (count + np.cumsum(pays) - 1)[own[best]]
        symbols[gone] = -1
        count += len(fresh)
        next_at = after[gone]
        after[at] = next_at
        before[next_at[next_at >= 0]] = at[next_at >= 0]
        beside = before[at]
        touched[live[own > 0]] = touched[live[out]] = touched[at] = touched[beside[beside >= 0]] = True
        live = np.flatnonzero(touched)
        touched[live] = False
        live = live[(symbols[live] >= 0) & (after[live] >= 0)]
    stays = symbols >= 0
    return symbols[stays].astype(np.int64), np.concatenate(([0], np.cumsum(stays)))[cuts], np.concatenate(rules), np.concatenate(size)


#: Ids of all rules that are expanded at once; a grammar with more is expanded level by level.
_POOL_IDS = 20_000_000


class Expander:
    """The ids of the rules of a grammar."""

    def __init__(self, rules: np.ndarray, expansion: np.ndarray, first_rule: int):
        self.rules, self.first_rule, self.pool = rules, first_rule, None
        if expansion.sum() > _POOL_IDS:
            return
        self.size = np.concatenate((np.ones(first_rule, np.int64), expansion))
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.empty(int(self.size.sum()), np.int32)
        self.pool[:first_rule] = np.arange(first_rule)
        low = first_rule  # rules up to here are expanded; those that hold only such ones come next
        while low < first_rule + len(rules):
            held = rules[low - first_rule :].max(axis=1)
            high = low + (int(np.argmax(held >= low)) if (held >= low).any() else len(held))
            part = rules[low - first_rule : high - first_rule].ravel()
            self.pool[self.start[low] : self.start[high - 1] + self.size[high - 1]] = self.pool[spread(self.start[part], self.size[part])]
            low = high

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        if self.pool is not None:
            return self.pool[spread(self.start[symbols], self.size[symbols])]
        return expand(symbols, self.rules, self.first_rule)


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids that symbols stand for: all rules of a level at once, until none is left."""
    while True:
        is_rule = symbols >= first_rule
        if not is_rule.any():
            return symbols
        width = 1 + is_rule.astype(np.int64)
        place = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[place[~is_rule]] = symbols[~is_rule]
        pair = rules[symbols[is_rule] - first_rule]
        out[place[is_rule]], out[place[is_rule] + 1] = pair[:, 0], pair[:, 1]
        symbols = out


def decode_slice(symbols: np.ndarray, rules: np.ndarray, expansion: np.ndarray, first_rule: int, start: int, length: int) -> np.ndarray:
    """ids[start:start + length] of a document, expanding only the symbols that hold them."""
    size = np.concatenate((np.ones(first_rule, np.int64), expansion))[symbols]
    ends = np.cumsum(size)
    low, high = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left") + 1
    before = int(ends[low - 1]) if low else 0
    return expand(symbols[low:high], rules, first_rule)[start - before : start - before + length]


#: Ids expanded at once, about.
_READ_IDS = 500_000
_FIELDS = "part int, shard int, first_rule int, ids_before long, n_ids long, doc_ids array<long>, lengths array<long>, cuts array<int>, rules binary, expansion binary, symbols binary"


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text with the file ``path``, appends ``end_id``, and writes the ids under ``out`` in order of the ids.

    The table is range-partitioned by the id and a hash of the text, so that part after part is in order and no id, null
    among them, has to fit into one. A null id comes first; of equal ids the texts' hashes, then the texts decide. A null
    or empty text is ``end_id`` alone; long ones are encoded whole, and a text larger than a shard is one of its own.
    Repeated rows are written each. Other columns are not read. An empty table gives files without rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = own.withColumn("h", F.xxhash64("text")).repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")

    def work(batches):
        model, part, before = loaded(path), TaskContext.get().partitionId(), 0
        first_rule = max(len(model.names), end_id + 1)
        for shard, rows in enumerate(shards(batches, "text", SHARD_BYTES)):
            ids, lengths = encoded(model, rows, end_id)
            symbols, cuts, rules, expansion = compress(ids, np.concatenate(([0], np.cumsum(lengths))), first_rule)
            row = {
                "part": part, "shard": shard, "first_rule": first_rule, "ids_before": before, "n_ids": len(ids), "doc_ids": rows["id"], "lengths": lengths, "cuts": cuts.astype(np.int32),
                "rules": rules.astype("<u4").tobytes(), "expansion": expansion.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
            }
            kinds = {"part": pa.int32(), "shard": pa.int32(), "first_rule": pa.int32(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "cuts": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k)) for k, v in row.items()], names=list(row))
            before += len(ids)

    mapped(ordered, work, _FIELDS).write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, at: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, ids) of every document of the files: start counts the ids of all documents before it; ids are
    little-endian unsigned 32-bit integers in a binary column. Null and repeated ids come back as they were written;
    files without rows give an empty table."""
    shards = spark.read.schema(_FIELDS).parquet(at)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition that was written
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_before"))

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch[name][k] for name in batch.schema.names}
                rules = np.frombuffer(row["rules"].as_py(), "<u4").astype(np.int64).reshape(-1, 2)
                expanded = Expander(rules, np.frombuffer(row["expansion"].as_py(), "<u4").astype(np.int64), row["first_rule"].as_py())
                lengths, cuts = row["lengths"].values.to_numpy(), row["cuts"].values.to_numpy()
                symbols = np.frombuffer(row["symbols"].as_py(), "<u4")
                start = row["part_before"].as_py() + row["ids_before"].as_py() + np.cumsum(lengths) - lengths
                doc_ids, low = row["doc_ids"].values, 0
                while low < len(lengths):  # some documents at a time
                    high = max(low + 1, int(np.searchsorted(np.cumsum(lengths[low:]), _READ_IDS, "right")) + low)
                    ids = expanded(symbols[cuts[low] : cuts[high]].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(low, high - low), pa.array(start[low:high]), packed(ids, lengths[low:high])], names=[id_col, "start", "ids"])
                    low = high

    return mapped(shards.join(F.broadcast(before), "part"), work, f"`{id_col}` long, start long, ids binary")


def encode_to_files(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents' ids into the shared folder and reads them back: (id_col, start, ids); see ``write_ids``."""
    out = new_folder(docs.sparkSession, "ids")
    write_ids(docs, path, out, end_id, id_col, text_col)
    return read_ids(docs.sparkSession, out, id_col)
