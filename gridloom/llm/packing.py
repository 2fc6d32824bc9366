"""Packing of documents into token windows by lexical retrieval: neighbours of a seed document fill its window.

1. A router, fitted on a bounded sample, is a tree of lexical halves: a node sends a document to one side by the product
   of its hashed tf-idf vector with the direction in which the node's sample spreads most. Leaves are numbered so that
   like ones are beside each other.
2. One pass over all texts counts document frequencies and gives each document its leaf and its product at the last node.
   Documents are dealt in the order of these to partitions of near equal bytes, and last by their row, so that a leaf of
   any size, long documents, or copies of one text are spread evenly over tasks and each run of documents is lexically close.
3. A task indexes runs of bounded size (the shards of the index). A shard's inverted index holds BM25 weights; the
   seed of a window asks it for the most similar documents that are not used yet, and these fill the window in order of
   their score. A document that does not fit is cut, and its rest seeds the next window, so that only the last window
   of a partition can be short.

Terms are words, told apart by 40 bits of their hash or more; their document frequencies are counted over all documents in
2**18 buckets of hashes, so that these statistics have a fixed size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .bpe import loaded, spread
from .shared import chunks, mapped, packed, shards, stored, strings
from .words import Words

#: Buckets of document frequencies, and of the router's vectors.
TERMS, ROUTE_TERMS = 1 << 18, 1 << 11
#: Documents that the router is fitted on, about; its depth, and the fewest documents of a node that is halved.
SAMPLE, DEPTH, LEAST_NODE = 2000, 8, 24
#: A shard's texts in bytes, about: documents that can meet in a window.
BLOCK_BYTES = 2_000_000
#: Texts of a partition in bytes, about; steps in which a leaf's products are counted when partitions are laid out.
PARTITION_BYTES, STEPS = 16_000_000, 64
K1, B = 1.2, 0.75
#: Neighbours of a seed that are put in order at first.
FIRST = 24


def _terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, term) with the term's frequency and its bucket; texts and terms in order."""
    bits = np.uint64(len(words.counts).bit_length())
    key, tf = np.unique(words.doc.astype(np.uint64) << (np.uint64(64) - bits) | words.hashes >> bits, return_counts=True)
    term = key & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1))
    return (key >> (np.uint64(64) - bits)).astype(np.int64), term, tf, (term >> (np.uint64(46) - bits)).astype(np.int64)


class Router:
    """The tree of lexical halves, from sample documents given as sorted (document, bucket of ROUTE_TERMS, tf) arrays."""

    def __init__(self, doc: np.ndarray, bucket: np.ndarray, tf: np.ndarray, n: int):
        held = np.bincount(np.unique(doc * ROUTE_TERMS + bucket) % ROUTE_TERMS, minlength=ROUTE_TERMS)
        self.idf = np.log1p((n - held + 0.5) / (held + 0.5)).astype(np.float32)
        whole = np.zeros((n, ROUTE_TERMS), np.float32)
        np.add.at(whole, (doc, bucket), self._weights(doc, bucket, tf, n))
        self.direction, self.edge, self.child, self.leaves = [], [], [], 0
        self._halve(whole, np.arange(n), 0)
        self.direction = np.array(self.direction, np.float32).reshape(-1, ROUTE_TERMS)
        self.edge, self.child = np.array(self.edge, np.float32), np.array(self.child, np.int64).reshape(-1, 2)

    def _weights(self, doc: np.ndarray, bucket: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """tf-idf weights, of length 1 in each document."""
        w = (1 + np.log(tf)).astype(np.float32) * self.idf[bucket]
        return w / np.maximum(np.sqrt(np.bincount(doc, weights=w * w, minlength=n)), 1e-9)[doc].astype(np.float32)

    def _halve(self, whole: np.ndarray, rows: np.ndarray, depth: int) -> int:
        """The node of these sample documents: its number, or -1 - leaf. Leaves are numbered from left to right."""
        product = None
        if depth < DEPTH and len(rows) >= LEAST_NODE:
            own = whole[rows]
            own -= own.mean(axis=0)
            direction = own[np.argmax((own * own).sum(axis=1))]
            for _ in range(8):  # power iteration
                direction = own.T @ (own @ direction)
                direction /= max(float(np.sqrt((direction * direction).sum())), 1e-12)
            product = whole[rows] @ direction
            ordered = np.sort(product)
            sums, left = np.cumsum(ordered), np.arange(1, len(rows))
            between = sums[:-1] ** 2 / left + (sums[-1] - sums[:-1]) ** 2 / (len(rows) - left)  # largest where the halves are apart most
            between[: len(rows) // 10] = between[len(rows) - 1 - len(rows) // 10 :] = -np.inf
            between[ordered[1:] <= ordered[:-1]] = -np.inf
            cut = int(between.argmax())
            if not np.isfinite(between[cut]):
                product = None
        if product is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.edge)
        self.direction.append(direction)
        self.edge.append((ordered[cut] + ordered[cut + 1]) / 2)
        self.child.append([0, 0])
        edge = self.edge[node]
        self.child[node] = [self._halve(whole, rows[product <= edge], depth + 1), self._halve(whole, rows[product > edge], depth + 1)]
        return node

    def __call__(self, doc: np.ndarray, bucket: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, product at the last node) of n documents."""
        leaf, last = np.zeros(n, np.int32), np.zeros(n, np.float32)
        if not len(self.edge):
            return leaf, last
        weight, node = self._weights(doc, bucket, tf, n), np.zeros(n, np.int64)
        going = np.ones(n, bool)
        for _ in range(DEPTH):
            product = np.bincount(doc, weights=weight * self.direction[node[doc], bucket], minlength=n)
            last[going] = product[going]
            side = self.child[node, (product > self.edge[node]).astype(np.int64)]
            done = going & (side < 0)
            leaf[done] = -1 - side[done]
            going &= ~done
            node = np.where(going, side, 0)
            if not going.any():
                break
        return leaf, last


def fit_router(texts: DataFrame) -> Router:
    """A router for a table with a column text. What reaches the driver are some SAMPLE vectors of ROUTE_TERMS numbers at
    most each, however long the texts are."""
    share = min(1.0, SAMPLE / max(1, texts.count()))
    wanted = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40)))

    def work(batches):
        for part in chunks(batches, "text"):
            doc, _, tf, bucket = _terms(Words(strings(part["text"]), lower=True))
            key, where = np.unique(doc * ROUTE_TERMS + bucket // (TERMS // ROUTE_TERMS), return_inverse=True)
            tf = np.bincount(where, weights=tf, minlength=len(key)).astype(np.int32)
            at = np.searchsorted(key // ROUTE_TERMS, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in ((key % ROUTE_TERMS).astype(np.int32), tf)]
            yield pa.RecordBatch.from_arrays(lists, names=["bucket", "tf"])

    rows = mapped(texts.where(wanted), work, "bucket array<int>, tf array<int>").toArrow()
    held = [rows[c].combine_chunks() for c in ("bucket", "tf")]
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(held[0]).to_numpy(zero_copy_only=False)) if len(rows) else np.zeros(0, np.int64)
    bucket, tf = (x.flatten().to_numpy() if len(rows) else np.zeros(0, np.int32) for x in held)
    return Router(doc, bucket, tf, len(rows))


def _routed(own: DataFrame, kind: str) -> tuple[DataFrame, np.ndarray, int, float]:
    """(own (id, text) with leaf, last and row, as a stage table; document frequencies, documents, mean length in words)."""
    spark = own.sparkSession
    router = spark.sparkContext.broadcast(fit_router(own))

    def work(batches):
        df, n, length = np.zeros(TERMS, np.int64), 0, 0
        first = TaskContext.get().partitionId() << 40
        for part in chunks(batches, "text"):
            words = Words(strings(part["text"]), lower=True)
            doc, _, tf, bucket = _terms(words)
            df += np.bincount(bucket, minlength=TERMS)
            leaf, last = router.value(doc, bucket // (TERMS // ROUTE_TERMS), tf, part.num_rows)
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part["id"], part["text"], pa.array(leaf), pa.array(last), pa.array(first + n + np.arange(part.num_rows)), none, none], names=names)
            n, length = n + part.num_rows, length + len(words.hashes)
        if n:
            some = np.flatnonzero(df)
            none = [pa.nulls(len(some) + 2, t) for t in (id_type, pa.string(), pa.int32(), pa.float32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(np.append(some, [-1, -2])), pa.array(np.append(df[some], [n, length]))], names=names)

    names, id_type = ["id", "text", "leaf", "last", "row", "term", "n"], to_arrow_type(own.schema["id"].dataType)
    stage = stored(mapped(own, work, f"id {kind}, text string, leaf int, last float, row long, term long, n long"), "routed")
    found = stage.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 2 rows at most
    term, n = (found[c].to_numpy() for c in ("term", "n"))
    df = np.zeros(TERMS, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    docs, length = (int(n[term == k].sum()) for k in (-1, -2))
    return stage.where("term IS NULL").drop("term", "n"), df, docs, length / max(1, docs)


def _dealt(routed: DataFrame) -> DataFrame:
    """routed in partitions of about PARTITION_BYTES, in the order of leaf and product; a step of equal products that is
    larger than a partition is dealt to several by its rows."""
    step = F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(0.999), F.col("last"))) + 1) * (STEPS / 2)).cast("int")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    routed = routed.withColumn("step", step)
    counted = routed.groupBy("leaf", "step").agg(F.sum(size).alias("size"))  # 2**DEPTH leaves of STEPS steps at most
    before = F.sum("size").over(Window.orderBy("leaf", "step")) - F.col("size")
    low, high = F.floor(before / PARTITION_BYTES), F.floor((before + F.col("size") - 1) / PARTITION_BYTES)
    laid = stored(counted.select("leaf", "step", low.cast("int").alias("low"), (high - low + 1).cast("int").alias("parts")), "layout")
    n = laid.agg(F.max(F.expr("low + parts"))).first()[0] or 1
    part = F.col("low") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    return routed.join(F.broadcast(laid), ["leaf", "step"]).withColumn("part", part).repartitionById(n, "part").drop("step", "low", "parts", "part")


class Index:
    """BM25 over one shard; ``neighbours`` gives the documents that are still unused, best first."""

    def __init__(self, words: Words, df: np.ndarray, n: int, mean: float):
        self.doc, term, tf, bucket = _terms(words)
        idf = np.log1p((n - df[bucket] + 0.5) / (df[bucket] + 0.5))
        self.weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * words.counts[self.doc] / max(mean, 1e-9)))
        self.first = np.searchsorted(self.doc, np.arange(len(words.counts) + 1))
        order = np.argsort(term, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = term[order[1:]] != term[order[:-1]]
        self.term = np.empty(len(order), np.int64)
        self.term[order] = number = np.cumsum(new) - 1
        # Terms that more than an eighth of the documents hold are columns of a matrix, the others have postings.
        held_by = np.bincount(number, minlength=1)
        column = np.cumsum(held_by > len(words.counts) // 8) - 1
        wide = (held_by > len(words.counts) // 8)[self.term]
        self.dense = np.zeros((len(words.counts), column[-1] + 1))
        self.dense[self.doc[wide], column[self.term[wide]]] = self.weight[wide]
        order = order[~wide[order]]
        self.holders, self.held = self.doc[order], self.weight[order]
        self.start = np.searchsorted(self.term[order], np.arange(len(held_by) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """All of ``ranked``."""
        return list(self.ranked(seed, unused))

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """All unused documents that share a term with the seed, by falling score, of equal ones in their order. A window mostly
        wants few of them, so the others are put in order only when these are taken."""
        term = self.term[self.first[seed] : self.first[seed + 1]]
        at = spread(self.start[term], self.start[term + 1] - self.start[term])
        score = np.bincount(self.holders[at], weights=self.held[at], minlength=len(unused))
        score = (score + self.dense @ (self.dense[seed] > 0)) * unused
        found = np.flatnonzero(score)
        if len(found) > 4 * FIRST:
            held = score[found]
            top = held >= np.partition(held, len(held) - FIRST)[len(held) - FIRST]  # with all that are equal to the last of them
            first, found = found[top], found[~top]
            yield from first[np.argsort(-score[first], kind="stable")].tolist()
        yield from found[np.argsort(-score[found], kind="stable")].tolist()


def pack_block(lengths: list[int], neighbours, window: int, room: int) -> list[tuple[int, int, int, bool]]:
    """Pieces (document, start, length, whether a new window begins) of one block; ``room`` is left in the open window.

    ``neighbours(seed, unused)`` yields documents by similarity. Every document is cut at window ends only.
    """
    unused = np.ones(len(lengths), bool)
    pieces: list[tuple[int, int, int, bool]] = []
    nearest: Iterator[int] = iter(())
    following, at, start = 0, -1, 0
    while True:
        if at < 0:  # the next document: a neighbour of the window's seed, or the first one left
            at = next((d for d in nearest if unused[d]), -1)
            if at < 0:
                while following < len(lengths) and not unused[following]:
                    following += 1
                if following == len(lengths):
                    return pieces
                at = following
                unused[at] = False
                nearest = iter(neighbours(at, unused))
            unused[at], start = False, 0
        fresh = room == 0
        if fresh:
            room = window
            if start:
                nearest = iter(neighbours(at, unused))
        size = min(room, lengths[at] - start)
        pieces.append((at, start, size, fresh))
        start, room = start + size, room - size
        if start == lengths[at]:
            at = -1


def pack_documents(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id_col, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned
    32-bit integers in a binary column.

    A document is its token ids (the file ``path``, no special tokens added) and ``end_id``; each of its ids lies in
    exactly one piece, and a sequence holds ``window`` ids but for the last of a partition. ``sequence_id`` is unique;
    offsets within it run on without gaps from 0.

    A null or empty text is ``end_id`` alone. Long texts are scored and cut whole; a text larger than a shard is one of its
    own. Null and repeated ids are documents like any other. Of equal BM25 scores the document that comes first in the
    order of the table packed counts (leaf, last product, row). Other columns are not read. An empty table gives an empty
    one. The order is that of a table that is written once, so a repeated task gives the same rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    routed, df, n, mean = _routed(own, kind)
    ordered = _dealt(routed).sortWithinPartitions("leaf", "last", "row").select("id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(df)

    def work(batches):
        model, df = loaded(path), shared.value
        sequence, room = (TaskContext.get().partitionId() << 36) - 1, 0
        for part in shards(batches, "text", BLOCK_BYTES):
            texts = strings(part["text"])
            index = Index(Words(texts, lower=True), df, n, mean)
            tokens, lengths = encoded(model, part, end_id)
            first = np.concatenate(([0], np.cumsum(lengths)))
            pieces = pack_block(lengths.tolist(), index.ranked, window, room)
            at, start, size, fresh = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            sequences = sequence + np.cumsum(fresh)
            filled = np.cumsum(size) - size - (np.cumsum(size) - size)[np.maximum.accumulate(np.where(fresh, np.arange(len(size)), 0))]
            offset = np.where(sequences == sequence, filled + window - room, filled) if not fresh[0] else filled
            used = offset[-1] + size[-1]
            sequence, room = int(sequences[-1]), int(window - used)
            ids = packed(tokens[spread(first[at] + start, size)], size)
            columns = [part["id"].take(pa.array(at)), pa.array(start), pa.array(size), ids, pa.array(lengths[at]), pa.array(sequences), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return mapped(ordered, work, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def encoded(model, rows: pa.RecordBatch, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts of rows, each followed by end_id; number of each text), in pieces of bounded size."""
    found = [_with_end(model, strings(piece["text"]), end_id) for piece in chunks([rows], "text")]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _with_end(model, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by end_id; number of each text)."""
    ids, count = model.encode(texts)
    lengths = count + 1
    out = np.full(lengths.sum(), end_id, np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = ids
    return out, lengths
