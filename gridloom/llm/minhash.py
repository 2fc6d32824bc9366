"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. One pass over the texts gives each document its shingle count, a 128-bit fingerprint of its shingle set, and band
   hashes. One hash per shingle fills all bins (one-permutation hashing); an empty bin copies the bin that its own
   sequence of probes meets first (Shrivastava, 2017).
2. Equal sets are one class, so copies never meet in a bucket.
3. Each bucket links its members to its least member only: a bucket of n classes gives n - 1 candidate edges.
4. Components of the candidate edges are clusters that hold every pair that shares a bucket. Within a cluster links are
   confirmed on full shingle sets through an inverted index of the shingles. Only a spanning forest of the confirmed
   links leaves a task.
5. A cluster too large for one task is cut first. Two sets of the wanted similarity share one of their rarest shingles
   (the prefix filter), so that stars over these give smaller clusters and lose no link. Each set is then compared with
   the least holder of its rare shingles that it shares most with. Sets linked so are not compared with each other again:
   blocks of the sets outside the largest group meet each other and the blocks of that group.
6. Components of the confirmed links are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import chunks, mapped, stored, strings
from .words import Words, mix

#: Shingles that one task compares at once: the memory of a comparison is some 60 bytes for each.
BLOCK_SHINGLES = 1_500_000
#: Bins that a task fills at once.
SKETCH_BINS = 1_000_000
#: A link at the threshold shares no bucket with this probability at most.
MISS = 1e-6
_PROBES = 48
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What tells one set from another: an id may stand for several texts.
_SET = ["id", "n", "fa", "fb"]


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands) for a similarity of percent / 100, from the wanted chance of a miss.

    A band agrees with a chance of a fifth at least: more rows would need many bands, fewer would make candidates of
    documents that are far from the threshold.
    """
    share = min(percent, 99) / 100
    rows = max(1, math.floor(math.log(0.2) / math.log(share)))
    return rows, math.ceil(math.log(MISS) / math.log1p(-(share**rows)))


def densify(sketch: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row of a (texts, bins) sketch from its own filled bins; rows without any stay."""
    n_bins = sketch.shape[1]
    filled = sketch != _EMPTY
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out = sketch.copy()
    for t in range(_PROBES):
        if not len(row):
            return out
        probe = (mix((col * _PROBES + t).astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(n_bins)).astype(np.int64)
        hit = filled[row, probe]
        out[row[hit], col[hit]] = sketch[row[hit], probe[hit]]
        row, col = row[~hit], col[~hit]
    # Few filled bins: the one whose hash with the empty bin is least, as if probing went on in a random order.
    for r in np.unique(row):
        have, want = np.flatnonzero(filled[r]), col[row == r]
        order = mix((want[:, None] * n_bins + have[None, :]).astype(np.uint64) + np.uint64(1 << 41))
        out[r, want] = sketch[r, have[order.argmin(axis=1)]]
    return out


def band_hashes(doc: np.ndarray, value: np.ndarray, n_docs: int, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) bucket keys of shingle sets given as sorted (text, hash) arrays."""
    n_bins = rows * bands
    sketch = np.full(n_docs * n_bins, _EMPTY)
    place = ((value >> np.uint64(32)) * np.uint64(n_bins)) >> np.uint64(32)
    np.minimum.at(sketch, doc * n_bins + place.astype(np.int64), mix(value + np.uint64(77)))
    sketch = densify(sketch.reshape(n_docs, n_bins)).reshape(n_docs, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n_docs, bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + sketch[:, :, k])
    return key


def fingerprints(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)))))
        at = np.searchsorted(doc, np.arange(n_docs + 1))
        out.append(sums[at[1:]] - sums[at[:-1]])
    return out[0], out[1]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def sketched(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs (id, text) -> (id, n, fa, fb, bands): set size, fingerprint, bucket keys (empty for an empty set)."""
    rows, bands = banding(percent)

    def work(batches):
        for part in chunks(batches, "text"):
            words = Words(strings(part["text"]), lower=True)
            doc, value = words.shingle_sets(width)
            n = np.bincount(doc, minlength=part.num_rows)
            fa, fb = fingerprints(doc, value, part.num_rows)
            keys, step = [np.zeros(0, np.uint64)], max(1, SKETCH_BINS // (rows * bands))
            for low in range(0, part.num_rows, step):
                high = min(low + step, part.num_rows)
                own = slice(*np.searchsorted(doc, (low, high)))
                keys.append(band_hashes(doc[own] - low, value[own], high - low, rows, bands)[n[low:high] > 0].ravel())
            keys = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays(
                [part["id"], pa.array(n.astype(np.int64)), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), _lists(keys, np.where(n > 0, bands, 0))],
                names=["id", "n", "fa", "fb", "bands"],
            )

    return mapped(docs, work, "id long, n long, fa long, fb long, bands array<long>")


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """docs (id, text) -> (id, n, fa, fb, shingles): the full set as sorted 64-bit hashes."""

    def work(batches):
        for part in chunks(batches, "text"):
            doc, value = Words(strings(part["text"]), lower=True).shingle_sets(width)
            n = np.bincount(doc, minlength=part.num_rows)
            fa, fb = fingerprints(doc, value, part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part["id"], pa.array(n.astype(np.int64)), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), _lists(value, n)],
                names=["id", "n", "fa", "fb", "shingles"],
            )

    return mapped(docs, work, "id long, n long, fa long, fb long, shingles array<long>")


def spanning_links(sizes: np.ndarray, values: np.ndarray, percent: int, start: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, sets given by sizes and their hashes;
    those that have the same ``start`` are known to be in one component.

    Each step compares one set with all others, by counting along the postings of its shingles. It ends when all sets
    that were not compared lie in one component, since a link between two of those could join nothing any more. The
    sets whose shingles are most common come first: they are the centres of groups of near copies.
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, term = np.unique(values, return_inverse=True)
    order = np.argsort(term, kind="stable")
    holders, first = owner[order], np.concatenate(([0], np.cumsum(np.bincount(term))))
    own = np.concatenate(([0], np.cumsum(sizes)))
    common = np.add.reduceat(np.diff(first)[term], own[:-1])
    queue = np.argsort(-common, kind="stable")
    component, left, links = np.arange(n) if start is None else start.copy(), np.ones(n, bool), []
    while True:
        rest = queue[left[queue]]
        kinds, count = np.unique(component[rest], return_counts=True)
        if len(kinds) <= 1:
            return links
        outside = rest[component[rest] != kinds[count.argmax()]] if count.max() > 1 else rest
        x = outside[0]
        left[x] = False
        mine = term[own[x] : own[x + 1]]
        length = first[mine + 1] - first[mine]
        skip = np.repeat(first[mine] - np.concatenate(([0], np.cumsum(length)[:-1])), length)
        both = np.bincount(holders[skip + np.arange(length.sum())], minlength=n)
        near = np.flatnonzero(100 * both >= percent * (sizes + sizes[x] - both))
        for c in np.unique(component[near]):
            if c != component[x]:
                links.append((x, near[component[near] == c][0]))
        component[np.isin(component, component[near])] = component[x]


def _confirm(percent: int):
    def work(group: pa.Table) -> pa.Table:
        cluster, ids, start = (group[c].to_numpy() for c in ("cluster", "id", "start"))
        column = group["shingles"].combine_chunks()
        sizes, values = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy()
        at, left, right = np.concatenate(([0], np.cumsum(sizes))), [], []
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            if len(rows) > 1:
                picked = np.concatenate([values[at[r] : at[r + 1]] for r in rows])
                for x, y in spanning_links(sizes[rows], picked, percent, start[rows]):
                    left.append(ids[rows[x]])
                    right.append(ids[rows[y]])
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return work


def _sets(own: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The full sets of the (id, n, fa, fb) wanted, from the texts."""
    texts = own.join(wanted.select("id").distinct().hint("merge"), "id", "left_semi")
    return shingled(texts, width).join(wanted, _SET, "left_semi").dropDuplicates(_SET)


def prefix_stars(sets: DataFrame, percent: int) -> DataFrame:
    """sets (id, n, fa, fb, shingles, cluster) -> (id, hub, c): sets of a cluster that share c of their rarest shingles with
    the least id that has these, too.

    In one order of all shingles, rarest first, two sets of the wanted similarity share one within the first
    n - ceil(percent * n / 100) + 1 of each. So all links lie inside the components of these stars.
    """
    words = sets.select("fa", "n", F.explode("shingles").alias("s"))
    counts = stored(words.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    own = Window.partitionBy("fa", "n")
    # Shingles of one set only come first and need no row: the others stand behind them.
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "s"))
    prefix = words.join(counts, "s").withColumn("place", place).where(f"place <= n - ({percent} * n + 99) div 100 + 1")
    rare = stored(prefix.join(sets.select("cluster", "id", "fa", "n"), ["fa", "n"]).select("cluster", "s", "id"), "rare")
    hubs = stored(rare.groupBy("cluster", "s").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c"), "hubs")
    return stored(rare.join(hubs, ["cluster", "s"]).where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("c")), "stars")


def narrowed(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """sets of large clusters -> (links (a, b) already confirmed, (id, n, fa, fb, cluster, start, minor) still to compare).

    The clusters are smaller ones, ``start`` is the component of the links a set is in, and ``minor`` is false for the
    largest of each cluster. Clusters that are one component are done and left out.
    """
    stars = prefix_stars(sets, percent)
    best = stars.groupBy("id").agg(F.min(F.struct((-F.col("c")).alias("c"), "hub")).alias("m")).select("id", F.col("m.hub").alias("hub"))
    near, far = sets.select("id", "n", "shingles"), sets.select(F.col("id").alias("hub"), F.col("n").alias("m"), F.col("shingles").alias("others"))
    near = stored(best.join(near, "id"), "asking")
    both = near.join(far, "hub").withColumn("both", F.size(F.array_intersect("shingles", "others")).cast("long"))
    links = stored(both.where(f"100 * both >= {percent} * (n + m - both)").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), "links")
    finer = components(stars.selectExpr("id AS a", "hub AS b")).selectExpr("node AS id", "root AS cluster")
    parts = sets.select(*_SET).join(finer, "id").join(components(links).selectExpr("node AS id", "root AS start"), "id", "left")
    parts = stored(parts.withColumn("start", F.coalesce("start", "id")), "parts")
    groups = parts.groupBy("cluster", "start").agg(F.sum("n").alias("held"))
    chief = groups.groupBy("cluster").agg(F.max(F.struct("held", "start")).alias("m"), F.count("*").alias("c")).where("c > 1")
    chief = stored(chief.select("cluster", F.col("m.start").alias("chief")), "chiefs")
    return links, parts.join(chief, "cluster").withColumn("minor", F.col("start") != F.col("chief")).drop("chief")


def _dealt(parts: DataFrame, tag: int) -> DataFrame:
    """parts (id, n, fa, fb, cluster, start, minor) -> the same with the task (u, i, j) of each comparison.

    Clusters that fit one task are gathered to tasks of about BLOCK_SHINGLES. Of others, each pair of blocks is a task,
    but for pairs of blocks of sets that are not ``minor``.
    """
    n, minor = F.col("n"), F.col("minor")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(minor, n)), F.lit(0)).alias("small"))
    fits = F.col("total") <= BLOCK_SHINGLES
    bins = max(1, math.ceil(2 * (total.where(fits).agg(F.sum("total")).first()[0] or 0) / BLOCK_SHINGLES))
    first, rest = (F.ceil(x / BLOCK_SHINGLES).cast("int") for x in (F.col("small"), F.col("total") - F.col("small")))
    cut = parts.join(total.select("cluster", fits.alias("fits"), first.alias("first"), rest.alias("rest")), "cluster")
    own = F.when(minor, F.pmod(F.xxhash64("id"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("id"), F.col("rest"))).cast("int")
    others = F.when(minor, F.col("first") + F.col("rest")).otherwise(F.col("first"))
    cut = cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("fits"), 1).otherwise(others) - 1)))
    bin_ = F.pmod(F.xxhash64("cluster"), F.lit(bins)).cast("long")
    return cut.select(
        *_SET, "cluster", "start",
        F.when(F.col("fits"), bin_).otherwise(F.col("cluster")).alias("u"),
        F.when(F.col("fits"), F.lit(tag)).otherwise(F.least("own", "other")).alias("i"),
        F.when(F.col("fits"), F.lit(tag)).otherwise(F.greatest("own", "other")).alias("j"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, kept).

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a text of fewer than ``width`` words has its word
    sequence as its one shingle. Documents are linked when 100 * intersection >= percent * union of their sets;
    component_id is the least id reachable, and the document that has it is the one kept.

    Null and empty texts have no shingles and are linked with nothing. Long texts are compared whole. A null id is linked
    with nothing: its component_id is null, and it is kept. Rows that repeat an id count as one document in a component,
    and ties cannot be, as the least id is one. Other columns of docs are not read. An empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    light = stored(sketched(own, width, percent), "sketches")
    # Written first: the join below then has a shuffle of its own on both sides, of which a hot class can be split.
    classes = stored(light.where("n > 0 AND id IS NOT NULL").groupBy("n", "fa", "fb").agg(F.min("id").alias("rep")), "classes")
    some = F.expr("n > 0 AND id IS NOT NULL")
    slim = light.drop("bands")
    joined = slim.where(some).join(classes, ["n", "fa", "fb"]).select("id", "n", "fa", "fb", "rep")
    member = stored(joined.unionAll(slim.where(~some | some.isNull()).withColumn("rep", F.col("id"))), "members")
    reps = member.where("id = rep AND n > 0").select("id", "n", "fa", "fb").distinct()
    keys = light.join(reps, ["id", "n", "fa", "fb"], "left_semi").select("id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    edges = keys.join(hubs, "key").where("id <> hub").selectExpr("id AS a", "hub AS b")
    cluster = components(edges).selectExpr("node AS id", "root AS cluster").join(reps, "id")
    cluster = stored(cluster, "clusters")

    total = cluster.groupBy("cluster").agg(F.sum("n").alias("total"))
    sized = cluster.join(total, "cluster").withColumn("large", F.col("total") > BLOCK_SHINGLES).drop("total")
    whole = _dealt(sized.where("NOT large").withColumn("start", F.col("id")).withColumn("minor", F.lit(True)), -1)
    columns, links = ["u", "i", "j", "cluster", "start", "id", "shingles"], None
    tasks = _sets(own, whole.select(*_SET), width).join(whole, _SET).select(*columns)
    if total.where(F.col("total") > BLOCK_SHINGLES).limit(1).count():
        large = sized.where("large").drop("large")
        sets = stored(_sets(own, large.select(*_SET), width).join(large, _SET), "large")
        links, parts = narrowed(sets, percent)
        tasks = tasks.unionAll(sets.drop("cluster").join(_dealt(parts, -2), _SET).select(*columns))
    forest = tasks.groupBy("u", "i", "j").applyInArrow(_confirm(percent), "a long, b long")
    forest = forest if links is None else forest.unionAll(links)
    found = components(forest)
    return member.join(found, member["rep"] == found["node"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "rep").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("root", "rep"), F.lit(True)).alias("kept"),
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, with all their columns: one document of each group. Null and empty
    texts and null ids stay; rows that repeat an id stay or go together."""
    gone = near_duplicates(docs, id_col, text_col, width, percent).where("NOT kept").select(F.col(id_col).alias("_gone"))
    return docs.join(gone.distinct().hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
