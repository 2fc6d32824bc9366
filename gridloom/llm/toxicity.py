"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of a lexicon learned from labels, nearness of its words to second-person words, and rates
of capitals, punctuation and obfuscated words. Labels are read for rows whose crc32(id as text) mod 5 is not 0; the
remainders have these parts:

    1, 2, 3   lexicon and trees; a document's own features come from a lexicon of the other two remainders
    4         isotonic calibration, with the lexicon of 1, 2 and 3, which is that of scoring
    0         held out

The classifier is fitted on a sample of about ``max_labelled`` labelled rows, chosen by a hash of the id; with that
bound the sample's labels are broadcast. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Lookup
from .shared import aside, chunks, kinds_of, mapped, stored, strings
from .words import hashes, mix, runs, utf8_offsets

#: Labelled rows that the classifier is fitted on, about.
MAX_LABELLED = 20_000
#: Lexicon keys: whole words, and beginnings of this many letters of longer words.
STEM = 4
#: A key of the lexicon stands in this many toxic documents at least, and its log odds ratio is this at least.
MIN_TOXIC, MIN_ODDS, STRONG = 2, 1.0, 3.0
#: Words apart that still count as near a second-person word.
NEAR = 5
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur ye du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes ti tuyo vosotros"
FEATURES = (
    "lexicon", "lexicon_strong", "lexicon_max", "lexicon_kinds", "stem", "stem_strong", "stem_max", "near_second_person",
    "second_person", "capitals", "exclamation", "punctuation", "obfuscated", "stretched", "log_words",
)
_LETTER, _DIGIT, _MARK, _GAP = 1, 2, 3, 0
_TABLE: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    if not _TABLE:
        kinds = {"L": _LETTER, "M": _LETTER, "N": _DIGIT, "P": _MARK, "S": _MARK}
        _TABLE.append(np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _GAP) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1))
    return _TABLE[0]


class Tokens:
    """Letter words of several texts in lower case, with the hashes of the words and of their beginnings."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        plain = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower()[0] for c in t) for t in texts]
        self.first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in plain])))[:-1].astype(np.int64)
        self.raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        whole = "\n".join(plain)
        self.points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.kind = _kinds()[self.points]
        self.start, self.end = runs(self.kind == _LETTER)
        self.doc = np.searchsorted(self.first, self.start, "right") - 1
        at = utf8_offsets(self.points)
        self.word = hashes(whole.encode("utf-8", "surrogatepass"), at[self.start], at[self.end])
        longer = self.end - self.start > STEM
        self.stem = np.zeros(len(self.start), np.uint64)
        for k in range(STEM):
            self.stem[longer] = mix(self.stem[longer] * np.uint64(0xD6E8FEB86659FD93) + self.points[self.start[longer] + k])

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, key) pairs of words and stems."""
        doc = np.concatenate((self.doc, self.doc[self.stem > 0]))
        key = np.concatenate((self.word, self.stem[self.stem > 0]))
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        return doc[new], key[new]


def features(texts: list[str], lexicon: Lookup, odds: np.ndarray, column: np.ndarray) -> np.ndarray:
    """(texts, FEATURES). odds: (keys of the lexicon + 1, 4), the last row zero; column: which of the four a text uses."""
    tokens = Tokens(texts)
    n, doc = tokens.n, tokens.doc

    def total(weights: np.ndarray, owner: np.ndarray = doc) -> np.ndarray:
        return np.bincount(owner, weights=weights, minlength=n)

    def largest(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        np.maximum.at(out, doc, values)
        return out

    words = np.maximum(total(np.ones(len(doc))), 1)
    length = np.maximum(np.diff(np.append(tokens.first, len(tokens.points) + 1)) - 1, 1)
    by_word = odds[lexicon((tokens.word >> np.uint64(1)).view(np.int64)), column[doc]]
    by_stem = odds[lexicon((tokens.stem >> np.uint64(1)).view(np.int64)), column[doc]]
    hit = np.flatnonzero((by_word >= STRONG) | (by_stem >= STRONG))
    second = np.isin(tokens.word, _second_person())
    where = np.flatnonzero(second)
    close = np.zeros(len(hit), bool)
    if len(where) and len(hit):
        for at in (np.searchsorted(where, hit) - 1, np.searchsorted(where, hit)):
            other = where[np.clip(at, 0, len(where) - 1)]
            close |= (np.abs(other - hit) <= NEAR) & (doc[other] == doc[hit])
    kinds = np.unique(doc[hit].astype(np.uint64) << np.uint64(40) | tokens.word[hit] >> np.uint64(24)) >> np.uint64(40)
    letters = tokens.kind == _LETTER
    point_doc = np.repeat(np.arange(n), np.diff(np.append(tokens.first, len(tokens.points))))
    upper = letters & (tokens.raw != tokens.points)
    mark = tokens.kind == _MARK
    inner = np.zeros(len(tokens.points), bool)  # a digit or mark with letters on both sides
    inner[1:-1] = (mark[1:-1] | (tokens.kind[1:-1] == _DIGIT)) & letters[:-2] & letters[2:] & ~np.isin(tokens.points[1:-1], (0x27, 0x2D, 0x2019))
    alike = np.zeros(len(tokens.points), bool)
    alike[3:] = letters[3:] & (tokens.points[3:] == tokens.points[2:-1]) & (tokens.points[2:-1] == tokens.points[1:-2]) & (tokens.points[1:-2] == tokens.points[:-3])

    def rate(mask: np.ndarray) -> np.ndarray:
        return np.bincount(point_doc[mask], minlength=n)

    letter_count = np.maximum(rate(letters), 1)
    columns = (
        total(by_word) / words, total(by_word >= STRONG) / words, largest(by_word), np.log1p(np.bincount(kinds.astype(np.int64), minlength=n)),
        total(by_stem) / words, total(by_stem >= STRONG) / words, largest(by_stem), total(close.astype(float), doc[hit]) / words,
        total(second) / words, rate(upper) / letter_count, rate(tokens.points == 0x21) / length, rate(mark) / length,
        rate(inner) / words, rate(alike) / words, np.log1p(total(np.ones(len(doc)))),
    )
    return np.stack(columns, axis=1)


def _second_person() -> np.ndarray:
    return Tokens([SECOND_PERSON]).word


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(id, text, toxic, part): the labelled sample; of several labels of one id the larger counts."""
    known = labels.where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("part", (F.crc32(F.col("id").cast("string")) % 5).cast("int")).where("part <> 0")
    share = min(1.0, max_labelled / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40))))
    return docs.join(F.broadcast(chosen), "id").select("id", "text", "toxic", "part")


def _lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys without their last bit, odds): of each key the log odds ratio from parts 1 to 3, and without 1, 2 and 3."""

    def work(batches):
        for batch in chunks(batches, "text"):
            doc, key = Tokens(strings(batch["text"])).keys()
            yield pa.RecordBatch.from_arrays(
                [pa.array((key >> np.uint64(1)).view(np.int64)), batch["toxic"].take(pa.array(doc)), batch["part"].take(pa.array(doc))], names=["key", "toxic", "part"]
            )

    parts = (1, 2, 3)
    sample = sample.where("part < 4")
    sizes = {(r["part"], r["toxic"]): r["count"] for r in sample.groupBy("part", "toxic").count().collect()}
    counted = mapped(sample.select("text", "toxic", "part"), work, "key long, toxic int, part int")
    counts = [F.count_if((F.col("part") == p) & (F.col("toxic") == t)).alias(f"n{p}{t}") for p in parts for t in (0, 1)]
    counted = counted.groupBy("key").agg(*counts)
    toxic, clean = (sum(sizes.get((p, t), 0) for p in parts) for t in (1, 0))
    t, c = F.expr("n11 + n21 + n31"), F.expr("n10 + n20 + n30")
    ratio = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    rows = counted.where((t >= MIN_TOXIC) & (ratio >= MIN_ODDS)).toPandas().sort_values("key")

    def odds(left: tuple[int, ...]) -> np.ndarray:
        t, c = (sum((rows[f"n{p}{k}"].to_numpy() for p in left), np.zeros(len(rows))) for k in (1, 0))
        a, b = (sum(sizes.get((p, k), 0) for p in left) for k in (1, 0))
        value = np.log((t + 0.5) / (a + 1)) - np.log((c + 0.5) / (b + 1))
        return np.where((t >= MIN_TOXIC) & (value >= MIN_ODDS), value, 0)

    table = np.stack([odds(parts)] + [odds(tuple(q for q in parts if q != p)) for p in parts], axis=1)
    return rows["key"].to_numpy(np.int64), np.concatenate((table, np.zeros((1, 4))))


def _featured(texts: DataFrame, keys: np.ndarray, odds: np.ndarray, keep_text: bool = False) -> DataFrame:
    """texts (.., text, column) -> the other columns and features; column says which of the four odds to use."""
    lexicon = Lookup(keys, np.arange(len(keys)))
    shared = texts.sparkSession.sparkContext.broadcast((lexicon, odds))
    others = [f for f in texts.schema if f.name != "column" and (keep_text or f.name != "text")]

    def work(batches):
        lexicon, odds = shared.value
        for batch in chunks(batches, "text"):
            found = features(strings(batch["text"]), lexicon, odds, batch["column"].to_numpy().astype(np.int64))
            at = np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), pa.ListArray.from_arrays(at, found.ravel())], names=[*(f.name for f in others), "features"])

    return mapped(texts, work, f"{kinds_of(others)}, features array<double>")


def _scored(own: DataFrame, labels: DataFrame, max_labelled: int, keep_text: bool) -> DataFrame:
    """own (id, text, ..) and held_out, score, predicted; without text unless it is to be kept."""
    sample = stored(_labelled(own.select("id", "text"), labels, max_labelled), "labelled")
    seen = {(r["late"], r["toxic"]): r["count"] for r in sample.groupBy((F.col("part") == 4).alias("late"), "toxic").count().collect()}
    held_out = (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out")
    carried = [c for c in own.columns if keep_text or c != "text"]
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    if min(seen.get((False, t), 0) for t in (0, 1)) < 2:
        toxic, every = sum(n for (_, t), n in seen.items() if t), sum(seen.values())
        return own.select(*carried, held_out, F.lit(toxic / every if every else 0.0).alias("score")).withColumn("predicted", predicted)

    keys, odds = _lexicon(sample)
    column = F.when(F.col("part") < 4, F.col("part")).otherwise(0).alias("column")
    fitted = stored(_featured(sample.select("text", "toxic", "part", column), keys, odds), "features")
    fitted = fitted.withColumn("vector", array_to_vector("features")).withColumn("label", F.col("toxic").cast("double"))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxDepth=3, maxIter=24, stepSize=0.3, minInstancesPerNode=2, seed=7)
    model = trees.fit(fitted.where("part < 4").select("vector", "label"))

    def raw(df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    ready = _featured(own.withColumn("column", F.lit(0)), keys, odds, keep_text).withColumn("vector", array_to_vector("features"))
    ready = raw(ready).select(*carried, held_out, "raw")
    if min(seen.get((True, t), 0) for t in (0, 1)) < 5:
        return ready.withColumnRenamed("raw", "score").withColumn("predicted", predicted)
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="fit").fit(raw(fitted.where("part = 4").select("vector", "label")))
    final = curve.transform(ready).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("fit") * 0.99 + F.col("raw") * 0.01)))
    return final.select(*carried, "held_out", "score", predicted)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: (id_col, held_out, score, predicted).

    ``score`` is a calibrated probability of label 1, from the text alone; ``predicted`` is 1 from 0.5 up. Isotonic
    regression gives ranges of the raw score one value, so a hundredth of the score is the raw one, which keeps its
    order. Without 2 labels of each class to learn from every score is the share of label 1 (0 without labels);
    with fewer than 5 of each to calibrate on, the raw score stands.

    Null and empty texts are scored as texts without words. A null id counts as held out. Labels that are null or
    neither 0 nor 1 are ignored, and so are labels of unknown ids. Repeated rows are scored alike. Other columns are
    not read. An empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic"))
    return _scored(own, known, max_labelled, False).select(F.col("id").alias(id_col), "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that ``toxicity`` does not predict to be toxic, with all their columns."""
    own, restored = aside(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).alias("toxic"))
    return _scored(own, known, max_labelled, True).where("predicted = 0").select(*restored)
