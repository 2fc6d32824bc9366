"""Quality rules by distribution divergence: each document's histograms against those of its language.

Two histograms are compared by Jensen-Shannon distance (base 2, so from 0 to 1): shares of character classes, and
shares of the language's common words with all other words as one class. The references are sums over the whole
corpus, by language, found in two passes; a language with fewer than LANGUAGE_WORDS words has none.

1. every piece of text reports its character classes, and the words that hold at least half of COMMON_SHARE of its
   words in one language. A word that holds COMMON_SHARE overall has at least half of that in what was reported, so
   at most 2 / COMMON_SHARE candidates for each language remain;
2. the candidates are counted exactly over all texts.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import aside, chunks, kinds_of, mapped, stored, strings
from .words import PART, Words, hashes

#: A common word holds this share of its language's words at least; so there are 500 at most.
COMMON_SHARE = 0.002
#: A language has a reference from so many words on, however large the corpus is.
LANGUAGE_WORDS = 5000
#: Fixed value: a label names a language by two or three letters, with or without a region; so there are 18,252 at most.
LANGUAGE = "^([a-z]{2,3})([-_].*)?$"
#: Guards: a histogram of fewer words or characters says nothing, and its rule passes.
MIN_WORDS, MIN_CHARS = 50, 200
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.27, 0.43
#: A document that does not fit its own language may be mislabelled: it passes if it is this near to another one's words.
#: These three bounds lie above all, or nearly all, documents labelled good in the tables given, and so depend on no quota.
OTHER_WORD_DISTANCE = 0.3
ALL = ""
_SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "point", "symbol", "other")
_TABLE: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """The number of the character class of every code point."""
    if not _TABLE:
        kinds = {"Ll": 0, "Lo": 0, "Lm": 0, "Mn": 0, "Mc": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Nl": 2, "No": 2, "Zs": 3, "Zl": 3, "Zp": 3}
        kinds |= dict.fromkeys(("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po"), 4) | dict.fromkeys(("Sm", "Sc", "Sk", "So"), 5)
        found = np.fromiter((kinds.get(unicodedata.category(chr(c)), 6) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        found[np.flatnonzero(PART)] = 3
        found[list(_SYMBOLS)] = 5
        _TABLE.append(found)
    return _TABLE[0]


def class_counts(texts: list[str]) -> np.ndarray:
    """(texts, classes) counts of code points."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * len(CLASSES) + _class_table()[points], minlength=len(texts) * len(CLASSES)).reshape(len(texts), len(CLASSES))


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n, raw = len(words.counts), words.bytes
    byte_doc = np.repeat(np.arange(n), np.append(words.sizes[:-1] + 1, words.sizes[-1:])) if n else np.zeros(0, np.int64)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(byte_doc[mask], minlength=n)

    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    # Lines with a word, as spans between line ends; a line that has a word keeps its white space.
    ends = np.flatnonzero(raw == 0x0A)
    start, end = np.concatenate(([0], ends + 1)), np.concatenate((ends, [len(raw)]))
    has = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, start)
    start, end = start[has], end[has]
    doc = np.searchsorted(words.offsets, start, "right") - 1
    key = hashes(raw.tobytes(), start, end)
    order = np.lexsort((key, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    dup_lines = np.bincount(doc[order][1:][same], minlength=n)
    # Words that lie in a window of three whose like stands elsewhere in the text.
    doc3, at, value = words.shingles(3)
    order = np.lexsort((value, doc3))
    same = (doc3[order][1:] == doc3[order][:-1]) & (value[order][1:] == value[order][:-1])
    twice = np.zeros(len(order) + 1, bool)
    twice[1:-1] = same
    again = at[order[twice[1:] | twice[:-1]]] if len(order) else at
    covered = np.zeros(len(words.hashes), bool)
    for k in range(3):
        covered[again + k] = True
    return {
        "n_words": words.counts,
        "word_chars": per_text(~PART[raw] & ((raw & 0xC0) != 0x80)),
        "n_symbols": per_text(symbol[raw]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
    }


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of counts p and q (base 2); nan where a row has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / p.sum(axis=-1, keepdims=True), q / q.sum(axis=-1, keepdims=True)
        m = (p + q) / 2
        part = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
        return np.where(np.isnan(p).any(-1) | np.isnan(q).any(-1), np.nan, np.sqrt(np.clip(part / 2, 0, 1)))


def language(lang_col: str):
    """The language that a label names, or ALL."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(lang_col).cast("string")), LANGUAGE, 1), F.lit(ALL))


def _pick(texts: DataFrame) -> DataFrame:
    """(lang, kind, key, n): class counts (kind 0), words (1), and likely common words (2) of every piece of text."""

    def work(batches):
        for part in chunks(batches, "text"):
            langs, number = np.unique(np.array(part["lang"].to_pylist(), object).astype(str), return_inverse=True)
            texts = strings(part["text"])
            words, classes = Words(texts), class_counts(texts)
            out: list[tuple[str, int, int, int]] = []
            for k, lang in enumerate(langs.tolist()):
                out += [(lang, 0, c, n) for c, n in enumerate(classes[number == k].sum(axis=0).tolist())]
                if lang == ALL:
                    continue
                keys, n = np.unique(words.hashes[number[words.doc] == k], return_counts=True)
                out.append((lang, 1, 0, int(n.sum())))
                often = n >= n.sum() * COMMON_SHARE / 2
                out += [(lang, 2, a, b) for a, b in zip(keys[often].view(np.int64).tolist(), n[often].tolist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "kind", "key", "n"])

    return mapped(texts, work, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def _count(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(lang, key, n): how often the wanted words stand in the texts of each language."""

    def work(batches):
        for part in chunks(batches, "text"):
            langs, number = np.unique(np.array(part["lang"].to_pylist(), object).astype(str), return_inverse=True)
            words = Words(strings(part["text"]))
            at = np.minimum(np.searchsorted(wanted, words.hashes), len(wanted) - 1)
            hit = wanted[at] == words.hashes
            n = np.bincount(number[words.doc[hit]] * len(wanted) + at[hit], minlength=len(langs) * len(wanted))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs[some // len(wanted)].tolist(), pa.string()), pa.array(wanted[some % len(wanted)].view(np.int64)), pa.array(n[some].astype(np.int64))],
                names=["lang", "key", "n"],
            )

    return mapped(texts, work, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each language: its common words' hashes (sorted), their counts and the rest's, its character classes' counts.

    The key "" is for all documents together, with character classes only. What reaches the driver are the languages with
    LANGUAGE_WORDS words, which LANGUAGE bounds, with 2 / COMMON_SHARE words each at most.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), language(lang_col).alias("lang"))
    picked = stored(_pick(texts), "picked")
    totals = picked.where((F.col("kind") == 1) & (F.col("n") >= LANGUAGE_WORDS)).select("lang", F.col("n").alias("words"))
    sizes = {r["lang"]: r["words"] for r in totals.collect()}
    classes: dict[str, np.ndarray] = {}
    known = picked.where("kind = 0").join(F.broadcast(totals), "lang").select("lang", "key", "n")
    every = picked.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "key", "n")
    for r in known.unionAll(every).collect():
        classes.setdefault(r["lang"], np.zeros(len(CLASSES), np.int64))[r["key"]] = r["n"]
    likely = picked.where("kind = 2").join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("words") * COMMON_SHARE / 2)
    wanted = np.unique(np.array([r["key"] for r in likely.select("key").distinct().collect()], np.int64).view(np.uint64))
    found: dict[str, dict[int, int]] = {}
    if len(wanted):
        exact = _count(texts, wanted).join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("words") * COMMON_SHARE)
        for r in exact.select("lang", "key", "n").collect():
            found.setdefault(r["lang"], {})[r["key"]] = r["n"]
    out = {ALL: (np.zeros(0, np.uint64), np.zeros(0, np.int64), classes.get(ALL, np.zeros(len(CLASSES), np.int64)))}
    for lang, size in sorted(sizes.items()):
        keys = np.array(sorted(np.array(list(found.get(lang, {})), np.int64).view(np.uint64).tolist()), np.uint64)
        n = np.array([found[lang][k] for k in keys.view(np.int64).tolist()] if len(keys) else [], np.int64)
        out[lang] = (keys, np.append(n, size - n.sum()), classes[lang])
    return out


def _distances(words: Words, classes: np.ndarray, reference: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(class distance, word distance) of every text to one reference; nan where a guard holds or there is nothing."""
    keys, counts, class_sum = reference
    by_class = np.where(classes.sum(axis=1) < MIN_CHARS, np.nan, js_distance(classes, class_sum[None]))
    if not len(counts):
        return by_class, np.full(len(by_class), np.nan)
    at = np.searchsorted(keys, words.hashes)
    place = np.minimum(at, max(len(keys) - 1, 0))
    column = np.where(keys[place] == words.hashes, place, len(keys)) if len(keys) else np.zeros(len(words.hashes), np.int64)
    n, width = len(words.counts), len(keys) + 1
    shares = np.bincount(words.doc * width + column, minlength=n * width).reshape(n, width)
    by_word = np.where(words.counts < MIN_WORDS, np.nan, js_distance(shares, counts[None]))
    return by_class, by_word


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _picked(words: Words, classes: np.ndarray, texts: list[str], rows: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words and classes of some of the texts."""
    return (words, classes) if len(rows) == len(texts) else (Words([texts[i] for i in rows.tolist()]), classes[rows])


def _judged(own: DataFrame, found: dict, keep_text: bool, min_words: int, max_repeat_percent: int) -> DataFrame:
    """own (id, text, label, ..) and the counts, distances and verdicts; without text unless it is to be kept."""
    carried = [f for f in own.schema if f.name != "label" and (keep_text or f.name != "text")]
    shared = own.sparkSession.sparkContext.broadcast(found)

    def work(batches):
        found = shared.value
        for part in chunks(batches, "text"):
            texts = strings(part["text"])
            words, classes = Words(texts), class_counts(texts)
            base = base_counts(words)
            failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
            near = np.full((2, len(texts)), np.nan)
            label = np.array([x if x in found else ALL for x in part["label"].to_pylist()], object).astype(str)
            for name in np.unique(label).tolist():
                rows = np.flatnonzero(label == name)
                near[:, rows] = _distances(*_picked(words, classes, texts, rows), found[name])
            fits = ~(near[0] > MAX_CLASS_DISTANCE) & ~(near[1] > MAX_WORD_DISTANCE)
            rows = np.flatnonzero(~fits & ~failed)
            if len(rows):  # may be of another language
                some = _picked(words, classes, texts, rows)
                for name in found:
                    c, w = _distances(*some, found[name])
                    fits[rows] |= (label[rows] != name) & ~(c > MAX_CLASS_DISTANCE) & (w <= OTHER_WORD_DISTANCE)
            columns = [*(part[f.name] for f in carried), *(pa.array(base[k].astype(np.int64)) for k in _COUNTS), pa.array(failed), *(pa.array(x, from_pandas=True) for x in near), pa.array(~failed & fits)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in carried), *_COUNTS, "base_failed", "class_distance", "word_distance", "kept"])

    counts = ", ".join(f"{k} long" for k in _COUNTS)
    return mapped(own, work, f"{kinds_of(carried)}, {counts}, base_failed boolean, class_distance double, word_distance double, kept boolean")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """One row per document: (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept).

    A document is kept unless base_failed (fewer than min_words words, or over max_repeat_percent of them in repeated
    windows of three) or it diverges: its class distance is over MAX_CLASS_DISTANCE or its word distance over
    MAX_WORD_DISTANCE, and no other language's words are as near as OTHER_WORD_DISTANCE (so a wrong label rejects
    nothing). The distances are those to the language that its label names. A document without such a reference, or
    with no label, has its classes held against those of all documents, and a null word distance. A null distance
    passes, as does a histogram below its guard, whose distance is null.

    Null and empty texts have zero counts and fail the base rules. Texts are counted whole, long ones too. Null ids and
    repeated rows are rows like any other. Only the three columns named are read. An empty table gives an empty one.
    """
    found = references(docs, text_col, lang_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), language(lang_col).alias("label"))
    judged = _judged(own, found, False, min_words, max_repeat_percent)
    return judged.select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "class_distance", "word_distance", "kept")


def without_low_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of docs that ``quality_rules`` keeps, with all their columns; the cases named there hold."""
    found = references(docs, text_col, lang_col)
    own, restored = aside(docs, id_col, text_col)
    lang = f"x{[c for c in docs.columns if c not in (id_col, text_col)].index(lang_col)}"
    return _judged(own.withColumn("label", language(lang)), found, True, min_words, max_repeat_percent).where("kept").select(*restored)
