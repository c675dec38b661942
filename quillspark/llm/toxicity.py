"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon of insults, their nearness to second-person
pronouns, rates of capitals, of punctuation and of obfuscated words. Besides a short fixed list the
lexicon holds words and word beginnings that mark toxic documents in labelled rows. A bounded
sample of labelled rows is dealt into three parts; a part's features come from the lexicon of the
other two, so no lexicon is judged on rows that shaped it. Two parts fit the trees (pyspark.ml),
the third the isotonic calibration. All documents are then scored where they lie, with the lexicon
of the whole sample. Labels, lang, source and doc_id are no features.

Defined cases: null and empty texts have features of zero and get the score of those; rows with a
null doc_id are scored and not held out; repeated rows are scored once each; labels that are null
or name no document are ignored; with fewer than MIN_CLASS labelled texts of either class in the
sample, the score is the fixed lexicon's share of words times ten, 1 at most; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied

#: Labelled rows of each class that are used at most: the bound of the sample.
SAMPLE_TOXIC = 3_000
SAMPLE_CLEAN = 6_000
MIN_CLASS = 12
LEXICON_TERMS = 3_000
#: A lexicon term is in at least so many toxic texts, and this share of them, and so many times
#: likelier there than in others.
TERM_TEXTS = 3
TERM_SHARE = 0.01
TERM_RATIO = 12.0
PARTS = 3
NEAR_WORDS = 5
CACHE_ENTRIES = 150_000

#: Insults, and second-person pronouns of English, German, French and Spanish.
INSULTS = "clown disgusting dumb fool garbage idiot idiots imbecile loser losers moron morons pathetic scum stupid trash vermin worthless".split()
SECOND_PERSON = "du dich dein deine dir euch ihr sie te tu toi ton votre vous tú ti usted ustedes vosotros you your yours yourself".split()
#: Characters that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "_": None, "-": None})

FEATURES = ("hits", "hit_rate", "kinds", "near_you", "you_rate", "capitals", "shouted", "exclaims", "punctuation", "obfuscated", "hidden_hits", "words")
#: ASCII other than letters becomes a space; other bytes stay, they belong to letters.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_RUN = re.compile(r"(?<!\w)(?:[@$]|[A-Za-z]++[0-9@$*!_-])[A-Za-z0-9@$*!_-]*+")
_TO_LAST_LETTER = re.compile(r"[A-Za-z0-9@$*!_-]*[A-Za-z](?!\w)")
_MARK = re.compile(r"[0-9@$*!_-]")


def hidden_words(text: str) -> list[str]:
    """Words of letters with digits or marks among them, which may stand for letters: from a word's
    start to its last letter that no letter, digit or underscore follows. Linear in the text."""
    found = []
    for run in _RUN.finditer(text):
        word = _TO_LAST_LETTER.match(text, run.start(), run.end() + 1)
        if word and _MARK.search(word.group()):
            found.append(word.group().lower())
    return found


def terms_of(word: str) -> list[str]:
    """A word and its beginnings of 4 to 8 letters (marked by a star)."""
    return [word, *(word[:n] + "*" for n in range(4, min(8, len(word)) + 1))]


class Featurizer:
    """Dense features of texts for a lexicon of terms."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = set(lexicon)
        self.known: dict[bytes, bool] = {}
        self.you = {w.encode() for w in SECOND_PERSON}

    def _toxic(self, word: bytes) -> bool:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            got = self.known[word] = not self.lexicon.isdisjoint(terms_of(word.decode("utf-8", "replace")))
        return got

    def __call__(self, raw: bytes) -> list[float]:
        if not raw:
            return [0.0] * len(FEATURES)
        text = raw.decode("utf-8", "replace")
        words = text.lower().encode().translate(_LETTERS).split()
        n, chars = max(1, len(words)), len(text)
        toxic = {w for w in set(words) if self._toxic(w)}
        you = self.you.intersection(words)
        places = [i for i, w in enumerate(words) if w in toxic] if toxic else []
        yous = np.array([i for i, w in enumerate(words) if w in you], np.int64) if you else np.array([], np.int64)
        near = 0
        if places and len(yous):
            at = np.asarray(places)
            k = np.searchsorted(yous, at)
            gap = np.minimum(np.abs(yous[np.minimum(k, len(yous) - 1)] - at), np.abs(yous[np.maximum(k - 1, 0)] - at))
            near = int((gap <= NEAR_WORDS).sum())
        data = np.frombuffer(raw, np.uint8)
        upper = int(((data >= 65) & (data <= 90)).sum())
        letters = upper + int(((data >= 97) & (data <= 122)).sum()) + int((data >= 0xC0).sum())
        marks = int(((data == 33) | (data == 63)).sum())
        punctuation = int((((data >= 33) & (data <= 47)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | ((data >= 123) & (data <= 126))).sum())
        pair = (data[1:] >= 65) & (data[1:] <= 90) & (data[:-1] >= 65) & (data[:-1] <= 90)
        odd = hidden_words(text) if punctuation or any(c in raw for c in b"0123456789") else []
        hidden = sum(self._toxic(o.translate(LOOKALIKES).encode()) for o in odd)
        return [
            math.log1p(len(places)), len(places) / n, float(len(toxic)), near / max(1, len(places)), len(yous) / n,
            upper / max(1, letters), int(pair.sum()) / max(1, letters), marks / chars, punctuation / chars, len(odd) / n, float(hidden), math.log1p(len(words)),
        ]


def _features(lexicon: list[str], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer(lexicon)
        for got in batches:
            rows, texts = [], got.column(got.num_columns - 1)
            for i in range(got.num_rows):
                value = texts[i].as_buffer()
                rows.append(of(b"" if value is None else value.to_pybytes()))
            kept = got.columns if keep_text else got.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.float64()))], names=[*got.schema.names[: len(kept)], "features"])

    return run


def featured(docs: DataFrame, lexicon: list[str], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns (text last) and the array of FEATURES for every row."""
    own = docs.select(*[c for c in columns if c != "text"], F.col("text").cast("string").alias("text"))
    kept = own if "text" in columns else own.drop("text")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in kept.dtypes)
    return own.mapInArrow(tidied(_features(lexicon, "text" in columns)), f"{schema}, features array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """A bounded sample of labelled training rows: doc_id, text, label, weight (the rows of its
    class that each stands for) and part (0 to 2), staged. Chosen by hash, the same in every run."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label")).where(fold(F.col("doc_id")) != 0)
    known = staged(known, "labelled")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = []
    for label, most in ((1, toxic), (0, clean)):
        weight = max(1.0, sizes.get(label, 0) / most)
        parts.append(known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(weight)))
    chosen = staged(parts[0].union(parts[1]), "chosen")  # at most toxic + clean rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).withColumn("copy", F.xxhash64("text"))
    rows = rows.dropDuplicates(["copy", "label"]).drop("copy")
    return staged(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int")), "sample")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        terms, labels = [], []
        for text, label in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
            words = set((text or "").lower().encode().translate(_LETTERS).split())
            own = {t for w in words for t in terms_of(w.decode("utf-8", "replace"))}
            terms += own
            labels += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32())], names=["term", "label"])


def learn_lexicons(rows: DataFrame, most: int = LEXICON_TERMS) -> list[list[str]]:
    """For each part the terms that mark toxic texts best in the other parts, then those of all
    parts; the fixed ones come first, at most ``most`` learned ones follow."""
    sizes = rows.groupBy("label", "part").count().collect()
    marked = rows.select("text", (F.col("label") + 2 * F.col("part")).cast("int").alias("label"))
    sums = [F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(2 * PARTS)]
    counts = marked.mapInArrow(tidied(_terms), "term string, label int").groupBy("term").agg(*sums)
    counts = staged(counts.where(sum(F.col(f"n{2 * p + 1}") for p in range(PARTS)) >= TERM_TEXTS), "terms")
    found = []
    for left_out in range(PARTS + 1):
        kept = [p for p in range(PARTS) if p != left_out]
        n1, n0 = (sum(r["count"] for r in sizes if r["label"] == label and r["part"] in kept) for label in (1, 0))
        t, c = (sum((F.col(f"n{2 * p + label}") for p in kept), F.lit(0)) for label in (1, 0))
        ratio = (t / (n1 + 1)) / ((c + 0.5) / (n0 + 1))
        best = counts.where((t >= max(TERM_TEXTS, TERM_SHARE * n1)) & (ratio >= TERM_RATIO)).orderBy(F.desc(t * F.log(ratio)), "term").limit(most)
        found.append(INSULTS + [r["term"] for r in best.select("term").collect()])
    return found


class Model:
    """A fitted lexicon, trees and calibration; ``trees`` is None where labels were too few."""

    def __init__(self, lexicon: list[str], trees=None, calibration=None):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The named columns and the score of every row."""
        rows = featured(docs, self.lexicon, columns)
        if self.trees is None:
            return rows.select(*columns, F.least(F.lit(1.0), 10 * F.col("features")[1]).alias("score"))
        found = self.calibration.transform(_raw(self.trees, rows))
        # within a step of the calibration the trees' own order decides
        score = 0.999 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))) + 0.001 * F.col("raw")
        return found.select(*columns, score.alias("score"))


def _raw(trees, rows: DataFrame) -> DataFrame:
    found = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    return found.withColumn("raw", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample of labelled rows whose fold is not 0."""
    rows = sample(docs, labels)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < MIN_CLASS:
        return Model(INSULTS)
    lexicons = learn_lexicons(rows)
    marked = rows.select(F.struct("doc_id", "label", "weight", "part").alias("doc_id"), "text")
    parts = [featured(marked.where(F.col("doc_id.part") == p), lexicons[p]) for p in range(PARTS)]
    table = staged(parts[0].union(parts[1]).union(parts[2]).select("doc_id.*", "features"), "features")
    table = table.withColumn("label", F.col("label").cast("double")).coalesce(2)
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=12, maxDepth=3, stepSize=0.3, seed=7)
    trees = trees.fit(table.where("part < 2").withColumn("vector", array_to_vector("features")).cache())
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight", predictionCol="calibrated")
    calibration = calibration.fit(_raw(trees, table.where("part = 2")).select("raw", "label", "weight"))
    return Model(lexicons[-1], trees, calibration)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (score of 0.5 or more) for every document."""
    found = fit(docs, labels).score(docs)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
