"""Language of pages by Bayesian fusion of independent evidence.

For every page and each language of the labelled documents, the logarithms of these are added:

- text: the likelihood of the page's character trigrams (hashed into BUCKETS) in a multinomial
  model that is counted over all labelled documents. Trigrams overlap and a page's words depend on
  each other, so the mean is weighted by a third of their number, TEXT_WEIGHT at most;
- markup: that the page declares its language rightly with probability MARKUP;
- address suffix: that a country's host is in one of the country's languages with SUFFIX;
- host: the share of languages among the host's other pages by their own evidence, smoothed with
  HOST_WEIGHT pages of the shares of all hosts with its address suffix, and these with SUFFIX_WEIGHT
  pages of the whole table's shares. A page never counts in its own prior, at no level.

Shares are summed as whole numbers of 1 / SCALE, so results do not hang on the order of rows.

Defined cases: every row of pages comes back once, repeated rows too; null and empty pages and
those without letters have no text evidence; a page without a host has the table's shares as prior;
a declared language or a suffix that no labelled document has tells nothing; without labelled
documents language and probability are null; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized_join, staged

BUCKETS = 1 << 14
SMOOTHING = 0.5
TEXT_WEIGHT = 100.0
MARKUP, SUFFIX = 0.9, 0.7
HOST_WEIGHT, SUFFIX_WEIGHT = 8, 32
SCALE = 1_000_000_000
#: Letters below which the text of menus and footers is read too.
FEW_LETTERS = 20
#: Characters turned into trigrams at a time.
CHUNK = 1 << 20
#: Languages by the suffix of a country's hosts.
SUFFIXES = {
    "de": ("de",), "at": ("de",), "li": ("de",), "ch": ("de", "fr", "it"), "fr": ("fr",), "be": ("nl", "fr", "de"), "lu": ("fr", "de"), "es": ("es",), "mx": ("es",), "ar": ("es",), "cl": ("es",),
    "pe": ("es",), "ve": ("es",), "uy": ("es",), "ec": ("es",), "uk": ("en",), "us": ("en",), "ie": ("en",), "nz": ("en",), "au": ("en",), "ca": ("en", "fr"), "gov": ("en",), "edu": ("en",), "it": ("it",),
    "nl": ("nl",), "pt": ("pt",), "br": ("pt",), "pl": ("pl",), "ru": ("ru",), "ua": ("uk",), "cz": ("cs",), "se": ("sv",), "no": ("no",), "dk": ("da",), "fi": ("fi",), "gr": ("el",), "tr": ("tr",), "jp": ("ja",), "cn": ("zh",), "kr": ("ko",),
}

_LETTERS = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-z][a-z0-9]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_CHROME = {"nav", "footer"}
_HTML = re.compile(r"<html\b([^>]*)>", re.I)
_LANG = re.compile(r"""(?<![\w-])(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""", re.I)
_HOST = re.compile(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\\]*@)?([^/?#:\\\s]+)", re.I)


def page_text(page: str) -> str:
    """What a page shows, without menus and footers unless there is hardly anything else."""
    parts, shown, depth, at = [], [], 0, 0
    for m in _MARK.finditer(page):
        parts.append(page[at : m.start()])
        if not depth:
            shown.append(parts[-1])
        if m.group(3) and m.group(3).lower() in _CHROME:
            depth = max(0, depth - 1) if m.group(2) else depth + 1
        at = m.end()
    parts.append(page[at:])
    if not depth:
        shown.append(parts[-1])
    own = html.unescape(" ".join(shown))
    return own if sum(map(len, _LETTERS.findall(own))) >= FEW_LETTERS else html.unescape(" ".join(parts))


def declared(page: str) -> str | None:
    """The primary language that the page's markup declares."""
    tag = _HTML.search(page)
    found = _LANG.search(tag.group(1)) if tag else None
    return found.group(1).lower() if found else None


def host(url: str | None) -> str | None:
    found = _HOST.match(url or "")
    return found.group(1).lower().rstrip(".") or None if found else None


def trigrams(text: str) -> np.ndarray:
    """How often each bucket occurs among the trigrams of the text's words with their borders."""
    words = _LETTERS.findall(text.lower())
    counts = np.zeros(BUCKETS, np.int64)
    if not words:
        return counts
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), np.uint32)
    for lo in range(0, len(c) - 2, CHUNK):
        p = c[lo : lo + CHUNK + 2]
        h = p[:-2] * np.uint32(0x9E3779B1) ^ p[1:-1] * np.uint32(0x85EBCA77) ^ p[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        counts += np.bincount(h & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return counts


def _text(value: pa.Scalar) -> str:
    raw = value.as_buffer()
    return "" if raw is None else raw.to_pybytes().decode("utf-8", "replace")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for got in batches:
        for lang, value in zip(got.column(0).to_pylist(), got.column(1)):
            counts = trigrams(_text(value))
            sums[lang] = sums[lang] + counts if lang in sums else counts
    for lang, counts in sums.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and by language the log probability of each bucket, from all labelled
    documents. At most BUCKETS sums for each language reach the driver."""
    lang = F.lower(F.regexp_extract(F.trim("lang"), "^([A-Za-z]{2,3})([^A-Za-z]|$)", 1)).alias("lang")
    rows = docs.select(lang, F.col("text").cast("string").alias("text")).where("lang <> '' AND text IS NOT NULL")
    sums = rows.mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_pylist()
    langs = sorted(set(names))
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS))
    counts[[at[x] for x in names], sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    counts += SMOOTHING
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def _told(langs: list[str], said: tuple[str, ...], right: float) -> np.ndarray:
    """Log likelihood by language of a statement that names some of them."""
    named = np.array([x in said for x in langs])
    if not named.any() or named.all():
        return np.zeros(len(langs))
    return np.where(named, math.log(right / named.sum()), math.log((1 - right) / (~named).sum()))


def _evidence(langs: list[str], logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            hosts, said, texts, sums, own = [], [], [], [], []
            for url, value in zip(got.column(1).to_pylist(), got.column(2)):
                page = _text(value)
                counts = trigrams(page_text(page))
                n = int(counts.sum())
                text = logs @ counts / n * min(n / 3, TEXT_WEIGHT) if n else np.zeros(len(langs))
                hosts.append(host(url))
                said.append(declared(page))
                suffix = SUFFIXES.get((hosts[-1] or "").rpartition(".")[2], ())
                all_ = text + _told(langs, (said[-1],), MARKUP) + _told(langs, suffix, SUFFIX)
                share = np.exp(all_ - all_.max())
                texts.append(langs[int(text.argmax())] if n else None)
                sums.append(all_ - all_.max())
                own.append(np.rint(share / share.sum() * SCALE).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [got.column(0), pa.array(hosts, pa.string()), pa.array(said, pa.string()), pa.array(texts, pa.string()), pa.array(sums, pa.list_(pa.float64())), pa.array(own, pa.list_(pa.int64()))],
                names=["page_id", "host", "declared", "text_lang", "evidence", "own"],
            )

    return run


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, text_lang (by the text alone), lang and probability for every row."""
    of = dict(pages.dtypes)["page_id"]
    langs, logs = fit(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("host"), none.alias("declared"), none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("probability"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = staged(rows.mapInArrow(_evidence(langs, logs), f"page_id {of}, host string, declared string, text_lang string, evidence array<double>, own array<bigint>"), "evidence")

    # the last label of a host; the levels' sums are grouped aggregations
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1))
    sums = [F.count("*").alias("n"), F.array(*(F.sum(F.col("own")[i]) for i in range(len(langs)))).alias("sums")]
    hosts = staged(rows.where("host IS NOT NULL").groupBy("host").agg(*sums), "hosts")
    suffixes = staged(rows.where("suffix IS NOT NULL").groupBy("suffix").agg(*sums), "suffixes").withColumnsRenamed({"n": "suffix_n", "sums": "suffix_sums"})
    whole = rows.agg(*sums).first()
    found = sized_join(sized_join(rows, hosts, ["host"], "left"), suffixes, ["suffix"], "left")

    def others(sums: Column, i: int) -> Column:
        return F.coalesce(sums[i] - F.col("own")[i], F.lit(0)) / F.lit(float(SCALE))

    def smoothed(i: int) -> Column:
        share = ((F.lit((whole["sums"][i] or 0) + SCALE) - F.col("own")[i]) / F.lit(float(SCALE))) / (whole["n"] - 1 + len(langs))
        near = (others(F.col("suffix_sums"), i) + SUFFIX_WEIGHT * share) / (F.coalesce(F.col("suffix_n") - 1, F.lit(0)) + SUFFIX_WEIGHT)
        return (others(F.col("sums"), i) + HOST_WEIGHT * near) / (F.coalesce(F.col("n") - 1, F.lit(0)) + HOST_WEIGHT)

    prior = F.array(*map(smoothed, range(len(langs))))
    found = found.withColumn("scores", F.zip_with("evidence", prior, lambda e, p: e + F.log(p)))
    found = found.withColumn("best", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("best")))
    lang = F.element_at(F.array(*map(F.lit, langs)), F.array_position("scores", F.col("best")).cast("int"))
    return found.select("page_id", "host", "declared", "text_lang", lang.alias("lang"), (1 / total).alias("probability"))
