"""Secret scanning with a trigram inverted index.

From every rule's regular expression a Boolean query over lower-case trigrams is derived (a
conjunction of clauses, each a choice of trigram sets). Documents are indexed in blocks: the
postings of a block hold, for each trigram that some query names, the documents with it. Queries
intersect postings, and only candidates are verified with the expression itself. Rules without a
mandatory trigram scan every document.

Defined cases: null and empty texts have no findings; texts are scanned whole; repeated rows and
null ids are reported once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A kind of secret. ``group`` of a match must have ``least`` characters, else it is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, in the order that breaks ties of spans.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("bearer", r"(?i:authorization: bearer) ([A-Za-z0-9._~+/-]{16,}=*)"),
)
RULES = BASE_RULES + MORE_RULES
#: A choice of literals wider than this ends the literal run (the query only gets weaker).
MAX_CHOICES = 64
BLOCK_BYTES = 8 << 20


def _trigrams(text: str) -> frozenset[bytes]:
    raw = text.encode().lower()
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


def _class_members(items) -> set[str] | None:
    """The lower-case characters of a small character class, or None."""
    found: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            found.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """Clauses that every text with a match fulfils; of each clause one trigram set is contained.

    An empty list means that nothing is mandatory and the rule has to scan.
    """
    clauses: list[list[frozenset[bytes]]] = []

    def close(run: set[str]) -> set[str]:
        sets = {_trigrams(s) for s in run}
        if run and all(sets):
            least = [s for s in sets if not any(o < s for o in sets)]
            clauses.append(sorted(least, key=sorted))
        return {""}

    def walk(items, run: set[str]) -> set[str]:
        """Strings that end at this place; {""} after an interruption."""
        for op, value in items:
            more: set[str] | None = None
            if op is sre.LITERAL:
                more = {chr(value).lower()}
            elif op is sre.IN:
                more = _class_members(value)
            elif op is sre.SUBPATTERN:
                run = walk(value[3], run)
                continue
            elif op is sre.BRANCH:
                exact = [literals(list(b)) for b in value[1]]
                more = set().union(*exact) if all(e is not None for e in exact) else None
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, sub = value
                once = literals(list(sub))
                if (low, high) == (0, 1) and once is not None:
                    more = once | {""}
                elif low and once is not None and low == high and len(once) == 1:
                    more = {once.pop() * low}
                elif low:
                    if once is not None and len(once) * len(run) <= MAX_CHOICES:
                        run = {a + b for a in run for b in once}
                    run = close(run)
                    continue
            elif op is sre.AT:
                continue
            if more is None or len(more) * len(run) > MAX_CHOICES:
                run = close(run)
            else:
                run = {a + b for a in run for b in more}
        return run

    def literals(items) -> set[str] | None:
        """All strings of an expression if they are few, else None."""
        out = {""}
        for op, value in items:
            if op is sre.LITERAL:
                more = {chr(value).lower()}
            elif op is sre.IN:
                more = _class_members(value)
            elif op is sre.SUBPATTERN:
                more = literals(list(value[3]))
            elif op is sre.BRANCH:
                parts = [literals(list(b)) for b in value[1]]
                more = set().union(*parts) if all(p is not None for p in parts) else None
            elif op is sre.MAX_REPEAT and value[0] == 0 and value[1] == 1:
                once = literals(list(value[2]))
                more = once | {""} if once is not None else None
            else:
                more = None
            if more is None or len(out) * len(more) > MAX_CHOICES:
                return None
            out = {a + b for a in out for b in more}
        return out

    close(walk(list(sre_parser.parse(pattern)), {""}))
    return clauses


def find(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans of a rule in a text: leftmost, not overlapping; short matches are consumed, then dropped."""
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


class BlockIndex:
    """Postings of a block of texts for a fixed vocabulary of trigrams."""

    def __init__(self, vocabulary: frozenset[bytes]):
        self.codes = np.sort(np.array([t[0] | t[1] << 8 | t[2] << 16 for t in vocabulary], np.uint32))
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[self.codes & 0xFFFF] = True

    def build(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        """For each trigram the ascending numbers of the texts that hold it."""
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        if len(data) < 3 or not len(self.codes):
            return {}
        ends = np.cumsum([len(t) for t in texts])
        at = np.flatnonzero(self.pairs[data[:-2] | data[1:-1].astype(np.uint16) << 8])
        code = data[at] | data[at + 1].astype(np.uint32) << 8 | data[at + 2].astype(np.uint32) << 16
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        doc = np.searchsorted(ends, at, "right")
        keep = (self.codes[place] == code) & (at + 2 < ends[doc])
        both = np.unique(place[keep].astype(np.int64) << 32 | doc[keep])
        terms, docs = both >> 32, both & 0xFFFFFFFF
        cuts = np.searchsorted(terms, np.arange(len(self.codes) + 1))
        return {int(c).to_bytes(3, "little"): docs[cuts[i] : cuts[i + 1]] for i, c in enumerate(self.codes)}


def candidates(query: list[list[frozenset[bytes]]], postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """Texts that fulfil all clauses, by intersecting and uniting postings."""
    none = np.array([], np.int64)
    found = None
    for clause in query:
        some = none
        for trigrams in clause:
            lists = sorted((postings.get(t, none) for t in trigrams), key=len)
            here = lists[0]
            for other in lists[1:]:
                here = np.intersect1d(here, other, assume_unique=True)
            some = np.union1d(some, here)
        found = some if found is None else np.intersect1d(found, some, assume_unique=True)
    return none if found is None else found


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = [re.compile(r.pattern, re.ASCII) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        index = BlockIndex(frozenset(t for q in queries for clause in q for ts in clause for t in ts))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

        def block(texts: list[bytes]) -> list[list[dict]]:
            postings, whole = index.build(texts), [t.decode("utf-8", "replace") for t in texts]
            found: list[list[tuple]] = [[] for _ in texts]
            for k, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
                for d in candidates(query, postings).tolist() if query else range(len(texts)):
                    found[d] += [(a, k, b) for a, b in find(rule, regex, whole[d])]
            return [[{"kind": rules[k].kind, "start": a, "end": b, "value": whole[d][a:b]} for a, k, b in sorted(f)] for d, f in enumerate(found)]

        for got in batches:
            out, some, size = [], [], 0
            for i in range(got.num_rows):
                value = got.column(1)[i].as_buffer()
                some.append(b"" if value is None else value.to_pybytes())
                size += len(some[-1])
                if size >= BLOCK_BYTES:
                    out += block(some)
                    some, size = [], 0
            out += block(some) if some else []
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(out, kind)], names=["doc_id", "findings"])

    return scan


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and findings (array of kind, start, end, value), by start and then rule order.
    Offsets are code points, ends exclusive."""
    of = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {of}, findings array<struct<kind:string,start:bigint,end:bigint,value:string>>"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scanner(rules), schema)
