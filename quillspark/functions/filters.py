"""Predicates that keep the null behaviour of the store they come from."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Json = dict | list | str | int | float | bool | None


def contains(struct: Column, wanted: Json) -> Column:
    """Containment of a literal document: all its keys and list items are there; {} fits all."""
    if isinstance(wanted, dict):
        parts = [contains(struct[k], v) for k, v in wanted.items()]
        return reduce(Column.__and__, parts, F.lit(True))
    if isinstance(wanted, list):
        return reduce(Column.__and__, [F.coalesce(F.array_contains(struct, F.lit(v)), F.lit(False)) for v in wanted], struct.isNotNull())
    return struct.isNull() if wanted is None else F.coalesce(struct == F.lit(wanted), F.lit(False))


def equal_if(column: Column, value) -> Column:
    """Equality, or no condition where no value is given."""
    return F.lit(True) if value is None else column == F.lit(value)


def differs(column: Column, value) -> Column:
    """IS DISTINCT FROM: nulls are kept."""
    return ~column.eqNullSafe(F.lit(value))


def within_days(ts: Column, as_of: datetime | Column, days: int) -> Column:
    """Rolling window back from ``as_of``; no condition for days of 0 or less."""
    if days <= 0:
        return F.lit(True)
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return ts >= end - F.make_dt_interval(F.lit(days))


def within_hours(ts: Column, as_of: datetime | Column, hours: int) -> Column:
    """As within_days, by hours."""
    if hours <= 0:
        return F.lit(True)
    end = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return ts >= end - F.make_dt_interval(F.lit(0), F.lit(hours))


def not_among(column: Column, excluded: tuple | None) -> Column:
    """Values outside a set; nulls stay, and without a set all do."""
    return F.lit(True) if not excluded else ~F.coalesce(column.isin(*excluded), F.lit(False))


def before_cursor(ts: Column, key: Column, last_ts, last_key) -> Column:
    """Keyset pagination, newest first."""
    return (ts < F.lit(last_ts)) | ((ts == F.lit(last_ts)) & (key < F.lit(last_key)))


def after_id(rows: DataFrame, key: str, last: int, n: int) -> DataFrame:
    """The next ``n`` rows after an id, in its order."""
    return rows.where(F.col(key) > F.lit(last)).orderBy(key).limit(n)


def any_ilike(columns: list[Column], q: str) -> Column:
    return reduce(Column.__or__, [F.coalesce(c.ilike(f"%{q}%"), F.lit(False)) for c in columns])


def overlaps_week(start: Column, end: Column, weekly: Column, first, last) -> Column:
    """Date ranges that touch a week (open ends count), and everything that recurs weekly."""
    return ((start <= F.lit(last)) & (end.isNull() | (end >= F.lit(first)))) | weekly.isNotNull()


def in_scope(row, workspace: str, project: str | None = None, project_only: bool = False, stale: bool = False, unconfirmed: bool = False, personal: bool = False) -> Column:
    """What a memory recall may see."""
    ok = row["workspace_id"] == workspace
    if project_only and project is not None:
        ok &= row["project_id"].eqNullSafe(F.lit(project))
    if not stale:
        ok &= ~F.coalesce(row["lifecycle_status"].isin("stale", "superseded", "rejected", "disputed"), F.lit(False))
    if not unconfirmed:
        ok &= ~F.coalesce(row["requires_user_confirmation"] & (row["review_status"] == "pending"), F.lit(False))
    if not personal:
        ok &= differs(row["visibility"], "personal")
    return ok


def capped(n: int, most: int) -> int:
    return max(1, min(n, most))


def parsed_words(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-search query as alternatives of parts that must all hold: (wanted, words); the words of a
    part stand in sequence. Words are all wanted, "phrases" in sequence, OR gives a choice, a dash
    excludes. Parts without a word are left out, as are alternatives without a part."""
    groups: list[list[tuple[bool, list[str]]]] = [[]]
    for sign, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not sign:
            groups.append([])
        elif re.search(r"\w", phrase or word):
            groups[-1].append((not sign, [w for w in re.split(r"[^\w]+", (phrase or word).lower()) if w]))
    return [g for g in groups if g]


def word_query(query: str, tokens: Column) -> Column:
    """Whether an array of tokens fits a web-search query; an empty query fits nothing."""

    def one(ws: list[str]) -> Column:
        if len(ws) > 1:
            joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
            return joined.contains(f" {' '.join(ws)} ")
        return F.array_contains(tokens, ws[0])

    groups = [[one(ws) if wanted else ~one(ws) for wanted, ws in g] for g in parsed_words(query)]
    if not groups:
        return F.lit(False)
    return F.coalesce(reduce(Column.__or__, [reduce(Column.__and__, g) for g in groups]), F.lit(False))


def memory_score(row, similarity: Column) -> Column:
    """Recall rank: similarity plus provenance, policy, review state and confidence."""
    by = lambda c, table, rest: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(table.items())[1:], F.when(c == next(iter(table)), next(iter(table.values())))).otherwise(rest)
    provenance = by(row["provenance_status"], {"user_confirmed": 0.3, "imported": 0.22, "observed": 0.15, "generated": 0.05}, 0.0)
    policy = F.when(row["can_use_as_instruction"], 0.2).when(row["can_use_as_evidence"], 0.08).otherwise(-0.2)
    review = by(row["review_status"], {"confirmed": 0.15, "evidence_only": 0.05, "pending": -0.08}, -0.25)
    return similarity + provenance + policy + review + F.coalesce(row["confidence"], F.lit(0.0)) * 0.15
