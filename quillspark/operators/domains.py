"""Everyday domain tables: job search, contacts, household, calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import any_ilike, overlaps_week
from . import patterns


def pipeline_join(interviews: DataFrame, applications: DataFrame, postings: DataFrame, companies: DataFrame) -> DataFrame:
    """Interviews with their application, posting and company."""
    return interviews.join(applications, "application_id").join(postings, "posting_id").join(companies, "company_id")


def with_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows with the row that their key names as a struct, null where there is none."""
    named = parents.select(key, F.struct(*[c for c in parents.columns if c != key]).alias(f"{key}_row"))
    return rows.join(named, key, "left")


def status_breakdown(rows: DataFrame, key: str = "status") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def search_contacts(contacts: DataFrame, q: str, columns: list[str], tags: list[str] | None = None) -> DataFrame:
    rows = contacts.where(any_ilike([F.col(c) for c in columns], q))
    return rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else rows


def search_jobs(contacts: DataFrame, companies: DataFrame, q: str, columns: list[str]) -> DataFrame:
    """Contacts that hold the query themselves or whose company does."""
    firms = companies.where(any_ilike([F.col("company_name")], q)).select("company_id", F.lit(True).alias("firm")).distinct()
    return contacts.join(firms, "company_id", "left").where(any_ilike([F.col(c) for c in columns], q) | F.coalesce("firm", F.lit(False))).drop("firm")


def follow_ups(contacts: DataFrame, today: date, days: int = 7) -> DataFrame:
    due = F.col("follow_up_date")
    state = F.when(due < F.lit(today), "overdue").when(due <= F.date_add(F.lit(today), days), "upcoming")
    return contacts.withColumn("state", state).where("state IS NOT NULL")


def week(activities: DataFrame, first: date, last: date) -> DataFrame:
    return activities.where(overlaps_week(F.col("start_date"), F.col("end_date"), F.col("day_of_week"), first, last))


def upcoming(rows: DataFrame, column: str, today: date, days: int) -> DataFrame:
    return rows.where(F.col(column).between(F.lit(today), F.date_add(F.lit(today), days))).orderBy(column)


def recipes_with(recipes: DataFrame, ingredient: str) -> DataFrame:
    return recipes.where(F.exists("ingredients", lambda i: i["name"] == ingredient))


def match_people(mentions: DataFrame, people: DataFrame) -> DataFrame:
    """mention, person by the first stage that finds one: name or alias, first name, or first name
    within the other's first name; the smallest id of several."""
    first = lambda c: F.lower(F.split(F.trim(c), r"\s+")[0])
    known = people.select("id", F.explode(F.transform(F.array_append("aliases", F.col("name")), F.lower)).alias("n"))
    rows = mentions.select("mention", F.lower(F.trim("mention")).alias("n"), first(F.col("mention")).alias("f"))
    exact = known.groupBy("n").agg(F.min("id").alias("by_name"))
    firsts = people.select("id", first(F.col("name")).alias("f")).where(F.length("f") >= 3)
    given = firsts.groupBy("f").agg(F.min("id").alias("by_first"))
    # an automaton over the first names that are asked for reads the known ones
    asked = rows.where(F.length("f") >= 3).select(F.col("f").alias("pattern"))
    within = patterns.contained(firsts, asked, text="f").groupBy(F.col("pattern").alias("f")).agg(F.min("id").alias("by_part"))
    return rows.join(exact, "n", "left").join(given, "f", "left").join(within, "f", "left").select("mention", F.coalesce("by_name", "by_first", "by_part").alias("person"))
