"""Document fingerprints as invertible Bloom lookup sketches over paragraph digests.

A text's paragraphs (lines, cut further at sentence ends) are digested with XXH64; every digest is
put into one cell of each of three subtables. A cell holds a count, the XOR of its digests and the
XOR of their check values. Sketches of two versions subtract cell by cell, what they share cancels,
and peeling (cells with one digest left give it away, it is taken out of its other cells) recovers
the digests in which the versions differ. If peeling gets stuck, the pair is sketched again, larger:
the digests are dealt into groups with a sketch each, as many as the stuck sketch's counts
estimate to be needed, and groups that get stuck are dealt into smaller ones once more.

Only DataFrame functions are used; a pair's work stays in its row.

Defined cases: a null text counts as empty; empty texts have the empty sketch, and the likeness of
two empty texts is 1; a paragraph repeated within a text counts once; ties of doc_id are ordered by
the text's hash and text; rows with a null doc_id come after all others; the only row of a table is
its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_join, staged

#: Cells of each of the three subtables.
CELLS = 8
TABLES = 3
ROUNDS = 10
#: Differences that a group should hold on average when a sketch is made larger.
PER_GROUP = 11
MAX_GROUPS = {1: 1024, 2: 256}
#: Quantiles of the ids at which buckets are cut.
SEGMENTS = 256
#: Documents of a bucket of the order by doc_id, on average.
BUCKET_ROWS = 1024
#: Where paragraphs end: after a line end or a sentence's last mark.
ENDS = r"(?<=[.!?\n])"


KEYS = "array<bigint>"
CELL_LIST = "array<struct<n:bigint,k:bigint,x:bigint>>"
SIGNED = "array<struct<k:bigint,s:bigint>>"
STATE = f"struct<cells:{CELL_LIST},found:{SIGNED},more:boolean>"


def let(value: Column, body: Callable[[Column], Column], kind: str) -> Column:
    """``body``, of type ``kind``, of a value that is computed once.

    A fold over one element rather than an element of a mapped array: Spark knows a fold's type
    from its start, while an access asks the whole nested expression for it at every row.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def digests(text: Column) -> Column:
    """The different paragraphs' digests."""
    parts = F.filter(F.transform(F.split(text, ENDS), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(key: Column, table: int, level: int) -> Column:
    """The key's cell in a subtable; other bits of the key choose it at every level."""
    return F.shiftrightunsigned(key, (21 * table + 5 * level) % 48).bitwiseAND(F.lit(CELLS - 1))


def _cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.alias("n"), key.alias("k"), check.alias("x"))


def sketch(keys: Column, level: int = 0) -> Column:
    """Cells of all subtables in order."""
    zero = _cell(*[F.lit(0).cast("bigint")] * 3)

    def table(t: int) -> Column:
        def cell(place: Column) -> Column:
            members = F.filter(keys, lambda k: _place(k, t, level) == place)
            return F.aggregate(members, zero, lambda c, k: _cell(c["n"] + 1, c["k"].bitwiseXOR(k), c["x"].bitwiseXOR(_check(k))))

        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(CELLS - 1).cast("bigint")), cell)

    return F.concat(*[table(t) for t in range(TABLES)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: _cell(p["n"] - q["n"], p["k"].bitwiseXOR(q["k"]), p["x"].bitwiseXOR(q["x"])))


def peel(cells: Column, level: int = 0) -> Column:
    """struct(solved, found): the digests with the sign of the version that has them (k, s)."""
    none = F.array().cast(SIGNED)

    def step(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["x"]))
        pure = F.array_distinct(F.transform(single, lambda c: F.struct(c["k"].alias("k"), c["n"].alias("s"))))

        def without(pures: Column) -> Column:
            full = F.transform(pures, lambda p: F.struct(p["k"].alias("k"), p["s"].alias("s"), _check(p["k"]).alias("x"), *[_place(p["k"], t, level).alias(f"p{t}") for t in range(TABLES)]))

            def cleaned(ps: Column) -> Column:
                def table(t: int) -> Column:
                    def cell(c: Column, i: Column) -> Column:
                        return F.aggregate(ps, c, lambda a, p: F.when(p[f"p{t}"] == i, _cell(a["n"] - p["s"], a["k"].bitwiseXOR(p["k"]), a["x"].bitwiseXOR(p["x"]))).otherwise(a))

                    return F.transform(F.slice(state["cells"], CELLS * t + 1, CELLS), cell)

                return F.struct(F.concat(*[table(t) for t in range(TABLES)]).alias("cells"), F.concat(state["found"], pures).alias("found"), (F.size(pures) > 0).alias("more"))

            return let(full, cleaned, STATE)

        on = let(pure, lambda p: F.when(F.size(p) == 0, F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("more"))).otherwise(without(p)), STATE)
        return F.when(state["more"], on).otherwise(state)

    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(True).alias("more"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        step,
        lambda s: F.struct((~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["x"] != 0))).alias("solved"), s["found"].alias("found")),
    )


def _power(n: Column, least: int, most: int) -> Column:
    """The next power of two, within bounds."""
    return F.least(F.greatest(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1.0))))), F.lit(float(least))), F.lit(float(most))).cast("bigint")


def _estimate(cells: Column, a: Column, b: Column) -> Column:
    """Estimated differences: squared counts of a difference's cells add up to them, but for what
    meets in a cell by chance."""
    squares = F.aggregate(cells, F.lit(0.0), lambda s, c: s + c["n"] * c["n"]) / TABLES
    side = (F.size(a) - F.size(b)).cast("double")
    guess = (squares - side * side / CELLS) / (1 - 1 / CELLS)
    return F.least(F.greatest(guess, F.abs(side), F.lit(1.0)), (F.size(a) + F.size(b)).cast("double"))


def _dealt(keys: Column, group: Column, groups: Column, level: int) -> Column:
    """The keys of a group, by bits that don't choose cells at this level."""
    return F.filter(keys, lambda k: F.shiftrightunsigned(k, {1: 50, 2: 34}[level]).bitwiseAND(groups - 1) == group)


def differences(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """Digests that only one of two versions has. ``cells_a`` and ``cells_b`` are the sketches."""
    keys = lambda found: F.transform(found, lambda f: f["k"])

    def larger(a: Column, b: Column, wanted: Column, level: int) -> Column:
        def group(groups: Column) -> Column:
            def one(g: Column) -> Column:
                return let(F.struct(_dealt(a, g, groups, level).alias("a"), _dealt(b, g, groups, level).alias("b")), attempt, KEYS)

            return F.flatten(F.transform(F.sequence(F.lit(0).cast("bigint"), groups - 1), one))

        def attempt(p: Column) -> Column:
            got = peel(subtract(sketch(p["a"], level), sketch(p["b"], level)), level)
            if level == 1:
                size = (F.size(p["a"]) + F.size(p["b"])).cast("double")
                again = larger(p["a"], p["b"], size / 3, 2)
            else:  # digests that meet in all cells, at all sizes
                again = F.concat(F.array_except(p["a"], p["b"]), F.array_except(p["b"], p["a"]))
            return let(got, lambda g: F.when(g["solved"], keys(g["found"])).otherwise(again), KEYS)

        return let(_power(wanted, 2, MAX_GROUPS[level]), group, KEYS)

    def first(cells: Column) -> Column:
        return let(peel(cells), lambda g: F.when(g["solved"], keys(g["found"])).otherwise(larger(a, b, _estimate(cells, a, b) / PER_GROUP, 1)), KEYS)

    return let(subtract(cells_a, cells_b), first, KEYS)


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared digests' part of all, from the two versions' numbers and the recovered differences."""
    total, d = (F.size(a) + F.size(b)).cast("double"), F.size(differing).cast("double")
    return F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d))


def written(cells: Column) -> Column:
    """A sketch as text: base64 of 32-bit counts, 64-bit digests and 32-bit check values."""
    one = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["x"]), 8, "0")))
    return F.base64(F.unhex(F.array_join(one, "")))


def with_next(docs: DataFrame, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending doc_id (after the last,
    the first).

    The order is dealt into buckets of neighbouring ids, by approximate quantiles of the ids, so that
    ids that crowd or lie far out make no large bucket beyond a SEGMENTS-th of the rows. To each bucket a mark is added that
    carries the first text of the next bucket, so a window within buckets sees every successor;
    the texts move once. ``derive`` may add columns that depend on the text; they are computed once
    for every text, and come with next_<name> as well.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / SEGMENTS) for i in range(SEGMENTS)]), F.lit(100 * SEGMENTS))
    low, high, n, cuts = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("*"), cuts).first()
    # segments between quantiles hold about as many rows each, and are cut evenly further
    starts = sorted({low, *cuts}) if low is not None else [0]
    per = max(1, -(-n // (len(starts) * bucket_rows)))
    widths = [max(1, -(-(hi - lo) // per)) for lo, hi in zip(starts, [*starts[1:], (high or 0) + 1])]
    place = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("doc_id"))).alias("place")
    start, width = (F.element_at(F.array(*[F.lit(v).cast("bigint") for v in vs]), F.col("place")) for vs in (starts, widths))
    docs = docs.withColumn("place", F.when(F.col("doc_id").isNotNull(), place)).withColumns({"start": start, "width": width})
    docs = docs.withColumn("bucket", F.coalesce(F.expr(f"place * {per}L + (doc_id - start) div width"), F.lit(-2).cast("bigint"))).select("doc_id", "text", "bucket")
    bucket = F.col("bucket")

    tops = staged(docs.groupBy(bucket).agg(F.max("doc_id").alias("top")), "tops")
    block = F.floor(F.col("bucket") / bucket_rows)
    within = Window.partitionBy("block").orderBy(F.desc("bucket"))
    near = tops.select("bucket", block.alias("block")).withColumn("after", F.lead("bucket").over(within))
    blocks = tops.groupBy(block.alias("block")).agg(F.max("bucket").alias("first"))  # one row for a million documents
    over = Window.orderBy(F.desc("block"))
    wrap = F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    blocks = blocks.select("block", F.coalesce(F.lead("first").over(over), wrap).alias("jump"))
    follows = near.join(blocks, "block").select("bucket", F.coalesce("after", "jump").alias("after"))

    heads = sized_join(docs.withColumn("top", F.coalesce("doc_id", F.lit(low or 0))), tops.select("bucket", F.coalesce("top", F.lit(low or 0)).alias("top")), ["bucket", "top"])
    heads = heads.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("head"))
    marks = staged(follows.join(heads.withColumnRenamed("bucket", "after"), "after").select("bucket", F.col("head.text").alias("text")), "marks")

    own = docs.select(bucket, "doc_id", "text", F.lit(1).alias("real"))
    marks = marks.select("bucket", F.lit(None).cast("bigint").alias("doc_id"), "text", F.lit(0).alias("real"))
    rows = derive(own).unionByName(derive(marks))
    carried = [c for c in rows.columns if c not in ("bucket", "doc_id", "real")]
    order = Window.partitionBy("bucket").orderBy(F.desc("real"), F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")), F.desc("text"))
    after = F.lead(F.struct(*carried)).over(order).alias("after")
    return rows.select("doc_id", "real", *carried, after).where("real = 1").select("doc_id", *carried, *[F.col(f"after.{c}").alias(f"next_{c}") for c in carried])


def edited(text: Column, other: Column) -> Column:
    """The text with its last third replaced by as many code points of another's beginning."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(other, F.lit(1), third))


def compare_versions(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, text, edited (its edited version), next_text; the sketches ``cells``
    and ``edited_cells``; the recovered ``edited_differs`` and ``next_differs``; and the
    likenesses near_edited and near_next."""
    def sketched(rows: DataFrame, of: str = "text", prefix: str = "") -> DataFrame:
        rows = rows.withColumn(f"{prefix}keys", digests(F.col(of)))
        return rows.withColumn(f"{prefix}cells", sketch(F.col(f"{prefix}keys")))

    rows = with_next(docs, sketched).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = sketched(rows, "edited", "edited_")
    pairs = [differences(F.col("keys"), F.col(f"{p}keys"), F.col("cells"), F.col(f"{p}cells")).alias(f"{p}differs") for p in ("edited_", "next_")]
    return rows.select("*", *pairs).select(
        "*",
        *[likeness(F.col("keys"), F.col(f"{p}_keys"), F.col(f"{p}_differs")).alias(f"near_{p}") for p in ("edited", "next")],
    )
