"""Entities, co-occurrence, neighbourhoods, paths and provenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.filters import within_days
from . import patterns


def pair(a: str, b: str) -> list[Column]:
    """The undirected normal form of a pair."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def dominant_classification(links: DataFrame, thoughts: DataFrame) -> DataFrame:
    """work or personal, whichever an entity's thoughts have more of; null for as many of both."""
    both = links.join(thoughts.select(F.col("id").alias("thought_id"), "classification"), "thought_id")
    n = lambda v: F.count_if(F.col("classification") == v)
    counts = both.groupBy("entity_id").agg(n("work").alias("n_work"), n("personal").alias("n_personal"))
    main = F.when(F.col("n_work") > F.col("n_personal"), "work").when(F.col("n_work") < F.col("n_personal"), "personal")
    return counts.withColumn("dominant", main)


def scoped(thoughts: DataFrame, as_of: datetime | None = None, days: int = 0, classification: str | None = None) -> DataFrame:
    """Ids of the thoughts of a window and a class."""
    rows = thoughts if as_of is None else thoughts.where(within_days(F.col("created_at"), as_of, days))
    rows = rows if classification is None else rows.where(F.col("classification") == classification)
    return rows.select(F.col("id").alias("thought_id"))


def top_entities(links: DataFrame, thoughts: DataFrame, entities: DataFrame, as_of: datetime, days: int = 90, most: int = 30, classification: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """The entities with the most links to thoughts of a window (and class), and their dominant
    class; without excluded types, entities without a type stay. The few best are found before
    anything is joined to them."""
    counts = links.join(scoped(thoughts, as_of, days, classification), "thought_id").groupBy("entity_id").agg(F.count("*").alias("mentions"))
    if excluded:
        counts = counts.join(entities.where(F.col("entity_type").isin(*excluded)).select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    few = F.broadcast(counts.orderBy(F.desc("mentions"), "entity_id").limit(most))  # at most ``most`` rows
    main = dominant_classification(links.join(few.select("entity_id"), "entity_id", "left_semi"), thoughts)
    return entities.join(few, entities.id == F.col("entity_id")).join(main, "entity_id", "left").select("entity_id", "name", "mentions", "dominant")


def co_occurrence(links: DataFrame, least: int = 1, ids: list[int] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """Pairs of entities (of ``ids``, if given) by the number of thoughts (of ``scope``) that link both."""
    rows = links if ids is None else links.where(F.col("entity_id").isin(ids))
    rows = rows if scope is None else rows.join(scope, "thought_id", "left_semi")
    a = rows.select("thought_id", F.col("entity_id").alias("a"))
    b = rows.select("thought_id", F.col("entity_id").alias("b"))
    return a.join(b, "thought_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def focus_neighbors(links: DataFrame, edges: DataFrame, focus: list[int], least: int = 1, most: int = 100, scope: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Entities that share thoughts (of ``scope``) or edges with the focus, by the stronger of both
    weights; without the ``excluded`` entities (id)."""
    links = links if scope is None else links.join(scope, "thought_id", "left_semi")
    wanted = F.col("entity_id").isin(focus)
    theirs = links.where(wanted).select("thought_id").distinct()
    shared = links.join(theirs, "thought_id", "left_semi").where(~wanted).groupBy("entity_id").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)
    out = edges.where(F.col("from_entity_id").isin(focus)).select(F.col("to_entity_id").alias("entity_id"), "support_count")
    back = edges.where(F.col("to_entity_id").isin(focus)).select(F.col("from_entity_id").alias("entity_id"), "support_count")
    linked = out.union(back).where(~wanted).groupBy("entity_id").agg(F.max("support_count").cast("bigint").alias("weight"))
    both = shared.unionByName(linked)
    if excluded is not None:
        both = both.join(excluded.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    return both.groupBy("entity_id").agg(F.max("weight").alias("weight")).orderBy(F.desc_nulls_last("weight"), "entity_id").limit(most)


def inferred_edges(edges: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Undirected inferred and manual edges, weight at least 1."""
    rows = edges.where(F.col("source").isin("inferred", "manual"))
    if ids is not None:
        rows = rows.where(F.col("from_entity_id").isin(ids) & F.col("to_entity_id").isin(ids))
    return rows.select(*pair("from_entity_id", "to_entity_id"), F.greatest("support_count", F.lit(1)).alias("weight"), "relation", "source")


def constellation(co: DataFrame, curated: DataFrame) -> DataFrame:
    """One edge for each pair: co-occurrence first, then the strongest curated one."""
    both = co.select("a", "b", "weight", F.lit("co_occurs").alias("relation"), F.lit(0).alias("rank"))
    both = both.unionByName(curated.select("a", "b", F.col("weight").cast("bigint").alias("weight"), "relation", F.lit(1).alias("rank")))
    best = F.min_by(F.struct("weight", "relation"), F.struct("rank", (-F.col("weight")).alias("w"), "relation"))
    return both.groupBy("a", "b").agg(best.alias("e")).select("a", "b", "e.*")


#: Prefixes up to which thoughts meet by two common items at once.
PAIR_PREFIX = 24


def overlap_pairs(links: DataFrame, least: int = 2, key: str = "thought_id", item: str = "entity_id") -> DataFrame:
    """Pairs of thoughts with at least ``least`` different entities in common: a, b, shared.

    Join with prefix filtering. Each thought's items are ordered by rising frequency. Two sets with
    ``least`` common items have the first of these among their first size - least + 1 items, and the
    first two among one more; so thoughts meet there only, and frequent items, which stand last, are
    looked up in the sets but seldom joined on. Short prefixes meet by two items at once, where
    groups are far smaller; a pair counts where these are its first common ones, so it is found
    once. With a long set on either side the first item alone is the meeting place.

    A thought's items are gathered in one row. Null ids and items are left out, repeated links count
    once."""
    least = max(1, least)
    links = links.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("t"), F.col(item).alias("i")).distinct()
    counts = links.groupBy("i").agg(F.count("*").alias("n"))
    sets = links.join(counts, "i").groupBy("t").agg(F.array_sort(F.collect_list(F.struct("n", "i"))).alias("s")).where(F.size("s") >= least)
    sets = sets.select("t", F.col("s.i").alias("s"))
    two = least >= 2
    reach = F.size("s") - least + (2 if two else 1)
    rows = sets.withColumn("prefix", F.slice("s", F.lit(1), reach)).checkpoint()
    long = F.size("prefix") > PAIR_PREFIX if two else F.lit(True)

    def meet(x: DataFrame, y: DataFrame, on: list[str], size: int) -> DataFrame:
        both = x.select(F.col("t").alias("a"), F.col("s").alias("sa"), F.col("prefix").alias("pa"), *on).join(y.select(F.col("t").alias("b"), F.col("s").alias("sb"), F.col("prefix").alias("pb"), *on), on)
        first = F.array_intersect("pa", "pb")  # in order
        return both.where(F.slice(first, 1, size) == F.array(*on)).withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("bigint")).where(F.col("shared") >= least).select("a", "b", "shared")

    single = lambda df: df.select("t", "s", "prefix", F.explode("prefix").alias("k1"))
    found = []
    if two:
        pairs = F.expr("flatten(transform(slice(prefix, 1, size(prefix) - 1), (x, n) -> transform(slice(prefix, n + 2, size(prefix)), y -> struct(x AS k1, y AS k2))))")
        short = rows.where(~long).select("t", "s", "prefix", F.inline(pairs))
        found.append(meet(short, short, ["k1", "k2"], 2).where("a < b"))
    longs = rows.where(long)
    if not two or longs.limit(1).count():
        one = single(longs)
        found.append(meet(one, one, ["k1"], 1).where("a < b"))
        if two:
            found.append(meet(single(rows.where(~long)), one, ["k1"], 1).select(*pair("a", "b"), "shared"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def connections(items: DataFrame, source_id: int, most: int = 20) -> DataFrame:
    """Thoughts that share list items with one thought, by the number of shared ones."""
    own = F.broadcast(items.where(F.col("thought_id") == source_id).select("item").distinct())  # one thought's items
    found = items.where(F.col("thought_id") != source_id).dropDuplicates(["thought_id", "item"]).join(own, "item")
    return found.groupBy("thought_id").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "thought_id").limit(most)


def thought_connections(thoughts: DataFrame, source_id, most: int = 20, exclude_restricted: bool = True) -> DataFrame:
    """Thoughts that share topics or people with one thought: the shared ones, a preview, and their
    number; ties by the newer one. Leaving out restricted rows leaves out those without a tier too."""
    empty = F.array().cast("array<string>")
    own = thoughts.where(F.col("id") == source_id).select(F.coalesce("topics", empty).alias("own_topics"), F.coalesce("people", empty).alias("own_people"))
    rows = thoughts.where(F.col("id") != source_id)
    rows = rows.where(F.col("sensitivity_tier") != "restricted") if exclude_restricted else rows
    both = lambda c: F.filter(F.coalesce(c, empty), lambda x: F.array_contains(f"own_{c}", x))
    rows = rows.crossJoin(F.broadcast(own.limit(1))).withColumns({"shared_topics": both("topics"), "shared_people": both("people")})  # one row
    rows = rows.withColumn("overlap", F.size("shared_topics") + F.size("shared_people")).where("overlap > 0")
    return rows.select("id", "type", "importance", F.substring("content", 1, 200).alias("preview"), "created_at", "shared_topics", "shared_people", "overlap").orderBy(F.desc("overlap"), F.desc("created_at"), F.desc("id")).limit(most)


def neighbors(nodes: DataFrame, edges: DataFrame, node, direction: str = "both", relation: str | None = None) -> DataFrame:
    """Nodes one edge away, in, out or both, with the edge's relation and the node's label."""
    rows = edges if relation is None else edges.where(F.col("relationship_type") == relation)
    out = rows.where(F.col("source_node_id") == node).select(F.col("target_node_id").alias("node"), "relationship_type", F.lit("out").alias("direction"))
    back = rows.where(F.col("target_node_id") == node).select(F.col("source_node_id").alias("node"), "relationship_type", F.lit("in").alias("direction"))
    found = {"out": out, "in": back}.get(direction) or out.union(back)
    return found.join(nodes.select(F.col("id").alias("node"), "label"), "node", "left")


def with_entities(thoughts: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Thoughts with the list of their entities (id, name), in order."""
    named = links.join(thoughts.select(F.col("id").alias("thought_id")), "thought_id", "left_semi").join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    listed = named.groupBy(F.col("thought_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("entity_id", "name"))).alias("entities"))
    return thoughts.join(listed, "id", "left")


def recent_entities(links: DataFrame, thoughts: DataFrame, entities: DataFrame, newest: int = 8, most: int = 6) -> DataFrame:
    """The entities that the newest thoughts mention most."""
    few = F.broadcast(thoughts.orderBy(F.desc("created_at"), F.desc("id")).limit(newest).select(F.col("id").alias("thought_id")))  # at most ``newest`` rows
    counts = links.join(few, "thought_id").groupBy("entity_id").agg(F.count("*").alias("n"))
    return counts.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id").orderBy(F.desc("n"), "entity_id").limit(most)


def batch_candidates(entities: DataFrame, links: DataFrame, least: int, most: int) -> DataFrame:
    """The entities seen last among those with enough links."""
    n = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("links")).where(F.col("links") >= least)
    return entities.join(n, "id").orderBy(F.desc_nulls_last("last_seen_at"), "id").limit(most)


def adjacency(edges: DataFrame, entities: DataFrame, node: int) -> DataFrame:
    """Edges in both directions, each once, with the other end's name."""
    out = edges.where(F.col("from_entity_id") == node).select("id", F.lit("out").alias("direction"), F.col("to_entity_id").alias("other"), "relation", "support_count")
    back = edges.where((F.col("to_entity_id") == node) & (F.col("from_entity_id") != node)).select("id", F.lit("in").alias("direction"), F.col("from_entity_id").alias("other"), "relation", "support_count")
    return out.union(back).join(entities.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other", "left")


def unlinked(entities: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("id")).distinct()
    return entities.join(ends, "id", "left_anti")


def traverse(spark: SparkSession, edges: DataFrame, start, depth: int = 3, relation: str | None = None) -> DataFrame:
    """All simple directed paths from a node: node, depth, path. Parallel edges count as paths."""
    rows = edges if relation is None else edges.where(F.col("relationship_type") == relation)
    rows = rows.select(F.col("source_node_id").alias("src"), F.col("target_node_id").alias("dst"))
    front = rows.where(F.col("src") == F.lit(start)).where("src <> dst").select(F.col("dst").alias("node"), F.lit(1).alias("depth"), F.array("src", "dst").alias("path"))
    found = front
    for level in range(2, depth + 1):
        front = front.join(rows, front.node == rows.src).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.lit(level).alias("depth"), F.array_append("path", F.col("dst")).alias("path"))
        found = found.union(front)
    return found


def shortest_path(edges: DataFrame, start, goal, most: int = 6) -> list | None:
    """Nodes of a shortest undirected path, by layers: of equal ones each step takes the smallest
    parent. None if it is longer than ``most``; only the frontier's size and the path reach the driver."""
    if start == goal:
        return [start]
    rows = edges.select("source_node_id", "target_node_id")
    both = rows.union(rows.select("target_node_id", "source_node_id")).toDF("src", "dst").distinct().persist()
    try:
        front = both.sparkSession.createDataFrame([(start,)], f"node {dict(both.dtypes)['src']}")
        seen, parents = front, []
        for _ in range(most):
            step = front.join(both, front.node == both.src).groupBy("dst").agg(F.min("src").alias("parent")).withColumnRenamed("dst", "node")
            step = step.join(seen, "node", "left_anti").checkpoint()
            parents.append(step)
            if step.where(F.col("node") == F.lit(goal)).limit(1).count():
                path = [goal]
                for layer in reversed(parents):
                    path.append(layer.where(F.col("node") == F.lit(path[-1])).first()["parent"])
                return path[::-1]
            front = step.select("node")
            if not front.limit(1).count():
                return None
            seen = seen.union(front)
        return None
    finally:
        both.unpersist()


def distances(edges: DataFrame, start, most: int = 6) -> DataFrame:
    """Least number of undirected steps from a node to every node within ``most``."""
    rows = edges.select("source_node_id", "target_node_id")
    both = rows.union(rows.select("target_node_id", "source_node_id")).toDF("src", "dst").distinct()
    seen = both.sparkSession.createDataFrame([(start, 0)], f"node {dict(both.dtypes)['src']}, distance int")
    front = seen
    for d in range(1, most + 1):
        front = front.join(both, front.node == both.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(d)).checkpoint()
        if not front.limit(1).count():
            break
        seen = seen.union(front)
    return seen


def provenance(thoughts: DataFrame, root, depth: int = 3, most: int = 250) -> DataFrame:
    """Upward walk over derived_from: id, parent, depth, cycle. A parent that is already on the
    path is reported as a cycle and not followed; restricted content is withheld."""
    depth, most = max(1, min(depth, 10)), max(1, min(most, 2000))
    links = thoughts.select(F.col("id").alias("child"), F.explode("derived_from").alias("up"))
    walk = thoughts.where(F.col("id") == F.lit(root)).select("id", F.lit(None).cast(dict(thoughts.dtypes)["id"]).alias("parent"), F.lit(0).alias("depth"), F.lit(False).alias("cycle"), F.array("id").alias("path"))
    found = walk
    for level in range(1, depth + 1):
        up = walk.where("NOT cycle").join(links, F.col("id") == F.col("child"))
        walk = up.select(F.col("up").alias("id"), F.col("child").alias("parent"), F.lit(level).alias("depth"), F.array_contains("path", F.col("up")).alias("cycle"), F.array_append("path", F.col("up")).alias("path"))
        found = found.union(walk)
    info = thoughts.select("id", F.when(~F.col("sensitivity_tier").eqNullSafe(F.lit("restricted")), F.col("content")).alias("content"), (F.col("sensitivity_tier") == "restricted").alias("restricted"))
    return found.drop("path").join(info, "id", "left").orderBy("depth", "id", "parent").limit(most)


def derivatives(thoughts: DataFrame, source, most: int = 100) -> DataFrame:
    rows = thoughts.where(F.array_contains("derived_from", F.lit(source)) & ~F.col("sensitivity_tier").eqNullSafe(F.lit("restricted")))
    return rows.orderBy(F.desc("created_at"), "id").limit(max(1, min(most, 500)))


def topic_pairs(topics: DataFrame) -> DataFrame:
    """Links (a, b) between topics (id, name) whose normal forms are alike: equal, one a word of the
    other or within twice its length, or a typo apart.

    No link is missed, and names are looked up, not compared with all others. An automaton over all
    names finds those that a name holds. Names a typo apart are equal after deleting, in each, as many
    letters as the typo has; only names of 4 to 25 letters can be. Topics of equal names are tied to
    the one with the smallest id, which stands for them in the other links.
    """
    norm = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " "))
    rows = topics.select("id", norm.alias("norm")).where("norm <> ''")
    names = rows.groupBy("norm").agg(F.min("id").alias("first")).checkpoint()

    part = patterns.contained(names, names.where("length(norm) >= 3"), "norm", "norm", "norm", share=0.5)
    part = part.where("norm <> pattern").select(F.col("pattern").alias("x"), F.col("norm").alias("y"))

    cut = lambda s: f"transform(sequence(1, length({s})), i -> concat(left({s}, i - 1), substring({s}, i + 1)))"
    one = f"concat(array(norm), {cut('norm')})"
    two = f"concat({one}, flatten(transform({cut('norm')}, v -> {cut('v')})))"
    # a name of 8 letters may have one of 10, and so two typos
    keys = F.expr(f"array_distinct(CASE WHEN length(norm) >= 8 THEN {two} ELSE {one} END)")
    short = names.where("length(norm) BETWEEN 4 AND 25").select("norm", F.explode(keys).alias("key"))
    typo = short.withColumnRenamed("norm", "x").join(short.withColumnRenamed("norm", "y"), "key").where("x < y").select("x", "y").distinct()
    d = F.levenshtein("x", "y")
    typo = typo.where((d <= 2) & (d / F.greatest(F.length("x"), F.length("y")) <= 0.2))

    alike = part.unionByName(typo).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = alike.join(names.select(F.col("first").alias("i"), F.col("norm").alias("x")), "x").join(names.select(F.col("first").alias("j"), F.col("norm").alias("y")), "y")
    equal = rows.join(names, "norm").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return both.select(*pair("i", "j")).unionByName(equal)


def components(edges: DataFrame, most: int = 30) -> DataFrame:
    """node, root: the smallest node reachable over edges (a, b), by spreading the smallest label
    and following labels of labels; checkpointed each round."""
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node").checkpoint()
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near, labels.node == near.a).select("node", F.least("root", "near").alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = new.join(jump, "root").select("node", F.col("far").alias("root")).checkpoint()
        if not new.join(labels.withColumnRenamed("root", "old"), "node").where("root <> old").limit(1).count():
            return new
        labels = new
    raise RuntimeError("components did not settle")


def strongest_per_relation(edges: DataFrame, n: int = 12) -> DataFrame:
    w = Window.partitionBy("relation").orderBy(F.desc("support_count"), "from_entity_id", "to_entity_id")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
