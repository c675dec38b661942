from quillspark.operators import graph, upsert
from quillspark.sources import importers


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_node_id string, target_node_id string, relationship_type string")


def test_diamond(spark):
    e = edges(spark, [("A", "B", "knows"), ("A", "B", "likes"), ("A", "C", "knows"), ("B", "D", "knows"), ("C", "D", "knows")])
    got = [(r.node, r.depth) for r in graph.traverse(spark, e, "A", 2).collect()]
    assert sorted(got) == [("B", 1), ("B", 1), ("C", 1), ("D", 2), ("D", 2), ("D", 2)]


def test_cycle_ends(spark):
    e = edges(spark, [("A", "B", "k"), ("B", "C", "k"), ("C", "A", "k")])
    assert graph.traverse(spark, e, "A", 6).count() == 2
    path = graph.shortest_path(e, "A", "C")
    assert path == ["A", "C"]
    assert graph.shortest_path(e, "A", "Z") is None


def test_provenance_cycle(spark):
    rows = [("a", ["b"], "x", "standard"), ("b", ["c"], "y", "restricted"), ("c", ["a"], "z", None)]
    t = spark.createDataFrame(rows, "id string, derived_from array<string>, content string, sensitivity_tier string")
    got = graph.provenance(t, "a", 10).collect()
    assert [(r.id, r.depth, r.cycle) for r in got] == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("a", 3, True)]
    assert got[1].content is None and got[2].restricted is None


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_dominant_tie(spark):
    links = spark.createDataFrame([(i, 1) for i in range(4)], "thought_id long, entity_id long")
    thoughts = spark.createDataFrame([(0, "work"), (1, "work"), (2, "personal"), (3, "personal")], "id long, classification string")
    assert graph.dominant_classification(links, thoughts).first()["dominant"] is None


def test_edge_fold(spark):
    rows = [(9, 4, "friend_of", 0.5), (4, 9, "friend_of", 0.7), (4, 9, "uses", 0.1), (5, 5, "uses", 1.0)]
    got = upsert.fold_entity_edges(spark.createDataFrame(rows, "from_id long, to_id long, relation string, confidence double")).collect()
    assert sorted((r.from_id, r.to_id, r.relation, r.support, r.confidence) for r in got) == [(4, 9, "friend_of", 2, 0.7), (4, 9, "uses", 1, 0.1)]


def test_pinned_edge_stays(spark):
    keys = "from_entity_id long, to_entity_id long, relation string"
    e = spark.createDataFrame([(1, 2, "r"), (3, 4, "r")], keys)
    none = spark.createDataFrame([], f"{keys}, confidence double")
    got = upsert.edge_support(none, spark.createDataFrame([(2,)], "id long"), e).collect()
    assert [(r.from_entity_id, r.support_count) for r in got] == [(1, 0)]


def test_upsert_fold(spark):
    rows = [(2, "a  B", {"k": "new", "x": "1"}, None, 2), (1, "A b", {"k": "old", "y": "2"}, [1.0], 1)]
    got = upsert.upsert_thoughts(spark.createDataFrame(rows, "seq long, content string, metadata map<string,string>, embedding array<float>, at long")).first()
    assert got.content == "A b" and dict(got.metadata) == {"k": "new", "x": "1", "y": "2"} and got.embedding == [1.0] and got.writes == 2


def test_threshold_learning(spark):
    rows = [("t", 0, True)] + [("t", i, False) for i in range(1, 21)] + [("u", 0, True)]
    df = spark.createDataFrame(rows, "type string, seq long, accepted boolean")
    for block in (3, 10_000):
        got = {r.type: round(r.threshold, 6) for r in upsert.learned_thresholds(df, block=block).collect()}
        assert got == {"t": 0.95, "u": 0.73}


def test_sessions_split_at_a_full_gap(spark):
    df = spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, m) AS t FROM VALUES (0), (240), (479) AS v(m)")
    assert [r.session for r in importers.sessions(df, "k", "t").orderBy("t").collect()] == [0, 1, 1]


def test_canonical_path(spark):
    rows = [("c", "r", None), ("c", "a", "r"), ("c", "b", "a"), ("c", "x", "r"), ("c", "d", "b"), ("c", "e", "d")]
    got = importers.canonical_path(spark.createDataFrame(rows, "conv_id string, node_id string, parent string")).orderBy("position").collect()
    assert [(r.node_id, r.position) for r in got] == [("r", 0), ("a", 1), ("b", 2), ("d", 3), ("e", 4)]


def test_merge_entities(spark):
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "thought_id long, entity_id long")
    e = spark.createDataFrame([(10, 11, "r", 5), (11, 12, "r", 2), (10, 12, "r", 3)], "from_entity_id long, to_entity_id long, relation string, support_count long")
    m = spark.createDataFrame([(11, 10)], "loser long, winner long")
    new_links, new_edges = upsert.merge_entities(m, links, e)
    assert sorted(map(tuple, new_links.collect())) == [(1, 10), (2, 10)]
    assert [tuple(r) for r in new_edges.collect()] == [(10, 12, "r", 3)]


def test_topic_pairs_match_all_pairs(spark):
    import random
    import re

    r = random.Random(6)
    names = ["able", "cables", "learning", "relearnings", "kubernetes", "cubernetas", "Able!", "a b", "ab", "tool", "the tool for all of the many teams", "x" * 24, "y" + "x" * 24, "", "--", "data", "data base", "my database"]
    for _ in range(150):
        w = "".join(r.choice("abc ") for _ in range(r.randrange(1, 14))) if r.random() < 0.5 else r.choice(names)
        for _ in range(r.randrange(4)):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abz ") + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice("abz") + w[i + 1 :]])
        names.append(w)
    norm = [" ".join(re.findall("[a-z0-9]+", n.lower())) for n in names]

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    def alike(x, y):
        if not x or not y:
            return False
        short, long = sorted((x, y), key=len)
        part = len(short) >= 3 and short in long and (f" {short} " in f" {long} " or len(long) <= 2 * len(short))
        return x == y or part or (len(long) <= 25 and (d := distance(x, y)) <= 2 and d / len(long) <= 0.2)

    first = {x: norm.index(x) for x in norm if x}  # equal names are tied to the first of them
    want = sorted([(i, j) for i in first.values() for j in first.values() if i < j and alike(norm[i], norm[j])] + [(first[x], i) for i, x in enumerate(norm) if x and first[x] != i])
    got = graph.topic_pairs(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    assert sorted((x.a, x.b) for x in got.collect()) == want
