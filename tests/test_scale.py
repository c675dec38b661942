"""What plans make of growing tables: rows between operators, memory of a batch, tasks and groups."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import curation, metric, search, text_index, upsert
from quillspark.sources import importers, json_array

from .compare import same


def made(df, kind, metric="numOutputRows"):
    """The most rows that a node of a kind put out in a run of the plan."""
    df.collect()
    most = 0

    def walk(node):
        nonlocal most
        name, metrics = node.nodeName(), node.metrics()
        if kind in name and metrics.contains(metric):
            most = max(most, metrics.apply(metric).value())
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif "QueryStage" in name:
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return most


# ---- pairs by shared thoughts -----------------------------------------------------------------------


def test_grounded_pairs_do_not_repeat_links(spark):
    """A link is no longer read again for every pair that one of its ends is in."""
    r = random.Random(5)
    links = {(t, e) for t in range(500) for e in r.sample(range(40), 4)}
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    got = curation.grounded(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sorted(links) * 2, "thought_id long, entity_id long"))
    assert made(got, "Join") <= 500 * 10  # before: 780 pairs, 50 thoughts each
    assert {(x.a, x.b): x.grounding for x in got.collect()} == {(a, b): sum((t, a) in links and (t, b) in links for t in range(500)) for a, b in pairs}


def test_grounded_pairs_of_hubs_and_odd_rows(spark):
    """Thoughts of many entities are not squared; ends in any order, equal, unknown, null or given twice."""
    hub = curation.PAIRED * 40
    links = [(0, e) for e in range(hub)] + [(1, e) for e in range(hub)] + [(2, 1), (2, 2), (2, 2), (3, 5), (None, 1), (None, 2), (4, None)]
    pairs = [(1, 2), (2, 1), (5, 5), (1, hub - 1), (7, hub + 1), (None, 5), (5, None), (None, None), (3, 4), (3, 4)]
    got = curation.grounded(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(links, "thought_id long, entity_id long"))
    assert made(got, "Join") < 10 * hub
    want = {(1, 2): 3, (2, 1): 3, (5, 5): 3, (1, hub - 1): 2, (7, hub + 1): 0, (None, 5): 0, (5, None): 0, (None, None): 0, (3, 4): 2}
    assert sorted(((x.a, x.b), x.grounding) for x in got.where("a IS NOT NULL AND b IS NOT NULL").collect()) == sorted((p, want[p]) for p in pairs if None not in p)
    assert all(x.grounding == 0 for x in got.where("a IS NULL OR b IS NULL").collect())


# ---- writes of one content -----------------------------------------------------------------------------


def test_many_writes_of_one_content(spark):
    """No group gathers its writes: the last value of every key is found first."""
    rows = spark.range(20_000).selectExpr("id AS seq", "concat('Same', id % 1) AS content", "map('kind', string(id), concat('u', id % 5000), string(id)) AS metadata", "array(double(id)) AS embedding", "id AS at")
    got = upsert.upsert_thoughts(rows)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()  # before: a fold over all maps, each as large as all keys so far
    r = got.first()
    assert r.writes == 20_000 and r.metadata == {"kind": "19999", **{f"u{k}": str(15_000 + k) for k in range(5000)}}
    assert "Join" not in got.drop("metadata")._jdf.queryExecution().optimizedPlan().toString()  # read once where no map is asked for


def test_odd_metadata(spark):
    rows = [(1, "a", None), (2, "a", {}), (1, "b", None), (1, "c", {"k": "1"}), (2, "c", {"k": None}), (3, "c", None), (5, "d", {"k": "late"}), (2, "d", {"k": "early", "x": "y"}), (1, None, {"n": "1"})]
    df = spark.createDataFrame(rows, "seq long, content string, metadata map<string,string>").selectExpr("*", "CAST(NULL AS array<float>) AS embedding", "seq AS at")
    got = {r.content: r.metadata for r in upsert.upsert_thoughts(df).collect()}
    assert got == {"a": {}, "b": None, "c": {"k": None}, "d": {"k": "late", "x": "y"}, None: {"n": "1"}}


def test_event_numbers_beyond_floats(spark, sf, tmp_path):
    """Numbers that single precision rounds (2^24 events and more) come back as they were."""
    from quillspark import catalog

    spark.read.parquet(f"{sf}/events.parquet").withColumn("event_id", F.expr("event_id * 3 + 30000003")).write.parquet(f"{tmp_path}/events.parquet")
    same(spark, catalog.QUERIES["upsert_keeps_vectors"], catalog.ORACLE_SQL["upsert_keeps_vectors"], str(tmp_path))


# ---- the text index --------------------------------------------------------------------------------------

NOTE = "serial_id long, content string, sensitivity_tier string, importance int, quality_score double"


def notes(n, seed=2):
    r = random.Random(seed)
    words = [*(f"w{i}" for i in range(20)), "the", "that", "Straße", "🙂🙃", "日本"]
    return [*((i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), None, 1, None) for i in range(n)), (n, None, None, 1, None), (n + 1, "", None, 1, None), (n + 2, "🙂🙃a", None, 1, None)]


def shuffled(spark, run):
    """Bytes that the jobs of a call put into shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    seen = {s.stageId() for s in _stages(sc)}
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteBytes() for s in _stages(sc) if s.stageId() not in seen)


def _stages(sc):
    store = sc._jsc.sc().statusStore()
    found = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]


def test_index_is_made_where_texts_lie(spark, tmp_path):
    df = spark.createDataFrame(notes(200), NOTE).repartition(3).checkpoint()
    assert shuffled(spark, lambda: text_index.build_index(df, f"{tmp_path}/index")) == 0  # before: words were dealt by term, texts and lists again
    assert shuffled(spark, lambda: df.repartition("serial_id").count()) > 0


def test_parts_are_made_when_they_are_needed(spark, tmp_path):
    df, path = spark.createDataFrame(notes(60), NOTE), f"{tmp_path}/index"
    index = text_index.build_index(df.where("serial_id < 40"), path, parts=("grams",))
    index = index.append(df.where("serial_id >= 35")).remove(spark.createDataFrame([(3,)], "id long"))
    now = df.where("serial_id <> 3")
    assert not os.path.exists(f"{path}/postings") and text_index.open_index(spark, path).parts == ("grams",)
    assert {r.id for r in index.holding("w1 w").collect()} == {r.serial_id for r in now.where("content LIKE '%w1 w%'").collect()}
    index.add("postings")
    opened = text_index.open_index(spark, path)
    assert opened.parts == text_index.PARTS and opened.add("grams") is opened
    assert {r.id for r in opened.word_hits("w1 -w2").collect()} == {r[0] for r in search.search_text(now, "w1 -w2", 100).collect()}


def test_rows_of_a_term_may_be_several(spark, tmp_path, monkeypatch):
    """A block of many words is inverted by parts; the texts beside the limit are where it is cut."""
    df = spark.createDataFrame(notes(150), NOTE).repartition(2)
    work = {"postings": text_index._postings, "grams": text_index._grams}
    code = "def few(batches):\n    from quillspark.operators import text_index\n    text_index.MOST_WORDS = 50\n    try:\n        yield from text_index.{0}(batches)\n    finally:\n        text_index.MOST_WORDS = 4_000_000\n"
    for name in work:
        exec(code.format(f"_{name}"), scope := {})
        monkeypatch.setattr(text_index, f"_{name}", scope["few"])
    index = text_index.build_index(df, f"{tmp_path}/index")
    monkeypatch.undo()
    again = index.table("postings").groupBy("term", "block").count().where("count > 1").count()
    assert again > 0 and index.table("grams").groupBy("gram", "block").count().where("count > 1").count() > 0
    for query in ("the that", '"w1 w2"', "straße", "-w3"):
        got = [(r.id, round(r.rank, 9), r.total) for r in index.search(query, 200).collect()]
        assert got == [(r[0], round(r[1], 9), r[2]) for r in search.search_text(df, query, 200).collect()], query
    for part in ("w1 w", "🙂🙃a", "日本 the", "STRASSE"):
        assert {r.id for r in index.holding(part).collect()} == {r.serial_id for r in df.where(F.col("content").ilike(f"%{part}%")).collect()}, part


def test_many_candidates_are_not_dealt(spark, tmp_path, monkeypatch):
    """Texts never go through a join: they are verified first, and only ids meet."""
    df = spark.createDataFrame(notes(100), NOTE)
    index = text_index.build_index(df, f"{tmp_path}/index", parts=("grams",))
    monkeypatch.setattr(text_index, "FEW", 3)
    got = index.holding("w1 w")
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    left = plan[[i for i, x in enumerate(plan) if "Join" in x][0] + 1]
    assert "Project" in left and "content" not in left
    assert {r.id for r in got.collect()} == {r.serial_id for r in df.where("content LIKE '%w1 w%'").collect()}


# ---- similarity join -------------------------------------------------------------------------------------


def test_rows_are_copied_by_regions(spark):
    """Evenly spread rows go to as many tasks as there are regions, not to every cell, and in pieces."""
    x = np.random.default_rng(4).normal(size=(2500, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = search.similar_pairs(df, 0.6, cell=20, sample=400)
    assert 2500 <= made(got, "Exchange", "shuffleRecordsWritten") <= 2500 * 10  # before: about half of 125 cells
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.triu(unit @ unit.T, 1)
    want = {(int(a), int(b)): sim[a, b] for a, b in zip(*np.nonzero(sim >= 0.6))}
    found = {(r.a, r.b): r.similarity for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 100 and all(abs(found[k] - s) < 1e-12 for k, s in want.items())


def test_regions():
    first, parts = metric.regions(np.array([3, 4, 25, 0, 10, 1, 9]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1, 1]


# ---- one huge JSON array --------------------------------------------------------------------------------


def test_structure_equals_a_walk_over_bytes():
    r = np.random.default_rng(6)
    for n in (*range(1, 9), 200):
        for _ in range(150):
            block = r.choice(np.frombuffer(b'"\\\\\\{}[],a', np.uint8), n)
            for state in (json_array.OUTSIDE, json_array.INSIDE, json_array.ESCAPED):
                inside, escaped, want = state != json_array.OUTSIDE, state == json_array.ESCAPED, []
                for i, c in enumerate(bytes(block)):
                    if c == 92:
                        escaped = not escaped
                        continue
                    if c == 34 and not escaped:
                        inside = not inside
                    elif not inside and c in b"{}[],":
                        want.append((i, {91: 1, 123: 1, 93: -1, 125: -1}.get(c, 0)))
                    escaped = False
                at, change, end = json_array.structure(block, state)
                assert list(zip(at.tolist(), change.tolist())) == want
                assert end == (json_array.OUTSIDE if not inside else json_array.ESCAPED if escaped else json_array.INSIDE)


def test_small_ranges_grow_with_the_file(spark, tmp_path):
    """Ranges of a size made for small files do not become thousands of tasks."""
    (tmp_path / "conversations.json").write_text("[" + ",".join(f'{{"id": {i}, "text": "{"x" * 80}"}}' for i in range(20_000)) + "]")
    size = (tmp_path / "conversations.json").stat().st_size
    rows = json_array.read(spark, [(f"file:{tmp_path}/conversations.json", size)], "id long, text string", split_bytes=2048)
    assert rows.rdd.getNumPartitions() <= 12 * spark.sparkContext.defaultParallelism  # before: 1000
    assert rows.select("id").distinct().count() == rows.count() == 20_000


def test_only_the_end_of_an_element_is_read_beyond_a_range(tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text("[" + ",".join(['"' + "y" * 5000 + '"'] * 2000) + "]")
    read, opened = [], json_array._opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            read.append((n, at))
            return self.f.read_at(n, at)

    monkeypatch.setattr(json_array, "_opened", lambda p: Counted(opened(p)))
    assert len(list(json_array.elements(f"file:{path}", 100_000, 200_000, json_array.INSIDE, 1))) in (19, 20)
    assert max(n + at for n, at in read) < 300_000  # before: 4 MB beyond


def test_a_path_reads_its_nodes_twice(spark):
    """Once for ids and parents, once with the texts."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [("c", str(i), str(i - 1) if i else None, i == 9, f"t{i}") for i in range(10)] + [("d", "0", None, False, "x"), ("d", "1", "0", False, "y"), ("d", "2", "0", False, "z")]
    nodes = spark.createDataFrame(rows, "conv_id string, node_id string, parent string, is_current boolean, text string").mapInPandas(count, "conv_id string, node_id string, parent string, is_current boolean, text string")
    got = sorted((r.conv_id, r.position, r.text) for r in importers.canonical_path(nodes).collect())
    assert got == [*(("c", i, f"t{i}") for i in range(10)), ("d", 0, "x"), ("d", 1, "z")]
    assert read.value <= 2 * len(rows)
