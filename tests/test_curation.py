import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import curation, stats
from quillspark.sources import importers


def test_capture_skips_known_and_repeated(spark):
    items = spark.createDataFrame([(1, "A b", "insight", "Work"), (2, "a  B", None, None), (3, " ", None, None), (4, "old", None, None)], "item long, content string, type string, classification string")
    from quillspark.functions import text

    known = spark.createDataFrame([("old",)], "c string").select(text.fingerprint(F.col("c")).alias("fingerprint"))
    new, rest = curation.capture(items, known)
    assert [(r.item, r.type, r.classification) for r in new.collect()] == [(1, "lesson", "work")]
    assert sorted(r.item for r in rest.collect()) == [2, 4]


def test_approve(spark):
    t = spark.createDataFrame([(1, "old", None), (2, "better", "pending"), (3, "new", "pending")], "id long, content string, review_status string")
    d = spark.createDataFrame([(2, "UPDATE", 1), (3, "NEW", None)], "pending_id long, action string, target_id long")
    assert sorted((r.id, r.content, r.review_status) for r in curation.approve(t, d).collect()) == [(1, "better", None), (3, "new", None)]


def test_manual_edges(spark):
    keys = "from_entity_id long, to_entity_id long, relation string"
    wanted = spark.createDataFrame([(9, 4, "knows", None), (1, 2, "uses", 3.0), (5, 6, "uses", 0.5), (7, 7, "uses", 0.5)], f"{keys}, confidence double")
    got = curation.manual_edges(wanted, spark.createDataFrame([(5, 6, "uses")], keys), spark.createDataFrame([(8, 9, "x")], keys), ("knows",)).collect()
    assert sorted((r.from_entity_id, r.to_entity_id, r.confidence) for r in got) == [(1, 2, 1.0), (4, 9, 0.95)]


def test_renames_absorb(spark):
    e = spark.createDataFrame([(1, "Old", "tool"), (2, "new name", "tool")], "id long, name string, entity_type string")
    rows, losers = curation.renamed(e, spark.createDataFrame([(1, "New Name", None)], "id long, new_name string, new_type string"))
    assert [tuple(r) for r in losers.collect()] == [(2, 1)] and [r.id for r in rows.collect()] == [1]


def test_undo_window(spark):
    at = dt.datetime(2024, 1, 1, 12)
    blocks = spark.createDataFrame([(1, at - dt.timedelta(minutes=5)), (2, at - dt.timedelta(hours=2))], "id long, created_at timestamp")
    kept, undone = curation.unblocked(blocks, at, 60)
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in undone.collect()] == [1]


def test_pages_keep_edits(spark):
    pages = spark.createDataFrame([("a", "A", "mine", True), ("b", "B", "old", False)], "slug string, title string, content string, manually_edited boolean")
    new = spark.createDataFrame([("a", "A2", "x"), ("b", "B2", "y"), ("c", "C", "z")], "slug string, title string, content string")
    assert sorted((r.slug, r.content) for r in curation.upsert_pages(pages, new).collect()) == [("a", "mine"), ("b", "y"), ("c", "z")]


def test_findings_first_of_a_category(spark):
    lines = "\n".join(f"We decided to take option number {i}" for i in range(8))
    rows = spark.createDataFrame([(1, 0, "user", lines), (1, 1, "assistant", "The old job failed twice yesterday."), (1, 2, "system", "We decided on nothing at all here")], "conv_id long, turn long, role string, text string")
    got = curation.findings(rows).collect()
    assert sorted({(r.category, r.rank) for r in got}) == [("decisions", i) for i in range(1, 6)] + [("failures", 1)]


def test_identities(spark):
    people = spark.createDataFrame([(1, "Ann Lee", "ann@x.org"), (2, "Bo Ek", None)], "id long, name string, mail string")
    a = spark.createDataFrame([("Ann <ANN@x.org>",), ('"Bo Ek" <bo@y.org>',), ("z@z.org",)], "address string")
    assert {r.mail: r.person for r in curation.identities(a, people).collect()} == {"ann@x.org": 1, "bo@y.org": 2, "z@z.org": None}


def test_junk_and_metadata(spark):
    df = spark.createDataFrame([("1/2/2024",), ("a.py",), ("apache spark",), ("The Tool",)], "n string")
    assert [r.v for r in df.select(curation.is_junk_topic(F.col("n")).alias("v")).collect()] == [True, True, False, True]
    raw = spark.createDataFrame([('"{\\"a\\": 1}"',), ('"text"',), ('{"a": 1}',)], "m string")
    assert [r.v for r in raw.select(curation.parsed_metadata(F.col("m")).alias("v")).collect()] == ['{"a": 1}', None, '{"a":1}']


def test_shopping_list(spark):
    plans = spark.createDataFrame([(1, "r"), (2, "r")], "plan_id long, recipe_id string")
    recipes = spark.createDataFrame([("r", [("salt", "1", "g"), ("egg", "2", None)])], "recipe_id string, ingredients array<struct<name:string,quantity:string,unit:string>>")
    assert {r["name"]: r.quantity for r in stats.shopping_list(plans, recipes).collect()} == {"salt": "1 + 1", "egg": "2 + 2"}


def test_mail_and_flags(spark):
    df = spark.createDataFrame([("SGVsbG8_", "TRUE", "2024-03-01T10:00:00Z", "no-reply@x.org")], "b string, f string, t string, s string")
    row = df.select(importers.mail_body(F.col("b")).alias("b"), importers.flags(F.col("f")).alias("f"), importers.number_or_date(F.col("t"), F.lit(None).cast("string")).alias("t"), importers.is_automatic_mail(F.col("s"), F.lit(""), F.lit("")).alias("a")).first()
    assert row.b == "Hello?" and row.f and row.t == dt.datetime(2024, 3, 1, 10) and row.a


def test_vault(spark, tmp_path):
    (tmp_path / "2024-02-03 note.md").write_text("---\ntags: x\n---\nSee [[Other|o]] and #idea\n" + "word " * 20)
    row = importers.vault(spark, str(tmp_path)).first()
    assert row.title == "2024-02-03 note" and row.links == ["Other"] and row.tags == ["idea"] and row.date == dt.date(2024, 2, 3)


def test_chat_export(spark, tmp_path):
    import json
    import zipfile

    def message(role, kind, *parts):
        return {"author": {"role": role}, "create_time": 1.0, "content": {"content_type": kind, "parts": list(parts)}}

    def chat(name):
        nodes = {"r": (None, None), "a": ("r", message("user", "text", "hello")), "b": ("a", message("assistant", "text", "old")), "c": ("a", message("assistant", "multimodal_text", "new", {"audio_transcription": {"text": "said"}}))}
        return {"id": name, "title": "t", "current_node": "c", "mapping": {k: {"id": k, "parent": p, "message": m} for k, (p, m) in nodes.items()}}

    (tmp_path / "conversations-001.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([chat("x")]).encode())
    (tmp_path / "other.json").write_text("[]")
    with zipfile.ZipFile(tmp_path / "export.zip", "w") as z:
        z.writestr("export/conversations.json", json.dumps([chat("y"), chat("z")]))
    found = importers.chat_export(spark, str(tmp_path))
    assert {r.id for r in found.collect()} == {"x", "y", "z"}
    path = importers.canonical_path(importers.chat_nodes(found)).where("text IS NOT NULL AND role IS NOT NULL")
    got = {}
    for r in sorted(path.collect(), key=lambda r: r.position):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: [("user", "hello"), ("assistant", "new\nsaid")] for k in "xyz"}


def test_search_and_memory_exports(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Title,Answer,Created At\n"A, b","line one\nline ""two""",2024-01-02\n')
    (tmp_path / "s.json").write_text('[{"query": "q", "answer_text": "a", "timestamp": "2024-01-02T03:04:05Z"}]')
    (tmp_path / "m.csv").write_text("MEMORY,IS_DELETED,IS_FORGOTTEN\nkeep,false,\ngone,TRUE,\npast,no,1\n")
    row = importers.searches(spark, str(tmp_path / "s.csv")).first()
    assert (row.title, row.answer, row.asked.year) == ("A, b", 'line one\nline "two"', 2024)
    row = importers.searches(spark, str(tmp_path / "s.json"), "json").first()
    assert (row.title, row.answer, row.asked.hour) == ("q", "a", 3)
    assert [r.MEMORY for r in importers.memory_export(spark, str(tmp_path / "m.csv")).collect()] == ["keep"]


def test_backup_and_summary(spark, tmp_path):
    rows = spark.range(7).selectExpr("id", "id % 2 AS half")
    importers.export_tables({"a": rows, "b": rows.limit(0)}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/a")).agg(F.sum("id")).first()[0] == 21
    rows.coalesce(1).write.csv(str(tmp_path / "c"), header=True, sep="\t")
    got = importers.csv_summary(spark, str(tmp_path / "c"), "\t")
    assert (got["rows"], got["columns"], got["header"], len(got["preview"])) == (7, 2, ["id", "half"], 5)


def test_atom_feed(spark, tmp_path):
    entry = '<entry><id>{i}</id><title>T</title><content type="html">&lt;p&gt;{body}&lt;/p&gt;</content><published>2024-01-02T03:04:05Z</published><category term="http://x/kind#{kind}"/></entry>'
    body = "".join(entry.format(i=i, body=b, kind=k) for i, b, k in ((1, "a long enough text of a post", "post"), (2, "short", "post"), (3, "a long enough text of settings", "settings"), (4, "a long enough comment text", "comment")))
    (tmp_path / "f.xml").write_text(f"<feed>{body}</feed>")
    got = {r.id: (r.kind, r.content) for r in importers.atom_feed(spark, str(tmp_path / "f.xml")).collect()}
    assert got == {"1": ("post", "a long enough text of a post"), "4": ("comment", "a long enough comment text")}
