"""The corpus pipeline, stage by stage, on a small folder."""

import tempfile

import corpus_pipeline as cp
from quillspark.llm import mixing, pii, simhash

from .test_operators import DOCS, prose


def folder(spark, rows, labels):
    path = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark):
    rows = []
    for i in range(120):
        t = prose(i, 60)
        if i % 6 == 0:
            t = " ".join(f"{w} you stupid idiot" if k % 15 == 0 else w for k, w in enumerate(t.split()))
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(200, rows[1][1], "en", "s1", 10), (201, "mail joe.b@corp.com " + prose(501, 50), "de", "s2", 9), (202, None, None, None, None), (203, "", "en", "s0", 0)]
    path = folder(spark, rows, [(i, 1, int(i % 6 == 0)) for i in range(120)])
    d = spark.read.parquet(f"{path}/documents.parquet")

    clean = cp.reject_toxic(spark, d, path).collect()
    assert {r.doc_id for r in clean} == {r[0] for r in rows if not (r[0] < 120 and r[0] % 6 == 0)}
    clean = spark.createDataFrame(clean, DOCS)

    single = cp.drop_near_duplicates(spark, clean, path)
    prints = {r.doc_id: r.component_id for r in simhash.similar_documents(clean).collect()}
    assert {r.doc_id for r in single.collect()} == {i for i, c in prints.items() if i == c}
    assert single.columns == cp.COLUMNS and 200 not in {r.doc_id for r in single.collect()}

    private = {r.doc_id: r for r in cp.replace_personal_data(spark, single, path).collect()}
    assert len(private) == single.count() and "joe.b@corp.com" not in private[201].text
    assert all(pii.detect(r.text) == [] for i, r in private.items() if i < 120)

    mixed = cp.mix_sources(spark, single, path)
    want = {r.doc_id for r in mixing.decisions(single).where("kept").collect()}
    assert mixed.columns == cp.COLUMNS and {r.doc_id for r in mixed.collect()} == want

    out = cp.run(spark, path)
    per = {}
    for p in out.collect():
        per.setdefault(p.doc_id, [0, p.doc_tokens])[0] += p.length
    assert per and all(a == b for a, b in per.values())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "pii_surrogates", "source_mixing", "packing"]


def test_one_row_of_each_group_stays(spark):
    x, z, q = (prose(i, 60) for i in (1, 2, 3))
    rows = [(3, x), (5, x), (1, z), (3, z), (7, q), (7, q), (None, q), (None, prose(4, 60)), (None, prose(4, 60)), (None, prose(5, 60))]
    d = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], DOCS)
    got = sorted(((r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, d, "").collect()), key=str)
    assert got == sorted([(3, x), (1, z), (7, q), (None, rows[7][1]), (None, rows[9][1])], key=str)
