"""The reader of JSON arrays by byte ranges against the json module."""

import json
import random

import numpy as np
import pytest

from quillspark.sources import importers, json_array

ODD = ['a "quote" \\ and \\\\', "[{,}]", "\\", '\\"', "é日😀 [", "", "\n\t\u2028", '","', "]]]}}", "\\\\\\", "x" * 300]


def values(n, seed):
    r = random.Random(seed)

    def one(depth):
        kind = r.randrange(6 if depth < 3 else 3)
        return [lambda: r.choice(ODD), lambda: r.randrange(1000), lambda: r.choice([None, True, 1.5]), lambda: [one(depth + 1) for _ in range(r.randrange(4))], lambda: {r.choice(ODD) + str(i): one(depth + 1) for i in range(r.randrange(4))}, lambda: {"id": r.randrange(99), "text": r.choice(ODD)}][kind]()

    return [one(0) for _ in range(n)]


@pytest.mark.parametrize("form", [{}, {"indent": 1}, {"ensure_ascii": False}, {"separators": (",", ":"), "ensure_ascii": False}])
@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_give_every_element_once(tmp_path, monkeypatch, form, split):
    monkeypatch.setattr(json_array, "BLOCK", 5 if split < 64 else 50)
    want = values(40, len(form) + split)
    path = tmp_path / "a.json"
    path.write_bytes(json.dumps(want, **form).encode())
    size, state, depth, got = path.stat().st_size, 0, 0, []
    import pandas as pd

    for start in range(0, size, split):
        end = min(start + split, size)
        got += list(json_array.elements(f"file:{path}", start, end, state, depth))
        r = next(json_array._scan(iter([pd.DataFrame({"path": [f"file:{path}"], "start": [start], "end": [end]})]))).iloc[0]
        state, depth = r.states[state], depth + r.depths[state]
    assert [json.loads(v) for _, v in got if v.strip()] == want and depth == 0
    assert [p for p, _ in got] == sorted({p for p, _ in got})


def test_states_of_blocks():
    raw = np.frombuffer(b'ab\\\\\\"c",[', np.uint8)
    assert json_array.structure(raw, json_array.INSIDE)[2] == json_array.OUTSIDE
    assert json_array.structure(raw[:3], json_array.INSIDE)[2] == json_array.ESCAPED
    assert json_array.structure(raw[2:4], json_array.ESCAPED)[2] == json_array.ESCAPED
    assert json_array.structure(raw[3:6], json_array.ESCAPED)[2] == json_array.INSIDE


def test_several_tasks_read_one_array(spark, tmp_path):
    want = [{"id": i, "text": ODD[i % len(ODD)], "more": {"a": [i] * 50}} for i in range(400)]
    (tmp_path / "x.json").write_bytes(b"\xef\xbb\xbf" + json.dumps(want, ensure_ascii=False).encode())
    size = (tmp_path / "x.json").stat().st_size
    files = [(f"file:{tmp_path}/x.json", size)]
    rows = json_array.read(spark, files, "id int, text string", split_bytes=size // 7)
    assert rows.rdd.getNumPartitions() == 8
    assert [(r.id, r.text) for r in rows.orderBy("position").collect()] == [(x["id"], x["text"]) for x in want]
    plain = json_array.read(spark, files, split_bytes=1000).orderBy("position").collect()
    assert [json.loads(r.value) for r in plain] == want


def test_odd_files(spark, tmp_path):
    def read(raw, **k):
        (tmp_path / "x.json").write_bytes(raw)
        return [r.value for r in json_array.read(spark, [(f"file:{tmp_path}/x.json", len(raw))], **k).collect()]

    assert read(b"") == [] and read(b" [ ] ") == [] and read(b"[1, [2], {}]\n") == ["1", "[2]", "{}"]
    assert read(b'[{"a": 1}, {"b": ') == ['{"a": 1}']
    with pytest.raises(Exception, match="no JSON array"):
        read(b'{"a": [1, 2]}')
    assert json_array.read(spark, []).count() == 0


def test_export_of_chats_by_ranges(spark, tmp_path):
    chats = [{"id": f"c{i}", "title": ODD[i % len(ODD)], "current_node": "n1", "mapping": {"n0": {"id": "n0", "parent": None, "message": None}, "n1": {"id": "n1", "parent": "n0", "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": [ODD[i % len(ODD)], "q"]}}}}} for i in range(60)]
    (tmp_path / "conversations.json").write_text(json.dumps(chats))
    whole, cut = (importers.chat_export(spark, str(tmp_path), n) for n in (1 << 20, 500))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(whole) == key(cut) and whole.count() == 60
    nodes = importers.chat_nodes(cut).where("role = 'user'")
    bare = lambda t: "".join(t.split())
    assert {(r.conv_id, bare(r.text)) for r in nodes.collect()} == {(c["id"], bare(ODD[i % len(ODD)] + "q")) for i, c in enumerate(chats)}
