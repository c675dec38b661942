"""JSON repair against the json module."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions import json_repair

CASES = {
    '```json\n{"a": [1, 2,],}\n```': {"a": [1, 2]},
    '{"a": "b"\n "c": "d"}': {"a": "b", "c": "d"},
    '[{"a": 1}\n{"b": 2}\n[3]\n[4]]': [{"a": 1}, {"b": 2}, [3], [4]],
    '{"a": [1, {"b": "cut off': {"a": [1, {"b": "cut off"}]},
    '{"a": [1, 2}': {"a": [1, 2]},
    "{'a': 'it\\'s \"x\"', b: True, 'c': None}": {"a": 'it\'s "x"', "b": True, "c": None},
    '{"a": "brackets ]}, and \\" quotes", "n": -1.5e3}': {"a": 'brackets ]}, and " quotes', "n": -1500.0},
    'Here you are: {"a": 1} and more [': {"a": 1},
    '{"a":': {"a": None},
    '{"a": "line\nbreak\ttab"}': {"a": "line\nbreak\ttab"},
    '[1,,2,]]': [1, 2],
    '{"a": "ends in \\\\"}': {"a": "ends in \\"},
    '{"a": "half \\': {"a": "half "},
    "[]": [],
    '["a" "b" 3]': ["a", "b", 3],
}


@pytest.mark.parametrize("raw", CASES)
def test_repairs(raw):
    assert json.loads(json_repair.repair(raw)) == CASES[raw]


def test_right_json_stays(spark):
    r = random.Random(4)

    def one(d):
        k = r.randrange(6 if d < 3 else 3)
        return [lambda: r.choice(['q"', "\\", "it's", "é\n", "", "a,b]", "'"]), lambda: r.randrange(-99, 99), lambda: r.choice([None, True, 0.5]), lambda: [one(d + 1) for _ in range(r.randrange(4))], lambda: {f"k{i}": one(d + 1) for i in range(r.randrange(4))}, lambda: {"a": one(d + 1)}][k]()

    for _ in range(500):
        value = [one(0)]
        assert json.loads(json_repair.repair(json.dumps(value, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1])))) == value
    rows = spark.createDataFrame([('{"a": 1,}',), ("no json",), (None,), ("{: }",)], "c string")
    assert [x.v for x in rows.select(json_repair.repaired(F.col("c")).alias("v")).collect()] == ['{"a":1}', None, None, "{}"]


def test_long_texts_take_linear_time():
    began = time.time()
    for hard in ("[" * 100_000, "]" * 10 + "[" + "]" * 0 + '"' + "\\" * 300_000, "[" + "'a' " * 100_000, '{"a": ' * 50_000, "[" + '"x' * 100_000):
        json_repair.repair(hard)
    assert time.time() - began < 10
