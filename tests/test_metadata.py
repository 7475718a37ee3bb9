import json

import pytest

from quadrille.functions import metadata
from quadrille.sources import items as sources


def labels(spark, properties, keys=None):
    items = sources.rows(spark, [{"id": str(i), "properties": p} for i, p in enumerate(properties)])
    keys = keys or sorted({k for p in properties for k in p})
    got = metadata.labels(items, keys)
    rows = items.orderBy("item_idx").select(*[c.alias(k) for k, c in got.items()])
    return {k: (kind, [r[k] for r in rows.collect()]) for k, kind in rows.dtypes}


def test_values_keep_their_types(spark):
    props = [{"n": 1, "x": 1.5, "b": True, "t": "1", "late": None, "mix": 1, "obj": {"a": [1]}}, {"n": 2, "x": 2, "b": False, "t": "b", "mix": "one", "obj": {"a": [2]}}, {"x": 1e300, "only": "c", "mix": None}]
    got = labels(spark, props)
    assert got["n"] == ("bigint", [1, 2, None]) and got["x"] == ("double", [1.5, 2.0, 1e300])
    assert got["b"] == ("boolean", [True, False, None]) and got["t"] == ("string", ["1", "b", None])
    assert got["only"] == ("string", [None, None, "c"]) and got["mix"] == ("string", ["1", "one", None])
    assert [v and json.loads(v) for v in got["obj"][1]] == [{"a": [1]}, {"a": [2]}, None]
    assert got["late"][1] == [None] * 3


def test_lists_follow_the_rules_of_axes(spark):
    props = [{"one": ["a"], "same": [3, 1, 3], "ragged": [1], "axis": [1, 2], "deep": [[1]]}, {"one": ["b"], "same": [3, 1, 3], "ragged": [1, 2], "axis": [3, 4], "deep": [[2]]}]
    got = labels(spark, props)
    assert got["one"] == ("string", ["a", "b"]) and got["same"] == ("array<bigint>", [[1, 3]] * 2) and got["ragged"] == ("array<bigint>", [[1], [1, 2]])
    assert "axis" not in got and "deep" not in got


def test_odd_names_and_no_items(spark):
    got = labels(spark, [{"a.b": 1, "eo:cloud_cover": 2, "it's": 3, 'say "x"': 4}])
    assert {k: v[1] for k, v in got.items()} == {"a.b": [1], "eo:cloud_cover": [2], "it's": [3], 'say "x"': [4]}
    assert metadata.labels(sources.rows(spark, [{"id": "x"}]), []) == {}


@pytest.mark.parametrize("text, want", [("red", "red"), ('["VV"]', "VV"), ('["VV", "VH", "VV"]', '["VH", "VV"]'), ("[[1], [2]]", None), ("[not json", "[not json"), ("[5]", "5")])
def test_labels_of_bands(text, want):
    assert metadata.label(text) == want
