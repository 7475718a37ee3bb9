import json

import pytest
from pyspark.errors import PythonException

from quadrille.plans.stack import stack
from quadrille.sources import catalogues, items


def feature(name, **more):
    return {"type": "Feature", "id": name, "properties": {"datetime": "2020-01-01T00:00:00Z"}, "assets": {}, **more}


def tree(root):
    """Three levels of links: a root with an item, two children (one linked twice) that link back up, and a paged collection."""
    docs = {
        "root.json": {"type": "Catalog", "links": [("child", "b/cat.json"), ("item", "./i0.json"), ("child", "a/cat.json"), ("child", "a/../a/cat.json"), ("self", "root.json"), ("license", "none.txt")]},
        "i0.json": feature("i0", links=[{"rel": "parent", "href": "root.json"}, {"rel": "item", "href": "nowhere.json"}]),
        "a/cat.json": {"type": "Collection", "links": [("root", "../root.json"), ("child", "../root.json"), ("item", "i1.json"), ("item", "i2.json"), ("child", "c/cat.json")]},
        "a/i1.json": feature("i1"),
        "a/i2.json": feature("i2"),
        "a/c/cat.json": {"type": "Catalog", "links": [("child", "../cat.json"), ("items", "page1.json")]},
        "a/c/page1.json": {"type": "FeatureCollection", "features": [feature("p1"), feature("p2")], "links": [("next", "page2.json")]},
        "a/c/page2.json": {"type": "FeatureCollection", "features": [feature("p3"), feature("p1")], "links": [("next", "page1.json")]},
        "b/cat.json": {"type": "Catalog", "links": [("item", "i3.json#part"), ("item", "../i0.json"), ("item", "../a/i1.json")]},
        "b/i3.json": feature("i3"),
    }
    for path, doc in docs.items():
        doc["links"] = [x if isinstance(x, dict) else {"rel": x[0], "href": x[1]} for x in doc.get("links", [])]
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(json.dumps(doc))
    return (root / "root.json").as_uri()


def test_a_tree_of_files_becomes_items(spark, tmp_path):
    got = catalogues.crawl(spark, tree(tmp_path)).orderBy("item_idx").collect()
    assert [r["item_idx"] for r in got] == list(range(len(got)))
    assert [json.loads(r["json"])["id"] for r in got] == ["i0", "i3", "i1", "i2", "p1", "p2", "p3", "p1"]
    assert got[1]["url"].endswith("/b/i3.json")
    read = items.rows(spark, catalogues.crawl(spark, tree(tmp_path)))
    assert {(r["item_idx"], r["id"]) for r in read.collect()} == {(r["item_idx"], json.loads(r["json"])["id"]) for r in got}


def test_each_document_is_opened_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    root = tree(tmp_path)

    def counting(url):
        import uuid

        (log / uuid.uuid4().hex).write_text(url)
        return catalogues.fetched(url)

    assert catalogues.crawl(spark, [root, root], counting).count() == 8
    urls = [f.read_text() for f in log.iterdir()]
    assert len(urls) == len(set(urls)) == 10 and not any("nowhere" in u or "none" in u for u in urls)


def test_errors_and_emptiness(spark, tmp_path):
    for name, doc in {"gone.json": {"type": "Catalog", "links": [{"rel": "item", "href": "no.json"}, {"rel": "item"}, "odd"]}, "list.json": [1], "none.json": {"links": None}}.items():
        (tmp_path / name).write_text(json.dumps(doc))
    uri = tmp_path.as_uri()
    with pytest.raises(PythonException, match="no.json"):
        catalogues.crawl(spark, f"{uri}/gone.json").collect()
    assert catalogues.crawl(spark, f"{uri}/gone.json", errors_as_missing=[FileNotFoundError("")]).count() == 0
    assert catalogues.crawl(spark, [f"{uri}/list.json", f"{uri}/none.json"]).count() == catalogues.crawl(spark, []).count() == 0


def test_a_crawled_catalogue_is_stacked(spark, tmp_path):
    kind = "image/tiff; application=geotiff"
    for i in range(3):
        asset = {"href": f"const://1/1/{i}", "type": kind, "proj:bbox": [400000 + 100 * i, 0, 400100 + 100 * i, 100]}
        item = feature(f"i{i}", assets={"B1": asset})
        item["properties"] = {"datetime": f"2020-01-0{3 - i}T00:00:00Z", "proj:epsg": 32613}
        (tmp_path / f"i{i}.json").write_text(json.dumps(item))
    links = [{"rel": "item", "href": f"i{i}.json"} for i in range(3)]
    (tmp_path / "cat.json").write_text(json.dumps({"type": "Catalog", "links": links}))
    s = stack(spark, catalogues.crawl(spark, (tmp_path / "cat.json").as_uri()), resolution=100)
    assert {(r["time_idx"], r["ix"], r["v"]) for r in s.pixels.collect()} == {(2, 0, 0.0), (1, 1, 1.0), (0, 2, 2.0)}


@pytest.mark.parametrize("numbers", [[], [5], [3, 1, 2, 40, 41, 7, 999, 12345, 12344, 64]])
def test_published_items_come_back_in_order(spark, tmp_path, numbers):
    rows = [(i, json.dumps(feature(f"i{i}"))) for i in numbers] + [(None, "{}"), (8, None)]
    root = catalogues.publish(spark.createDataFrame(rows, "item_idx long, json string"), (tmp_path / "x").as_uri(), per_page=4, fan=3)
    got = catalogues.crawl(spark, root).orderBy("item_idx").collect()
    assert [json.loads(r["json"])["id"] for r in got] == [f"i{i}" for i in sorted(numbers)]
    for f in (tmp_path / "x").rglob("*.json"):
        doc = json.loads(f.read_text())
        assert len(doc.get("features", [])) <= 4 and len(doc.get("links", [])) <= 3
