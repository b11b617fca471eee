"""The versioned store and the seed flow: versions, untouched buckets, lost loads, files that are not whole."""

import json
from pathlib import Path

import pytest

from quillon.operators.versioned_store import VersionedStore
from quillon.sources.seed import Seed

SCHEMA = "id string, version long, text string"


@pytest.fixture
def store(spark, tmp_path):
    return VersionedStore(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, buckets=8)


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def content(store, load=None):
    return sorted((tuple(r) for r in store.read(load).collect()), key=repr)


def test_against_a_dictionary(spark, store):
    held = {}
    for n in range(3):
        new = [(f"k{i * (n + 3) % 40}", (i * 7 + n) % 5, f"{n}-{i}") for i in range(30)]
        store.upsert(rows(spark, *new))
        best = {}
        for k, v, t in new:
            text = lambda x: json.dumps({"id": k, "version": x[0], "text": x[1]}, separators=(",", ":"))  # noqa: B023, E731
            if k not in best or (v, text((v, t))) > (best[k][0], text(best[k])):
                best[k] = (v, t)
        for k, x in best.items():
            if k not in held or x[0] > held[k][0]:
                held[k] = x
        assert content(store) == sorted(((k, *x) for k, x in held.items()), key=repr)


def test_untouched_buckets_keep_their_files(spark, store):
    store.upsert(rows(spark, *[(f"k{i}", 1, "old") for i in range(60)]))
    files = {p: p.stat().st_mtime_ns for p in Path(store.at).glob("data/**/*.parquet")}
    done = store.upsert(rows(spark, ("k3", 2, "new"), (None, 9, "no key")))
    assert done == {"load": 1, "buckets": 1, "rejected": 1}
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert sum(n == 1 for n in store.manifest().values()) == 1
    assert [r for r in content(store) if r[0] == "k3"] == [("k3", 2, "new")] and len(content(store)) == 60
    assert ("k3", 1, "old") in content(store, 0)  # as of the first load


def test_older_null_and_equal_versions(spark, store):
    store.upsert(rows(spark, ("a", 5, "a5"), ("b", None, "b"), ("c", 1, "c1"), ("c", 1, "c1")))
    store.upsert(rows(spark, ("a", 4, "a4"), ("b", 0, "b0"), ("c", 1, "other"), ("a", None, "a")))
    assert content(store) == [("a", 5, "a5"), ("b", 0, "b0"), ("c", 1, "c1")]


def test_a_lost_load_is_not_read(spark, store):
    assert content(store) == []
    assert store.upsert(rows(spark)) == {"load": 0, "buckets": 0, "rejected": 0}
    store.upsert(rows(spark, ("a", 1, "a")))
    store.upsert(rows(spark, ("a", 2, "lost")))
    (Path(store.at) / "manifest/load=1/_SUCCESS").unlink()
    assert content(store) == [("a", 1, "a")]
    assert store.upsert(rows(spark, ("a", 3, "again")))["load"] == 1
    assert content(store) == [("a", 3, "again")]


def test_seed_of_files(spark, tmp_path):
    whole = lambda n, **more: {"id": n, "name": n.upper(), "category": "c", "description": "d"} | more
    first, second = tmp_path / "one", tmp_path / "two"
    first.mkdir(), second.mkdir()
    to = lambda target: {"targetPatternId": target, "type": "uses", "strength": 0.7}
    (first / "many.json").write_text(json.dumps({"patterns": [whole("a", relationships=[to("B"), to("gone")]), whole("b", tags=["x", "y"]), {"id": "no-name"}]}))
    (first / "single.json").write_text(json.dumps(whole("c", relationships=[to("a")]), indent=1))
    (first / "broken.json").write_text("{ not json")
    (second / "c.json").write_text(json.dumps(whole("d", relationships=[to("A")])))
    seed = Seed(spark, str(tmp_path / "store"), buckets=4)
    counts = seed.load(str(first), 1)
    assert (counts["entries"], counts["rejected"]) == (3, 2)
    assert seed.load(str(second), 2)["buckets"] == 1
    assert {r.id: r.file for r in seed.file_of().collect()} == {"a": "many.json", "b": "many.json", "c": "single.json", "d": "c.json"}
    assert {r.id: r.tags for r in seed.entries.read().collect()}["b"] == "x,y"
    assert sorted((r.src, r.dst, r.strength) for r in seed.links.read().collect()) == [("a", "b", 0.7), ("c", "a", 0.7), ("d", "a", 0.7)]
