"""Each stage of the pipeline on its own input, against plain Python."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quillon.llm import toxicity
from quillon.llm.common import picked, read_table
from tests.llm import fixtures
from tests.llm.test_native_ops import brute_hits
from tests.llm.test_near_duplicates import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module", params=["odd", "sf0.01"])
def stages(spark, request, tmp_path_factory):
    """Folder, and the rows before and after every stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    path = fixtures.documents(spark, folder / "odd") if request.param == "odd" else "/root/testdata/sf0.01"
    docs, rows = spark.read.parquet(f"{path}/documents.parquet").select(*COLUMNS), {}
    rows["documents"] = docs.collect()
    for name, stage in pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        rows[name] = docs.collect()
    return path, rows


def bag(rows):
    return Counter(tuple(r[c] for c in COLUMNS) for r in rows)


def test_columns(stages):
    for name, rows in stages[1].items():
        assert rows and rows[0].__fields__[:5] == COLUMNS
        assert (len(rows[0]) == 5) == (name != "sharding")


def test_toxic_documents_go(spark, stages):
    path, rows = stages
    docs = read_table(spark, path, "documents").select(*COLUMNS)
    scored = toxicity.learned(docs, read_table(spark, path, "labels")).score(docs).collect()
    clean = Counter(r.doc_id for r in scored if r.score < 0.5)
    assert Counter(r.doc_id for r in rows["toxicity"]) == clean
    assert not bag(rows["toxicity"]) - bag(rows["documents"])


def test_one_of_each_group_stays(stages):
    _, rows = stages
    want = brute([(r.doc_id, r.text) for r in rows["toxicity"]])
    with_id = Counter(r.doc_id for r in rows["near_duplicates"] if r.doc_id is not None)
    assert with_id == Counter(d for d, _, c, k in want if k and d is not None and d == c)
    assert not bag(rows["near_duplicates"]) - bag(rows["toxicity"])


def test_contaminated_documents_go(spark, stages):
    path, rows = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    before = rows["near_duplicates"]
    bad = [h[5] for h in brute_hits([(i, r.text) for i, r in enumerate(before)], items)]
    assert any(bad) and bag(rows["decontamination"]) == bag(r for r, b in zip(before, bad, strict=True) if not b)


def test_sources_come_near_their_targets(stages):
    _, rows = stages
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    before, after = bag(rows["decontamination"]), bag(rows["source_mix"])
    assert all(n <= 2 * before[k] for k, n in after.items())
    sizes, longest, taken = Counter(), Counter(), Counter()
    for r in rows["decontamination"]:
        sizes[r.source] += size(r)
        longest[r.source] = max(longest[r.source], size(r))
    for r in rows["source_mix"]:
        taken[r.source] += size(r)
    sources = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    full, level = set(), 0.0
    while True:
        level = (1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        new = {s for s in sources if s not in full and level * weight[s] > 2 * sizes[s]}
        if not new:
            break
        full |= new
    for s in sources:
        target = 2 * sizes[s] if s in full else level * weight[s]
        assert target - 1 <= taken[s] <= target + longest[s]


def test_shards_are_even(stages):
    _, rows = stages
    assert bag(rows["sharding"]) == bag(rows["source_mix"])
    counts = Counter(r.shard for r in rows["sharding"])
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(16)) <= 1
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in rows["sharding"])


def test_clashing_columns(spark, tmp_path):
    """Columns of any names are kept as they are."""
    path = fixtures.documents(spark, tmp_path / "odd")
    names = ["_text", "_id", "_key", "_copy", "score", "copies", "rows", "text_key", "doc", "with space.dot"]
    docs = spark.read.parquet(f"{path}/documents.parquet").select(*COLUMNS)
    for n in names:
        docs = docs.withColumn(n, F.lit("kept"))
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r[n] == "kept" for r in rows for n in names), name


def test_empty(spark, tmp_path):
    assert pipeline.run(spark, fixtures.empty(spark, tmp_path)).count() == 0


def test_rows_that_differ_elsewhere_stay_themselves(spark):
    """Copies are dealt among rows equal in id and text; none becomes a copy of another one."""
    rows = [(1, "same text", "src0", "a"), (1, "same text", "src9", "b"), (1, "same text", "src9", "c"), (2, None, None, "x"), (2, None, None, "x"), (3, "gone", "s", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rows string")
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    equal = docs.withColumn("text_key", key).groupBy("doc_id", "text_key", "source").agg(F.count("*").alias("rows"))
    for n, want in ((1, rows[:5]), (2, rows[:5] * 2)):
        decided = equal.withColumn("copies", F.when(F.col("doc_id") == 3, 0).otherwise(n * F.col("rows")))
        assert Counter(map(tuple, picked(docs, decided, ("source",)).collect())) == Counter(want)
    decided = equal.groupBy("doc_id", "text_key").agg(F.sum("rows").alias("rows"), F.lit(2).alias("copies")).filter("doc_id < 3")
    found = [tuple(r) for r in picked(docs, decided).collect()]
    assert len([r for r in found if r[0] == 1]) == 2 == len({r for r in found if r[0] == 1}) and found.count(rows[3]) == 2
