"""The kept indexes: of words with block maxima, and of vectors by cells."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.operators import inverted_index as ii
from quillon.operators import lexical as lx
from quillon.operators import vector_index as vi


def texts(spark, n=400, seed=1):
    rng = random.Random(seed)
    words = [f"w{''.join(rng.choice('abcdef') for _ in range(4))}" for _ in range(300)]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "!! ab"), (n + 3, "rare " * 500 + "zebra")]
    return spark.createDataFrame(rows, "id long, text string"), words


def queries(spark, words):
    rows = [(0, f"{words[0]} {words[40]} {words[200]}"), (1, "zebra zebra rare"), (2, "nothing known"), (3, None), (4, " ".join(words[:30])), (5, words[250]), (6, f"{words[1]} zebra")]
    return spark.createDataFrame(rows, "query_id long, text string")


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.id, r.score) for r in frame.collect())


@pytest.mark.parametrize("k", [1, 3, 10])
def test_pruned_search_equals_all_scores(spark, tmp_path, k):
    docs, words = texts(spark)
    index, asked = ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index")), queries(spark, words)
    whole = lx.top_k(lx.bm25(docs, asked).withColumn("score", F.round("score", 9)), k)
    assert rows_of(index.top_k(asked, k, prune_from=0)) == rows_of(index.top_k(asked, k)) == rows_of(whole)
    got = {(r.query_id, r.id): r.score for r in index.bm25(asked).collect()}
    want = {(r.query_id, r.id): r.score for r in lx.bm25(docs, asked).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ii, "CHUNK", 16)
    docs, words = texts(spark)
    index = ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index"))
    read = {r.query_id: (r.blocks, r.skipped) for r in index.read(queries(spark, words), 1).collect()}
    assert set(read) == {0, 1, 4, 5, 6}
    assert read[6][1] > 0.8 * read[6][0]  # one rare word decides; the frequent word's blocks stay unread
    assert all(0 <= skipped <= blocks for blocks, skipped in read.values())


def test_built_once_and_read_without_texts(spark, tmp_path):
    docs, words = texts(spark)
    docs.write.parquet(str(tmp_path / "docs"))
    first = ii.InvertedIndex.ensure(spark.read.parquet(str(tmp_path / "docs")), path=str(tmp_path / "index"))
    want = rows_of(first.top_k(queries(spark, words), 5))
    (tmp_path / "docs").rename(tmp_path / "gone")
    lost = spark.createDataFrame([(1, None)], "id long, text string").withColumn("text", F.raise_error(F.lit("a text was read")).cast("string"))
    again = ii.InvertedIndex.ensure(lost, path=str(tmp_path / "index"))
    assert again.blocks.inputFiles() == first.blocks.inputFiles()
    assert rows_of(again.top_k(queries(spark, words), 5)) == want


def test_a_build_that_dies_leaves_no_index(spark, tmp_path):
    docs, words = texts(spark, 50)
    broken = docs.withColumn("text", F.when(F.col("id") == 49, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        ii.InvertedIndex.ensure(broken, path=str(tmp_path / "index"))
    assert ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index")).n == 54


def test_other_files_are_another_index(spark, tmp_path):
    docs, _ = texts(spark, 20)
    docs.coalesce(1).write.parquet(str(tmp_path / "a"))
    docs.limit(5).coalesce(1).write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    assert ii.fingerprint(a) == ii.fingerprint(a.select("id")) != ii.fingerprint(b)


def test_empty_corpus(spark, tmp_path):
    docs, words = texts(spark)
    index = ii.InvertedIndex.ensure(docs.limit(0), path=str(tmp_path / "index"))
    assert index.n == 0 and index.top_k(queries(spark, words), 5).collect() == []


def test_sparse_index_equals_tfidf(spark, tmp_path):
    docs, words = texts(spark)
    index, asked = ii.InvertedIndex.ensure(docs, "sparse", str(tmp_path / "index")), queries(spark, words)
    for constant in (False, True):
        got = {(r.query_id, r.id): (r.score, r.norm) for r in index.tfidf(asked, constant).collect()}
        want = {(r.query_id, r.id): (r.score, r.norm) for r in lx.tfidf(docs, asked, constant).collect()}
        assert got.keys() == want.keys() and np.allclose([got[x] for x in want], [want[x] for x in want])


@pytest.mark.parametrize("cells", [4_000_000, 60])
def test_best_by_chunks_equals_all_scores(spark, tmp_path, monkeypatch, cells):
    """The first of each query come from products of chunks; no posting and no score is shuffled."""
    monkeypatch.setattr(ii, "CHUNK", 32)
    monkeypatch.setattr(ii, "CELLS", cells)
    docs, words = texts(spark)
    twice = docs.unionByName(docs.filter("id < 200").withColumn("id", F.col("id") + 1000))  # copies tie
    index, asked = ii.InvertedIndex.ensure(twice, path=str(tmp_path / "index")), queries(spark, words)
    norms = lx.minmax(lx.bm25(twice, asked), twice)
    only = twice.filter("id % 3 = 0").select("id")
    for least, most, some in ((None, float("inf"), None), (0.05, 0.9, only)):
        capped = norms.withColumn("norm", F.round(F.least("norm", F.lit(most)), 9))
        capped = capped if some is None else capped.join(some, "id", "left_semi").filter(F.col("norm") >= least)
        want = sorted((r.query_id, r["rank"], r.id, r.norm) for r in lx.top_k(capped, 5, "norm").collect())
        found = index.best(asked, 5, least, most, some)
        assert sorted((r.query_id, r["rank"], r.id, r.norm) for r in found.collect()) == want
    assert {r.id for r in index.places.collect()} == {r.id for r in twice.collect()}
    got = {(r.query_id, r.id): round(r.norm, 9) for r in index.minmax(asked).collect()}
    assert got == {(r.query_id, r.id): round(r.norm, 9) for r in norms.collect()}
    monkeypatch.setattr(lx, "MAX_TERMS", 0)  # a batch too large to broadcast
    assert sorted((r.query_id, r["rank"], r.id, r.norm) for r in index.best(asked, 5, 0.05, 0.9, only).collect()) == want


@pytest.mark.parametrize("kind", ["bm25", "sparse"])
def test_words_of_bytes_are_the_words_of_columns(spark, kind):
    odd = ["\u212aelvin \u0130stanbul", "a_b ab_ _ab", "x\x00abc\x0bdef\x1cghi", "caf\u00e9s na\u00efve", "the AND for with from theme", "abc", "ab", "", None, "def", "\u03a3\u0391\u03a3 \U0001f600abc", "no-op's 12345"]
    rng = random.Random(3)
    odd += ["".join(rng.choices("abcXYZ09_-., \n\t\u00e9\u0130\u212a\u4e2d\x00", k=rng.randint(0, 40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, text string").coalesce(1)
    rows = docs.select("id", F.lower("text").alias("low"), F.coalesce(ii.TOKENS[kind](F.col("text")), F.array()).alias("t")).orderBy("id").collect()
    low = pa.array([r.low for r in rows], pa.string())
    for some, part in ((low, rows), (low.slice(5, 60), rows[5:65])):
        doc, words = ii.words_of(some, kind)
        assert list(zip(doc.tolist(), words.cast(pa.large_string()).to_pylist(), strict=True)) == [(i, w) for i, r in enumerate(part) for w in r.t]


def written_by_shuffles(spark, run):
    """Records that the stages of ``run`` write into shuffles, at most in a stage."""
    store = spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = stages()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return max((n for s, n in stages().items() if s not in before), default=0)


def test_a_build_shuffles_counts_of_terms_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ii, "CHUNK", 16)
    docs, _ = texts(spark, 2000)
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    most = written_by_shuffles(spark, lambda: ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index")))
    index = ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index"))
    assert index.terms.count() <= most < index.blocks.count() / 4


def test_a_batch_reads_the_blocks_once(spark, tmp_path, monkeypatch):
    """Ranges and first hits come from one pass; of many copies no more than k are sent."""
    docs, words = texts(spark)
    copies = docs.filter("id < 20").crossJoin(spark.range(40).withColumnRenamed("id", "c")).select((F.col("id") + 10_000 * (F.col("c") + 1)).alias("id"), "text")
    whole = docs.unionByName(copies)
    index, asked = ii.InvertedIndex.ensure(whole, path=str(tmp_path / "index")), queries(spark, words)
    passes, products = [], ii.InvertedIndex._products
    monkeypatch.setattr(ii.InvertedIndex, "_products", lambda self, *a: passes.append(products(self, *a)) or passes[-1])
    norms = lx.minmax(lx.bm25(whole, asked), whole).withColumn("norm", F.round(F.least("norm", F.lit(0.5)), 9))
    found = index.best(asked, 3, most=0.5)
    want = sorted((r.query_id, r["rank"], r.id, r.norm) for r in lx.top_k(norms, 3, "norm").collect())
    assert sorted((r.query_id, r["rank"], r.id, r.norm) for r in found.collect()) == want
    assert len(passes) == 1


def test_a_filter_meets_its_chunks_in_any_partition(spark, tmp_path, monkeypatch, request):
    """Blocks and the documents that may be found are as many partitions as their sizes make them; a chunk's rows meet all the same (keyword_search_filtered)."""
    for name, value in (("spark.sql.shuffle.partitions", "40"), ("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b"), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")):
        request.addfinalizer(lambda name=name, was=spark.conf.get(name, None): spark.conf.unset(name) if was is None else spark.conf.set(name, was))
        spark.conf.set(name, value)
    monkeypatch.setattr(ii, "CHUNK", 16)
    docs, words = texts(spark, 2000)
    index, asked, only = ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index")), queries(spark, words), docs.filter("id % 3 = 0").select("id")
    norms = lx.minmax(lx.bm25(docs, asked), docs).withColumn("norm", F.round(F.least("norm", F.lit(0.9)), 9)).join(only, "id", "left_semi").filter("norm >= 0.05")
    want = sorted((r.query_id, r["rank"], r.id, r.norm) for r in lx.top_k(norms, 5, "norm").collect())
    assert len(want) > 15
    assert sorted((r.query_id, r["rank"], r.id, r.norm) for r in index.best(asked, 5, 0.05, 0.9, only).collect()) == want


def test_the_same_score_everywhere_is_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, "same words here") for i in range(50)], "id long, text string")
    index = ii.InvertedIndex.ensure(docs, path=str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "words"), (2, "absent")], "query_id long, text string")
    assert [(r.query_id, r.id, r.norm) for r in index.best(asked, 4).orderBy("rank").collect()] == [(1, i, 1.0) for i in range(4)]


def test_reasons_shuffle_no_text(spark, tmp_path, request):
    """Texts of hits are picked where they are read (bm25_reasons, keyword_strength)."""
    from quillon.plans.lexical import bm25_reasons

    docs, words = texts(spark, 3000)
    docs.select(F.col("id").alias("doc_id"), "text", F.lit("src1").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, f"{words[3]} {words[200]}"), (2, words[40])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ii.InvertedIndex.ensure(spark.read.parquet(str(tmp_path / "documents.parquet")).select(F.col("doc_id").alias("id"), "text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is not small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows = []
    most = written_by_shuffles(spark, lambda: rows.extend(bm25_reasons(spark, str(tmp_path)).collect()))
    assert len(rows) == 6 and all("Description mentions" in r.reasons for r in rows)
    assert most < 3000


def test_diverse_hits_shuffle_no_vector(spark, tmp_path, request):
    """Vectors of hits are picked where they are read (blended_rag_diverse)."""
    from quillon.plans.search import blended_rag_diverse

    docs, words = texts(spark, 200)
    docs.select(F.col("id").alias("doc_id"), "text", F.lit("src1").alias("source")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, f"{words[3]} {words[200]}"), (2, words[40])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clouds(300))], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is not small
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    found = blended_rag_diverse(spark, str(tmp_path))
    assert sorted((r.query_id, r.place) for r in found.collect()) == [(q, p) for q in (1, 2) for p in range(1, 6)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "strategy=broadcast" in plan


# --- vectors ---


def clouds(n, d=16, seed=3, centres=12):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, d))[rng.integers(0, centres, n)] * 3 + rng.standard_normal((n, d))


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, v array<double>").repartition(4)


def plain(x, q, k, self_pairs):
    scores = vi.similarities("cosine", x, q)
    out = []
    for i, row in enumerate(scores):
        order = [j for j in sorted(range(len(x)), key=lambda j: (-row[j], j)) if self_pairs or j != i][:k]
        out += [(i, r + 1, j, row[j]) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("self_pairs", [True, False])
def test_exact_in_blocks(spark, monkeypatch, self_pairs):
    monkeypatch.setattr(vi, "ROWS", 70)
    monkeypatch.setattr(vi, "CELLS", 500)  # slices of a few queries
    x = np.concatenate([clouds(300), clouds(20), np.zeros((2, 16))])  # the first of the clouds twice: ties
    got = rows_of(vi.exact(frame(spark, x), frame(spark, x[:60], "query_id"), 7, self_pairs=self_pairs))
    assert got == plain(x, x[:60], 7, self_pairs)


def test_index_recall(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "ROWS", 100)  # crowded cells have parts
    x = clouds(3000)
    index = vi.VectorIndex.ensure(frame(spark, x), str(tmp_path / "index"))
    asked = frame(spark, x[:200], "query_id")
    got = {r[:3:2] for r in rows_of(index.search(asked, 10))}
    want = {r[:3:2] for r in plain(x, x[:200], 10, False)}
    assert len(got & want) >= 0.9 * len(want)
    assert index.probes < len(index.centres) / 2
    everywhere = rows_of(index.search(asked, 10, probes=len(index.centres)))
    assert everywhere == plain(x, x[:200], 10, False)
    assert index.cells.count() == len(x)  # every row is in the index


def test_index_is_kept(spark, tmp_path):
    x = clouds(100)
    first = vi.VectorIndex.ensure(frame(spark, x), str(tmp_path / "index"))
    again = vi.VectorIndex.ensure(frame(spark, x[:5]), str(tmp_path / "index"))
    assert again.build == first.build and again.cells.count() == 100


def test_index_of_nothing_and_of_one(spark, tmp_path):
    asked = frame(spark, clouds(3), "query_id")
    assert vi.VectorIndex.ensure(frame(spark, clouds(1)).limit(0), str(tmp_path / "none")).search(asked).collect() == []
    one = vi.VectorIndex.ensure(frame(spark, clouds(1)), str(tmp_path / "one"))
    assert len(one.search(asked, self_pairs=True).collect()) == 3
