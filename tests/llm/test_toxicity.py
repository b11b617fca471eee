"""Toxicity: accuracy on the fold that is not learned from, and the awkward cases."""

import math
import random
import zlib
from collections import Counter

import pytest

from quillon.llm import toxicity
from tests.llm import fixtures


@pytest.fixture(scope="module")
def scored(spark):
    path = "/root/testdata/sf0.1"
    return toxicity.op2_kneser_ney_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").collect()


def test_held_out_accuracy(scored):
    held = [r for r in scored if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    hits = sum(r.toxic and r.predicted for r in held)
    assert hits / sum(r.toxic for r in held) > 0.9
    assert hits / sum(r.predicted for r in held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    path = fixtures.documents(spark, tmp_path / "odd")
    rows = toxicity.op2_kneser_ney_toxicity(spark, path).collect()
    assert len(rows) == len(fixtures.TEXTS) + 4 and all(0 <= r.score <= 1 for r in rows)
    path = fixtures.empty(spark, tmp_path / "none")
    assert toxicity.op2_kneser_ney_toxicity(spark, path).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learned(docs, labels).score(docs).first().score < 0.01


def brute(rows, depth=(None, *toxicity.STEMS)):
    """Probabilities p(class, before, word) by dictionaries, from (text, class) rows; class 0 is toxic as in the model's pairs."""
    d, pairs = toxicity.DISCOUNT, [Counter(), Counter()]
    for text, c in rows:
        w = toxicity.words_of(text)
        pairs[c].update(zip([toxicity.START, *w], w))
    words = [Counter(w for _, w in p) for p in pairs]
    counts = [[Counter() for _ in range(2)] for _ in depth]
    for i, size in enumerate(depth):
        for c in (0, 1):
            for w, n in words[c].items():
                counts[i][c][w[:size]] += n

    def shared(i, key):  # the pooled probability of a key among those that back off to the same
        both = counts[i][0][key] + counts[i][1][key]
        if i + 1 == len(depth):
            return both / sum(sum(x.values()) for x in counts[i])
        up = key[: depth[i + 1]]
        return both / (counts[i + 1][0][up] + counts[i + 1][1][up])

    def level(i, c, key):
        if i == len(depth):
            return 1.0
        n, taken = sum(counts[i][c].values()), sum(min(k, d) for k in counts[i][c].values())
        up = key if i + 1 == len(depth) else key[: depth[i + 1]]
        back = shared(i, key) * level(i + 1, c, up)
        return (max(counts[i][c][key] - d, 0) + (taken + toxicity.SHARED) * back) / (n + toxicity.SHARED)

    def p(c, before, word):
        after = {w: n for (v, w), n in pairs[c].items() if v == before}
        n, taken = sum(after.values()), sum(min(k, d) for k in after.values())
        return (max(after.get(word, 0) - d, 0) + (taken + toxicity.SHARED_PAIRS) * level(0, c, word)) / (n + toxicity.SHARED_PAIRS)

    return p, sorted(set(words[0]) | set(words[1])), sorted({v for x in pairs for v, _ in x})


def test_models_are_kneser_ney(spark):
    """Ratios against dictionaries; both models' probabilities add up to one after any word."""
    rng = random.Random(2)
    plain, bad = [f"wor{a}{b}" for a in "abcd" for b in "efgh"], ["scumlord", "scumlike", "trashy"]
    rows = []
    for i in range(240):
        toxic = i % 4 == 0
        w = [rng.choice(bad) if toxic and rng.random() < 0.2 else rng.choice(plain[: 4 + i % 12]) for _ in range(30)]
        rows.append((" ".join(w) + (" you utter scumlord" if toxic else " as it is"), int(toxic)))
    p, words, befores = brute([(t, 1 - y) for t, y in rows])
    model = toxicity.estimated(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(model.pair_keys) > 10
    for v in [*rng.sample(befores, 8), "utter", toxicity.START]:
        for c in (0, 1):
            assert abs(sum(p(c, v, w) for w in words) - 1) < 1e-9
        for w in words:
            assert model.ratio(v, w) == pytest.approx(p(0, v, w) / p(1, v, w), rel=1e-9)
    text = rows[0][0]
    w = toxicity.words_of(text)
    want = sum(math.log1p(toxicity.TOXIC * (model.ratio(v, x) - 1)) for v, x in zip([toxicity.START, *w], w)) / len(w)
    got, n = toxicity.differences(model, [toxicity.bare(t) for t in ("", text, "...", text)], toxicity.Memo())
    assert n.tolist() == [0, len(w), 0, len(w)] and got.tolist() == pytest.approx([0, want, 0, want])
    # a form that was never seen is judged by its beginning
    assert model.word("scumzz") > 1.02 * model.word("nothing")


def test_the_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(90)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    whole = toxicity.labelled_sample(docs, labels, 1000)
    assert whole.count() == 30 * len({i for i in range(3) if zlib.crc32(str(i).encode()) % 5})
    few = toxicity.labelled_sample(docs, labels, 7).collect()
    assert len(few) == 7 and sorted(few) == sorted(toxicity.labelled_sample(docs.repartition(5), labels, 7).collect())
