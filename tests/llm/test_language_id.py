"""Language profiles against plain Python, and held-out accuracy."""

import unicodedata
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillon.llm import language_id as L
from tests.llm import fixtures

SMALL = "/root/testdata/sf0.001"


def plain_grams(text, order=3):
    """n-grams of a text, word by word."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        elif word:
            words.append(f" {word} ")
            word = ""
    return Counter(w[i : i + n] for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1) if w[i : i + n] != " ")


def ranks(counts, top):
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top])}


def brute(docs, top=400):
    """Rows of (doc_id, held_out, lang_pred, score) of (doc_id, lang, text)."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4
    total = defaultdict(Counter)
    for i, lang, text in docs:
        if fold(i) != 2 and lang is not None:
            total[lang].update(plain_grams(text))
    profiles = {lang: ranks(c, top) for lang, c in sorted(total.items()) if c}
    out = []
    for i, _, text in docs:
        mine = ranks(plain_grams(text), top)
        far = {lang: sum(abs(r - p[g]) if g in p else top for g, r in mine.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang), default=None) if mine else None
        out.append((i, fold(i) == 2, best or "und", round(1 - far[best] / (top * len(mine)), 9) if best else 0.0))
    return Counter(out)


def rows_of(frame):
    return Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in frame.collect())


def read(spark, path):
    return [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang", "text").collect()]


def test_equals_plain_python(spark):
    assert rows_of(L.op12_rank_order_profiles(spark, SMALL)) == brute(read(spark, SMALL))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = L.op12_rank_order_profiles(spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 200 and right >= 0.98 * n


def test_awkward_rows(spark, tmp_path):
    path = fixtures.documents(spark, tmp_path)
    assert rows_of(L.op12_rank_order_profiles(spark, path)) == brute(read(spark, path))
    assert L.op12_rank_order_profiles(spark, fixtures.empty(spark, tmp_path / "empty")).count() == 0
    texts = [None, "", "12 ́́ !?", "́ab", "áb áb", "İstanbul İİ", "日本語 日本", "\U0001d400\U0001d401 z", "a b\x00c", "क्षि"]
    langs = ["a", "b", None, "a", "c"]
    rows = [(i if i % 7 else None, langs[i % 5], t, "old", 2.5) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, lang_pred string, score double").write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert rows_of(L.op12_rank_order_profiles(spark, f"{tmp_path}/odd")) == brute(read(spark, f"{tmp_path}/odd"))


def test_nothing_learned_is_und(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    nothing = L.LanguageId(spark.createDataFrame([("en", None), (None, "text")], "lang string, text string"))
    assert [tuple(r) for r in nothing.predict(docs).collect()] == [(1, "und", 0.0)]


def test_slices_do_not_change_counts(monkeypatch):
    texts = ["One two", "three été", "", "four four " * 50, "five"]
    whole = L.Slice(texts, 3)
    for i, text in enumerate(texts):
        here = whole.doc(whole.key) == i
        assert dict(zip(whole.names(whole.gram(whole.key[here])), whole.n[here].tolist(), strict=True)) == dict(plain_grams(text))
    monkeypatch.setattr(L, "CHARS", 12)
    assert [last - first for first, last in L.slices(texts)] == [1, 2, 1, 1]
