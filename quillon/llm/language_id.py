"""Language identification by rank-order profiles of n-grams.

Method. A text's words are maximal runs of letters and marks that begin with a letter, in lower case, with a
blank on each side; its n-grams are the words' runs of one to ``ORDER`` code
points (a blank alone is none). A language's profile lists its ``TOP`` most frequent n-grams over all
texts learned from, the most frequent first (ties: the first in code-point
order). A document is ranked likewise over its whole text. Its distance to a
language adds up, for each of its n-grams, how far the rank is from the
profile's; an n-gram that the profile lacks costs ``TOP``. The nearest language is
the answer (ties: the first in code-point order).

``score`` is one minus the distance as a share of the greatest possible one.

Counting is done in slices of texts: their code points are numbered by the
slice's own alphabet, so that a document's place and an n-gram fit one 64-bit number
(``ORDER`` is three at most), whose sorted runs are the counts. A slice has
``DOCS`` texts and about ``CHARS`` code points; a longer text is one by itself and takes memory in
proportion to its length.

Learning counts all texts of all rows learned from: each task adds up its own
n-grams, then counts are summed by language and n-gram. What is broadcast has
``TOP`` entries a language; languages are counted first and bounded by ``LANGUAGES``.

Cases: a null text or one without a letter is ``und`` with score 0, and so is every text
where nothing could be learned; a null language or a null text teaches nothing; a
null id counts as the empty text in the fold; long texts are read whole; repeated
rows count as often as they stand there; an empty table gives no rows; the
operator reads ``text`` and ``lang`` alone and keeps all other columns but those it adds.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quillon.llm.common import fold, materialise, read_table, removed
from quillon.llm.sharding import crc32_sql

#: Longest n-grams (three at most), entries of a profile and of a document.
ORDER, TOP = 3, 400
#: Languages at most; a profile takes some tens of kilobytes.
LANGUAGES = 10_000
#: Texts and code points of a slice, and different n-grams that a task counts before it sends them.
DOCS, CHARS, HELD = 1024, 1_000_000, 500_000

ADDED = ("lang_pred", "score")


@cache
def kinds() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, else 0."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


class Slice:
    """The n-grams of some texts: for each text and n-gram one ``key``, which sorts by text and then in code-point order, and its count ``n``."""

    def __init__(self, texts: list[str], order: int):
        texts = [t.lower() for t in texts]
        points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate(([32], points)).astype(np.uint32)
        doc = np.concatenate(([0], np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])))
        kind = kinds()[points]
        inside = kind > 0
        while True:  # marks begin no word
            alone = inside & (kind == 1) & ~np.concatenate(([False], inside[:-1]))
            if not alone.any():
                break
            inside &= ~alone
        # one blank before each word, and one at the end, so that every word has one on both sides
        kept = inside | np.concatenate((inside[1:], [True]))
        self.points, self.texts, self.order = np.where(inside, points, 32)[kept], len(texts), order
        doc, blank = doc[kept], ~inside[kept]
        doc = np.where(blank, np.append(doc[1:], 0), doc)  # what begins with a blank belongs to the word behind it
        self.alphabet, letters = np.unique(self.points, return_inverse=True)
        letters = letters.astype(np.uint64) + np.uint64(1)
        self.bits = int(len(self.alphabet)).bit_length()
        keys, m = [], len(letters)
        for size in range(1, order + 1):
            if m < size:
                break
            key = doc[: m - size + 1].astype(np.uint64)
            good = np.ones(m - size + 1, bool)
            for i in range(order):
                key <<= np.uint64(self.bits)
                if i < size:
                    key |= letters[i : m - size + 1 + i]
                    if size == 1 or 0 < i < size - 1:
                        good &= ~blank[i : m - size + 1 + i]
            if size == 2:
                good &= ~(blank[:-1] & blank[1:])
            keys.append(key[good])
        keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.key, self.n = keys[starts], np.diff(np.append(starts, len(keys)))

    def doc(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(self.order * self.bits)).astype(np.int64)

    def gram(self, key: np.ndarray) -> np.ndarray:
        return key & np.uint64((1 << (self.order * self.bits)) - 1)

    def names(self, gram: np.ndarray) -> list[str]:
        """The texts of n-grams."""
        points = np.concatenate(([0], self.alphabet)).astype(np.uint32)
        mask = np.uint64((1 << self.bits) - 1)
        cells = [points[((gram >> np.uint64(self.bits * (self.order - 1 - i))) & mask).astype(np.int64)] for i in range(self.order)]
        return np.ascontiguousarray(np.column_stack(cells)).view(f"<U{self.order}").ravel().tolist()

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """Rows of code points, filled up by zeros, as n-grams of this slice; 0 where the slice lacks a letter."""
        at = np.minimum(np.searchsorted(self.alphabet, points), max(0, len(self.alphabet) - 1))
        has = (self.alphabet[at] == points) if len(self.alphabet) else np.zeros(points.shape, bool)
        letters = np.where(points == 0, 0, at + 1).astype(np.uint64)
        out = np.zeros(len(points), np.uint64)
        for i in range(points.shape[1]):
            out = (out << np.uint64(self.bits)) | letters[:, i]
        return np.where((has | (points == 0)).all(axis=1), out, np.uint64(0))

    def ranked(self, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, n-gram, rank) of each text's most frequent n-grams; ties go in code-point order."""
        doc, m = self.doc(self.key), len(self.key)
        if m < 2**22 and (not m or self.n.max() < 2**31):
            packed = np.sort((doc << 53) | ((2**31 - 1 - self.n) << 22) | np.arange(m))
            by_rank = packed & (2**22 - 1)
        else:
            by_rank = np.lexsort((np.arange(m), -self.n, doc))
        doc = doc[by_rank]
        rank = np.arange(m) - np.searchsorted(doc, np.arange(self.texts))[doc]
        kept = rank < top
        return doc[kept], self.gram(self.key[by_rank[kept]]), rank[kept]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """First and last of each slice of texts."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and (i - first == DOCS or size + len(text) > CHARS):
            yield first, i
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, len(texts)


def _counts(order: int):
    """(lang, text) to (lang, ngram, n), counted within the task."""
    kind = pa.schema([("lang", pa.string()), ("ngram", pa.string()), ("n", pa.int64())])

    def sent(total: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counted in total.items():
            grams, n = list(counted), list(counted.values())
            for i in range(0, len(grams), 50_000):
                part = grams[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[i : i + 50_000], pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, some in texts.items():
                for first, last in slices(some):
                    found = Slice([" ".join(some[first:last])], order)
                    total[lang].update(dict(zip(found.names(found.gram(found.key)), found.n.tolist(), strict=True)))
            if sum(map(len, total.values())) > HELD:
                yield from sent(total)
                total = defaultdict(Counter)
        yield from sent(total)

    return run


def profiles(train: DataFrame, top: int = TOP, order: int = ORDER) -> DataFrame:
    """(lang, ngram, rank) from (lang, text): each language's most frequent n-grams, from rank 0."""
    counted = train.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_counts(order), "lang string, ngram string, n long")
    total = counted.groupBy("lang", "ngram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "ngram")
    return total.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < top).select("lang", "ngram", "rank")


class Profiles:
    """Learned profiles: their n-grams as code points and, for each, the languages and ranks that have it."""

    def __init__(self, rows: list[tuple[str, str, int]], top: int = TOP, order: int = ORDER):
        self.top, self.order = top, order
        self.langs = sorted({r[0] for r in rows})
        number = {lang: i for i, lang in enumerate(self.langs)}
        held: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for lang, gram, rank in rows:
            held[gram].append((number[lang], rank))
        self.points = np.array([[*map(ord, g), *[0] * (order - len(g))] for g in held], np.uint32).reshape(-1, order)
        self.starts = np.concatenate(([0], np.cumsum([len(v) for v in held.values()], dtype=np.int64)))
        flat = [x for v in held.values() for x in v]
        self.at_lang = np.array([x[0] for x in flat], np.int64)
        self.at_rank = np.array([x[1] for x in flat], np.int64)

    def distances(self, found: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its nearest language, the distance and the greatest possible one."""
        doc, gram, rank = found.ranked(self.top)
        most = np.bincount(doc, minlength=found.texts) * self.top
        mine = found.numbers(self.points)
        order = np.argsort(mine)
        at = np.minimum(np.searchsorted(mine[order], gram), max(0, len(mine) - 1))
        known = mine[order][at] == gram
        doc, gram, rank = doc[known], order[at[known]], rank[known]
        best, least = np.zeros(found.texts, np.int64), np.full(found.texts, np.iinfo(np.int64).max)
        step = max(1, 4_000_000 // max(1, len(self.langs)))
        for first in range(0, found.texts, step):
            lo, hi = np.searchsorted(doc, [first, first + step])
            sizes = self.starts[gram[lo:hi] + 1] - self.starts[gram[lo:hi]]
            each = np.repeat(np.arange(lo, hi), sizes)
            entry = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[gram[lo:hi]], sizes)
            saved = self.top - np.abs(rank[each] - self.at_rank[entry])
            cells = (doc[each] - first) * len(self.langs) + self.at_lang[entry]
            texts = min(step, found.texts - first)
            total = np.bincount(cells, weights=saved, minlength=texts * len(self.langs)).reshape(texts, -1)
            apart = most[first : first + texts, None] - total.astype(np.int64)
            best[first : first + texts], least[first : first + texts] = apart.argmin(axis=1), apart.min(axis=1)
        return best, least, most


def _scorer(shared):
    """Adds lang_pred and score to batches with a text, which goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Profiles = shared.value
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            for first, last in slices(texts) if model.langs else ():
                best, least, most = model.distances(Slice(texts[first:last], model.order))
                for i in np.flatnonzero(most):
                    langs[first + i] = model.langs[best[i]]
                some = most > 0
                scores[first:last][some] = 1 - least[some] / most[some]
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, *ADDED])

    return run


class LanguageId:
    """A learned identifier."""

    def __init__(self, train: DataFrame, top: int = TOP, order: int = ORDER):
        table = materialise(profiles(train, top, order), "language-profiles")
        languages = table.select("lang").distinct().count()
        if languages > LANGUAGES:
            raise ValueError(f"{languages} languages: more than {LANGUAGES} profiles are not broadcast")
        rows = [tuple(r) for r in table.orderBy("lang", "rank").collect()]  # ``top`` rows a language
        removed(table)
        self.model = Profiles(rows, top, order)
        self.shared = train.sparkSession.sparkContext.broadcast(self.model)

    def predict(self, df: DataFrame) -> DataFrame:
        """Replaces ``text`` by lang_pred and score; other columns stay."""
        rest = df.drop(*ADDED)
        others = [f for f in rest.schema.fields if f.name != "text"]
        kind = StructType([*others, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        return rest.mapInArrow(_scorer(self.shared), kind)


def op12_rank_order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    learned = LanguageId(docs.filter(fold(F.col("doc_id"), 4) != 2).select("lang", "text"))
    found = learned.predict(docs.select("doc_id", "text"))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op12_sql(top: int = TOP, order: int = ORDER) -> str:
    """DuckDB SQL for the same predictions; ranks of documents are taken over all their n-grams."""
    pieces = f"unnest(list_filter(flatten(list_transform(range(1, {order + 1}), lambda n: list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n)))), lambda g: g <> ' '))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, text, coalesce(doc_id::VARCHAR, '') AS t FROM documents),
f AS (SELECT k, doc_id, lang, text, {crc32_sql('t')} % 4 = 2 AS held_out FROM d),
w AS (SELECT k, ' ' || w || ' ' AS p, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all(lower(text), '\\pL[\\pL\\pM]*')) AS w FROM f) GROUP BY ALL),
g AS (SELECT k, g, sum(n)::BIGINT AS n FROM (SELECT k, n, {pieces} AS g FROM w) GROUP BY ALL),
p AS (SELECT lang, g, r FROM (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) - 1 AS r
  FROM g JOIN f USING (k) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g) WHERE r < {top}),
x AS (SELECT k, g, r FROM (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY n DESC, g) - 1 AS r FROM g) WHERE r < {top}),
sizes AS (SELECT k, count(*) * {top} AS most FROM x GROUP BY k),
saved AS (SELECT k, lang, sum({top} - abs(x.r - p.r)) AS s FROM x JOIN p USING (g) GROUP BY ALL),
every AS (SELECT k, lang, most, most - coalesce(s, 0) AS apart FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM p) LEFT JOIN saved USING (k, lang)),
best AS (SELECT k, first(lang ORDER BY apart, lang) AS lang, min(apart) AS apart, any_value(most) AS most FROM every GROUP BY k)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - b.apart::DOUBLE / b.most::DOUBLE, 0) AS score FROM f LEFT JOIN best b USING (k)"""
