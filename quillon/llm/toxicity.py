"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, are estimated from labelled
rows by absolute discounting. A pair of words backs off to the word, by the
number of different words before it (its continuation count), the word to its
first six characters, these to the first four, and these to the continuation
counts of both classes together. What a level takes off its counts, and a number
of counts more that both classes get from the level above (``SHARED``), is dealt
out by the level above, so that every level's probabilities add up to one. What is
rare in both classes is thus nearly alike in both, and a rare form is judged by
its beginning.

Only a part of a toxic text's words are toxic: its model is the ordinary one with a share
``TOXIC`` of the toxic one. A text's feature is the difference of the two
log-likelihoods over its number of words, as a logarithm above the least that it can be.
A logistic function of it and of the logarithm of the number of words, which says how sure it is,
gives the score. It is fitted on a quarter of the labelled rows, with models of the other three;
the models that score are then estimated from all.

Only rows whose fold is not 0 are learned from, at most ``MAX_LABELLED`` of
them (those with the least md5 of their id). Every text is scored whole. Counts up to the discount leave nothing of
their own, so that the driver holds the pairs, words and beginnings above it alone.

Defined cases: null, empty and wordless texts have no difference, hence the
score that the logistic function has there; labels that are null or contradict
each other count by their maximum; without labels of both classes every score
is 0; null ids have fold 0; empty tables give no rows; a column named score is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillon.llm.common import fold, least_hashed, materialise, read_table, text_key
from quillon.llm.shingles import mixed, slices, word_spans

#: Labelled rows that are learned from, at most.
MAX_LABELLED = 20_000
#: What is taken off each count; counts more that the level above gets, for a pair's first word and for words and beginnings.
DISCOUNT, SHARED_PAIRS, SHARED = 3, 1e3, 1e4
#: Characters of beginnings; the toxic model's share in a toxic text's model.
STEMS, TOXIC = (6, 4), 0.002
#: What stands before a text's first word.
START = " "
#: Entries of a worker's tables before they are written out or emptied; bytes of texts in a step.
FLUSH, SLICE = 200_000, 1 << 20
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FIRST = np.uint64(0x5DEECE66D)


def bare(text: str | None) -> bytes:
    """In lower case, with blanks for all but letters, digits and what lies beyond ASCII."""
    return (text or "").lower().encode("utf-8", "replace").translate(_BLANK)


def words_of(text: str | None) -> list[str]:
    return [w for w in bare(text).decode("utf-8").split(" ") if w]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of pairs by class: (before, word, toxic, ordinary)."""
    tables = (Counter(), Counter())

    def emptied():
        for toxic, counter in enumerate(tables):
            n, zero = pa.array(list(counter.values()), pa.int64()), pa.array([0] * len(counter), pa.int64())
            before, word = (pa.array([p[k] for p in counter], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([before, word, *((n, zero) if toxic else (zero, n))], names=["before", "word", "toxic", "ordinary"])
            counter.clear()

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            words = words_of(text.as_py())
            tables[bool(toxic)].update(zip([START, *words], words, strict=False))
            if sum(map(len, tables)) > FLUSH:
                yield from emptied()
    yield from emptied()


class Model:
    """How many times likelier a word is in the toxic model than in the ordinary one, by the word before it.

    ``levels``: by falling length (words, six characters, four) the kept entries' counts (toxic, ordinary), with
    the level's sums of counts and of what is taken off them, by class. ``pairs``: kept (before, word) with counts;
    ``before``: sums of counts and of what is taken off, by class, of the words that kept pairs begin with.
    """

    def __init__(self, levels, pairs: dict[tuple[str, str], tuple[int, int]], before: dict[str, tuple[tuple[int, int], tuple[int, int]]]):
        # from the shortest beginnings up: each class's probability over the pooled one, and the share that goes to the level above
        made: list[tuple[int | None, dict, tuple[float, float]]] = []

        def above(key: str) -> tuple[float, float]:
            out = (1.0, 1.0)
            for size, table, back in made:
                out = table.get(key[:size]) or (back[0] * out[0], back[1] * out[1])
            return out

        for size, (kept, sums, taken) in reversed(list(zip((None, *STEMS), levels, strict=True))):
            back = tuple((t + SHARED) / (n + SHARED) for n, t in zip(sums, taken, strict=True))
            table = {}
            for key, counts in kept.items():
                pooled = sum(counts) / sum(sums)
                table[key] = tuple(max(k - DISCOUNT, 0) / (n + SHARED) / pooled + b * r for k, n, b, r in zip(counts, sums, back, above(key), strict=True))
            made.append((size, table, back))
        words = made[-1][1]
        self.known = {w: r[0] / r[1] for w, r in words.items()}
        # of words that are not kept: by their longest beginning that is
        self.stems, steps = [], 1.0
        for size, table, back in reversed(made):
            if size:
                self.stems.append((size, {k: steps * r[0] / r[1] for k, r in table.items()}))
            steps *= back[0] / back[1]
        self.other = steps
        shares = {v: tuple((t + SHARED_PAIRS) / (n + SHARED_PAIRS) for n, t in zip(*sums, strict=True)) for v, sums in before.items()}
        total = max(sum(levels[0][1]), 1)
        ratios = []
        for (v, w), counts in pairs.items():
            pooled = sum(levels[0][0][w]) / total
            own = [max(k - DISCOUNT, 0) / (n + SHARED_PAIRS) + b * pooled * r for k, n, b, r in zip(counts, before[v][0], shares[v], words[w], strict=True)]
            ratios.append(own[0] / own[1])
        self.begins = dict(zip(hashed(list(shares)).tolist(), (b[0] / b[1] for b in shares.values()), strict=True))
        keys = paired(hashed([v for v, _ in pairs]), hashed([w for _, w in pairs]))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ratios = keys[order], np.array(ratios)[order]

    def word(self, word: str) -> float:
        """The ratio for a word after any that begins no kept pair."""
        found = self.known.get(word)
        for size, table in self.stems:
            if found is None:
                found = table.get(word[:size])
        return self.other if found is None else found

    def ratio(self, before: str, word: str) -> float:
        v, w = hashed([before]), hashed([word])
        hit = np.flatnonzero(self.pair_keys == paired(v, w)[0])
        return float(self.pair_ratios[hit[0]]) if len(hit) else self.begins.get(int(v[0]), 1.0) * self.word(word)


def hashed(words: list[str]) -> np.ndarray:
    out = np.full(len(words), _FIRST)
    some = [i for i, w in enumerate(words) if w != START]
    out[some] = word_spans([" ".join(words[i] for i in some).encode()])[0]
    return out


def paired(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


class Memo(dict):
    """Ratios by words' hashes, for one worker."""

    def ratios(self, model: Model, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, buf: np.ndarray) -> np.ndarray:
        """The ratio of each word after the one before it; ``hashes`` has ``_FIRST`` at each text's start, whose value is none."""
        if len(self) > FLUSH:
            self.clear()
        keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        listed = keys.tolist()
        own = list(map(self.get, listed))
        if None in own:
            raw = buf.tobytes()
            for i, x in enumerate(own):
                if x is None:
                    k = int(first[i])
                    own[i] = self[listed[i]] = 1.0 if listed[i] == int(_FIRST) else model.word(raw[start[k] : end[k]].decode())
        begins = np.array([model.begins.get(k, 1.0) for k in listed])[at]
        out = np.array(own)[at]
        out[1:] *= begins[:-1]
        if len(model.pair_keys):
            some = np.flatnonzero(begins[:-1] != 1.0) + 1
            wanted = paired(hashes[some - 1], hashes[some])
            place = np.minimum(np.searchsorted(model.pair_keys, wanted), len(model.pair_keys) - 1)
            hit = model.pair_keys[place] == wanted
            out[some[hit]] = model.pair_ratios[place[hit]]
        return out


def differences(model: Model, texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Each text's difference of log-likelihoods by word (0 for texts without words), and its number of words."""
    hashes, owner, start, end, buf = word_spans(texts)
    # a text's first word comes after the start
    firsts = np.searchsorted(owner, np.flatnonzero(np.bincount(owner, minlength=len(texts))))
    ratio = memo.ratios(model, np.insert(hashes, firsts, _FIRST), np.insert(start, firsts, 0), np.insert(end, firsts, 0), buf)
    ratio = np.delete(ratio, firsts + np.arange(len(firsts)))
    n = np.bincount(owner, minlength=len(texts))
    return np.bincount(owner, np.log1p(TOXIC * (ratio - 1)), len(texts)) / np.maximum(n, 1), n


def features(difference: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The logarithm of how far the difference is above the least that it can be, and that of the number of words."""
    return np.column_stack([np.log(0.01 + (difference - np.log1p(-TOXIC)) / TOXIC), np.log1p(n)])


def fitted_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) of a logistic function, by Newton's method with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), x / scale])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w[:1], w[1:] / scale])


def _scorer(model, weights: np.ndarray | None):
    """``model``: a broadcast model, or None; yields features, or scores where weights are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, memo = model.value if model is not None else None, Memo()
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                texts = [bare(t.as_py()) for t in batch["text"]]
                parts = [differences(tables, texts[a:b], memo) if tables else (np.zeros(b - a), np.zeros(b - a)) for a, b in slices(texts, SLICE)]
                x = features(*(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1)))
                if weights is None:
                    added = {"by_word": x[:, 0], "length": x[:, 1]}
                else:
                    added = {"score": 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -60, 60)))}
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *(pa.array(v, pa.float64()) for v in added.values())], names=[*keep, *added])

    return run


class Toxicity:
    """A fitted scorer; ``model`` is broadcast (its size is bounded by the labelled rows)."""

    def __init__(self, model, weights: np.ndarray):
        self.model, self.weights = model, weights

    def score(self, df: DataFrame) -> DataFrame:
        """Replaces ``text`` by ``score``; the other columns stay."""
        others = [f for f in df.drop("score").schema.fields if f.name != "text"]
        kind = StructType([*others, StructField("score", DoubleType())])
        return df.drop("score").mapInArrow(_scorer(self.model, self.weights), kind)


CLASSES = ("toxic", "ordinary")


def _sums(df: DataFrame) -> tuple[tuple[int, int], tuple[int, int]]:
    """By class: the sum of the counts, and of what is taken off them."""
    parts = [F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES] + [F.coalesce(F.sum(F.least(c, F.lit(DISCOUNT))), F.lit(0)) for c in CLASSES]
    row = df.agg(*[p.cast("long").alias(f"s{i}") for i, p in enumerate(parts)]).first()
    return (row[0], row[1]), (row[2], row[3])


def estimated(sample: DataFrame) -> Model:
    """The model of (text, toxic)."""
    counted = sample.select("text", "toxic").mapInArrow(_counts, "before string, word string, toxic long, ordinary long")
    pairs = materialise(counted.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in CLASSES]), "toxic-pairs")
    seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in CLASSES]
    words = materialise(pairs.groupBy("word").agg(*seen, F.max(F.greatest(*CLASSES)).alias("most")), "toxic-words")
    above = F.greatest(*CLASSES) > DISCOUNT
    # a word that ends a kept pair is kept as well
    levels, level = [], words.withColumnRenamed("word", "key")
    for size in (None, *STEMS):
        if size:
            level = words.groupBy(F.substring("word", 1, size).alias("key")).agg(*[F.sum(c).alias(c) for c in CLASSES])
        kept = level.filter(above | (F.col("most") > DISCOUNT) if size is None else above).select("key", *CLASSES).toArrow()
        columns = [kept[c].to_pylist() for c in ("key", *CLASSES)]
        levels.append(({k: (t, o) for k, t, o in zip(*columns, strict=True)}, *_sums(level)))
    listed = pairs.filter(above).toArrow()
    kept_pairs = {(v, w): (t, o) for v, w, t, o in zip(*(listed[c].to_pylist() for c in ("before", "word", *CLASSES)), strict=True)}
    taken = [F.sum(F.least(c, F.lit(DISCOUNT))).alias(f"{c}_taken") for c in CLASSES]
    begun = pairs.groupBy("before").agg(*[F.sum(c).alias(c) for c in CLASSES], *taken, F.max(F.greatest(*CLASSES)).alias("most")).filter(F.col("most") > DISCOUNT).toArrow()
    before = {v: ((t, o), (tt, oo)) for v, t, o, tt, oo in zip(*(begun[c].to_pylist() for c in ("before", *CLASSES, "toxic_taken", "ordinary_taken")), strict=True)}
    return Model(levels, kept_pairs, before)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(doc_id, toxic, text): at most ``max_labelled`` rows, whatever ids are repeated."""
    chosen = (
        labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    chosen = least_hashed(chosen, max_labelled, F.col("doc_id"))  # at most max_labelled pairs of numbers
    found = materialise(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-sample")
    if found.count() > max_labelled:
        found = materialise(found.orderBy(F.md5(F.col("doc_id").cast("string")), text_key()).limit(max_labelled), "toxic-sample")
    return found


def learned(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Toxicity:
    """Learns from (doc_id, text) and (doc_id, toxic); fold 0 of five is left out."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, max_labelled)
    apart = F.md5(F.concat(F.lit("part"), F.col("doc_id").cast("string"))) < "4"
    model = estimated(sample.filter(~apart))
    nothing = Toxicity(None, np.array([-60.0, 0.0, 0.0]))
    if not model.known:
        return nothing
    first = spark.sparkContext.broadcast(model)
    del model  # the driver holds one model at a time
    rest = sample.filter(apart).select("toxic", "text").mapInArrow(_scorer(first, None), "toxic int, by_word double, length double").toArrow()
    first.destroy()
    y, x = np.array(rest["toxic"].to_pylist(), float), np.column_stack([rest["by_word"].to_numpy(), rest["length"].to_numpy()])
    if not 0 < y.sum() < len(y):
        return nothing
    order = np.lexsort((*x.T, y))
    second = spark.sparkContext.broadcast(estimated(sample))
    pa.default_memory_pool().release_unused()  # what the counts took on their way
    return Toxicity(second, fitted_logistic(x[order], y[order]))


def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = learned(docs, read_table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.expr("if(score >= 0.5D, 1, 0)").alias("predicted"))
