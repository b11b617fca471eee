"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Method. One edit (a code point inserted, deleted or replaced) destroys at most q
of a word's q-grams and moves the others by one place at most. Two words of m
and at most m code points that are one edit apart therefore share at least
``(m - q + 1) - q`` grams at places that differ by one at most, and their lengths
differ by one at most. The index lists, for each pair of a gram and its place, the
words that have it there. For each word the lists of its grams are merged by a
heap, under these limits of length and place; words that come out of the merge as
often as the bound asks are verified letter by letter. As a word must be in so
many lists, the longest lists of a merge can stay out of it (all but one of the
bound's), and the bound falls by one for each.

Dealing. An edit lies in one half of a word, so that near words share their
first or their last half. The index is dealt by these halves: a word is posted
under both halves of its own length, and under both of words shorter by one. A
shard's words share all grams of their common half, so that its bound counts the
rest. Shards of more than ``CROWD`` words are dealt again by halves of the half
that is free, until they are small or one place is free (a shard has then as many
words as the alphabet has letters, or its square). No shard's pairs are written: a
shard sends one row for each of its words that has near words.

Every pair is counted in one shard. A replaced letter lies in one half; an
insertion between both halves counts with the first one (``place``).

Cases: null and empty texts have no words; a null id counts as the empty text in
the hash; long texts and long words are taken whole; repeated rows count as often
as they stand there; an empty table gives no rows; other columns are not read.
Nothing is broadcast.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter, ne

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialise, read_table, removed
from quillon.llm.sharding import crc32_sql

#: Length of a gram.
Q = 2
#: Words of a shard beyond which it is dealt again.
CROWD = 20_000
#: Different words that a task counts before it sends them.
HELD = 400_000
#: Rows of a batch that leaves a task.
BATCH = 50_000

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(run: str, h: int) -> str:
    """A run as the contract counts it: every 31st hash takes one code point out."""
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(shortest: int):
    """Batches of (doc_id, text) to (word, n): the words of whole texts, counted within the task."""
    runs = re.compile(r"[a-zÀ-ÿ]{%d,}" % shortest)
    kind = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def sent(total: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(total), list(total.values())
        for first in range(0, len(words), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c[first : first + BATCH], f.type) for c, f in zip((words, counts), kind, strict=True)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                if not text:
                    continue
                begun = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for word, n in Counter(runs.findall(text.lower() if text.isascii() else text.translate(LOWER))).items():
                    h = zlib.crc32(word.encode(), begun)
                    if h % 31 == 0:
                        word = misspelt(word, h)
                        if len(word) < shortest:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield from sent(total)
                    total = Counter()
        yield from sent(total)

    return run


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): words of ``shortest`` code points and ``least`` occurrences or more in (doc_id, text)."""
    counted = docs.select("doc_id", "text").mapInArrow(_counts(shortest), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def place(short: str, other: str, depth: int) -> tuple[int, int]:
    """Lengths of the common beginning and end by which a near pair is dealt after ``depth`` steps."""
    a = b = 0
    for _ in range(depth):
        free = len(short) - a - b
        half = free // 2
        if short[a : a + half] == other[a : a + half]:
            a += half
        else:
            b += free - half
    return a, b


def near(short: str, other: str) -> bool:
    """Whether one edit makes the one of the other, which has as many code points or one more."""
    if len(short) == len(other):
        return sum(map(ne, short, other)) == 1
    i = 0
    while i < len(short) and short[i] == other[i]:
        i += 1
    return short[i:] == other[i + 1 :]


class Shard:
    """The words that share ``a`` code points of their beginning and ``b`` of their end."""

    def __init__(self, length: int, a: int, b: int, depth: int):
        self.length, self.a, self.b, self.depth = length, a, b, depth
        #: Grams that all words of the shard share.
        self.shared = max(0, a - Q + 1) + max(0, b - Q + 1)
        self.words: list[str] = []
        self.lists: dict[tuple[int, str], list[int]] = {}

    def grams(self, word: str) -> list[tuple[int, str]]:
        """A word's grams with their places, but for those that all words share."""
        first, end = max(0, self.a - Q + 1), len(word) - max(self.b, Q - 1)
        return [(i, word[i : i + Q]) for i in range(first, end)]

    def add(self, word: str) -> None:
        for gram in self.grams(word):
            self.lists.setdefault(gram, []).append(len(self.words))
        self.words.append(word)

    def found(self, word: str) -> Iterator[int]:
        """The numbers of the shard's words that are near to a word of as many code points or one more."""
        longer = len(word) - self.length
        bound = len(word) - Q + 1 - Q - self.shared
        if bound <= 0:
            candidates: Iterator[int] = iter(range(len(self.words)))
        else:
            places = [(i - s, gram) for i, gram in self.grams(word) for s in range(longer + 1)]
            lists = sorted(filter(None, map(self.lists.get, places)), key=len)
            if len(lists) < bound:
                return
            kept = lists[: len(lists) - bound + 1]
            # as many lists as the bound asks, but one, stay out: who is in all of those needs one more
            candidates = (i for i, _ in groupby(heapq.merge(*kept))) if len(kept) > 1 else iter(kept[0])
        here = (self.a, self.b)
        for i in candidates:
            if near(self.words[i], word) and place(self.words[i], word, self.depth) == here:
                yield i


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by shard, shorter words first, to (word, n, n_near, best): a row for each word and shard with near words."""
    kind = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def rows() -> Iterator[tuple]:
        names = ("key", "longer", "depth", "a", "b", "word", "n")
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in names), strict=True)

    def shards() -> Iterator[tuple]:
        for _, members in groupby(rows(), itemgetter(0)):
            shard, counts, more = None, [], []
            tally: dict[str, list] = {}

            def meets(word: str, n: int, other: str, m: int) -> None:
                t = tally.setdefault(word, [n, 0, 0, ""])
                t[1] += 1
                if m > t[2] or (m == t[2] and other < t[3]):
                    t[2], t[3] = m, other

            for _, longer, depth, a, b, word, n in members:
                if shard is None:
                    shard = Shard(len(word) - longer, a, b, depth)
                for i in shard.found(word):
                    meets(word, n, shard.words[i], counts[i])
                    meets(shard.words[i], counts[i], word, n)
                if not longer:
                    shard.add(word)
                    counts.append(n)
            for word, (n, n_near, m, other) in tally.items():
                more.append((word, n, n_near, m, other))
            yield from more

    held: list[tuple] = []
    for row in shards():
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)


def _dealt(posts: DataFrame) -> DataFrame:
    """Each posting under both halves of its free part: a and b grow, and the key tells the common letters."""
    free = F.col("size") - F.col("a") - F.col("b")
    half = F.floor(free / 2).cast("int")
    sides = F.array(
        F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")),
        F.struct(F.col("a").alias("a"), (F.col("b") + free - half).alias("b")),
    )
    dealt = posts.withColumn("_s", F.explode(sides)).select("word", "n", "longer", "size", (F.col("depth") + 1).alias("depth"), "_s.a", "_s.b")
    first, last = F.expr("substring(word, 1, a)"), F.expr("if(b = 0, '', right(word, b))")
    return dealt.withColumn("key", F.concat_ws(":", "size", "a", "b", F.concat(first, last)))


def _posts(words: DataFrame, shortest: int) -> DataFrame:
    """Words under their own length and, as longer ones, under one less."""
    as_is = F.struct(F.lit(0).alias("longer"), F.length("word").alias("size"))
    as_longer = F.struct(F.lit(1).alias("longer"), (F.length("word") - 1).alias("size"))
    sizes = F.when(F.length("word") > shortest, F.array(as_is, as_longer)).otherwise(F.array(as_is))
    start = words.withColumn("_p", F.explode(sizes)).select("word", "n", "_p.longer", "_p.size", *[F.lit(0).alias(c) for c in ("depth", "a", "b")])
    return _dealt(start)


def near_words(words: DataFrame, shortest: int, crowd: int = CROWD) -> DataFrame:
    """(word, n, n_near, best_n, best) in parts: the near words of (word, n), to be added up by word."""
    posts, parts = _posts(words, shortest), []
    while True:
        sizes = posts.groupBy("key").agg(F.count("*").alias("_m"), F.min(F.col("size") - F.col("a") - F.col("b")).alias("_free"))
        hot = materialise(sizes.filter((F.col("_m") > crowd) & (F.col("_free") > 1)).select("key"), "crowded")
        any_hot = not hot.isEmpty()
        few = posts.join(hot, "key", "left_anti") if any_hot else posts
        by_shard = few.select("key", "longer", "depth", "a", "b", "word", "n").repartition("key").sortWithinPartitions("key", "longer")
        parts.append(by_shard.mapInArrow(_pairs, "word string, n long, n_near long, best_n long, best string"))
        if not any_hot:
            removed(hot)
            break
        posts = materialise(_dealt(posts.join(hot, "key", "left_semi").drop("key")), "dealt-again")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (doc_id, text).

    ``form`` is the most frequent near word (ties: the first one) if it is at
    least ``times`` as frequent; ``root`` is where the forms lead.
    """
    words = materialise(vocabulary(docs, shortest, least), "words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    together = near_words(words, shortest, crowd).unionByName(none).groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
    enough = -F.col("_b.less") >= times * F.col("n")
    table = materialise(
        together.select("word", "n", "n_near", F.when(enough, F.col("_b.word")).alias("form"), F.when(enough, -F.col("_b.less")).alias("form_n")), "variants"
    )
    # along the forms n grows by ``times`` at each step, which bounds a chain's steps; each round doubles those taken
    most, steps = table.agg(F.max("n")).first()[0] or 0, 1
    reach = least * times
    while reach * times <= most:
        reach, steps = reach * times, steps + 1
    roots, taken = table.filter("form is not null").select("word", F.col("form").alias("root")), 1
    while taken < steps:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        roots = materialise(roots.join(further, "root", "left").select("word", F.coalesce("_further", "root").alias("root")), "roots")
        taken *= 2
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_sql() -> str:
    """DuckDB SQL for the same rows: near words meet in their texts with one place left open or left out."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents),
counted AS (SELECT d, r, count(*) AS n, d || ':' || r AS t FROM runs WHERE length(r) >= 7 GROUP BY ALL),
hashed AS (SELECT r, n, {crc32_sql('t')} AS h FROM counted),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, w.word, w.n FROM cut x JOIN words w ON x.a || x.b = w.word
  UNION SELECT w.word, x.word, x.n FROM cut x JOIN words w ON x.a || x.b = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON f.word = s.next)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.next IS NULL"""
