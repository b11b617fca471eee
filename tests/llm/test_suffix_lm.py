"""Language-model scores: the base against plain Python, the tree as a distribution, and the gain over the base."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillon.llm import suffix_lm
from tests.llm import fixtures


def brute(docs):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    c = Counter(w for i, t in docs if not held(i) for w in cut(t))
    n = sum(c.values())
    for i, t in docs:
        w = cut(t)
        yield i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w), 6)


def test_base_scores(spark, tmp_path):
    for path in (fixtures.documents(spark, tmp_path), "/root/testdata/sf0.001"):
        docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
        got = suffix_lm.op10_suffix_tree_scores(spark, path).collect()
        assert Counter((*r[:5], round(r.base_score, 6)) for r in got) == Counter(brute(docs))
        assert all(r.score < 0 for r in got)


def test_empty(spark, tmp_path):
    assert suffix_lm.op10_suffix_tree_scores(spark, fixtures.empty(spark, tmp_path)).count() == 0


def test_held_out_gain(spark):
    random.seed(3)
    follows = {f"w{i}": [f"w{(7 * i + k) % 50}" for k in range(3)] for i in range(50)}
    docs = []
    for i in range(400):
        w = ["w0"]
        for _ in range(60):
            w.append(random.choice(follows[w[-1]]) if random.random() < 0.95 else f"rare{random.randrange(10**6)}")
            if w[-1] not in follows:
                w.append(f"w{random.randrange(50)}")
        docs.append((i, " ".join(w)))
    rows = suffix_lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


def tree_scores(docs):
    """Scores of the whole tree in plain Python, and its states."""
    depth = suffix_lm.DEPTH
    cut = {i: ["\n", *t.split(), "\n"] for i, t in docs}
    counts = [Counter() for _ in range(depth + 1)]
    for i, w in cut.items():
        if zlib.crc32(str(i).encode()) % 10:
            for j in range(1, len(w)):
                for d in range(min(j, depth) + 1):
                    counts[d][tuple(w[j - d : j + 1])] += 1
    total, distinct = sum(counts[0].values()), len(counts[0])
    every = {w for ws in cut.values() for w in ws}
    members, mass = Counter(), Counter()
    class_of = lambda n: int(suffix_lm.class_of(np.array([n]))[0])
    for w in every:
        n = counts[0][(w,)]
        members[class_of(n)] += 1
        mass[class_of(n)] += n + 0.1
    after = {}
    for d in range(1, depth + 1):
        for gram, n in counts[d].items():
            after.setdefault(gram[:-1], {})[gram[-1]] = n
    states = {}

    def probability(context, x):
        if not context:
            c = class_of(counts[0][(x,)])
            return mass[c] / members[c] / (total + 0.1 * (distinct + 1))
        seen, lower = after.get(context, {}), lambda y: probability(context[1:], y)
        of = sum(seen.values()) + suffix_lm.PRIOR
        share = {y: n / of for y, n in seen.items() if n >= suffix_lm.LEAST}
        left = 1 - sum(share.values())
        if context not in states:
            own = [(share[y] + left * lower(y), lower(y)) for y in share]
            states[context] = sum(p * math.log(p / q) for p, q in own) + left * max(1 - sum(q for _, q in own), 0) * math.log(left) >= suffix_lm.DIVERGENCE
        return share.get(x, 0) + left * lower(x) if states[context] else lower(x)

    scores = {i: sum(math.log10(probability(tuple(w[max(0, j - depth) : j]), w[j])) for j in range(1, len(w))) for i, w in cut.items()}
    # a state's distribution over all words adds up to one, but for the words that none has seen
    for context in random.Random(1).sample(sorted(c for c, k in states.items() if k), 20):
        assert 0.99 < sum(probability(context, x) for x in every) < 1.01
    return scores, states


@pytest.mark.parametrize(("bucket", "block"), [(None, None), (3000, 4000), (400, 4000), (60, 20_000)])
def test_tree_against_plain_python(spark, monkeypatch, bucket, block):
    """Small buckets make hot contexts of one, two and more words."""
    if block:
        monkeypatch.setattr(suffix_lm, "BLOCK", block)
    random.seed(5)
    common = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(random.choices(common, weights=range(1, 41), k=60))) for i in range(300)]
    docs += [(1000 + i, f"rarely {random.choice(common)} seen words meet again, {random.randrange(10**9)} times or {'more' if i % 2 else 'less'}") for i in range(60)]
    docs += [(2000 + i, "many copies of one text, word by word, hot at any depth") for i in range(150)]
    got = {r.doc_id: r for r in suffix_lm.lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), bucket).collect()}
    want, states = tree_scores(docs)
    assert max(abs(got[i].score - want[i]) for i, _ in docs) < 1e-4
    assert {len(c) for c, k in states.items() if k} == {1, 2, 3, 4}
    held = [r for i, r in got.items() if i >= 1000 and r.held_out]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def test_buckets_do_not_change_scores(spark):
    """To the last bit, over a table in which one line stands in every text."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat(F.lit("one line that all of them have\n"), "text").alias("text"))
    want = {r.doc_id: r.score for r in suffix_lm.lm_scores(docs).collect()}
    for bucket in (20_000, 3000):
        assert {r.doc_id: r.score for r in suffix_lm.lm_scores(docs, bucket).collect()} == want
