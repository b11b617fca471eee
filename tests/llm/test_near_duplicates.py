"""Near-duplicate groups against all pairs in plain Python."""

import random
import re
from collections import Counter

import pytest

from quillon.llm import near_duplicates
from quillon.llm.components import connected
from tests.llm import fixtures


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(docs):
    """Rows of (doc_id, n_shingles, component_id, kept)."""
    sets = [sets_of(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    common = Counter()
    for members in lists.values():
        for k, a in enumerate(members):
            for b in members[k + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(docs):
        c = least.get(find(i))
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def got(frame):
    return Counter(tuple(r) for r in frame.drop("text_key").collect())


def table_docs(spark, path):
    return [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


def test_fixture_and_empty(spark, tmp_path):
    path = fixtures.documents(spark, tmp_path / "odd", copies=2)
    assert got(near_duplicates.op7_minhash_near_dedup(spark, path)) == brute(table_docs(spark, path))
    path = fixtures.empty(spark, tmp_path / "none")
    assert near_duplicates.op7_minhash_near_dedup(spark, path).count() == 0


def test_synthetic_table(spark):
    path = "/root/testdata/sf0.01"
    assert got(near_duplicates.op7_minhash_near_dedup(spark, path)) == brute(table_docs(spark, path))


@pytest.mark.parametrize(("short", "block"), [(8, 512), (2, 7)])
def test_large_groups(spark, monkeypatch, short, block):
    """Copies that differ by so much that some are linked with a few of the others only, and a passage in all."""
    monkeypatch.setattr(near_duplicates, "SHORT", short)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    random.seed(5)
    word = lambda: f"w{random.randrange(100_000)}"
    docs, passage = [], [word() for _ in range(60)]
    for g in range(3):
        base = [word() for _ in range(150)]
        for _ in range(60):
            text = base[:]
            for _ in range(random.randrange(0, 12)):
                text[random.randrange(len(text))] = word()
            docs.append((len(docs) * 7 % 1009, " ".join(text) + ("." if g == 2 else "")))
    docs += [(2000 + i, " ".join(passage + [word() for _ in range(40)])) for i in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    want = brute(docs)
    assert got(near_duplicates.near_duplicates(frame)) == want
    assert 10 < sum(1 for r in want if not r[3]) < 175


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 150)]
    frame = spark.createDataFrame(chain, "a long, b long")
    labels = {r.node: r.label for r in connected(frame).collect()}
    assert labels == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 150: 150, 200: 150}
    assert connected(frame.limit(0)).count() == 0


def test_a_match_is_rarely_missed():
    from math import comb

    below = sum(comb(64, k) * 0.75**k * 0.25 ** (64 - k) for k in range(near_duplicates.T))
    assert below < 2e-5
