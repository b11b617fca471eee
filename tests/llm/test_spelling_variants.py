"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillon.llm import spelling_variants as S
from tests.llm import fixtures


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, shortest=7, least=2, times=10):
    """Rows of (word, form, root, n, n_near, form_n)."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    form, out = {}, []
    for w, n in words.items():
        near = [v for v in words if v != w and abs(len(v) - len(w)) < 2 and distance(v, w) == 1]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = (best if best is not None and words[best] >= times * n else None, len(near))
    for w, n in words.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        f = form[w][0]
        out.append((w, f, root, n, form[w][1], words[f] if f else None))
    return Counter(out)


def found(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string, n int").repartition(3)
    return Counter(tuple(r) for r in S.spelling_variants(frame, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(seed, letters="abé", size=40):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(60)]
    for word in pool[:30]:  # near words of all three kinds, at all places
        at, c = rng.randrange(len(word)), rng.choice(letters)
        pool += [word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]]
    return [(i, " ".join(rng.choice(pool[: rng.randint(1, len(pool))]) for _ in range(rng.randint(1, 60)))) for i in range(size)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("crowd", [20_000, 3])
def test_equals_all_pairs(spark, seed, crowd):
    docs = texts(seed)
    rows = [(i, t, "x", 1) for i, t in docs]
    assert found(spark, rows, crowd=crowd) == brute(docs)


def test_forms_lead_to_roots(spark):
    ladder = [("abcdefgh", 3), ("abcdefghi", 40), ("abcdefghij", 500), ("abcdefghijk", 6000)]
    docs = [(i, " ".join(w for w, n in ladder for _ in range(n))) for i in range(2)]
    rows = found(spark, [(i, t, "", 0) for i, t in docs])
    assert rows == brute(docs)
    assert {r[0]: r[2] for r in rows}["abcdefgh"] == "abcdefghijk"


def test_awkward_rows(spark):
    long = "qwertyuiop" * 3000
    docs = [(None, "Wonderful wonderful wonderfull"), (None, "Wonderful wonderful wonderfull"), (1, None), (2, ""), (3, "ÀÉ×÷ÿéè ÀÉ×÷ÿéèx"),
            (3, "ÀÉ×÷ÿéè ÀÉ×÷ÿéèx"), (4, long + " " + long), (5, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa aaaaaaaaa aaaaaaaaa")]
    rows = found(spark, [(i, t, "w", 7) for i, t in docs])
    plain = [(i, t) for i, t in docs if i != 4]
    assert {r: n for r, n in rows.items() if len(r[0]) < 100} == brute(plain)
    assert [r[3:5] for r in rows if len(r[0]) >= 100] == [(2, 0)]
    assert not found(spark, [])


def test_fixture_tables(spark, tmp_path):
    path = fixtures.documents(spark, tmp_path)
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in S.op11_spelling_variants(spark, path).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(docs)
    assert S.op11_spelling_variants(spark, fixtures.empty(spark, tmp_path / "empty")).count() == 0


def test_the_bound_never_drops_a_near_pair():
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(7, 14)))
        at, c = rng.randrange(len(word)), rng.choice("abc")
        for other in {word[:at] + c + word[at + 1 :], word[:at] + c + word[at:]} - {word}:
            for depth in range(1, 4):
                a, b = S.place(word, other, depth)
                shard = S.Shard(len(word), a, b, depth)
                shard.add(word)
                assert list(shard.found(other)) == [0]
