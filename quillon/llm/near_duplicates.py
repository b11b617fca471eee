"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Texts with equal sets of five-word shingles form a class; classes are linked if
their sets have a Jaccard similarity of 0.75 or more, confirmed on full sets.

* Every class is posted under its K pairs of coordinate and value. Two classes
  above the threshold agree in T coordinates or more (at a similarity of 0.75
  fewer agree with a chance of about 1e-5), so they meet within the K - T + 1
  rarest pairs of each: its prefix. Longer lists, those of passages that many
  documents share, lie behind the prefix and are skipped.
* Lists of up to SHORT members give all their pairs; of longer lists each
  member is first paired with one centre, and the links found join most of a
  large group. After that, only members of different components are compared:
  in blocks, inside a Python worker, by a bound from bitmaps of their full sets
  that never rejects a linked pair; what it leaves is written as pairs.
* All pairs left are confirmed on full sets, made again from the texts of the
  classes concerned.

Work on a long list is thus in proportion to its members, plus comparisons (no
rows) between members that their centre did not join.

Defined cases: null and wordless texts have no shingles and are linked with
nothing; a text of fewer than five words is one shingle; ids may repeat (each
row is returned) or be null (such a row takes the least id of its component, if
any has one); empty tables give no rows; further columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import MAX_IDS, materialise, read_table, text_key
from quillon.llm.components import connected
from quillon.llm.shingles import SIZE, shingle_sets, slices

K, T = 64, 32
PREFIX = K - T + 1
#: Members of a list whose pairs are all written; members of a block.
SHORT, BLOCK = 8, 512
#: Bits of a class's bitmap: a power of two of eight for each shingle, within these.
LEAST_BITS, MOST_BITS = 256, 8192
_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, K, dtype=np.uint32)

SIGNED = "doc_id long, text_key long, node binary, n_shingles long, signature binary, bits binary"


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature_rows(sets: list[np.ndarray]) -> list[bytes]:
    """The K minima of each set, little-endian 32-bit; sets must not be empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), K), np.uint32)
    for i in range(K):
        out[:, i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], starts)
    return [row.tobytes() for row in out]


def bitmap(shingles: np.ndarray) -> bytes:
    size = min(max(LEAST_BITS, 1 << (8 * len(shingles) - 1).bit_length()), MOST_BITS)
    bits = np.zeros(size, np.uint8)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        for first, last in slices(raw):
            sets = shingle_sets(raw[first:last])
            some = [i for i, s in enumerate(sets) if len(s)]
            nodes: list = [None] * len(sets)
            signatures, bits = nodes[:], nodes[:]
            if some:
                for i, s in zip(some, signature_rows([sets[i] for i in some]), strict=True):
                    nodes[i], signatures[i], bits[i] = digest_of(sets[i]), s, bitmap(sets[i])
            columns = [ids.slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(signatures, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n_shingles", "signature", "bits"])


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, n_shingles, signature, bits) for every row of (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("text_key")).mapInArrow(_sign, SIGNED)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _folded(raw: bytes, size: int) -> np.ndarray:
    """A bitmap as 0 and 1, folded to ``size`` bits: bits that fall together are joined by or."""
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))
    return bits.reshape(-1, size).max(axis=0)


def _enough(n_a, n_b):
    """The least intersection of a link between sets of these sizes."""
    return -(-75 * (n_a + n_b) // 175)


def _may_link(a_bits: list[bytes], b_bits: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """For every a and b: whether their bitmaps allow a link.

    A bit that only one has stands for at least one shingle that the other lacks.
    """
    out = np.zeros((len(a_bits), len(b_bits)), bool)
    by_size = lambda rows: {s: [i for i, r in enumerate(rows) if len(r) * 8 == s] for s in {len(r) * 8 for r in rows}}
    for size_a, rows_a in by_size(a_bits).items():
        for size_b, rows_b in by_size(b_bits).items():
            size = min(size_a, size_b)
            x = np.array([_folded(a_bits[i], size) for i in rows_a], np.float32)
            y = np.array([_folded(b_bits[i], size) for i in rows_b], np.float32)
            common = x @ y.T
            sizes_a, sizes_b = n_a[rows_a][:, None], n_b[rows_b][None, :]
            least = _enough(sizes_a, sizes_b)
            upper = np.minimum(sizes_a - (x.sum(1)[:, None] - common), sizes_b - (y.sum(1)[None, :] - common))
            out[np.ix_(rows_a, rows_b)] = (upper >= least) & (np.minimum(sizes_a, sizes_b) >= least)
    return out


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, n, signature, bits of each): the pairs that signatures and bitmaps allow."""
    for batch in batches:
        same = (_matrix(batch["sig_a"]) == _matrix(batch["sig_b"])).sum(axis=1) >= T if batch.num_rows else np.zeros(0, bool)
        for i in np.flatnonzero(same).tolist():
            row = {c: batch[c][i].as_py() for c in ("bits_a", "bits_b", "n_a", "n_b")}
            same[i] = _may_link([row["bits_a"]], [row["bits_b"]], np.array([row["n_a"]]), np.array([row["n_b"]]))[0, 0]
        kept = pa.array(same)
        yield pa.RecordBatch.from_arrays([batch["a"].filter(kept), batch["b"].filter(kept)], names=["a", "b"])


def _across(table: pa.Table) -> pa.Table:
    """Of the members of two blocks: the pairs between blocks, with different labels, that may be linked."""
    side, labels, nodes = table["side"].to_numpy(), table["label"].to_pylist(), table["node"].to_pylist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    code = {x: i for i, x in enumerate(set(labels))}
    coded = np.array([code[x] for x in labels])
    signatures, bits, n = _matrix(table["signature"]), table["bits"].to_pylist(), table["n_shingles"].to_numpy()
    # a pair that shares several lists is written in the first of them
    token, tokens = table["token"][0].as_py(), [set(t) for t in table["tokens"].to_pylist()]
    found: set[tuple[bytes, bytes]] = set()
    if len(left) and len(right):
        near = np.zeros((len(left), len(right)), np.int16)
        for i in range(K):
            near += signatures[left, i][:, None] == signatures[right, i][None, :]
        open_ = (near >= T) & (coded[left][:, None] != coded[right][None, :])
        if open_.any():
            open_ &= _may_link([bits[i] for i in left], [bits[i] for i in right], n[left], n[right])
        for i, j in zip(*np.nonzero(open_), strict=True):
            a, b = nodes[left[i]], nodes[right[j]]
            if min(tokens[left[i]] & tokens[right[j]]) == token:
                found.add((min(a, b), max(a, b)))
    pairs = sorted(found)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        for first, last in slices(raw):
            sets = [s for s in shingle_sets(raw[first:last]) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "shingles"]
            )


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, full sets of each): the pairs with a similarity of 0.75 or more."""
    for batch in batches:
        kept = []
        for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
            both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            kept.append(100 * common >= 75 * (len(both) - common))
        mask = pa.array(kept, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], names=["a", "b"])


def postings(classes: DataFrame) -> DataFrame:
    """(token, node, members): each class under the pairs of its prefix that another class has too."""
    # outer, as for an inner explode the optimizer makes the array twice to skip empty ones
    little = "concat(substr(h, {0} + 7, 2), substr(h, {0} + 5, 2), substr(h, {0} + 3, 2), substr(h, {0} + 1, 2))"
    tokens = classes.select("node", F.hex("signature").alias("h")).select(
        "node", F.posexplode_outer(F.expr(f"transform(sequence(0, {K - 1}), i -> cast(conv({little.format('8 * i')}, 16, 10) as bigint))")).alias("i", "v")
    ).select("node", (F.col("i").cast("long") * (1 << 32) + F.col("v")).alias("token"))
    shared = tokens.groupBy("token").count().filter("count > 1")
    ranked = tokens.join(shared, "token").withColumns(
        {
            "_r": F.row_number().over(Window.partitionBy("node").orderBy("count", "token")),
            "_m": F.count("*").over(Window.partitionBy("node")),
        }
    )
    return ranked.filter(F.col("_r") <= F.col("_m") - (K - PREFIX)).select("token", "node", "count")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The linked of some pairs (a, b) of classes, by full sets made from the classes' texts."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    chosen = materialise(nodes.join(classes.select("node", "doc_id"), "node"), "chosen")
    ids = chosen.select("doc_id").distinct()
    picked = F.broadcast(ids) if ids.count() <= MAX_IDS else ids
    texts = docs.join(picked.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets_of, "node binary, shingles binary").join(chosen.select("node"), "node", "left_semi")
    sets = materialise(sets.dropDuplicates(["node"]), "sets")
    x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_linked, "a binary, b binary"), "linked")


def candidate_pairs(classes: DataFrame, posted: DataFrame) -> DataFrame:
    """(a, b): all pairs of short lists, and of long lists each member with the list's least member."""
    members = posted.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("centre"))
    lists = posted.select("token", "node").join(members.filter("n > 1"), "token")
    stars = lists.filter(F.col("n") > SHORT).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    short = lists.filter(F.col("n") <= SHORT).groupBy("token").agg(F.sort_array(F.collect_list("node")).alias("l")).select("l").distinct()
    short = short.select(F.explode(F.expr("flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> named_struct('a', x, 'b', y))))")).alias("p")).select("p.*")
    pairs = stars.unionByName(short).filter("a <> b").distinct()
    of = lambda s: classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"sig_{s}"), F.col("bits").alias(f"bits_{s}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_close_pairs, "a binary, b binary")


def cross_pairs(classes: DataFrame, posted: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): of long lists, the pairs between components that signatures and bitmaps allow."""
    long_ = posted.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > SHORT).select("token")
    lists = posted.select("token", "node").join(long_, "token").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = lists.groupBy("token", "label").count()
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n"))
    open_ = lists.join(main.filter("n_main < n"), "token").withColumns(
        {
            "rest": F.col("label") != F.col("main"),
            "blocks_rest": F.ceil((F.col("n") - F.col("n_main")) / BLOCK),
            "blocks_main": F.ceil(F.col("n_main") / BLOCK),
        }
    )
    part = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("blocks_rest")).otherwise(F.col("blocks_main")))
    # blocks of the rest meet each other and those of the main component; the main one's do not meet
    open_ = open_.withColumn("k", part).select(
        "token", "node", "label",
        F.explode(F.expr(
            "if(rest, concat(transform(sequence(0, blocks_rest - 1), o -> named_struct('i', least(k, o), 'j', greatest(k, o), 'main', false)),"
            " transform(sequence(0, blocks_main - 1), o -> named_struct('i', k, 'j', o, 'main', true))),"
            " transform(sequence(0, blocks_rest - 1), o -> named_struct('i', o, 'j', k, 'main', true)))"
        )).alias("to"), "rest", "k",
    ).select("token", "node", "label", "to.*", "rest", "k")
    # a block that meets itself stands on both sides
    sides = F.when(F.col("main"), F.array((~F.col("rest")).cast("int"))).when(F.col("i") == F.col("j"), F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col("k") == F.col("j")).cast("int")))
    of_node = lists.groupBy("node").agg(F.collect_list("token").alias("tokens"))  # PREFIX at most
    members = classes.select("node", "n_shingles", "signature", "bits").join(of_node, "node")
    placed = open_.withColumn("side", F.explode(sides)).join(members, "node")
    placed = placed.select("token", "i", "j", "main", "side", "node", "label", "tokens", "n_shingles", "signature", "bits")
    return placed.groupBy("token", "i", "j", "main").applyInArrow(_across, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) for every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(signed(docs), "signed")
    some = rows.filter("n_shingles > 0")
    # signature and bitmap follow from the set, so that any of a class's will do
    classes = materialise(some.groupBy("node").agg(*[F.min(c).alias(c) for c in ("doc_id", "n_shingles", "signature", "bits")]), "classes")
    posted = materialise(postings(classes), "postings")
    links = confirmed(candidate_pairs(classes, posted), docs, classes)
    labels = connected(links)
    more = confirmed(cross_pairs(classes, posted, labels), docs, classes)
    labels = connected(links.unionByName(more))
    least = classes.select("node", "doc_id").join(labels, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    moved = labels.join(least, "label").select("node", "component_id")
    of_class = classes.select("node", F.col("doc_id").alias("least_id")).join(moved, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    grouped = some.select("doc_id", "text_key", "node", "n_shingles").join(of_class, "node").select("doc_id", "text_key", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


__all__ = ["SIZE", "near_duplicates", "op7_minhash_near_dedup", "signed"]
