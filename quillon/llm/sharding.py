"""Shard assignment by a Feistel permutation of global row numbers.

Rows are numbered 0..N-1 in the order of ``md5(id | size)``, which needs one
narrow shuffle: rows are grouped by the hash's first digits, numbered inside
each group, and shifted by the rows of all groups before. A balanced Feistel
network over ``side * side >= N`` points permutes the numbers; a point that
leaves 0..N-1 is sent through the network again (cycle walking). Position p
lies in shard ``p mod n_shards`` at slot ``p div n_shards``, so that shard and
slot follow from the row number alone, counts differ by one at most and slots
have no gaps.

Defined cases: null texts count no bytes (size 1, checksum 0); null ids are
hashed as the empty string; rows equal in id, text and size are
interchangeable; empty tables give no rows; columns of the input that clash
with the added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import read_table

PRIME = 2147483647
ROUNDS = 6
#: Hex digits of the hash that make a numbering group.
DIGITS = 3
#: Applications of the network that a walk may take; enough for every N below
#: 1000 by counting, and left with a chance under 1e-70 beyond.
WALK = 64
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round, from a Lehmer generator."""
    x, out = seed % (PRIME - 1) + 1, []
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            x = x * 48271 % PRIME
            key.append(x)
        out.append(tuple(key))
    return out


def side_of(n: int) -> int:
    """The least side whose square holds n points."""
    side = math.isqrt(max(n, 1))
    return side if side * side >= n else side + 1


def permuted(point: str, side: int, seed: int) -> str:
    """SQL for one pass of the network over an expression below side * side."""
    keys = ", ".join(f"named_struct('a', {a}L, 'b', {b}L, 'c', {c}L)" for a, b, c in round_keys(seed))
    t = f"((s.r * k.a + k.b) % {PRIME}L)"
    mixed = f"(({t} * ({t} % 65521L + k.c)) % {PRIME}L)"
    return (
        f"aggregate(array({keys}), named_struct('l', {point} div {side}L, 'r', {point} % {side}L), "
        f"(s, k) -> named_struct('l', s.r, 'r', (s.l + {mixed}) % {side}L), s -> s.l * {side}L + s.r)"
    )


def walked(point: str, n: int, seed: int) -> str:
    """SQL for the permutation of 0..n-1: the network until the point is inside."""
    again = permuted("w", side_of(n), seed)
    return (
        f"aggregate(sequence(1, {WALK}), {point}, (w, i) -> if(w < {n}L, w, {again}), "
        f"w -> if(w < {n}L, w, raise_error('the permutation left its range')))"
    )


def numbered(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Adds ``row_no``: 0..N-1 in the order of the hash of id and size."""
    keyed = df.withColumn("_h", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")))
    keyed = keyed.withColumn("_b", F.substring("_h", 1, digits))
    before = (
        keyed.groupBy("_b").count()
        .select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))
    )  # one row for each of 16 ** digits groups
    inside = Window.partitionBy("_b").orderBy("_h", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("_r", F.row_number().over(inside))
    return ranked.join(before, "_b").withColumn("row_no", F.col("_before") + F.col("_r") - 1).drop("_b", "_h", "_before", "_r")


def feistel_shards(df: DataFrame, n_shards: int = 16, seed: int = 20240229, n_rows: int | None = None) -> DataFrame:
    """Adds size, text_crc32, law, shard, slot and grown_shard to (doc_id, text, ...).

    ``n_rows`` saves the count where the caller knows it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = df.drop(*ADDED).withColumns(
        {"size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    )
    n = df.count() if n_rows is None else n_rows
    side = side_of(n)
    return (
        numbered(sized)
        .withColumn("_p", F.expr(permuted("row_no", side, seed)))
        .withColumn("_p", F.expr(f"if(_p < {n}L, _p, {walked('_p', n, seed)})"))
        .withColumns(
            {
                "law": F.lit("rows"),
                "shard": F.expr(f"cast(_p % {n_shards}L as int)"),
                "slot": F.expr(f"_p div {n_shards}L"),
                "grown_shard": F.lit(None).cast("int"),
            }
        )
        .drop("_p", "row_no")
    )


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return feistel_shards(docs, 16).select("doc_id", *ADDED)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text's UTF-8 bytes, a nibble at a time."""
    poly, table = 0xEDB88320, []
    for i in range(16):
        c = i
        for _ in range(4):
            c = (c >> 1) ^ poly if c & 1 else c >> 1
        table.append(c)
    digits = f"string_split(hex(encode({text})), '')"
    value = "(strpos('0123456789ABCDEF', d) - 1)::BIGINT"
    pairs = f"list_transform({digits}, lambda d: {value})"
    swapped = f"list_transform(range(0, 2 * strlen({text})), lambda i: v[(i + 1 + (CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END))::BIGINT])"
    step = f"xor(c >> 4, ({table}::BIGINT[])[(xor(c, x) & 15) + 1])"
    return (
        f"(SELECT xor(list_reduce(list_prepend(4294967295::BIGINT, {swapped}), lambda c, x: {step}), 4294967295) "
        f"FROM (SELECT {pairs} AS v))"
    )


def op8_sql(n_shards: int = 16, seed: int = 20240229) -> str:
    """DuckDB SQL for the same assignment; the permutation is tabled over its whole domain."""
    steps, last = ["net0 AS (SELECT x, x // side AS l, x % side AS r, side, n FROM (SELECT unnest(range(side * side)) AS x, side, n FROM dims))"], "net0"
    for i, (a, b, c) in enumerate(round_keys(seed), 1):
        steps.append(
            f"net{i} AS (SELECT x, r AS l, (l + (t * (t % 65521 + {c})) % {PRIME}) % side AS r, side, n "
            f"FROM (SELECT *, (r * {a}::BIGINT + {b}) % {PRIME} AS t FROM {last}))"
        )
        last = f"net{i}"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT + 1 AS size FROM documents),
c AS (SELECT doc_id, size, {crc32_sql('t')} AS text_crc32 FROM d),
dims AS (SELECT n, CASE WHEN s * s >= n THEN s ELSE s + 1 END AS side FROM (
  SELECT count(*)::BIGINT AS n, floor(sqrt(count(*)))::BIGINT AS s FROM d)),
o AS (SELECT *, row_number() OVER (ORDER BY h, doc_id, text_crc32, size) - 1 AS row_no FROM (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '') || '|' || size::VARCHAR) AS h FROM c)),
{', '.join(steps)},
perm AS (SELECT x, l * side + r AS y, n FROM {last}),
walk AS (SELECT x, y, n FROM perm WHERE x < n
  UNION ALL SELECT w.x, p.y, w.n FROM walk w JOIN perm p ON p.x = w.y WHERE w.y >= w.n)
SELECT o.doc_id, o.size, o.text_crc32, 'rows' AS law, (w.y % {n_shards})::INTEGER AS shard,
  w.y // {n_shards} AS slot, NULL::INTEGER AS grown_shard
FROM o JOIN walk w ON w.x = o.row_no AND w.y < w.n"""
