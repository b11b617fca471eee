"""Language-model scores by a probabilistic suffix tree over words.

Training texts are those whose crc32(id as text) modulo 10 is not 0; each
counts with all its words and one end.

The tree. The root is the distribution of the base score, in which words of nearly
equal counts (equal below ``EXACT``) share their mass equally. A context of one to
``DEPTH`` words is a state if its next-symbol distribution diverges (Kullback and
Leibler, in nats) from that of its longest suffix that is a state by ``DIVERGENCE`` or
more; nothing else prunes. Next symbols seen ``LEAST`` times or more have a share of
their own, and what is left goes to the suffix's distribution, with a weight of
``PRIOR`` counts more. A token has the probability of the longest state that the words
before it end with.

The work. Everything known of the contexts that end in a word lies together, as do the
tokens that follow them, so that tokens are sent once:

1. Blocks of texts are tokenized and written, with their distinct words. These are
   counted by ranges of their hashes, and each block gets back its words' counts and
   numbers. Words are numbered by falling count. A word that occurs once in the whole
   corpus can be in no context that occurs twice, and ends the contexts that it is in.
2. Tokens go, with the words before them, to the bucket of the nearest word before
   them, as compressed columns. Contexts of more than half a bucket's tokens are hot:
   they are spread over buckets by the next word before, and their own distribution,
   counted before by blocks, is sent to each of these. So are hot contexts of two and
   more words in turn.
3. A bucket counts contexts and symbols level by level, and adds up its tokens'
   log-probabilities by text, each rounded to 2^-24, so that scores are the same whatever the buckets.
   Blocks bring these sums together.

Words are known by 64 bits of their hash. The driver holds the number of words by range and
class of counts (at most ``RANGES`` times 800 numbers) and the hot contexts (at most four for each bucket).

Defined cases: null texts are empty and have the end alone; null ids are hashed
as the empty text and have fold 0; repeated rows are scored each; without
training texts all counts are 0; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fold, materialise, read_table, removed
from quillon.llm.packed import packed, unpacked
from quillon.llm.shingles import mixed, slices, word_spans

#: Words of a context at most, and times that a next symbol is seen before it has a share.
DEPTH, LEAST = 4, 2
#: Divergence that keeps a state, and counts that its suffix stands for.
DIVERGENCE, PRIOR = 0.01, 5.0
#: Bytes of texts in a block and in a step of tokenizing; tokens that a bucket is planned for.
BLOCK, SLICE, BUCKET = 12 << 20, 4 << 20, 1 << 20
#: Ranges of words' hashes, at most; blocks for each.
RANGES, BLOCKS = 4096, 2
#: The end's hash; it is also the context of a text's first word. The number of what is before it, and of words that occur once.
END, NONE = np.uint64(1), 0
#: Counts below have a class each; of larger ones, eight classes double the count. The class of words that occur once.
EXACT, ONCE = 256, -1

#: Parts of one that a token's logarithm is rounded to before it is added up: sums of whole numbers are the same in any order and grouping.
PARTS = 2.0**24

PIECE = "block long, range int, payload binary"
CODED = "block long, docs binary, tokens binary"
DEALT = "bucket long, block long, payload binary"
SUMS = "block long, bucket long, payload binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def class_of(n: np.ndarray) -> np.ndarray:
    return np.where(n < EXACT, n, EXACT + np.floor(8 * np.log2(np.maximum(n, EXACT) / EXACT))).astype(np.int32)


def _batch(kind: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _tabled(kind: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(kind, *(zip(*rows, strict=True) if rows else [[] for _ in kind.split(", ")]))])


def _block(ids: list, training: list[int], texts: list[bytes], block: int, ranges: int) -> pa.RecordBatch:
    """A block's tokens (range -1), and its distinct words' hashes with counts, by range."""
    hashes, lengths = [], np.zeros(len(texts), np.int64)
    for a, b in slices(texts, SLICE):
        h, owner, *_ = word_spans(texts[a:b])
        hashes.append(h)
        lengths[a:b] = np.bincount(owner, minlength=b - a)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    stream = np.full(len(hashes) + len(texts), END)
    stream[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), lengths)] = hashes
    train = np.array(training, np.int64)
    words, local = np.unique(stream, return_inverse=True)
    every = np.bincount(local, minlength=len(words))
    n = np.bincount(local, np.repeat(train, lengths + 1), len(words)).astype(np.int64)
    known = np.array([i is not None for i in ids], np.uint8)
    payload = packed(np.array([i or 0 for i in ids], np.int64), known, train.astype(np.uint8), lengths, local.astype(np.uint32))
    rows = [(block, -1, payload)]
    cuts = np.searchsorted((words >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            rows.append((block, r, packed(np.diff(words[a:b], prepend=np.uint64(0)), n[a:b], every[a:b])))
    return _batch(PIECE, *zip(*rows, strict=True))


def _blocks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        ids, training, texts = [], [], []
        for batch in batches:
            for i, t, text in zip(batch["doc_id"].to_pylist(), batch["training"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                ids.append(i)
                training.append(t)
                texts.append(raw)
                held += len(raw) + 64
                if held >= BLOCK:
                    yield _block(ids, training, texts, block, ranges)
                    ids, training, texts, held, block = [], [], [], 0, block + 1
        if ids:
            yield _block(ids, training, texts, block, ranges)

    return run


def _counted(hot: int):
    """For a range of hashes: each block's words' counts, class and number within range and class; and (block -1) the range's sums."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [unpacked(p) for p in table["payload"].to_pylist()]
        hashes = np.concatenate([np.cumsum(p[0]) for p in parts])
        words, at = np.unique(hashes, return_inverse=True)
        n, every = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(words)).astype(np.int64) for k in (1, 2))
        cls = np.where(every == 1, ONCE, class_of(n))
        order = np.lexsort((words, cls))
        classes, first, sizes = np.unique(cls[order], return_index=True, return_counts=True)
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words)) - np.repeat(first, sizes)
        mass = np.bincount(np.searchsorted(classes, cls), n, len(classes)).astype(np.int64)
        wide = np.flatnonzero((every > hot) & (cls != ONCE))
        sums = packed(classes, sizes, mass, np.array([np.count_nonzero(n), every.sum(), n.sum()]), cls[wide], place[wide], every[wide])
        rows, done = [(-1, key[0].as_py(), sums)], 0
        for block, p in zip(table["block"].to_pylist(), parts, strict=True):
            own = at[done : done + len(p[0])]
            done += len(own)
            rows.append((block, key[0].as_py(), packed(cls[own], place[own], n[own])))
        return _tabled(PIECE, rows)

    return run


class Numbers:
    """Words' numbers from the ranges' sums: by falling class, then range, then place; and the root's distribution."""

    def __init__(self, rows: list[tuple[int, list[np.ndarray]]], ranges: int):
        self.classes = np.array(sorted({int(c) for _, s in rows for c in s[0]} - {ONCE}, reverse=True), np.int64)
        rank = {int(c): i for i, c in enumerate(self.classes)}
        sizes, mass = np.zeros((len(self.classes), ranges), np.int64), np.zeros(len(self.classes), np.int64)
        total = np.zeros(3, np.int64)
        for r, s in rows:
            total += s[3]
            for c, size, m in zip(s[0].tolist(), s[1].tolist(), s[2].tolist(), strict=True):
                if c != ONCE:
                    sizes[rank[c], r] = size
                    mass[rank[c]] += m
        self.distinct, self.tokens, self.total = map(int, total)
        self.norm = self.total + 0.1 * (self.distinct + 1)
        starts = np.cumsum(sizes.ravel()) - sizes.ravel() + 1
        self.starts = starts.reshape(sizes.shape)
        if starts.max(initial=0) + sizes.max(initial=0) >= 1 << 32:
            raise ValueError("words are numbered in 32 bits")
        # the number that each class begins with, and the share of each of its words
        self.first = self.starts[:, 0] if len(self.classes) else np.zeros(0, np.int64)
        size = sizes.sum(axis=1)
        self.share = (mass + 0.1 * size) / np.maximum(size, 1) / self.norm

    def numbered(self, cls: np.ndarray, place: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.full(len(cls), NONE, np.uint32)
        some = np.flatnonzero(cls != ONCE)
        rank = len(self.classes) - 1 - np.searchsorted(self.classes[::-1], cls[some])
        out[some] = self.starts[rank, r[some]] + place[some]
        return out

    def root(self, symbol: np.ndarray, training: np.ndarray) -> np.ndarray:
        """Probabilities; a word that occurs once is seen in training if this is where it occurs."""
        if not len(self.first):
            return (training + 0.1) / self.norm
        return np.where(symbol == NONE, (training + 0.1) / self.norm, self.share[np.searchsorted(self.first, symbol, side="right") - 1])


def _windows(symbols: np.ndarray, lengths: np.ndarray, end: int) -> list[np.ndarray]:
    """The words before each token, nearest first; NONE from a word that occurs once on, and before the start."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    out = []
    for d in range(1, DEPTH + 1):
        shifted = np.concatenate((np.zeros(min(d, len(symbols)), np.uint32), symbols[:-d]))
        shifted[place < d] = NONE
        shifted[place == d - 1] = end
        if out:
            shifted[out[-1] == NONE] = NONE
        out.append(shifted)
    return out


def _coder(shared, end: int):
    """A block's documents, with base scores, and its tokens as numbers."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        numbers: Numbers = shared.value
        ranges = table["range"].to_numpy()
        order = np.argsort(ranges)
        assert ranges[order[0]] == -1
        ids, known, training, lengths, local = unpacked(table["payload"][int(order[0])].as_py())
        replies = [(int(ranges[i]), unpacked(table["payload"][int(i)].as_py())) for i in order[1:]]
        cls, place, n = (np.concatenate([p[k] for _, p in replies]) for k in range(3))
        symbol = numbers.numbered(cls, place, np.repeat([r for r, _ in replies], [len(p[0]) for _, p in replies]))[local]
        of = np.repeat(np.arange(len(ids)), lengths + 1)
        summed = lambda x: np.bincount(of, x, len(ids))
        base = summed(np.log10((n + 0.1) / numbers.norm)[local])
        seen = summed((n > 0)[local]).astype(np.int64)
        # tokens after a word that occurs once have the root's probability
        last = _windows(symbol, lengths, end)[0]
        rest = summed(np.where(last == NONE, np.log10(numbers.root(symbol, training[of])), 0.0))
        return _tabled(CODED, [(key[0].as_py(), packed(ids, known, training, lengths, seen, base, rest), packed(symbol))])

    return run


class Hot:
    """Hot contexts as nodes of a tree by depth, each with its buckets."""

    def __init__(self):
        self.keys: list[np.ndarray] = []  # by depth: sorted (node of the suffix << 32 | word), nodes beside them
        self.nodes: list[np.ndarray] = []
        self.parent, self.parts, self.first = [], [], []
        self.buckets = 0

    def add(self, keys: list[int], tokens: list[int], bucket: int) -> None:
        order = np.argsort(np.array(keys, np.uint64))
        self.keys.append(np.array(keys, np.uint64)[order])
        self.nodes.append(len(self.parent) + np.arange(len(keys)))
        for i in order.tolist():
            self.parent.append(-1 if len(self.keys) == 1 else int(keys[i]) >> 32)
            self.parts.append(tokens[i] // bucket + 1)
            self.first.append(self.buckets)
            self.buckets += self.parts[-1]

    def depth(self, node: int) -> int:
        return next(d for d, nodes in enumerate(self.nodes, 1) if len(nodes) and node <= nodes[-1])

    def below(self, root: int) -> list[int]:
        """A node and all below it, suffixes first."""
        out = [root]
        for h, parent in enumerate(self.parent):
            if parent in out:
                out.append(h)
        return out

    def path(self, windows: list[np.ndarray]) -> Iterator[np.ndarray]:
        """By depth: the node of each token's context, or -1."""
        node = np.zeros(len(windows[0]), np.int64)
        for keys, nodes, word in zip(self.keys, self.nodes, windows, strict=False):
            wanted = (np.maximum(node, 0).astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            hit = (keys[at] == wanted) & (node >= 0) & (word != NONE) if len(keys) else np.zeros(len(word), bool)
            node = np.where(hit, nodes[at] if len(nodes) else -1, -1)
            yield node


def _tokens_of(row) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    docs = unpacked(row["docs"])
    (symbol,) = unpacked(row["tokens"])
    return docs, symbol, np.repeat(np.arange(len(docs[0])), docs[3] + 1)


def _hot_counts(shared, end: int, least: int):
    """(key, n): contexts one word longer than the deepest hot ones, by block; fewer than ``least`` in a block are left to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                docs, symbol, _ = _tokens_of(row)
                windows = _windows(symbol, docs[3], end)
                node, word = list(hot.path(windows))[-1], windows[len(hot.keys)]
                some = (node >= 0) & (word != NONE)
                keys, n = np.unique((node[some].astype(np.uint64) << np.uint64(32)) | word[some], return_counts=True)
                yield _batch("key long, n long", keys[n >= least].astype(np.int64), n[n >= least])

    return run


def _hot_grams(shared, end: int):
    """(root, block, payload): counts of the symbols after every hot context, by block and context of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                docs, symbol, of = _tokens_of(row)
                training, path = docs[2][of] > 0, list(hot.path(_windows(symbol, docs[3], end)))
                keys, roots = [], []
                for node in path:
                    some = (node >= 0) & training
                    keys.append((node[some].astype(np.uint64) << np.uint64(32)) | symbol[some])
                    roots.append(path[0][some])
                keys, at, n = np.unique(np.concatenate(keys), return_index=True, return_counts=True)
                root = np.concatenate(roots)[at]
                rows = [(int(r), row["block"], packed(keys[root == r], n[root == r])) for r in np.unique(root)]
                yield _batch(DEALT, *(zip(*rows, strict=True) if rows else ([], [], [])))

    return run


def _level(ctx: np.ndarray, n: np.ndarray, listed: np.ndarray, lower: np.ndarray, contexts: int):
    """For the symbols after some contexts (each once, with its training count, whether it has a share, and its probability
    after the suffix): shares; and of each context, what is left to its suffix and whether it is a state."""
    listed = np.where(listed, n, 0)
    of = np.bincount(ctx, n, contexts) + PRIOR
    left = 1 - np.bincount(ctx, listed, contexts) / of
    share = listed / of[ctx]
    some = listed > 0
    p = share[some] + left[ctx[some]] * lower[some]
    own = np.bincount(ctx[some], p * np.log(p / lower[some]), contexts)
    unlisted = np.maximum(1 - np.bincount(ctx[some], lower[some], contexts), 0)
    return share, left, own + left * unlisted * np.log(np.maximum(left, 1e-12)) >= DIVERGENCE


def _hot_distributions(shared_hot, shared_numbers):
    """(bucket, -1, payload) for each bucket of each hot context: listed symbols, their probabilities, and the others' as a share of the root's."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        hot, numbers = shared_hot.value, shared_numbers.value
        parts = [unpacked(p) for p in table["payload"].to_pylist()]
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        node, symbol = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        after: dict[int, tuple] = {}
        rows = []
        for h in hot.below(key[0].as_py()):
            found = after.get(hot.parent[h], (np.zeros(0, np.uint32), np.zeros(0), 1.0))
            symbols, count = symbol[node == h], n[node == h]
            listed = (count >= LEAST) & (symbols != NONE)
            lower = _after(found, symbols, numbers.root(symbols, np.zeros(len(symbols))))
            share, left, state = _level(np.zeros(len(symbols), np.int64), count, listed, lower, 1)
            after[h] = found
            if state[0]:
                far, q, scale = found
                own = ~np.isin(far, symbols[listed])
                symbols, p = np.concatenate((symbols[listed], far[own])), np.concatenate(((share + left * lower)[listed], left * q[own]))
                order = np.argsort(symbols)
                after[h] = (symbols[order], p[order], scale * left[0])
            payload = packed(after[h][0], after[h][1], np.array([after[h][2]]), np.array([hot.depth(h)]))
            rows += [(-1 - hot.first[h] - k, -1, payload) for k in range(hot.parts[h])]
        return _tabled(DEALT, rows)

    return run


def _after(found: tuple, symbol: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Probabilities of symbols by (listed symbols, probabilities, the others' share of the root's)."""
    listed, p, scale = found
    if not len(listed):
        return scale * root
    at = np.minimum(np.searchsorted(listed, symbol), len(listed) - 1)
    return np.where(listed[at] == symbol, p[at], scale * root)


def _dealer(shared, end: int, buckets: int):
    """Tokens by bucket: the words before, symbol, document (twice, and one more for training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = shared.value
        parts, first = np.array(hot.parts or [1], np.uint64), np.array(hot.first or [0], np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                docs, symbol, of = _tokens_of(row)
                windows = _windows(symbol, docs[3], end)
                some = np.flatnonzero(windows[0] != NONE)
                windows, symbol, of = [w[some] for w in windows], symbol[some], of[some]
                bucket = (mixed(windows[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                for d, node in enumerate(hot.path(windows), 1):
                    at = np.flatnonzero(node >= 0)
                    by = windows[d][at] if d < DEPTH else symbol[at]
                    bucket[at] = -1 - first[node[at]] - (mixed(by.astype(np.uint64)) % parts[node[at]]).astype(np.int64)
                # the two words are in the key only so that what is alike lies together
                low = bucket.min(initial=0)
                key = ((bucket - low).astype(np.uint64) << np.uint64(40)) | (windows[0].astype(np.uint64) & np.uint64(0xFFFFFF)) << np.uint64(16) | (windows[1] & np.uint64(0xFFFF))
                order = np.argsort(key)
                bucket = bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else []
                who = (of * 2 + docs[2][of])[order].astype(np.uint32)
                columns = [*(w[order] for w in windows), symbol[order], who]
                rows = [(int(bucket[a]), row["block"], packed(*(c[a:b] for c in columns))) for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
                for at in range(0, len(rows), 64):
                    yield _batch(DEALT, *zip(*rows[at : at + 64], strict=True))

    return run


def _scorer(shared):
    """Each text's log-probability in a bucket, by block."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        numbers: Numbers = shared.value
        parts = [(b.as_py(), unpacked(p.as_buffer())) for b, p in zip(table["block"], table["payload"], strict=True)]
        given = [p for b, p in parts if b < 0]
        parts = sorted((x for x in parts if x[0] >= 0), key=lambda x: x[0])
        if not parts:
            return _tabled(SUMS, [])
        columns = [np.concatenate([p[k] for _, p in parts]) for k in range(DEPTH + 2)]
        parts = [(b, p[DEPTH + 1]) for b, p in parts]  # the other columns are held once
        windows, symbol, who = columns[:DEPTH], columns[DEPTH], columns[DEPTH + 1]
        training = (who & 1).astype(np.int64)
        p = numbers.root(symbol, training)
        depth, ctx = 0, np.zeros(len(symbol), np.int64)
        if given:
            listed, q, scale, at = given[0]
            p, depth = _after((listed, q, float(scale[0])), symbol, p), int(at[0])
        alive = np.arange(len(symbol))
        for d in range(depth, DEPTH):
            word = windows[d][alive]
            alive, ctx = alive[word != NONE], ctx[word != NONE]
            if not len(alive):
                break
            _, ctx = np.unique((ctx.astype(np.uint64) << np.uint64(32)) | windows[d][alive], return_inverse=True)
            grams, first, gram = np.unique((ctx.astype(np.uint64) << np.uint64(32)) | symbol[alive], return_index=True, return_inverse=True)
            n = np.bincount(gram, training[alive], len(grams)).astype(np.int64)
            of, contexts = ctx[first], int(ctx.max()) + 1
            # words that occur once are one symbol here, but none of them occurs twice
            listed = (n >= LEAST) & (symbol[alive][first] != NONE)
            share, left, state = _level(of, n, listed, p[alive[first]], contexts)
            p[alive] = np.where(state[ctx], share[gram] + left[ctx] * p[alive], p[alive])
            some = np.bincount(of[listed], minlength=contexts) > 0
            # where no symbol is listed, none is after a longer context
            alive, ctx = alive[some[ctx]], ctx[some[ctx]]
        found, done, rows = np.rint(np.log10(p) * PARTS), 0, []
        for block, part in parts:
            docs = part >> 1
            sums = np.bincount(docs, found[done : done + len(docs)])
            done += len(docs)
            some = np.flatnonzero(sums)
            small = np.abs(sums[some]) < 2**31  # all but those of long texts
            few, many = some[small], some[~small]
            rows.append((block, key[0].as_py(), packed(few.astype(np.uint32), sums[few].astype(np.int32), many.astype(np.uint32), sums[many].astype(np.int64))))
        return _tabled(SUMS, rows)

    return run


def _gathered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """A block's documents with all their sums."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["payload"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0))
    ids, known, _, lengths, seen, base, score = unpacked(rows[0][1])
    whole = np.zeros(len(score), np.int64)
    for _, payload in rows[1:]:
        few, small, many, large = unpacked(payload)
        whole[few] += small
        whole[many] += large
    score = score + whole / PARTS
    batch = pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), *map(pa.array, (lengths + 1, seen, base, score))], names=[f.split()[0] for f in SCORED.split(", ")])
    return pa.Table.from_batches([batch])


def _hot_contexts(coded: DataFrame, hot: Hot, end: int, bucket: int, blocks: int) -> None:
    """Adds hot contexts of two and more words, a depth at a time while there are any."""
    context = coded.sparkSession.sparkContext
    while hot.keys and len(hot.keys[-1]) and len(hot.keys) < DEPTH:
        # a context of half a bucket's tokens has a quarter's in blocks where it occurs so often
        least = max(bucket // (4 * blocks), 1)
        counts = coded.mapInArrow(_hot_counts(context.broadcast(hot), end, least), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        found = counts.filter(F.col("n") >= bucket // 4).collect()
        hot.add([r.key for r in found], [r.n for r in found], bucket)


def lm_scores(docs: DataFrame, bucket: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text)."""
    spark, context, bucket = docs.sparkSession, docs.sparkSession.sparkContext, bucket or BUCKET
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(F.col("doc_id"), 10) != 0).cast("int").alias("training"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranges = min(max(size // BLOCK // BLOCKS, 1), RANGES)
    pieces = materialise(docs.mapInArrow(_blocks(ranges), PIECE), "lm-blocks")
    replies = materialise(pieces.filter("range >= 0").groupBy("range").applyInArrow(_counted(bucket // 2), PIECE), "lm-replies")
    sums = [(r["range"], unpacked(r["payload"])) for r in replies.filter("block < 0").collect()]  # a row for each range
    numbers = Numbers(sums, ranges)
    shared = context.broadcast(numbers)
    wide = [np.concatenate(x) for x in zip(*([numbers.numbered(s[4], s[5], np.full(len(s[4]), r)), s[6]] for r, s in sums), strict=True)] if sums else [[], []]
    end = _number_of_end(pieces, replies, numbers)
    hot = Hot()  # an empty first depth where no word is hot
    hot.add([int(x) for x in wide[0]], [int(x) for x in wide[1]], bucket)
    both = pieces.filter("range < 0").unionByName(replies.filter("block >= 0"))
    coded = materialise(both.groupBy("block").applyInArrow(_coder(shared, end), CODED), "lm-coded")
    removed(pieces)
    removed(replies)
    _hot_contexts(coded, hot, end, bucket, max(coded.count(), 1))
    shared_hot = context.broadcast(hot)
    buckets = max(numbers.tokens // bucket, 1)
    dealt = coded.mapInArrow(_dealer(shared_hot, end, buckets), DEALT)
    if hot.parent:
        grams = coded.mapInArrow(_hot_grams(shared_hot, end), DEALT)
        dealt = dealt.unionByName(grams.groupBy("bucket").applyInArrow(_hot_distributions(shared_hot, shared), DEALT))
    own = coded.select("block", F.lit(None).cast("long").alias("bucket"), F.col("docs").alias("payload"))
    summed = own.unionByName(dealt.groupBy("bucket").applyInArrow(_scorer(shared), SUMS))
    scored = summed.groupBy("block").applyInArrow(_gathered, SCORED)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(numbers.total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _number_of_end(pieces: DataFrame, replies: DataFrame, numbers: Numbers) -> int:
    """The end's number, from the first block that has it: all have it, as the least of their words in range 0."""
    first = replies.filter("block >= 0 and range = 0").select("payload").first()
    if first is None:
        return NONE
    cls, place, _ = unpacked(first[0])
    return int(numbers.numbered(cls[:1], place[:1], np.zeros(1, np.int64))[0])


def op10_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


__all__ = ["lm_scores", "op10_suffix_tree_scores"]
