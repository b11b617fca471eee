"""Token-id files: every document its own zstandard frame, with one shared dictionary.

A token table is a folder in any file system that Spark writes to. It holds the
dictionary with its SHA-256, and segments, each one binary value:

    magic, the dictionary's SHA-256, the number of documents, then for each
    document its id (with a flag for null), tokens and frame length, then the
    frames, little-endian.

The entries' running sums are the offset index: one document is read by
fetching its segment (first and last id are columns, so that Parquet's
statistics pick it) and decompressing its frame alone. A frame holds the ids as
32-bit little-endian numbers, the end id last. Documents lie in ascending
order of (id, checksum), null ids first: texts are dealt by ranges of that
order, sorted within, and encoded where they land, so that ids are moved by no
shuffle.

The dictionary is trained on the first ``SAMPLE_IDS`` ids of ``SAMPLE`` documents
(those with the least md5 of their id), whatever the table's size.

Encoding is the same for a text as for its pieces between white space in turn where the
tokenizer drops white space and joins nothing across it; ``cuts_at_space`` tells this from the
tokenizer's file, and texts are encoded whole where it does not hold.

Defined cases: null texts are empty and have the end id alone; ids may be null
or repeated; an empty table gives an empty folder, and no rows.
"""

from __future__ import annotations

import hashlib
import json
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import least_hashed, read_table, shared_dir
from quillon.llm.shingles import slices, word_spans

END = 2
MAGIC = b"QTOK0001"
#: Bytes of frames after which a segment ends.
SEGMENT = 2 << 20
#: Documents and ids of each that the dictionary is trained on; its size; the compression level.
SAMPLE, SAMPLE_IDS, DICTIONARY, LEVEL = 1000, 2048, 1 << 16, 3
#: Pieces that a worker remembers twice over: as many found of late, and as many before these.
CACHE = 400_000
#: Below, lower-casing a letter depends on nothing else, and no letter has a second form in NFC.
LATIN = "\u0130"
#: Signs that the tokenizer keeps together after a word (an apostrophe may begin a suffix).
SIGNS = string.punctuation.replace("'", "")
#: Bytes of texts that are encoded in one go.
SLICE = 4 << 20
ENTRY = struct.Struct("<qBIQ")
SEGMENT_KIND = "part int, seq int, first_id long, last_id long, n_docs long, n_tokens long, segment binary"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable Latin-1 itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}


def cuts_at_space(description: dict) -> bool:
    """Whether a tokenizer file drops white space, joins nothing across it, lowers letters and cuts words from signs.

    Only then is a text encoded by its pieces; any other file encodes texts whole.
    """
    steps = (description.get("normalizer") or {}).get("normalizers", [])
    cut = (description.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": "\\s+"}
        and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
        and cut[0]["pattern"].get("Regex", "").endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and description["model"]["type"] == "BPE"
        and all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in description["added_tokens"])
    )


class Encoder:
    """Encodes texts with a tokenizer file.

    Texts are cut at ASCII white space. A slice's pieces are told apart by 64 bits of hash,
    each different one is looked up or encoded once, and the ids are gathered by position.
    Texts in which a special token may stand are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = cuts_at_space(json.loads(self.tokenizer.to_str()))
        self.letters = byte_letters()
        self.late: dict[int, bytes] = {}
        self.before: dict[int, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One run of letters, or of signs, in lower case."""
        if len(self.words) > CACHE:
            self.words.clear()
        written = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        found = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        return found

    def _pieces(self, raw: list[bytes]) -> list[bytes]:
        """The ids of some pieces, A-Z in lower case."""
        out, words = [], self.words
        for piece in map(bytes.decode, raw):
            plain = piece.isascii()
            if plain or max(piece) < LATIN:
                stem = piece.rstrip(SIGNS)
                if stem.isalpha():
                    signs = piece[len(stem) :]
                    stem = stem if plain else stem.lower()
                    ids = words.get(stem) or self._word(stem)
                    out.append(ids + (words.get(signs) or self._word(signs)) if signs else ids)
                    continue
            out.append(self._whole(piece))
        return out

    def _slice(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text's ids."""
        if len(self.late) > CACHE:
            self.before, self.late = self.late, {}
        hashes, owner, start, end, buf = word_spans(texts)
        keys, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        late, listed = self.late, keys.tolist()
        ids = list(map(late.get, listed))
        if None in ids:
            earlier, raw = self.before.get, buf.tobytes()
            for i in [i for i, x in enumerate(ids) if x is None]:
                ids[i] = earlier(listed[i])
            new = [i for i, x in enumerate(ids) if x is None]
            pieces = [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            for i, x in zip(new, self._pieces(pieces), strict=True):
                ids[i] = x
            late.update(zip(listed, ids, strict=True))
        held = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        store = np.frombuffer(b"".join(ids), "<u4")
        offsets = (np.cumsum(held) - held)[at]
        n = held[at]
        done = np.cumsum(n)
        gathered = store[np.arange(int(done[-1]) if len(done) else 0) + np.repeat(offsets - done + n, n)]
        # ids before each text's end
        upto = np.concatenate(([0], done))[np.searchsorted(owner, np.arange(len(texts) + 1))]
        return [gathered[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def encode(self, texts: list[str | None], end: int = END) -> list[bytes]:
        """Each text's ids and the end id, as bytes."""
        last = np.uint32(end).astype("<u4").tobytes()
        whole = [not self.by_pieces or "<|" in (t or "") for t in texts]
        raw = [b"" if w else (t or "").encode() for t, w in zip(texts, whole, strict=True)]
        out = [ids.tobytes() + last for a, b in slices(raw, SLICE) for ids in self._slice(raw[a:b])]
        for i, w in enumerate(whole):
            if w:
                out[i] = self._whole(texts[i] or "") + last
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw)


def segment_bytes(sha: bytes, entries: list[tuple[int | None, int, bytes]]) -> bytes:
    """A segment of (id, tokens, frame)."""
    index = b"".join(ENTRY.pack(i or 0, i is None, n, len(f)) for i, n, f in entries)
    return b"".join([MAGIC, sha, struct.pack("<I", len(entries)), index, *(e[2] for e in entries)])


def index_of(segment: bytes, sha: bytes) -> list[tuple[int | None, int, int, int]]:
    """(id, tokens, offset, length) of a segment's documents; the dictionary must be the one it was written with."""
    if segment[:8] != MAGIC or segment[8:40] != sha:
        raise ValueError("not a segment written with this dictionary")
    (n,) = struct.unpack_from("<I", segment, 40)
    at, out = 44 + n * ENTRY.size, []
    for k in range(n):
        i, null, tokens, length = ENTRY.unpack_from(segment, 44 + k * ENTRY.size)
        out.append((None if null else i, tokens, at, length))
        at += length
    return out


def _writer(tokenizer: str, dictionary: bytes, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        sha = hashlib.sha256(dictionary).digest()
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_loaded(dictionary))
        entries: list[tuple[int | None, int, bytes]] = []
        held = 0

        def emptied():
            ids = [e[0] for e in entries]
            known = [i for i in ids if i is not None]
            values = [part, seq, min(known, default=None), max(known, default=None), len(entries), sum(e[1] for e in entries), segment_bytes(sha, entries)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in SEGMENT_KIND.split(", ")])

        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                some = batch.slice(first, 2048)
                for i, raw in zip(some["doc_id"].to_pylist(), encoder(tokenizer).encode(some["text"].to_pylist(), end), strict=True):
                    entries.append((i, len(raw) // 4, compressor.compress(raw)))
                    held += len(entries[-1][2])
                    if held >= SEGMENT:
                        yield emptied()
                        entries, held, seq = [], 0, seq + 1
        if entries:
            yield emptied()

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> None:
    """Write (doc_id, text) to ``folder``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    first = least_hashed(docs, SAMPLE, F.col("doc_id")).select("text")

    def sampled(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x[: 4 * SAMPLE_IDS] for x in encoder(tokenizer).encode(batch["text"].to_pylist(), end)], pa.binary())], names=["ids"])

    samples = sorted(r[0] for r in first.mapInArrow(sampled, "ids binary").collect())  # SAMPLE rows of 8 KB at most
    dictionary = dictionary_of([bytes(s) for s in samples])
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    keyed = docs.withColumn("_c", F.crc32("text"))
    ranged = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_c")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("_c"))
    ranged.select("doc_id", "text").mapInArrow(_writer(tokenizer, dictionary, end), SEGMENT_KIND).write.parquet(f"{folder}/segments")


def dictionary_in(spark: SparkSession, folder: str) -> bytes:
    sha, raw = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(raw).hexdigest() != sha:
        raise ValueError("the dictionary does not match its hash")
    return bytes(raw)


def _reader(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256(dictionary).digest()
        decompressor = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary))
        for batch in batches:
            for part, seq, segment in zip(batch["part"].to_pylist(), batch["seq"].to_pylist(), batch["segment"], strict=True):
                raw = segment.as_py()
                rows, before = [], 0
                for i, tokens, at, length in index_of(raw, sha):
                    ids = decompressor.decompress(memoryview(raw)[at : at + length])
                    if len(ids) != 4 * tokens:
                        raise ValueError("a frame does not have the tokens that its index states")
                    rows.append((part, seq, i, before, tokens, zlib.crc32(ids)))
                    before += tokens
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"])

    return run


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the files."""
    segments = spark.read.parquet(f"{folder}/segments")
    rows = segments.select("part", "seq", "segment").mapInArrow(_reader(dictionary_in(spark, folder)), "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long")
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("of_parts"))
    inside = (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("of_segments")
    starts = sizes.select("part", "seq", inside).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("of_parts") + F.col("of_segments")).alias("first"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[int] | None:
    """One document's ids: its segment is fetched, and its frame alone is decompressed."""
    near = spark.read.parquet(f"{folder}/segments").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("segment")
    dictionary = dictionary_in(spark, folder)
    for (segment,) in near.toLocalIterator():
        for i, _, at, length in index_of(bytes(segment), hashlib.sha256(dictionary).digest()):
            if i == doc_id:
                raw = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary)).decompress(bytes(segment[at : at + length]))
                return np.frombuffer(raw, "<u4").tolist()
    return None


def op9_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_back(spark, folder)
