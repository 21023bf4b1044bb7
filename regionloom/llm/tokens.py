"""Token ids of documents in a word-aligned binary format (Simple-8b).

A 64-bit word holds a 4-bit selector above 60 bits of payload: the selector
says how many ids of how many bits are packed (240 or 120 zeros, 60 of 1 bit,
..., 1 of 60 bits).  An id that does not fit in 60 bits is an escape: the word
holds 60 ones and the id follows in the chunk's list of escapes.

A file is a row of chunks, each ended by a line feed.  A chunk holds whole
documents in ascending doc_id order:

    header   8 int64: magic, documents, ids, ids in a block, blocks, words,
             escapes, length of the documents' part in bytes
    documents  int64 doc_ids, uint8 validity, Simple-8b words of the lengths
    offsets  uint32 for each block and the end: its first word
    escapes  uint64
    words    uint64

No word crosses a block, so any block can be decoded on its own, and all words
of a chunk in one vectorised pass for each selector.

Files are written by Spark's own committer to whatever store the path names: a
task that is run again replaces its file.  A range partition by doc_id makes
file order document order; no task holds more than its own chunk.

White space never joins a token of the vocabulary in use, which also lower-cases
and keeps runs of letters and of marks apart.  So each distinct white-space-
delimited piece is encoded once per worker and looked up after.  That is a
property of a tokenizer's configuration, which is read first: one that is not
known to have it (``by_pieces``) encodes whole texts, as ``pieces=False`` does.

Defined cases: null and blank texts give the end id alone; null doc_ids come
first; rows with equal doc_id follow one another, in the order of their texts'
first ``_HEAD`` characters, then of a hash of the texts, and so may lie in several
files; an empty table gives no file rows; other columns are not read.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, scratch, settings, worker_cache, written

MAGIC = 0x6234733862
BLOCK = 4096
CHUNK_IDS = 1 << 19
END_ID = 1
#: Simple-8b: how many ids a word holds and of how many bits, by selector (fixed values).
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_ESCAPE = (1 << 60) - 1
_PIECES_KEPT = 700_000
PARTITION_BYTES = 32 << 20
#: Texts that are encoded together.
_TEXTS = 4096
_HEAD = 64


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block and the end, escapes) of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    high = ids >= _ESCAPE
    escapes = ids[high]
    low = np.where(high, np.uint64(_ESCAPE), ids) if len(escapes) else ids
    # only how many bits an id needs matters here: narrow arrays, as this part is bound by memory
    lengths = np.frexp(low.astype(np.float64))[1].astype(np.uint8)
    lengths[low >= 1 << 52] = 60
    at = np.arange(n, dtype=np.int32)
    left = np.minimum(block - at % block, n - at)
    most, selector = int(lengths.max()), np.full(n, 255, np.uint8)
    for k, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True)):
        if most <= bits:
            fits = left >= count
        elif count > 6:
            # short ids come rarely in runs: a run of so many covers one multiple of the count
            fits = np.zeros(n, bool)
            seeds = np.flatnonzero(lengths[::count] <= bits) * count
            padded = np.concatenate((np.full(count, 255, np.uint8), lengths, np.full(count, 255, np.uint8)))
            for some in np.array_split(seeds, len(seeds) * count // (1 << 18) + 1):
                bad = np.cumsum(padded[some[:, None] + np.arange(1, 2 * count)] > bits, axis=1, dtype=np.int32)
                row, lane = np.nonzero(bad[:, count - 1 :] == np.concatenate((np.zeros((len(some), 1), np.int32), bad[:, : count - 1]), axis=1))
                fits[some[row] - count + 1 + lane] = True
            fits &= left >= count
        else:
            bad = np.where(lengths > bits, at, np.int32(n))
            fits = (np.minimum.accumulate(bad[::-1])[::-1] - at >= count) & (left >= count)
        selector[fits & (selector == 255)] = k
    step = np.array(COUNTS, np.int32)[selector]
    # all blocks are walked at once, a word of each at a time
    begins = np.zeros(n, bool)
    place, ends = np.arange(0, n, block), np.minimum(np.arange(0, n, block) + block, n)
    while len(place):
        begins[place] = True
        place = place + step[place]
        more = place < ends
        place, ends = place[more], ends[more]
    starts = np.flatnonzero(begins)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k in np.unique(chosen):
        if BITS[k]:
            mine = np.flatnonzero(chosen == k)
            lanes = np.arange(COUNTS[k])
            words[mine] |= np.bitwise_or.reduce(low[starts[mine][:, None] + lanes] << (lanes * BITS[k]).astype(np.uint64), axis=1)
    offsets = np.append(np.searchsorted(starts, np.arange(0, n, block)), len(starts)).astype(np.uint32)
    return words, offsets, escapes


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of ``words``: of a chunk, or of a block with its escapes."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array(COUNTS)[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k in np.unique(chosen):
        if BITS[k]:
            mine = np.flatnonzero(chosen == k)
            lanes = np.arange(COUNTS[k])
            out[starts[mine][:, None] + lanes] = words[mine][:, None] >> (lanes * BITS[k]).astype(np.uint64) & np.uint64((1 << BITS[k]) - 1)
    if len(escapes):
        out[out == _ESCAPE] = escapes
    return out


def chunk_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets, escapes = pack(ids, block)
    sizes, _, _ = pack(lengths, max(1, len(lengths)))
    docs = b"".join((np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(), sizes.astype("<u8").tobytes()))
    header = np.array([MAGIC, len(doc_ids), len(ids), block, len(offsets) - 1, len(words), len(escapes), len(docs)], "<i8")
    return b"".join((header.tobytes(), docs, offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_chunks(data: bytes | memoryview) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, ids) of each chunk of a file."""
    at = 0
    while at < len(data):
        magic, n_docs, n_ids, _, n_blocks, n_words, n_escapes, docs = np.frombuffer(data, "<i8", 8, at).tolist()
        if magic != MAGIC:
            raise ValueError(f"no chunk at byte {at}")
        at += 64
        doc_ids, valid = np.frombuffer(data, "<i8", n_docs, at).tolist(), np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        lengths = unpack(np.frombuffer(data, "<u8", (docs - 9 * n_docs) // 8, at + 9 * n_docs), np.zeros(0, np.uint64)).astype(np.int64)
        at += docs + 4 * (n_blocks + 1)
        escapes = np.frombuffer(data, "<u8", n_escapes, at)
        at += 8 * n_escapes
        ids = unpack(np.frombuffer(data, "<u8", n_words, at), escapes)
        if len(ids) != n_ids or lengths.sum() != n_ids:
            raise ValueError("a chunk is damaged")
        at += 8 * n_words + 1
        yield [d if v else None for d, v in zip(doc_ids, valid.tolist(), strict=True)], lengths, ids


#: Pieces of these alone are one token run each: letters that no normalizer joins or takes apart.
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_MARKS = ".,;:!?*#$%&|\"()-"
_END_OF_WORD = "</w>"


def by_pieces(configuration: dict) -> bool:
    """Whether a tokenizer is known to give a text's ids piece by piece: what this module's shortcuts rely on, and nothing else."""
    steps = lambda part, name: (part or {}).get(name) or ([part] if part else [])
    normal = [(s.get("type"), (s.get("pattern") or {}).get("Regex"), s.get("content")) for s in steps(configuration.get("normalizer"), "normalizers")]
    cuts = steps(configuration.get("pre_tokenizer"), "pretokenizers")
    model = configuration.get("model") or {}
    return (
        normal == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
        and [s.get("type") for s in cuts] == ["Split", "ByteLevel"]
        and (cuts[0].get("pattern"), cuts[0].get("behavior"), cuts[0].get("invert")) == ({"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True)
        and (cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == (False, False)
        and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in configuration.get("added_tokens") or [])
        and (model.get("type"), model.get("dropout"), model.get("end_of_word_suffix"), model.get("continuing_subword_prefix")) == ("BPE", None, _END_OF_WORD, None)
        and not configuration.get("truncation") and not configuration.get("padding")
    )


class _Encoder:
    """Texts to ids; pieces that were met before are looked up."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            self.by_pieces = by_pieces(json.load(f))
        # piece -> ids as little-endian uint32 bytes; when the newer half is full it becomes the older
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.made.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.made.get_vocab_size() + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_END_OF_WORD)]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.made.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, texts: pa.Array):
        """(number of ids of each text, function that gives the ids of texts a to b)."""
        raw = self._raw(["" if t is None else t for t in texts.to_pylist()])
        return np.array([len(r) // 4 for r in raw], np.int64), lambda a, b: np.frombuffer(b"".join(raw[a:b]), "<u4")

    def _learn_words(self, words: list[str]) -> None:
        """Pieces of letters alone: many in a call, told apart by the mark that the last token of a word carries."""
        for i in range(0, len(words), 256):
            group = words[i : i + 256]
            ids = np.array(self.made.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(group):
                self.known.update(zip(group, self._raw(group), strict=True))
                continue
            raw, cut = ids.tobytes(), [0, *(4 * cut).tolist()]
            self.known.update(zip(group, (raw[a:b] for a, b in zip(cut, cut[1:], strict=False)), strict=True))

    def _learn(self, new: list[str]) -> None:
        """Adds pieces: from the older half, from their letters and marks, or by encoding them."""
        known, older = self.known, self.older
        halves, words, rest = [], set(), set()
        plain = lambda w: w.isalpha() if w.isascii() else _LETTERS.fullmatch(w)
        for w in new:
            if (ids := older.get(w)) is not None:
                known[w] = ids
            elif plain(w):
                words.add(w)
            else:
                # letters before marks are a run of their own, as marks are
                stem = w.rstrip(_MARKS)
                if len(stem) == len(w) or not "a" <= stem[-1:] <= "z":
                    rest.add(w)
                    continue
                halves.append((w, stem))
                for part in (stem, w[len(stem) :]):
                    if part not in known:
                        (words if plain(part) else rest).add(part)
        self._learn_words(list(words))
        known.update(zip(rest, self._raw(list(rest)), strict=True))
        for w, stem in halves:
            known[w] = known[stem] + known[w[len(stem) :]]

    def pieces(self, texts: pa.Array):
        """The same, piece by piece: each distinct piece is looked up once."""
        gc.disable()  # millions of strings and no cycles
        try:
            return self._pieces(texts)
        finally:
            gc.enable()

    def _pieces(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        # the vocabulary lower-cases, but special tokens are spelt in one case only
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        coded = split.flatten().dictionary_encode()
        if len(self.known) > _PIECES_KEPT // 2:
            self.known, self.older = {"": b""}, self.known
        known, distinct = self.known, coded.dictionary.to_pylist()
        raw = list(map(known.get, distinct))
        if new := [i for i, ids in enumerate(raw) if ids is None]:
            self._learn([distinct[i] for i in new])
            for i in new:
                raw[i] = known[distinct[i]]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        firsts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(raw), "<u4")
        codes, at = coded.indices.to_numpy(), split.offsets.to_numpy() - split.offsets[0].as_py()
        upto = np.concatenate(([0], np.cumsum(sizes[codes])))[at]

        def of(a: int, b: int) -> np.ndarray:
            part = codes[at[a] : at[b]]
            n = sizes[part]
            ends = np.cumsum(n)
            return ids[np.repeat(firsts[part] - (ends - n), n) + np.arange(n.sum())]

        return np.diff(upto), of


def _trim() -> None:
    """Gives freed memory back to the system: a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def _encoder(tokenizer: str, pieces: bool):
    kept = worker_cache().setdefault("tokenizers", {})
    if tokenizer not in kept:
        kept[tokenizer] = _Encoder(tokenizer)
    made = kept[tokenizer]
    return made.pieces if pieces and made.by_pieces else made.whole


def encode_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, pieces: bool = True, block: int = BLOCK) -> None:
    """Writes the ids of every text to files below ``path``, in ascending doc_id order over the files."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, pieces)

        def parts() -> Iterator[pa.RecordBatch]:
            """Some batches at a time: small ones bound the JVM's side, larger ones know more pieces again."""
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= _TEXTS:
                    yield pa.concat_batches(held)
                    held.clear()
            if held:
                yield pa.concat_batches(held)

        for part in parts():
            if part.num_rows:
                sizes, ids_of = encode(part.column("text"))
                doc_ids, upto = part.column("doc_id").to_pylist(), np.concatenate(([0], np.cumsum(sizes + 1)))
                # a chunk ends with the document that passes its share of the ids
                cuts = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(CHUNK_IDS, upto[-1], CHUNK_IDS)), [len(sizes)])))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    # the end id goes after each document's own
                    ended = np.full(upto[b] - upto[a], end_id, "<u4")
                    ended[np.arange(len(ended) - (b - a)) + np.repeat(np.arange(b - a), sizes[a:b])] = ids_of(a, b)
                    data = chunk_bytes(doc_ids[a:b], sizes[a:b] + 1, ended, block)
                    yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["chunk"])
                del part, ids_of
                _trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a doc_id that many rows share is cut by its texts, and equal texts by their places: no range is one task
    order = ["doc_id", F.substring("text", 1, _HEAD), F.xxhash64("text"), F.monotonically_increasing_id()]
    keys = [f"_o{i}" for i in range(len(order))]
    rows = rows.select("*", *[F.col(o).alias(k) if isinstance(o, str) else o.alias(k) for o, k in zip(order, keys, strict=True)])
    rows = rows.repartitionByRange(partitions_for(docs.select("doc_id", "text"), PARTITION_BYTES), *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    # text files of one "line" for each chunk: Spark's writer puts the bytes down as they are
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="512"):
        rows.mapInArrow(chunks, "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: file, doc_id, start (in the file), ids."""
    return _read(spark, path, lambda ids: ids.astype(np.int64), pa.list_(pa.int64()), "array<bigint>", "ids")


def _read(spark: SparkSession, path: str, of_ids, kind: pa.DataType, ddl: str, name: str) -> DataFrame:
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _trim()
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                before = 0
                for doc_ids, lengths, ids in read_chunks(memoryview(data.as_buffer())):
                    ends = np.cumsum(lengths)
                    values = [of_ids(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(values, kind)], ["file", "doc_id", "start", "n_tokens", name])
                    before += int(ends[-1])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(documents, f"file string, doc_id bigint, start bigint, n_tokens bigint, {name} {ddl}")


def part_number(file: Column) -> Column:
    """The number in a part's name, by which files are in document order: names are not, once it has six digits."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("long")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        docs = written(_read(spark, path, crc, pa.int64(), "bigint", "ids_crc32"), "token-digests")
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part_number(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.join(totals.select("file", before.alias("before")), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    encode_files(docs, path, tokenizer)
    return digest(docs.sparkSession, path)
