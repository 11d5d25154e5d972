"""Token-id output: frequency-ranked ids in a byte-aligned code with separate control bytes.

Writing takes three steps, each from a stored table, so that a lost executor costs
a task and no text is tokenised twice:

1. Every whole text is tokenised and closed with ``END_ID``. Texts are cut at spaces
   and line feeds; the tokenizer never joins across them, so the ids of the pieces are
   kept in a bounded cache.
2. Ids are counted over all documents and ranked, the most frequent first.
3. Ranks are written in blocks: a control byte holds the byte lengths (1 to 4, two
   bits each) of four ranks, data bytes hold the ranks in little-endian order. Parts
   are ranges of doc_id, whose bounds come from the ids alone; blocks ascend in a part.

The container of the blocks is Parquet with one block a row (part, block, docs' ids
and lengths, control, data), which any store that Spark reaches can commit and read.
Decoding looks control bytes up in a table of 256 x 4 lengths.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first;
rows with equal doc_id are all kept, ordered by their coded bytes; texts of any length
are one document, in one block; an empty table gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.base import discard, staged
from millrace.staging import path_of

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Entries of one generation of a worker's cache of words.
CACHED = 200_000
#: Documents that are cut into pieces at a time.
ROWS = 2_000
#: Tokens after which a block ends; a document is never split.
BLOCK_TOKENS = 1 << 14

#: Stored bytes of a range, which one task writes.
RANGE_BYTES = 64 << 20
#: Where a null doc_id stands.
LOW = -(1 << 63)

#: Lengths of the four values of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)


class Generations(dict):
    """A cache that computes what it lacks; two generations of up to CACHED entries live at a time."""

    def __init__(self, compute: Callable[[str], bytes]) -> None:
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: which letter stands for each byte that is not printable in Latin-1."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: 256 + n for n, byte in enumerate(b for b in range(256) if b not in plain)}


class PieceEncoder:
    """Ids of whole texts, by way of their distinct pieces.

    A piece of Latin letters, digits and common marks is cut as the tokenizer cuts it
    (runs of letters, single digits, runs of marks), and its words go to the tokenizer's
    model at once. All other pieces take the tokenizer's whole way.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.end = end_id
        self.letters = _byte_letters()
        self.words = Generations(self._word)
        self.shortcut = all(self._cut(p) == self._whole(p) for p in PROBES)

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], dtype=self.dtype).tobytes()

    def _cut(self, piece: str) -> bytes:
        return b"".join([self.words[w] for w in _WORDS.findall(piece.lower())])

    def piece(self, piece: str) -> bytes:
        if not self.shortcut:
            return self._whole(piece)
        if piece.isalpha() and (piece.isascii() or _LETTERS.fullmatch(piece)):
            return self.words[piece.lower()]
        word = piece[:-1]
        if piece[-1:] in ENDS and word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)):
            return self.words[word.lower()] + self.words[piece[-1]]
        return self._cut(piece) if _COMMON.fullmatch(piece) else self._whole(piece)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with the end id, and their numbers."""
        lists = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        pieces = lists.flatten().dictionary_encode()
        coded = [self.piece(p) for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.array([len(c) for c in coded], dtype=np.int64) // self.dtype.itemsize
        table, first = np.frombuffer(b"".join(coded), dtype=self.dtype), np.cumsum(size) - size
        codes = pieces.indices.to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[codes])])
        ends = upto[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        ids = np.empty(upto[-1], dtype=self.dtype)
        for at in range(0, len(codes), STEP):
            part = codes[at : at + STEP]
            a, b = upto[at], upto[min(len(codes), at + STEP)]
            ids[a:b] = table[np.repeat(first[part] - upto[at : at + len(part)], size[part]) + np.arange(a, b)]
        return np.insert(ids, ends, self.end), np.diff(ends, prepend=0) + 1


#: Pieces whose ids are put together at a time.
STEP = 1 << 18
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"
ENDS = {",", ".", "!", "?", ";", ":"}
_LETTERS = re.compile(f"[{_LATIN}]+")
_COMMON = re.compile(f"[{_LATIN}0-9{_MARKS}]+")
_WORDS = re.compile(f"[{_LATIN}]+|[0-9]|[{_MARKS}]+")
#: The shortcut is taken only with a tokenizer that treats these alike on either way.
PROBES = ["the", "Été", "über", "Straße", "ÿ", ",", "zqxjk", "a1b22", "x%%%", "(y)_z", "WH!!", "a.b,", "[~]^`{|}", "@#$&*+-/:;=>?"]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def _encoder(path: str, end_id: int) -> PieceEncoder:
    """The worker's encoder; it stays between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = PieceEncoder(path, end_id)
    return _encoders[path, end_id]


def _forget() -> None:
    """Free the worker's encoder and its caches, when tokenising is over."""
    _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, tie (a hash of ids) and ids (binary, numbers of ``id_type``, with the end id) of each whole text."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(path, end_id)
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids, counts = coder.encode(part.column(1))
            ends = np.concatenate([[0], np.cumsum(counts * ids.itemsize)]).astype(np.int64)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column(0), data.cast(pa.binary())], names=["doc_id", "ids"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
    return found.select("doc_id", F.xxhash64("ids").alias("tie"), "ids")


def range_count(stored: DataFrame) -> int:
    """How many ranges a stored frame is written in: by its bytes, and enough for all cores."""
    system, where = path_of(stored.sparkSession, stored._staged_path)  # noqa: SLF001
    size = system.getContentSummary(where).getLength()
    return max(-(-size // RANGE_BYTES), 2 * stored.sparkSession.sparkContext.defaultParallelism)


def bounds(keys: DataFrame, n: int) -> list[tuple[int, int]]:
    """Greatest (doc_id, tie) of each of ``n`` ranges but the last, a null id lowest.

    The number is given, as adaptive planning would make a few ranges of these small rows.
    """
    ranged = keys.select(F.coalesce("doc_id", F.lit(LOW)).alias("id"), "tie").repartitionByRange(n, "id", "tie")
    tops = ranged.groupBy(F.spark_partition_id()).agg(F.max(F.struct("id", "tie")).alias("top"))
    return sorted((r.top.id, r.top.tie) for r in tops.collect())[:-1]


def ranges_of(tops: list[tuple[int, int]], ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The range of each (id, tie): how many of ``tops`` are below it."""
    top_ids = np.array([i for i, _ in tops], dtype=np.int64)
    out = np.searchsorted(top_ids, ids)
    inside = out < len(tops)
    for k in np.flatnonzero(inside)[top_ids[out[inside]] == ids[inside]].tolist():  # ids that are a range's last
        out[k] = bisect_left(tops, (int(ids[k]), int(ties[k])))
    return out


def frequencies(tokens: DataFrame, dtype: np.dtype) -> DataFrame:
    """id and n of every id that occurs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=dtype))
            if len(part) > len(total):
                part, total = total, part.astype(np.int64)
            total[: len(part)] += part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _padding(counts: np.ndarray) -> np.ndarray:
    """Places, among all documents' values, before which an unused slot closes a control byte."""
    return np.repeat(np.cumsum(counts), -counts % 4)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; ``counts`` are the documents' numbers of ranks.

    Documents begin at a control byte of their own.
    """
    ranks = ranks.astype("<u4")
    longest = (int(ranks.max(initial=0)).bit_length() + 7) // 8 or 1
    codes = np.zeros(len(ranks), dtype=np.uint8)
    for k in range(1, longest):
        codes += ranks >= 1 << 8 * k
    slots = np.insert(codes, _padding(counts), 0).reshape(-1, 4)
    control = (slots[:, 0] | slots[:, 1] << 2 | slots[:, 2] << 4 | slots[:, 3] << 6).tobytes()
    bytes_of = ranks.view(np.uint8).reshape(-1, 4)[:, :longest]
    data = bytes_of[np.arange(longest, dtype=np.uint8) <= codes[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(counts)])
    bounds = (ends + np.concatenate([[0], np.cumsum(codes, dtype=np.int64)])[ends]).tolist()
    cuts = np.concatenate([[0], np.cumsum((counts + 3) // 4)]).tolist()
    return (
        [control[a:b] for a, b in zip(cuts, cuts[1:], strict=False)],
        [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)],
    )


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks that ``pack`` coded, of all documents one after another."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)
    pads = _padding(counts)
    size = np.delete(size, pads + np.arange(len(pads)))
    longest = int(size.max(initial=1))
    out = np.zeros((len(size), 4), dtype=np.uint8)
    held = out[:, :longest]
    held[np.arange(longest, dtype=np.uint8) < size[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


def _coded(tokens: DataFrame, rank_of: np.ndarray, dtype: np.dtype, tops: list[tuple[int, int]]) -> DataFrame:
    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(2).to_pylist()
                counts = np.array([len(x) // dtype.itemsize for x in ids], dtype=np.int64)
                control, data = pack(rank_of[np.frombuffer(b"".join(ids), dtype=dtype)], counts)
                part = ranges_of(tops, pc.fill_null(batch.column(0), LOW).to_numpy(), batch.column(1).to_numpy())
                columns = [
                    pa.array(part, pa.int32()),
                    batch.column(0),
                    batch.column(1),
                    pa.array(counts),
                    pa.array(control, pa.binary()),
                    pa.array(data, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "tie", "n", "control", "data"])

    return tokens.mapInArrow(code, "part int, doc_id long, tie long, n long, control binary, data binary")


BLOCK_SCHEMA = "part int, block int, start long, doc_ids array<long>, lengths array<long>, control binary, data binary"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, start, tokens = -1, 0, 0, 0
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        nonlocal block, start, tokens, rows
        doc_ids, lengths, control, data = zip(*rows, strict=True)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([start], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([b"".join(control)], pa.binary()),
                pa.array([b"".join(data)], pa.binary()),
            ],
            names=["part", "block", "start", "doc_ids", "lengths", "control", "data"],
        )
        block, start, tokens, rows = block + 1, start + tokens, 0, []
        return out

    for batch in batches:
        for of, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if of != part:
                if rows:
                    yield flush()
                part, block, start = of, 0, 0
            rows.append(row)
            tokens += row[1]
            if tokens >= BLOCK_TOKENS:
                yield flush()
    if rows:
        yield flush()


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """The stored blocks and the stored code book (rank, id) of ``docs``."""
    path = path or public_tokenizers.path(VOCABULARY)
    dtype = _encoder(path, end_id).dtype
    tokens = staged(tokenized(docs, path, end_id), "token-ids")
    ranked = frequencies(tokens, dtype).toPandas().sort_values(["n", "id"], ascending=[False, True])  # vocabulary-sized
    ids = ranked["id"].to_numpy(dtype=np.int64)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank_of[ids] = np.arange(len(ids))
    spark = docs.sparkSession
    book = staged(spark.createDataFrame(list(enumerate(ids.tolist())), "rank int, id long").coalesce(1), "token-book")
    ranges = range_count(tokens)
    ordered = (
        _coded(tokens, rank_of, dtype, bounds(tokens.select("doc_id", "tie"), ranges))
        .repartitionById(ranges, "part")
        .sortWithinPartitions("part", "doc_id", "tie", "control", "data")
        .drop("tie")
    )
    blocks = staged(ordered.mapInArrow(_blocks, BLOCK_SCHEMA), "token-blocks")
    discard(tokens)
    return blocks, book


def read(blocks: DataFrame, book: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the blocks."""
    ids_of = np.array([r.id for r in book.orderBy("rank").collect()] or [0], dtype="<u4")  # vocabulary-sized

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        for batch in batches:
            for block in (batch.slice(i, 1) for i in range(batch.num_rows)):
                part, start, doc_ids, lengths, control, data = (c[0].as_py() for c in block.columns)
                counts = np.array(lengths, dtype=np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids_of[unpack(control, data, counts)].tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(counts), pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    found = blocks.select("part", "start", "doc_ids", "lengths", "control", "data").mapInArrow(
        decode, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    # One row a part: as many as the writer had tasks.
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = blocks.select("part", size.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` and report what the files hold."""
    return read(*write(docs, path, end_id))
