"""Operator 10: texts to token ids by way of a table of distinct words, and back by a join with the pieces."""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from . import bpe
from .common import Scratch, settled

BLOCK = 6 << 20  # characters of the texts whose words are numbered together; a longer text is alone
BUCKET = 1 << 18  # words, counted once a block, that go to one bucket of the table of distinct words
LONG = 1 << 20  # characters from which a text's words aren't held as a list
EMIT = 1 << 18  # ids of a batch that a task hands on, but for a longer row
PIECES = 1 << 20  # pieces that a vocabulary may have, since they are broadcast
_CODEC = "zstd"
_CHUNKS = "rows binary, ids array<int>"


def _pack(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_CODEC, asbytes=True)


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Compressed numbers of 0 to 2**32 - 1, byte by byte, so that the high bytes, which are often 0, lie together."""
    out = [len(arrays).to_bytes(8, "little")]
    for x in arrays:
        x = x.astype(np.uint32)
        wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        planes = x.view(np.uint8).reshape(-1, 4).T[:wide]
        out += [len(x).to_bytes(8, "little"), wide.to_bytes(8, "little"), np.ascontiguousarray(planes).tobytes()]
    return _pack(b"".join(out))


def unpack_numbers(blob: bytes) -> list[np.ndarray]:
    raw = _unpack(blob)
    at, found = 8, []
    for _ in range(int.from_bytes(raw[:8], "little")):
        n, wide = int.from_bytes(raw[at : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 16], "little")
        x = np.zeros((n, 4), np.uint8)
        x[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at + 16).reshape(wide, n).T
        found.append(x.reshape(-1).view(np.uint32))
        at += 16 + n * wide
    return found


def pack_words(words: list[bytes]) -> bytes:
    """Compressed lengths and bytes of words."""
    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return _pack(len(words).to_bytes(8, "little") + lens.tobytes() + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = _unpack(blob)
    n = int.from_bytes(raw[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 8), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([8 + 4 * n, *ends], ends)]


def _ranked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by their hash, and the hashes in that order."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    order = np.argsort(crc, kind="stable")
    return order, crc[order]


def _numbered(text: str, split, found, known: defaultdict) -> np.ndarray:
    """The number of each word of text; known gets the new words."""
    if len(text) < LONG:
        words = split(text)
        return np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
    return np.fromiter((known[m.group()] for m in found(text)), np.uint32)


def _blocks(docs: DataFrame, kept: list[str]) -> DataFrame:
    """(block, n_words, rows, numbers, words): the texts of a block of rows as numbers of its distinct words.

    rows has the kept columns, numbers the words of each text (a null text's
    count is one more than the words of all) and then the number at each
    position, words the distinct words by number.
    """
    names = docs.columns
    at, wanted = names.index("text"), [names.index(c) for c in kept]

    def run(batches):
        split, found = bpe.splitter(), bpe.finder()

        def fresh():
            known = defaultdict()
            known.default_factory = known.__len__
            return known, [], [], 0

        known, numbers, rows, chars = fresh()

        def flush():
            flat = np.concatenate([np.zeros(0, np.uint32), *(x for x in numbers if x is not None)])
            counts = np.array([len(flat) + 1 if x is None else len(x) for x in numbers], np.int64)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as writer:
                for r in rows:
                    writer.write_batch(r)
            words = pack_words([w.encode("utf-8", "replace") for w in known])
            values = [uuid.uuid4().int >> 65, len(known), _pack(sink.getvalue().to_pybytes()), pack_numbers(counts, flat), words]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), *[pa.binary()] * 3))], names=["block", "n_words", "rows", "numbers", "words"])

        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(i) for i in wanted], names=[f"c{i}" for i in range(len(wanted))]) if wanted else pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows)], names=["c"])
            begin = 0
            for i, text in enumerate(batch.column(at).to_pylist()):
                if numbers and chars + len(text or "") > BLOCK:
                    if i > begin:
                        rows.append(own.slice(begin, i - begin))
                    yield flush()
                    known, numbers, rows, chars = fresh()
                    begin = i
                numbers.append(None if text is None else _numbered(text, split, found, known))
                chars += len(text or "")
            if batch.num_rows > begin:
                rows.append(own.slice(begin))
        if numbers:
            yield flush()

    return docs.mapInArrow(settled(run), "block long, n_words long, rows binary, numbers binary, words binary")


def _spread(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words): each block's distinct words by the bucket of their hash."""

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = unpack_words(blob)
                order, crc = _ranked(words)
                own = (crc.astype(np.int64) * buckets) >> 32
                cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else np.zeros(1, np.int64)
                which = own[cuts[:-1]]
                order = order.tolist()
                blobs = [pack_words([words[k] for k in order[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([block] * len(which), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block", "words"])

    return blocks.select("block", "words").mapInArrow(settled(run), "bucket long, block long, words binary")


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of a sequence of words, and offsets of each word's."""
    n = counts[at]
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(n, out=offsets[1:])
    return flat[np.arange(offsets[-1]) + np.repeat(starts[at] - offsets[:-1], n)], offsets


class _Distinct:
    """The distinct words of one bucket and their ids, as far as they have been met."""

    def __init__(self, m: bpe.Merges):
        self.m, self.index = m, {}
        self.flat, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, lists: list[list[bytes]]) -> list[bytes]:
        """Packed number of ids of each word, and ids; words met for the first time are encoded, all at once."""
        new = list(set().union(*lists).difference(self.index))
        if new:
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            flat, offsets = bpe.merge(new, self.m)
            self.flat, self.counts = np.concatenate([self.flat, flat]), np.concatenate([self.counts, np.diff(offsets)])
            self.starts = np.cumsum(self.counts) - self.counts
        out = []
        for words in lists:
            flat, offsets = _gather(self.flat, self.starts, self.counts, np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
            out.append(pack_numbers(np.diff(offsets), flat))
        return out


def _encoded_words(spread: DataFrame, path: str) -> DataFrame:
    """(block, bucket, ids): the ids of each block's words.

    All rows of a bucket pass through one task, one after the other, which
    keeps the bucket's distinct words only and encodes each of them once.  A
    word is there once for each block that has it, however often it occurs,
    so that no bucket is hotter than others.
    """
    shared = spread.sparkSession.sparkContext.broadcast(bpe.load(path))  # of the vocabulary's size

    def run(batches):
        now, known = None, None
        for batch in batches:
            buckets, blobs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            lists, begin, n = [], 0, 0
            out = []
            for i, (bucket, blob) in enumerate(zip(buckets, blobs)):
                if lists and (bucket != now or n > 200_000):
                    out += known.ids(lists)
                    lists, n = [], 0
                if bucket != now:
                    now, known = bucket, _Distinct(shared.value)
                lists.append(unpack_words(blob))
                n += len(lists[-1])
            if lists:
                out += known.ids(lists)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    return spread.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settled(run), "block long, bucket long, ids binary")


def _chunks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about EMIT ids."""
    ends = np.cumsum(counts)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + EMIT, side="right")))
        yield a, b
        a = b


def _encoded(docs: DataFrame, scratch: Scratch, path: str, column: str, kept: list[str]) -> tuple[DataFrame, Callable, StructType]:
    """Blocks with the ids of their words, and what makes rows of (kept, column) of them, of a schema."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = scratch.save_bucketed(_blocks(docs, kept), "blocks", "block", partitions)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    spread = _spread(blocks, max(partitions, -(-total // BUCKET)))
    ids = _encoded_words(spread, path).groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ids"))), lambda x: x["ids"]).alias("ids"))
    # a block without words has no ids
    work = blocks.hint("merge").join(ids, "block", "left").select("rows", "numbers", "words", F.coalesce("ids", F.array().cast("array<binary>")).alias("ids"))
    schema = StructType([*(docs.schema[c] for c in kept), StructField(column, ArrayType(IntegerType()))])
    width = len(kept)

    def rows_of(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows, numbers, words, blobs = (batch.column(c)[k].as_py() for c in range(4))
                whole = pa.ipc.open_stream(_unpack(rows)).read_all().combine_chunks()
                count, at = unpack_numbers(numbers)
                order, _ = _ranked(unpack_words(words))
                parts = [unpack_numbers(x) for x in blobs]
                del rows, numbers, words, blobs
                n_ids, starts = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
                n_ids[order] = np.concatenate([np.zeros(0, np.uint32), *(p[0] for p in parts)])
                ids = np.concatenate([np.zeros(0, np.uint32), *(p[1] for p in parts)]).astype(np.int32)
                starts[order] = np.cumsum(n_ids[order]) - n_ids[order]
                void = count > len(at)
                first = np.zeros(len(count) + 1, np.int64)
                np.cumsum(np.where(void, 0, count), out=first[1:])
                tokens = np.zeros(len(at) + 1, np.int64)
                np.cumsum(n_ids[at], out=tokens[1:])
                for a, b in _chunks(np.diff(tokens[first])):
                    flat, _ = _gather(ids, starts, n_ids, at[first[a] : first[b]])
                    offsets = (tokens[first[a : b + 1]] - tokens[first[a]]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(void[a:b]))
                    part = whole.slice(a, b - a).combine_chunks().to_batches()[0]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], lists], names=schema.names)

    return work, rows_of, schema


def encode(docs: DataFrame, scratch: Scratch, path: str = bpe.VOCABULARY, column: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) and one more column: the ids of text's tokens under a byte-level vocabulary of ranks.

    Texts are split once: a saved table has, for each block of rows, its
    distinct words and the number of the word at each position.  The words go
    to the table of distinct words, in buckets by their hash, where each is
    encoded once; the ids of a block's words come back by a join on the block
    (of which the saved table has as many buckets as a shuffle has partitions,
    so that it isn't shuffled), and each position takes the ids of its word.
    Only words are shuffled, never texts, each as often as there are blocks
    with it.  The number of buckets grows with the words.

    A null text has null ids, an empty one none.  Names of special tokens are
    ordinary text.  Repeated rows each have a result.  Columns may have any
    names but ``column``'s, which is replaced.  No documents, no rows.
    """
    docs = docs.drop(column)
    kept = docs.columns if keep is None else keep
    work, rows_of, schema = _encoded(docs, scratch, path, column, kept)
    return work.mapInArrow(settled(rows_of), schema)


def pieces(spark, path: str = bpe.VOCABULARY) -> DataFrame:
    """(id, piece): the vocabulary as a table, of PIECES rows at most."""
    every = bpe.load(path).pieces
    if len(every) > PIECES:
        raise ValueError(f"a vocabulary of {len(every)} pieces is too large to broadcast")
    return spark.createDataFrame(list(enumerate(map(bytearray, every))), StructType([StructField("id", IntegerType()), StructField("piece", BinaryType())]))


def _chunked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(rows, ids): rows of batch, whose last column has lists of ids, by about EMIT ids, as one binary; and their distinct ids."""
    lists = batch.column(batch.num_columns - 1)
    for a, b in _chunks(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)):
        part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], names=[f"c{i}" for i in range(batch.num_columns)])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as writer:
            writer.write_batch(part)
        ids = np.unique(pc.drop_null(lists.slice(a, b - a).flatten()).to_numpy(zero_copy_only=False)).astype(np.int32)
        # without an id there is still a chunk
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary()), pa.array([ids if len(ids) else [-1]], pa.list_(pa.int32()))], names=["rows", "ids"])


def _chunks_of(rows_of: Callable | None = None) -> Callable:
    def run(batches):
        for batch in rows_of(batches) if rows_of else batches:
            if batch.num_rows:
                yield from _chunked(batch)

    return run


def _decoded(chunks: DataFrame, path: str, schema: StructType) -> DataFrame:
    """Rows of chunks, of this schema: what goes along, the ids if the schema has them too, and the text of their pieces.

    Each distinct id of a chunk is a row that is joined to the table of
    pieces.  That has the vocabulary's size, so it is broadcast, and the
    chunk's rows stay in their order: they come to the same task one after the
    other, behind the chunk, which goes along with the first of them.
    """
    items = chunks.select("rows", F.posexplode("ids").alias("pos", "id"))
    items = items.select(F.when(F.col("pos") == 0, F.col("rows")).alias("rows"), "id")
    joined = items.join(F.broadcast(pieces(chunks.sparkSession, path)), "id", "left").select("rows", "id", "piece")
    width = len(schema.names)

    def whole(held):
        ids = np.concatenate([b.column(1).to_numpy() for b in held])
        parts = pa.concat_arrays([*(b.column(2) for b in held), pa.array([b""], pa.binary())])
        batch = pa.ipc.open_stream(held[0].column(0)[0].as_py()).read_all().combine_chunks().to_batches()[0]
        lists = batch.column(batch.num_columns - 1)
        flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        at = np.searchsorted(ids, flat)
        real = flat >= 0
        if (np.diff(ids) <= 0).any() or (ids[np.minimum(at, len(ids) - 1)] != flat)[real].any():
            raise AssertionError("the ids of a chunk are not whole")
        # the last piece, which is empty, stands for what has none
        text = pc.fill_null(parts, b"").take(pa.array(np.where(real, at, len(ids))))
        first = np.zeros(len(lists) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=first[1:])
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
        offsets = ends[first]
        data = text.buffers()[2] if len(text) and text.buffers()[2] is not None else pa.py_buffer(b"")
        joined = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), data])
        try:
            joined = joined.cast(pa.string())
        except pa.ArrowInvalid:
            joined = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
        joined = pc.if_else(lists.is_valid(), joined, pa.scalar(None, pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns[: width - 1], joined], names=schema.names)

    def run(batches):
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(0).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows]):
                if a in starts and held:
                    yield whole(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield whole(held)

    return joined.mapInArrow(settled(run), schema)


def decode(encoded: DataFrame, path: str = bpe.VOCABULARY, column: str = "token_ids", to: str = "text", keep_ids: bool = False) -> DataFrame:
    """encoded with ``column`` of ids turned into ``to``, the text of their pieces; with ``keep_ids`` both are there.

    The distinct ids of each few rows are joined to the table of pieces; the
    rows then take the pieces of their ids.  Nothing is shuffled.

    Null ids make a null text.  An id that is null or has no piece adds
    nothing; bytes that aren't UTF-8 become replacement characters.  Other
    columns stay, one named ``to`` is replaced.  No rows, no result.
    """
    kept = [c for c in encoded.columns if c not in (column, to)]
    schema = StructType([*(encoded.schema[c] for c in kept), *([StructField(column, ArrayType(IntegerType()))] if keep_ids else []), StructField(to, StringType())])
    chunks = encoded.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").cast("array<int>")).mapInArrow(settled(_chunks_of()), _CHUNKS)
    return _decoded(chunks, path, schema)


def encode_and_decode(docs: DataFrame, scratch: Scratch, path: str = bpe.VOCABULARY, column: str = "token_ids", keep: list[str] | None = None, to: str = "text") -> DataFrame:
    """decode(encode(docs), keep_ids=True), with one step less between them."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (column, to)]
    work, rows_of, schema = _encoded(docs, scratch, path, column, kept)
    return _decoded(work.mapInArrow(settled(_chunks_of(rows_of)), _CHUNKS), path, StructType([*schema.fields, StructField(to, StringType())]))


def round_trip(docs: DataFrame, scratch: Scratch, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, token_ids, text) for each row of docs, where text is decoded from the ids.

    Edge cases: encode and decode.
    """
    return encode_and_decode(docs.select("doc_id", "text"), scratch, path, keep=["doc_id"])
