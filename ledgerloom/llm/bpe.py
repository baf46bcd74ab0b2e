"""Encoding and decoding whole corpora with a word-cutting BPE tokenizer.

The tokenizer cuts texts at white space first, so the ids of a text are those of its words in order.
Three steps use that:

1. Texts are cut into words, in chunks of bounded size. A chunk keeps each of its words once; its
   texts become lists of positions in that word list.
2. The word lists are shuffled by the words' hash, in parts, and every distinct word of a part is
   encoded once.
3. The ids return to their chunk and are joined back by position.

Only word lists, ids of words and lists of positions are moved, compressed, never the ids of whole
texts. A word that every text holds comes once for each chunk, so no word is hot.
"""

from functools import lru_cache, partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import release_unused, small_batches

CHUNK_BYTES = 16 << 20  # of text in a chunk; a longer text is a chunk of its own
LEAST_PARTS = 64  # of a chunk's word list
REMEMBERED = 1 << 19  # words whose ids a task holds
_JOINED_IDS = 1 << 20  # ids that are decoded at once
# Numbers below _ONE take one byte, those below _TWO two, those below _THREE three, others five.
_ONE, _TWO = 160, 160 + 64 * 256
_THREE = _TWO + 31 * 65536


@lru_cache(maxsize=4)
def _tokenizer(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pack(values):
    """Numbers as bytes, small ones short. First bytes and further bytes are compressed apart."""
    if not isinstance(values, np.ndarray):
        values = np.array(values, np.int64)
    one, two, three = values < _ONE, values < _TWO, values < _THREE
    second, third, last = values[~one & two] - _ONE, values[~two & three] - _TWO, values[~three]
    first = values.astype(np.uint8)  # right below _ONE, the others are set next
    first[~one & two] = 160 + (second >> 8)
    first[~two & three] = 224 + (third >> 16)
    first[~three] = 255
    streams = [first, second, third, third >> 8]
    streams = [zstandard.compress(x.astype(np.uint8).tobytes(), 3) for x in streams]
    streams.append(last.astype("<u4").tobytes())
    return b"".join([np.array([len(x) for x in streams], "<u4").tobytes(), *streams])


def _unpack(data):
    ends = 20 + np.cumsum(np.frombuffer(data, "<u4", 5, 0), dtype=np.int64)
    streams = [data[a:b] for a, b in zip([20, *ends.tolist()], ends.tolist())]
    first, second, low, high = (
        np.frombuffer(zstandard.decompress(x), np.uint8) for x in streams[:4]
    )
    out = first.astype(np.int64 if streams[4] else np.int32)
    two, three = (first >= 160) & (first < 224), (first >= 224) & (first < 255)
    out[two] = _ONE + ((out[two] - 160) << 8) + second
    out[three] = _TWO + ((out[three] - 224) << 16) + (high.astype(np.int32) << 8) + low
    if streams[4]:
        out[first == 255] = np.frombuffer(streams[4], "<u4")
    return out


def _moved(id_type):
    """Rows of a chunk: its texts (ids of the documents; sizes and positions), or a part of its words
    (their positions and, before they are encoded, the words)."""
    return f"key long, chunk long, docs array<{id_type}>, payload binary, words binary"


def _batch(rows, id_type):
    kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary()]
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["key", "chunk", "docs", "payload", "words"]
    )


def _chunk_rows(chunk, words, texts, docs, parts):
    """A row of all texts, and for each part a row of words.

    Frequent words get small numbers. The others are numbered by part and alphabet, so that a part's
    words compress well and their positions are mostly consecutive.
    """
    names = list(words)
    sizes = [len(t) for t in texts]
    flat = np.concatenate(texts) if texts else np.empty(0, np.int32)
    part = np.fromiter((crc32(w) % parts for w in names), np.int64, len(names))
    by_count = np.argsort(-np.bincount(flat, minlength=len(names)), kind="stable")
    rest = by_count[_TWO:].tolist()
    rest.sort(key=names.__getitem__)
    rest = np.array(rest, np.int64)
    rest = rest[np.argsort(part[rest], kind="stable")]
    order = np.concatenate([by_count[:_TWO], rest])
    number = np.empty(len(names), np.int32)
    number[order] = np.arange(len(names))
    payload = _pack(np.concatenate([np.array([len(sizes), *sizes], np.int32), number[flat]]))
    rows = [(chunk, chunk, docs, payload, None)]
    by_part = order[np.argsort(part[order], kind="stable")]
    cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            own = by_part[a:b]
            text = zstandard.compress(b" ".join([names[i] for i in own.tolist()]), 3)
            rows.append((p, chunk, None, _pack(np.diff(number[own], prepend=0)), text))
    return rows


def _cut(batches, chunk_bytes, parts):
    """The rows of all chunks. The number of a chunk is made of the task's and its place in the task,
    so a repeated task gives the same chunks."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    size, words, texts, docs, id_type = 0, {}, [], [], None
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py() or b""
            if docs and size + len(text) > chunk_bytes:
                yield _batch(_chunk_rows(chunk, words, texts, docs, parts), id_type)
                chunk, size, words, texts, docs = chunk + 1, 0, {}, [], []
            size += len(text)
            found = text.split()
            texts.append(
                np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found))
            )
            docs.append(doc_id)
    if docs:
        yield _batch(_chunk_rows(chunk, words, texts, docs, parts), id_type)


def _encode(batches, path):
    """Encode each distinct word of the task's parts once; rows of texts pass through."""
    tokenizer, known = _tokenizer(path), {}
    for batch in batches:
        release_unused()
        id_type = batch.schema.field("docs").type.value_type
        rows = []
        for key, chunk, docs, payload, words in zip(*(c.to_pylist() for c in batch.columns)):
            if words is None:
                rows.append((key, chunk, docs, payload, None))
                continue
            words = zstandard.decompress(words).split(b" ")
            if len(known) + len(words) > REMEMBERED:
                known.clear()
            new = [w for w in words if w not in known]
            texts = [w.decode("utf-8", "replace") for w in new]
            for word, found in zip(new, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                known[word] = found.ids
            ids = [known[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for one in ids for i in one), np.int64, sizes.sum())
            data = np.concatenate([[len(ids)], _unpack(payload), sizes, flat])
            rows.append((key, chunk, None, _pack(data), None))
        yield _batch(rows, id_type)


def _assemble(group: pa.Table, id_type):
    """The ids of every text of one chunk."""
    release_unused()  # of the chunk before
    places, sizes, flat = [], [], []
    for docs, payload in zip(group["docs"].to_pylist(), group["payload"].to_pylist()):
        values = _unpack(payload)
        n = int(values[0])
        if docs is not None:
            doc_ids, lengths, numbers = docs, values[1 : n + 1], values[n + 1 :]
            continue
        places.append(np.cumsum(values[1 : n + 1]))
        sizes.append(values[n + 1 : 2 * n + 1])
        flat.append(values[2 * n + 1 :].astype(np.int32))
    none = [np.empty(0, np.int64)]
    place, size = np.concatenate(places or none), np.concatenate(sizes or none)
    flat = np.concatenate(flat or [np.empty(0, np.int32)])
    if len(place) != (numbers.max() + 1 if len(numbers) else 0):
        raise RuntimeError("a chunk has not got all of its words back")
    begin, count = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    begin[place], count[place] = np.cumsum(size) - size, size
    ids, ends, at = [], [0], 0
    for length in lengths.tolist():
        own = numbers[at : at + length]
        at += length
        size = count[own]
        shift = np.repeat(begin[own] - (np.cumsum(size) - size), size)
        ids.append(flat[shift + np.arange(len(shift))])
        ends.append(ends[-1] + len(shift))
    if ends[-1] < 1 << 31:
        values = pa.array(np.concatenate(ids), pa.int32())
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    else:
        column = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
    return pa.table({"doc_id": pa.array(doc_ids, id_type), "ids": column})


def _part_of(parts):
    """Words go to their own part; texts to any by the chunk's hash, as chunks of all tasks have the same
    low digits."""
    key = F.when(F.col("docs").isNotNull(), F.xxhash64("chunk")).otherwise(F.col("key"))
    return F.pmod(key, F.lit(parts)).cast("int")


def encode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
    parts: int | None = None,
    decode_into: str | None = None,
) -> DataFrame:
    """One row (id, ids array<int>) for each row of `docs`: the ids of the whole text.

    `tokenizer` is the path of a tokenizers file on every executor. Its pre-tokenizer must cut at
    ASCII white space and drop it, and normalise each word by itself; the result is then equal to
    `encode(text, add_special_tokens=False).ids`. Null texts count as empty and give an empty list.
    Rows with equal or null ids are encoded each by itself. Other columns of `docs` play no part.

    `parts` is the number of parts that word lists are cut in; by default that of shuffle partitions,
    `LEAST_PARTS` at least. `decode_into` names a column for the text that `decode` gives for the ids;
    it is made where the ids are, which saves a second pass of all ids through Python.
    """
    small_batches(docs.sparkSession)
    if parts is None:
        parts = max(LEAST_PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    rows = given.mapInArrow(partial(_cut, chunk_bytes=chunk_bytes, parts=parts), _moved(id_type))
    placed = rows.repartitionById(parts, _part_of(parts))
    encoded = placed.mapInArrow(partial(_encode, path=tokenizer), _moved(id_type))

    def assemble(group: pa.Table) -> pa.Table:
        found = _assemble(group, group.schema.field("docs").type.value_type)
        if decode_into:
            texts = _decoded(found["ids"].combine_chunks(), _pieces(tokenizer))
            found = found.append_column("decoded", texts)
        release_unused()
        return found

    if decode_into:
        _check_decoder(tokenizer)
    schema = f"doc_id {id_type}, ids array<int>" + ", decoded string" * bool(decode_into)
    ids = encoded.groupBy("chunk").applyInArrow(assemble, schema)
    names = {"doc_id": id_col} | ({"decoded": decode_into} if decode_into else {})
    return ids.withColumnsRenamed(names)


@lru_cache(maxsize=4)
def _pieces(path):
    tokenizer = _tokenizer(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    pieces = [None] * (max(vocabulary.values(), default=-1) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece
    return pa.array(pieces, pa.string())


def _joined(lists, pieces):
    """The texts of some lists of ids."""
    flat = lists.flatten()
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces)))
    found = pieces.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if found.null_count:
        valid = found.is_valid().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(valid)])[ends]
        found = found.drop_null()
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")
    return pc.if_else(lists.is_valid(), texts, pa.scalar(None, texts.type))


def _decoded(lists, pieces):
    """The texts of a column of lists of ids, some lists at a time."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // _JOINED_IDS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(lists)]
    return pa.chunked_array(
        [_joined(lists.slice(a, b - a), pieces) for a, b in zip(cuts, cuts[1:])], pa.string()
    )


def _check_decoder(tokenizer):
    if _tokenizer(tokenizer).decoder is not None:
        raise ValueError("this tokenizer has a decoder of its own")


def decoded(ids, tokenizer: str):
    """A column of texts for a column of ids, as the tokenizer's
    `decode(ids, skip_special_tokens=False)` without a decoder gives them.

    The ids of a batch are joined to the vocabulary's table of pieces, in one pass for many texts; ids
    without a piece are left out and a null list gives a null. The table is bounded by the vocabulary.
    """

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        return _decoded(lists, _pieces(tokenizer)).combine_chunks()

    return of(F.col(ids) if isinstance(ids, str) else ids)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the decoded text of a column of ids; the file's own decoder must be unset."""
    _check_decoder(tokenizer)
    return encoded.withColumn(into, decoded(ids_col, tokenizer))


def digests(ids_col: str = "ids", decoded_col: str = "decoded"):
    """Columns n_tokens, ids_sha256 (of the decimal ids, joined by a space) and decoded_sha256."""
    decimal = F.array_join(F.col(ids_col).cast("array<string>"), " ")
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256"),
    ]
