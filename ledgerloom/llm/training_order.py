"""Training order on disk: token sequences in a keyed random order, in shards of fixed stride.

Texts are written as the ids of a tokenizer's vocabulary, in 16 or 32 bits as the vocabulary needs, and
packed into sequences of one length. Without a tokenizer the tokens are bytes; UTF-8 never uses 0xFE and
0xFF, which stand for padding and the end of a document. Sequences are numbered by task and place, the
numbers are permuted by a keyed Feistel network with cycle-walking, and the permuted number is the
sequence's slot. A shard is a range of slots in one file; a sequence lies at `slot * length` tokens of
the files put end to end. A reader that knows how many sequences were consumed can go on at the next
slot with one seek.

Ids are made once: the first pass encodes, packs and stores sequences under the number of their task and
their place in it, the second adds the tasks' offsets and moves them to their slots.
"""

import json
import re
import zlib
from functools import partial
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import REMEMBERED, _tokenizer
from ledgerloom.llm.feistel import ArrayPermutation
from ledgerloom.llm.scratch import Scratch, small_batches
from ledgerloom.llm.word_ids import text_ids

SEQUENCE = 2048  # tokens
SHARD_SEQUENCES = 8192
_TOGETHER = 4096  # sequences that are placed at once
_STORED = 256  # sequences in a stored row
END, PAD = 0xFF, 0xFE  # bytes that UTF-8 never uses
END_TOKEN = "<|endoftext|>"  # ends a document and pads, where the vocabulary has it


def _files(path):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def _part(id_type):
    return pa.struct(
        [("doc_id", id_type), ("doc_begin", pa.int64()), ("position", pa.int32()), ("n_tokens", pa.int32())]
    )


def _sequences(documents, length, width, pad):
    """(tokens, parts) of every sequence; documents are ids and tokens of `width` bytes, end mark included."""
    buffer, parts, filled = bytearray(), [], 0
    for doc_id, data in documents:
        at, last = 0, len(data) // width
        while at < last:
            size = min(length - filled, last - at)
            parts.append({"doc_id": doc_id, "doc_begin": at, "position": filled, "n_tokens": size})
            buffer += data[at * width : (at + size) * width]
            at, filled = at + size, filled + size
            if filled == length:
                yield bytes(buffer), parts
                buffer, parts, filled = bytearray(), [], 0
    if filled:
        yield bytes(buffer) + pad * (length - filled), parts


def _by_shard(rows, slots, shard_sequences, id_type):
    """A row for each shard that some of the sequences go to."""
    shard = slots // shard_sequences
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
    groups = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    tokens = [zstandard.compress(b"".join(rows[i][0] for i in g), 3) for g in groups]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(shard[g[0]]) for g in groups], pa.int32()),
            pa.array([slots[g] for g in groups], pa.list_(pa.int64())),
            pa.array(tokens, pa.binary()),
            pa.array([[rows[i][1] for i in g] for g in groups], pa.list_(pa.list_(_part(id_type)))),
        ],
        ["shard", "slots", "tokens", "parts"],
    )


def _pack(batches, length, shard_sequences, offsets, n, key):
    """Sequences of bytes with their slots, and the parts of documents that they are made of; those of one
    shard travel together."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    first, last = offsets.get(task, (0, 0))
    place = ArrayPermutation(n, key) if n else None
    number, rows, types = first, [], None

    def documents():
        nonlocal types
        for given in batches:
            types = given.schema.field(0).type
            for doc_id, text in zip(given.column(0).to_pylist(), given.column(1)):
                yield doc_id, (text.as_py() or b"") + bytes([END])

    for row in _sequences(documents(), length, 1, bytes([PAD])):
        rows.append(row)
        number += 1
        if len(rows) >= _TOGETHER:
            yield _by_shard(rows, place(np.arange(number - len(rows), number)), shard_sequences, types)
            rows = []
    if rows:
        yield _by_shard(rows, place(np.arange(number - len(rows), number)), shard_sequences, types)
    if number != last:
        raise RuntimeError(
            f"partition {task} has {number - first} sequences now and had {last - first} when they were "
            "counted; the input must be read the same way twice (files, or a checkpoint)"
        )


def _marks(path, end_token=END_TOKEN):
    """(bytes of an id, id of the end mark); a vocabulary without the token gets the next free id."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    end = vocabulary.get(end_token, max(vocabulary.values(), default=-1) + 1)
    return (2 if max(end, *vocabulary.values()) < 1 << 16 else 4), end


def _pack_ids(batches, path, length):
    """Sequences of ids in stored rows: the task, the place of the first, and the parts of documents."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    width, end = _marks(path)
    mark, made = end.to_bytes(width, "little"), text_ids(path, width, REMEMBERED // 2)
    number, rows, types = 0, [], None

    def documents():
        nonlocal types
        for given in batches:
            types = given.schema.field(0).type
            for doc_id, ids in zip(given.column(0).to_pylist(), made.of(given.column(1))):
                yield doc_id, ids + mark

    def stored():
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task], pa.int32()),
                pa.array([number - len(rows)], pa.int64()),
                pa.array([zstandard.compress(b"".join(tokens for tokens, _ in rows), 3)], pa.binary()),
                pa.array([[parts for _, parts in rows]], pa.list_(pa.list_(_part(types)))),
            ],
            ["task", "first", "tokens", "parts"],
        )

    for row in _sequences(documents(), length, width, mark):
        rows.append(row)
        number += 1
        if len(rows) >= _STORED:
            yield stored()
            rows = []
    if rows:
        yield stored()


def _place(batches, stride, shard_sequences, offsets, n, key):
    """Stored sequences with their slots; those of one shard travel together. `stride` is in bytes."""
    place, numbers, rows, types = ArrayPermutation(n, key) if n else None, [], [], None
    for batch in batches:
        types = batch.schema.field("parts").type.value_type.value_type.field("doc_id").type
        columns = [batch.column(c) for c in ("task", "first", "tokens", "parts")]
        for task, first, tokens, parts in zip(*columns):
            tokens, parts = zstandard.decompress(tokens.as_py()), parts.as_py()
            number = offsets[task.as_py()] + first.as_py()
            numbers.append(np.arange(number, number + len(parts)))
            rows += [(tokens[i * stride : (i + 1) * stride], one) for i, one in enumerate(parts)]
            if len(rows) >= _TOGETHER:
                yield _by_shard(rows, place(np.concatenate(numbers)), shard_sequences, types)
                numbers, rows = [], []
    if rows:
        yield _by_shard(rows, place(np.concatenate(numbers)), shard_sequences, types)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _write(batches, path, length, shard_sequences, n):
    """Put the shards of a partition together and write them; yields what lies where. `length` is in bytes.

    A task holds one shard at a time. It is written beside its place and moved there when it is
    complete, so a repeated or a second attempt of a task leaves the same file.
    """
    files, root = _files(path)
    files.create_dir(root, recursive=True)
    shards = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "slots", "tokens")]
        index = []
        for shard, slots, tokens in zip(*columns):
            first = shard * shard_sequences
            if shard not in shards:
                shards[shard] = bytearray(min(shard_sequences, n - first) * length)
            tokens = zstandard.decompress(tokens)
            for i, slot in enumerate(slots):
                one, offset = tokens[i * length : (i + 1) * length], (slot - first) * length
                shards[shard][offset : offset + length] = one
                index.append((shard, slot, offset, zlib.crc32(one)))
        columns = list(zip(*index)) or [[]] * 4
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column("parts").flatten()],
            ["shard", "slot", "offset", "crc32", "parts"],
        )
    for shard, data in shards.items():
        temporary = f"{root}/_{uuid4().hex}"
        with files.open_output_stream(temporary) as stream:
            stream.write(bytes(data))
        files.move(temporary, f"{root}/{shard_name(shard)}")


def materialise(
    docs: DataFrame,
    path: str,
    key: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = SEQUENCE,
    shard_sequences: int = SHARD_SEQUENCES,
    tokenizer: str | None = None,
) -> DataFrame:
    """Write the shards, an index and a manifest below `path`; returns the index.

    `tokenizer` is the path of a tokenizers file on every executor, as `bpe.encode` takes it. The tokens
    are its ids, little-endian in `bytes_per_token` bytes of the manifest, and `END_TOKEN` ends a document
    and pads. Without a tokenizer the tokens are bytes.

    The index has a row for each part of a document in a sequence: the document's id, where the part
    begins in the document's tokens (`doc_begin`) and in the sequence (`position`), its `n_tokens` with
    the end mark, and the sequence's slot, shard, `offset` in the shard's file and CRC-32. Null and
    empty texts are one end mark. Repeated rows and null ids are written like others; an empty table
    gives no shard. Other columns of `docs` play no part.

    Sequences of ids are stored and counted by task. Of bytes, the numbers of sequences are counted first,
    by partition: `docs` must come from files or a
    checkpoint, so that a second reading has the same partitions; a task that finds another number
    fails rather than write. One number for each partition goes through the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    parts = f"array<struct<doc_id: {id_type}, doc_begin: bigint, position: int, n_tokens: int>>"
    placed = f"shard int, slots array<long>, tokens binary, parts array<{parts}>"
    n, stored, scratch = 0, None, None
    if tokenizer:
        width, end = _marks(tokenizer)
        pad, offsets = end, {}
        scratch = Scratch(spark, "training-order-ids")
        stored = scratch.store(
            given.mapInArrow(
                partial(_pack_ids, path=tokenizer, length=length),
                f"task int, first long, tokens binary, parts array<{parts}>",
            ),
            "sequences",
        )
        counts = stored.groupBy("task").agg(F.sum(F.size("parts")).alias("sequences"))
        for row in sorted(counts.collect(), key=lambda r: r["task"]):
            offsets[row["task"]] = n
            n += row["sequences"]
        packed = stored.mapInArrow(
            partial(
                _place, stride=length * width, shard_sequences=shard_sequences, offsets=offsets, n=n, key=key
            ),
            placed,
        )
    else:
        width, end, pad, offsets = 1, END, PAD, {}
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
        sizes = given.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(size).alias("bytes"))
        for row in sorted(sizes.collect(), key=lambda r: r["task"]):
            count = -(-row["bytes"] // length)
            offsets[row["task"]] = (n, n + count)
            n += count
        packed = given.mapInArrow(
            partial(
                _pack, length=length, shard_sequences=shard_sequences, offsets=offsets, n=n, key=key
            ),
            placed,
        )
    shards = -(-n // shard_sequences)
    written = packed.repartitionById(max(1, shards), "shard").mapInArrow(
        partial(_write, path=f"{path}/shards", length=length * width, shard_sequences=shard_sequences, n=n),
        f"shard int, slot long, offset long, crc32 long, parts {parts}",
    )
    written.select("shard", "slot", "offset", "crc32", F.explode("parts").alias("p")).select(
        F.col("p.doc_id").alias("doc_id"), "p.doc_begin", "p.position", "p.n_tokens", "slot", "shard",
        "offset", "crc32",
    ).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/index")
    if stored is not None:
        scratch.drop(stored)
    files, root = _files(path)
    manifest = {
        "sequences": n, "length": length, "shard_sequences": shard_sequences, "shards": shards,
        "bytes_per_token": width, "end": end, "pad": pad,
    }
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return read_index(spark, path).withColumnRenamed("doc_id", id_col)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read_manifest(path: str) -> dict:
    files, root = _files(path)
    with files.open_input_stream(f"{root}/manifest.json") as stream:
        return json.loads(stream.read())


def read_sequences(path: str, first: int = 0, count: int | None = None):
    """Yield (slot, tokens as a numpy array) from slot `first` on, each file read from one seek."""
    manifest, (files, root) = read_manifest(path), _files(path)
    length, per_shard = manifest["length"], manifest["shard_sequences"]
    last = manifest["sequences"] if count is None else min(manifest["sequences"], first + count)
    kind = np.dtype(f"<u{manifest['bytes_per_token']}")
    stride, slot = length * kind.itemsize, first
    while slot < last:
        shard = slot // per_shard
        with files.open_input_file(f"{root}/shards/{shard_name(shard)}") as stream:
            stream.seek(slot % per_shard * stride)
            while slot < last and slot // per_shard == shard:
                yield slot, np.frombuffer(stream.read(stride), kind)
                slot += 1
