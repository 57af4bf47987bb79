"""Best-fit packing of documents into sequences of a fixed number of tokens.

A document is its ids and one end id. Documents longer than a sequence are cut into full
pieces with the shorter piece first; a full piece is a sequence of its own. Pieces are dealt
to partitions of about ``per_partition`` by a hash of their row, and each partition packs
its own by best fit, longest first.

A lower bound certifies what a partition has: the largest of a family of dual feasible
functions summed over its lengths. Partitions that use more sequences than their bound
have a gap; these hand out the pieces of every sequence that is not full, and, while the
total is above the bound of all pieces together, every other partition hands out its
emptiest sequence. What is handed out is dealt to new partitions and packed again, and so
on as long as that saves sequences. Only counts per length, as many as a sequence has
tokens, and sums reach the driver.

Null and empty texts are a document of the end id alone. Repeated rows are packed each.
Added tokens of the tokenizer file are ordinary text, or, with ``added``, cut out of the
texts first and given their own ids, as the library does unless told otherwise.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.materialize import batches_of, materialize

from .bpe import Encoder, kept, slices

CAPACITY = 2048
END_ID = 0
PER_PARTITION = 20_000
#: Bytes of text encoded at a time: what a worker holds beside the encoder's tables grows with it.
SLICE = 1 << 20
#: Texts handed to a worker at a time: either side of the pipe holds a batch, the executor in buffers that double.
BATCH = 2000
#: Sequences of a partition are numbered below this.
STRIDE = 1 << 24
PLACE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "room", "gap")]
    + [T.StructField("emptiest", T.BooleanType())]
)


def tokenizer_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a byte-level tokenizer file, without its added tokens.

    Such files write each byte as a character: printable ones as they are, the others as
    characters from 256 on, in order.
    """
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}
    added = {t["id"] for t in model.get("added_tokens", ())}
    return {bytes(byte_of[c] for c in token): n for token, n in model["model"]["vocab"].items() if n not in added}


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokenizer file's added tokens; only those that are matched as they stand."""
    with open(path, encoding="utf-8") as lines:
        model = json.load(lines)
    found = model.get("added_tokens", ())
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in found):
        raise ValueError("added tokens with rules about what surrounds them")
    return {t["content"]: t["id"] for t in found}


class AddedEncoder:
    """Ids of whole columns like ``Encoder``, with added tokens cut out of the texts first."""

    def __init__(self, encoder: Encoder, added: dict[str, int]):
        self.encoder, self.added = encoder, added
        # of two tokens at one place the longer one
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self.encoder.column(texts)
        parts, owner, special = [], [], []
        for n, text in enumerate(texts.to_pylist()):
            for k, part in enumerate(self.cut(text) if holds[n] else [text]):
                parts.append(None if k % 2 else part)
                owner.append(n)
                special.append(self.added[part] if k % 2 else -1)
        flat, counts = self.encoder.column(pa.array(parts, pa.large_string()))
        special = np.array(special)
        at = np.flatnonzero(special >= 0)
        flat = np.insert(flat, (np.cumsum(counts) - counts)[at], special[at].astype(flat.dtype))
        counts = counts + (special >= 0)
        return flat, np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


@kept
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(tokenizer_ranks(path), pattern)


def pieces(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of every row: row_id, id, piece, start, length, ids_crc32 and, if asked for, ids."""
    kind = docs.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"row_id long, id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    )
    source = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")
    )

    tokens = added_tokens(path) if added else {}

    def run(batches):
        enc = _encoder(path, pattern)
        enc = AddedEncoder(enc, tokens) if tokens else enc
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, counts = enc.column(part.column("text"))
                raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                length = counts + 1
                number = -(-length // capacity)
                row = np.repeat(np.arange(len(counts)), number)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                first = length - (number - 1) * capacity
                start = np.where(nth == 0, 0, first[row] + (nth - 1) * capacity)
                size = np.where(nth == 0, first[row], capacity)
                base = (np.cumsum(counts) - counts)[row]
                crc, ids = [], []
                for at, n, last in zip((base + start).tolist(), size.tolist(), (nth + 1 == number[row]).tolist()):
                    body = raw[4 * at : 4 * (at + n - last)]
                    crc.append(zlib.crc32(end, zlib.crc32(body)) if last else zlib.crc32(body))
                    if with_ids:
                        ids.append(bytes(body) + end * last)
                columns = [
                    part.column("row_id").take(pa.array(row)),
                    part.column("id").take(pa.array(row)),
                    pa.array(nth, pa.int32()),
                    pa.array(start),
                    pa.array(size),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, steps: int = 20) -> int:
    """Least number of bins for ``counts[n]`` items of size n; the capacity is the last n.

    The largest bound of two families of dual feasible functions: one rounds sizes above
    ``capacity - t`` up to the whole and those below t down to nothing, the other rounds
    sizes down to multiples of a k-th of the bin, counted with k + 1 parts.
    """
    capacity = len(counts) - 1
    counts = counts.astype(object)
    size = np.arange(capacity + 1).astype(object)
    many, total = np.cumsum(counts), np.cumsum(counts * size)
    best = -(-total[-1] // capacity)
    for t in range(1, capacity // 2 + 1):
        weight = (many[-1] - many[capacity - t]) * capacity + total[capacity - t] - total[t - 1]
        best = max(best, -(-weight // capacity))
    for k in range(1, steps):
        parts = size * (k + 1)
        weight = np.where(parts % capacity == 0, size * k, parts // capacity * capacity)
        best = max(best, -(-int((counts * weight).sum()) // (capacity * k)))
    return int(best)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the room left per bin; items come longest first."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit n: some bin has room n
    for n, size in enumerate(sizes.tolist()):
        fitting = present >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = with_room[left].pop()
            if not with_room[left]:
                present ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[n], offsets[n] = b, capacity - left
        left -= size
        room[b] = left
        with_room[left].append(b)
        if left:
            present |= 1 << left
    return bins, offsets, room


def _packed(items: DataFrame, turn: int, per_partition: int, capacity: int) -> DataFrame:
    """Items with their place after one packing of all partitions, and what it leaves open."""
    parts = max(1, -(-items.count() // per_partition))
    own = [f for f in items.schema if f.name not in PLACE.names]
    schema = T.StructType([*own, *PLACE])

    def pack(key, rows):
        rows = rows.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes = rows["length"].to_numpy()
        bins, offsets, room = best_fit(sizes, capacity)
        left = np.array(room)
        rows["sequence_id"] = ((turn << 32) + int(key[0])) * STRIDE + bins
        rows["offset"], rows["room"] = offsets, left[bins]
        rows["gap"] = len(room) - lower_bound(np.bincount(sizes, minlength=capacity + 1))
        rows["emptiest"] = bins == int(left.argmax())
        return rows[schema.names]

    dealt = items.select(*(f.name for f in own)).withColumn(
        "part", F.pmod(F.xxhash64("row_id", "piece", F.lit(turn)), F.lit(parts))
    )
    return materialize(dealt.groupBy("part").applyInPandas(pack, schema))


def _used(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def pack(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, per_partition: int = PER_PARTITION, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; columns as in ``pieces``, the key under its name."""
    # the ids themselves take no part in the packing
    with batches_of(docs.sparkSession, BATCH):
        cut = materialize(pieces(docs, path, pattern, text, key, capacity, with_ids=with_ids, added=added))
    items = cut.drop("ids")
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r.length] = r["count"]
    bound = lower_bound(counts)
    packed = _packed(items, 0, per_partition, capacity)
    total, turn, settled = _used(packed), 0, None
    while total > bound:
        turn += 1
        open_ = (F.col("gap") > 0) & (F.col("room") > 0) | F.col("emptiest")
        given = packed.filter(open_)
        again = _packed(given, turn, per_partition, capacity)
        saved = _used(given) - _used(again)
        if saved <= 0:
            break
        rest = packed.filter(~open_)
        settled = rest if settled is None else settled.unionByName(rest)
        packed, total = again, total - saved
    out = packed if settled is None else settled.unionByName(packed)
    out = out.drop("room", "gap", "emptiest")
    if with_ids:
        out = out.join(cut.select("row_id", "piece", "ids"), ["row_id", "piece"])
    return out.withColumnRenamed("id", key).drop("row_id")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences (sequence_id, ids, documents) of a packing that carries its ids.

    A sequence is bounded by its capacity, and so is what is gathered for it.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(whole.alias("ids"), F.count(F.lit(1)).alias("documents"))
