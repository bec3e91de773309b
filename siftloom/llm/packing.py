"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Each text is tokenised whole, the separator id is appended, and texts beyond the capacity are cut into full pieces (the
first piece takes the remainder). Full pieces are sequences of their own. All other pieces are dealt, by a hash of their row,
into blocks of bounded size; each block is packed by several islands. An island holds a small population of packings;
crossover injects well-filled bins of one parent into the other, drops the bins that lost documents to them and puts the
displaced documents back by best fit. After each epoch every island sends its elite to the next one; in the end the
best packing of a block wins. Sequences that stayed loose are then dissolved and packed again across blocks.

Defined results: a null or empty text is one piece that holds the separator only; repeated rows and null ids are
packed like any other; an empty table gives no rows; the result is the same on every run over the same rows in the same layout,
and the number of sequences is so up to the dealing.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import batch_of, cut, lean, parts, trimmed, trimmed_groups

CAPACITY = 2048
#: The tokenizer's split rule, as its file states it.
SPLIT_RULE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space between white space, or behind it at the end of the text.
INNER_SPACE = re.compile(r" (?<=\s )(?:\s|\Z)")


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ChunkIds(dict):
    """Ids of a space and the text behind it, up to the next space, as little-endian 32-bit integers; keeps the first `most` chunks."""

    def __init__(self, encode, most: int = 150_000):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(" " + chunk)).tobytes()
        if len(self) < self.most and len(chunk) < 64:
            self[chunk] = ids
        return ids


class Tokenizer:
    """Byte-level BPE of a tokenizers JSON file; a word's ids are computed once per worker and then looked up.

    Splitting at a space never cuts a pre-token where white space stands on one side of it at most: it then begins a pre-token.
    A space between white space, or behind it at the end, may lie inside of one; such texts, those with two adjacent
    spaces and those with an added token in them go to the encoder whole.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in self.added}
        self.plain = tiktoken.Encoding("file", pat_str=SPLIT_RULE, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.path, self.fast = path, None
        self.chunks = ChunkIds(self.plain)

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            if self.fast is None:
                from tokenizers import Tokenizer as Fast

                self.fast = Fast.from_file(self.path)
            return array("I", self.fast.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text or INNER_SPACE.search(text):
            return array("I", self.plain(text)).tobytes()
        first, *rest = text.split(" ")
        head = array("I", self.plain(first)).tobytes() if first else b""
        return head + b"".join(map(self.chunks.__getitem__, rest))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's pieces."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32")] + [("piece", pa.int32())])
    tail = array("I", [separator]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            doc, start, length, crc, piece = [], array("q"), array("q"), array("q"), array("i")
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tok.ids(text.as_py() or "") + tail
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = n % capacity or capacity if at == 0 else capacity
                    doc.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    piece.append(k)
                    at, k = at + size, k + 1
            yield batch_of(schema, [pa.array(doc, pa.int64()), *(np.frombuffer(a, np.int64) if len(a) else np.zeros(0, np.int64) for a in (start, length, crc)), np.array(piece, np.int32)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, start long, length long, ids_crc32 long, piece int")


class Packing:
    """Bins as lists of items with the room left in each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity, self.bins, self.room = lengths, capacity, [], []

    def best_fit(self, items: list[int]) -> None:
        """Put each item into the bin with the least room that holds it, or into a new bin."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, r in enumerate(self.room):
            if r:
                by_room[r].append(b)
                mask |= 1 << r
        for i in items:
            n = self.lengths[i]
            fits = mask >> n
            if fits:
                r = n + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    mask ^= 1 << r
                self.bins[b].append(i)
            else:
                r, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.room.append(r)
            r -= n
            self.room[b] = r
            if r:
                by_room[r].append(b)
                mask |= 1 << r

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then the fuller ones full."""
        return -len(self.bins), sum(((self.capacity - r) / self.capacity) ** 2 for r in self.room)

    def labels(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out

    @classmethod
    def of(cls, lengths: list[int], capacity: int, labels: np.ndarray) -> Packing:
        out = cls(lengths, capacity)
        n = int(labels.max()) + 1 if len(labels) else 0
        out.bins, out.room = [[] for _ in range(n)], [capacity] * n
        for i, b in enumerate(labels.tolist()):
            out.bins[b].append(i)
            out.room[b] -= lengths[i]
        return out


def crossover(a: Packing, b: Packing, rng: np.random.Generator) -> Packing:
    """A child of `a` with well-filled bins of `b`; documents that lose their bin are placed by best fit."""
    room = np.array(b.room)
    full = np.flatnonzero(room <= np.quantile(room, 0.6))
    chosen = full[rng.random(len(full)) < rng.uniform(0.1, 0.5)]
    taken = bytearray(len(a.lengths))
    child = Packing(a.lengths, a.capacity)
    for k in chosen.tolist():
        child.bins.append(list(b.bins[k]))
        child.room.append(b.room[k])
        for i in b.bins[k]:
            taken[i] = 1
    loose = int(np.argmax(a.room))  # the emptiest bin goes as well, as a mutation
    displaced = []
    for k, items in enumerate(a.bins):
        if k == loose or any(taken[i] for i in items):
            displaced += [i for i in items if not taken[i]]
        else:
            child.bins.append(list(items))
            child.room.append(a.room[k])
    child.best_fit(sorted(displaced, key=lambda i: (-a.lengths[i], i)))
    return child


def evolve(lengths: np.ndarray, capacity: int, seeds: list[np.ndarray], rng: np.random.Generator, population: int, generations: int) -> list[Packing]:
    """One epoch of an island, best packing first.

    The first packings are best-fit ones, of the pieces by decreasing length and of ever noisier orders. All generations run, since a packing that
    needs as few sequences as any can still be bettered: room that lies together in few sequences serves the packing across blocks.
    """
    sizes = lengths.tolist()
    people = [Packing.of(sizes, capacity, s) for s in seeds]
    while len(people) < population:
        noise = 1.0 if not people else rng.uniform(0.7, 1.0, len(sizes))
        fresh = Packing(sizes, capacity)
        fresh.best_fit(np.lexsort((np.arange(len(sizes)), -lengths * noise)).tolist())
        people.append(fresh)
    people.sort(key=Packing.fitness, reverse=True)
    for _ in range(generations * (len(sizes) > 1)):
        for _ in range(population // 2):
            i, j = rng.choice(len(people), 2, replace=False)
            child = crossover(people[i], people[j], rng)
            if child.fitness() > people[-1].fitness():
                people[-1] = child
                people.sort(key=Packing.fitness, reverse=True)
    return people


def pack_blocks(items: DataFrame, capacity: int, block_items: int, islands: int, epochs: int, population: int, generations: int, salt: int) -> DataFrame:
    """(row, block, bin, room) for items (row, length), each block packed by its islands."""
    spark = items.sparkSession
    n = items.count()
    blocks = max(1, math.ceil(n / block_items))
    state = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("kind", pa.int32()), ("rows", pa.binary()), ("lengths", pa.binary()), ("labels", pa.binary())])
    ddl = "block long, island int, kind int, rows binary, lengths binary, labels binary"

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, lengths = table.column("row").to_numpy(), table.column("length").to_numpy().astype(np.int32)
        block = table.column("block")[0].as_py()
        return pa.table([[block] * islands, list(range(islands)), [0] * islands, [rows.tobytes()] * islands, [lengths.tobytes()] * islands, [b""] * islands], schema=state)

    def epoch(number: int):
        def run(table: pa.Table) -> pa.Table:
            records = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["labels"]))
            block, island = records[0]["block"], records[0]["island"]
            base = next(r for r in records if r["rows"])
            lengths = np.frombuffer(base["lengths"], np.int32)
            seeds = [np.frombuffer(r["labels"], np.int32) for r in records if r["labels"]]
            rng = np.random.default_rng([salt, number, block, island])
            people = evolve(lengths, capacity, seeds, rng, population, generations)
            last = number == epochs - 1
            out = [(block, island, 0, base["rows"], base["lengths"], people[0].labels().tobytes())]
            if not last:
                out += [(block, island, 1, b"", b"", p.labels().tobytes()) for p in people[1:]]
                out.append((block, (island + 1) % islands, 2, b"", b"", people[0].labels().tobytes()))
            return pa.table([list(c) for c in zip(*out, strict=True)], schema=state)

        return run

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("block", pa.int64()), ("bin", pa.int64()), ("room", pa.int64()), ("offset", pa.int64())])
        for batch in batches:
            for r in batch.to_pylist():
                rows, lengths, label = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["lengths"], np.int32).astype(np.int64), np.frombuffer(r["labels"], np.int32)
                used = np.bincount(label, lengths).astype(np.int64)
                order = np.argsort(label, kind="stable")
                ends = np.cumsum(lengths[order])
                before = np.cumsum(used) - used
                offset = np.empty(len(rows), np.int64)
                offset[order] = ends - lengths[order] - before[label[order]]
                yield batch_of(schema, [rows, np.full(len(rows), r["block"]), label.astype(np.int64), capacity - used[label], offset])

    width = min(max(1, blocks * islands), 4 * parts(spark))
    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).alias("block"))
    frame = dealt.groupBy("block").applyInArrow(trimmed_groups(gather), ddl)
    for e in range(epochs):
        frame = frame.repartition(width, "block", "island").groupBy("block", "island").applyInArrow(epoch(e), ddl)

    def choose(table: pa.Table) -> pa.Table:
        records = sorted(table.to_pylist(), key=lambda r: (int(np.frombuffer(r["labels"], np.int32).max()), r["island"]))
        return pa.Table.from_pylist(records[:1], schema=state)

    return frame.groupBy("block").applyInArrow(choose, ddl).mapInArrow(trimmed(unpack), "row long, block long, bin long, room long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, block_items: int = 4096, islands: int = 3, epochs: int = 2, population: int = 4, generations: int = 6, loose: float = 0.02) -> DataFrame:
    """Pieces with the sequence and the offset that each is put at: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    lean(docs.sparkSession)
    table = cut(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    whole = table.where(F.col("length") == capacity).select("row", (F.lit(1 << 60) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.where(F.col("length") < capacity).select("row", "length")
    settings = (capacity, block_items, islands, epochs, population, generations)
    first = cut(pack_blocks(rest, *settings, salt=1))
    is_loose = F.col("room") > capacity * loose
    again = pack_blocks(rest.join(first.where(is_loose).select("row"), "row"), *settings, salt=2)
    number = lambda level: (F.lit(level << 56) + F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id")
    placed = whole.unionByName(first.where(~is_loose).select("row", number(1), "offset")).unionByName(again.select("row", number(2), "offset"))
    return table.join(placed, "row").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
