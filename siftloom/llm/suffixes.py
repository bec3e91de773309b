"""Removal of repeated byte passages by a distributed sort of suffixes.

Texts are bytes. Every window of `length` bytes has an anchor: of the `gram`-byte strings inside it the one with the least hash, the
last of equals. Equal windows have their anchors at the same place, so a window can only repeat where its anchor's gram
does: grams are counted over the whole corpus, one text standing for each group of equal texts, and only
windows around grams that are found twice go on, as suffixes with the bytes they need.

Splitters from a sample (200,000 at most) of the leading grams cut these suffixes into ranges of bounded size; where that needs more ranges than the
sample can tell apart, each stretch between splitters is cut further by a hash of the gram. A gram that several splitters fall on is dealt over all its ranges. Each range sorts its suffixes by multikey quicksort, a key being the next 64 bytes, and windows
that are equal over the whole length are repeated. Suffixes of dealt grams that found no equal in their own range are compared
across the boundaries, one representative of each range's distinct windows taking part.

Defined results: null texts are empty; texts shorter than a window lose nothing; a text that occurs twice loses everything if it has a window; rows that
repeat count as documents of their own; null ids are kept and matched as such; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm import bytescan as bs
from siftloom.llm.common import batch_of, cut, free_shuffles, from_planes, in_bitmap, key_bitmap, lean, parts, planes, scratch, text_slices, trimmed, trimmed_groups

LENGTH, GRAM, BLOCK = 400, 128, 64
U = np.uint64
GROUP_STEP = U(0xD1342543DE82EF95)
GRAM_STEP = 0x9E3779B97F4A7C15
PLACE_BITS = 18
#: Bytes of text that one numpy pass takes at a time.
SLICE = 1 << 16
#: Passages of over fifty words are found by the least 13-word gram of each window.
WORDS, WORD_GRAM = 51, 13


def window_anchors(sequence: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's gram, anchor, first window start, last window start) for each run of windows with one anchor.

    The sequence is one of bytes, or of 64-bit words.
    """
    out: list[tuple[np.ndarray, ...]] = []
    owners = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    step = 1 << (PLACE_BITS - 1)
    low = U((1 << PLACE_BITS) - 1)
    width = length - gram + 1
    for begin in range(0, max(1, len(sequence) - length + 1), step):
        part = sequence[begin : begin + step + length - 1]
        if len(part) < length:
            break
        hasher = bs.Hasher(part)
        starts = np.arange(len(part) - gram + 1)
        grams = hasher.of(starts, starts + gram)
        del hasher
        padded = np.full(-(-len(grams) // width) * width, U(0xFFFFFFFFFFFFFFFF))
        np.bitwise_and(grams, ~low, out=padded[: len(grams)])
        padded[: len(grams)] |= low - starts.astype(U)
        blocks = padded.reshape(-1, width)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        n = len(part) - length + 1
        least = np.minimum(behind[:n], ahead[width - 1 : n + width - 1])
        del blocks, padded, behind, ahead
        text = owners[begin : begin + n]
        inside = np.arange(begin + length, begin + length + n) <= offsets[text + 1]
        windows = np.flatnonzero(inside)
        if not len(windows):
            continue
        least, text = least[windows], text[windows]
        anchor = (low - (least & low)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(windows)] - 1
        out.append((grams[anchor[first]], anchor[first] + begin, windows[first] + begin, windows[last] + begin))
    if not out:
        return np.zeros(0, U), *(np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_sequence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit words, offsets of the texts' words, first byte and end of each word)."""
    start, end = bs.words(buf, offsets)
    return bs.Hasher(buf).of(start, end), np.searchsorted(start, offsets), start, end


def base_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, text): a text is known by two hashes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(29), text).alias("f2"), text.alias("text"))


def anchor_table(base: DataFrame, path: str, length: int, gram: int, words: int) -> DataFrame:
    """Written as Parquet: (doc_id, f1, f2, n, runs, word_runs) of every row, the last two array<struct<gram, lo, hi, a, b>>.

    lo and hi are the first and the last window's start, in bytes or words; a and b bound the bytes of all the run's windows.
    """
    item = pa.struct([("gram", pa.int64()), *((c, pa.int32()) for c in ("lo", "hi", "a", "b"))])
    schema = pa.schema([*((c, pa.int64()) for c in ("doc_id", "f1", "f2", "n")), ("runs", pa.list_(item)), ("word_runs", pa.list_(item))])

    def listed(sequence: np.ndarray, offsets: np.ndarray, length: int, gram: int, begin=None, end=None, text_offsets=None) -> pa.Array:
        grams, _, first, last = window_anchors(sequence, offsets, length, gram)
        text = bs.owner(offsets, first)
        bounds = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
        lo, hi = first - offsets[text], last - offsets[text]
        a, b = (lo, hi + length) if begin is None else (begin[first] - text_offsets[text], end[last + length - 1] - text_offsets[text])
        values = pa.StructArray.from_arrays([pa.array(grams.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (lo, hi, a, b))], fields=list(item))
        return pa.ListArray.from_arrays(pa.array(bounds), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_slices(batch, "text", SLICE):
                sequence, word_offsets, begin, end = word_sequence(buf, offsets)
                lists = listed(buf, offsets, length, gram), listed(sequence, word_offsets, words, WORD_GRAM, begin, end, offsets)
                yield batch_of(schema, [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), np.diff(offsets), *lists])

    runs = "array<struct<gram:long,lo:int,hi:int,a:int,b:int>>"
    base.mapInArrow(trimmed(run), f"doc_id long, f1 long, f2 long, n long, runs {runs}, word_runs {runs}").write.parquet(path)
    return base.sparkSession.read.parquet(path)


def pick_rows(base: DataFrame, bitmap, key: str = "f1") -> DataFrame:
    """Rows of `base` whose key may be in the broadcast bitmap."""
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(batch.schema.names.index(key)).to_numpy())))
            if hit.num_rows:
                yield batch_of(schema, [hit.column(i).cast(schema.field(i).type) for i in range(4)])

    return base.mapInArrow(trimmed(run), "doc_id long, f1 long, f2 long, text string")


CONTEXT_DDL = "bucket int, dealt boolean, f1 long, f2 long, gram long, lo int, hi int, bytes binary"


def contexts(rows: DataFrame, splitters: np.ndarray, length: int, finer: int = 1) -> DataFrame:
    """The suffixes of each flagged run with the bytes they need, and the range they belong to. rows: (f1, f2, text, runs).

    Each stretch between splitters is `finer` ranges: a gram has one of them, by its hash, or all if it is dealt.
    """
    types = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    schema = pa.schema(list(zip("bucket dealt f1 f2 gram lo hi bytes".split(), types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for f1, f2, text, runs in zip(*(batch.column(i) for i in range(4)), strict=True):
                data, a, b = text.as_buffer().to_pybytes(), f1.as_py(), f2.as_py()
                for r in runs.as_py():
                    g = r["gram"]
                    low, high = int(np.searchsorted(splitters, g, "left")), int(np.searchsorted(splitters, g, "right"))
                    if high == low:
                        bucket = low * finer + (g * GRAM_STEP >> 20) % finer
                    else:
                        bucket = low * finer + (a ^ b * 31 + r["lo"]) % ((high - low + 1) * finer)
                    out.append((bucket, high > low, a, b, g, r["lo"], r["hi"], data[r["lo"] : r["hi"] + length]))
                    held += r["hi"] + length - r["lo"]
                if held > 1 << 22:
                    yield batch_of(schema, [list(c) for c in zip(*out, strict=True)])
                    out, held = [], 0
            if out:
                yield batch_of(schema, [list(c) for c in zip(*out, strict=True)])

    return rows.mapInArrow(trimmed(run), CONTEXT_DDL)


def multikey_equal(hasher: bs.Hasher, starts: np.ndarray, length: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes of equal length by multikey quicksort; (sorted indexes into `starts` of those with an equal, their group).

    The keys are the next `block` bytes; after each key, suffixes that are alone among their equals so far leave the sort.
    """
    order = np.arange(len(starts))
    group = np.zeros(len(starts), U)
    for at in range(0, length, block):
        # equal (group, key) couples get one number; sorting by it keeps groups together
        key = hasher.raw(starts[order] + at, starts[order] + min(at + block, length)) + group * GROUP_STEP
        by = np.argsort(key)
        order, key = order[by], key[by]
        new = np.ones(len(order), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        alone = np.bincount(group, minlength=len(order))[group] == 1 if len(order) else np.zeros(0, bool)
        order, group = order[~alone], group[~alone].astype(U)
    by = np.lexsort((order, group))
    return order[by], group[by]


SPAN_DDL = "f1 long, f2 long, starts binary, ends binary, hashes binary, first binary, bucket int"
SPAN_SCHEMA = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary()), ("hashes", pa.binary()), ("first", pa.binary()), ("bucket", pa.int32())])


def runs_of(positions: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of maximal runs of consecutive positions; sorted by owner and position."""
    by = np.lexsort((positions, owner))
    positions, owner = positions[by], owner[by]
    new = np.ones(len(positions), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (positions[1:] != positions[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(positions)] - 1 if len(first) else first
    return owner[first], positions[first], positions[last]


def sort_ranges(frame: DataFrame, length: int, boundary_buckets: int) -> DataFrame:
    """Each range's repeated spans (bucket -1), and what the comparison across boundaries needs (bucket from 0)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data = table.column("bytes").chunk(0) if table.column("bytes").num_chunks == 1 else pa.concat_arrays(table.column("bytes").chunks)
        data = data.cast(pa.large_binary())
        bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        buf = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        f1, f2, lo, dealt = (table.column(c).to_numpy() for c in ("f1", "f2", "lo", "dealt"))
        hasher = bs.Hasher(buf)
        count = np.diff(bounds) - length + 1
        record = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        starts = bounds[record] + offset
        order, group = multikey_equal(hasher, starts, length)
        rec, first, last = runs_of(lo[record[order]] + offset[order], record[order])
        out = []
        if len(rec):
            cut_at = np.flatnonzero(np.r_[True, rec[1:] != rec[:-1]])
            ends = np.r_[cut_at[1:], len(rec)]
            a, b = first.astype(np.int32), (last + length).astype(np.int32)
            pieces = [(a[i:j].tobytes(), b[i:j].tobytes()) for i, j in zip(cut_at, ends, strict=True)]
            n = len(cut_at)
            out.append(batch_of(SPAN_SCHEMA, [f1[rec[cut_at]], f2[rec[cut_at]], [p[0] for p in pieces], [p[1] for p in pieces], pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), np.full(n, -1, np.int32)]))
        if dealt.any():
            # one of each group of equals, and all that are alone
            alone = np.ones(len(starts), bool)
            alone[order] = False
            leader = order[np.r_[True, group[1:] != group[:-1]]] if len(order) else order
            send = np.concatenate([np.flatnonzero(alone), leader])
            send = send[dealt[record[send]]]
            h = hasher.of(starts[send], starts[send] + length)
            bucket = (h % U(boundary_buckets)).astype(np.int32)
            single = alone[send]
            for k in np.unique(bucket):
                at = np.flatnonzero(bucket == k)
                who = np.stack([f1[record[send[at]]], f2[record[send[at]]], lo[record[send[at]]] + offset[send[at]], single[at].astype(np.int64)])
                out.append(batch_of(SPAN_SCHEMA, [[None], [None], [who.tobytes()], [None], [h[at].tobytes()], [None], [k]]))
        return pa.Table.from_batches(out, schema=SPAN_SCHEMA)

    return frame.groupBy("bucket").applyInArrow(trimmed_groups(run), SPAN_DDL)


def across_boundaries(sent: DataFrame, length: int) -> DataFrame:
    """Spans of windows that have an equal in another range only."""

    def run(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in table.column("hashes")])
        who = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in table.column("starts")], axis=1)
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        group = np.cumsum(new) - 1
        hit = order[(np.bincount(group)[group] > 1) & (who[3][order] == 1)]
        if not len(hit):
            return pa.Table.from_batches([], schema=SPAN_SCHEMA)
        texts, index = np.unique(who[:2, hit], axis=1, return_inverse=True)
        rec, first, last = runs_of(who[2, hit], index.ravel())
        n = len(rec)
        return pa.Table.from_batches([batch_of(SPAN_SCHEMA, [texts[0][rec], texts[1][rec], [x.tobytes() for x in first.astype(np.int32)], [x.tobytes() for x in (last + length).astype(np.int32)], pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), np.full(n, -1, np.int32)])])

    return sent.groupBy("bucket").applyInArrow(trimmed_groups(run), SPAN_DDL)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: A gram with more than one in so many of all runs is hot; so there are fewer hot grams than this.
HOT_SHARE = 2000


def twice_found(table: DataFrame, column: str) -> DataFrame:
    """The distinct runs (f1, f2, gram, lo, hi, a, b) whose gram is found at two places, copies of a text being one.

    Runs of the few hot grams are recognised where they are read; only the others are dealt by gram, so that no passage that very many texts share
    meets in one task.
    """
    runs = table.select("f1", "f2", F.explode(column).alias("r")).select("f1", "f2", *(f"r.{c}" for c in ("gram", "lo", "hi", "a", "b")))
    place = F.xxhash64("f1", "f2", "lo", "hi")
    counted = runs.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("c")).where("a <> b").select("gram", "c")
    twice = cut(counted)
    total = table.agg(F.sum(F.greatest(F.size(column), F.lit(0)).cast("long"))).first()[0] or 0
    hot = twice.where(F.col("c") * HOT_SHARE > total).select("gram")
    rest = runs.join(F.broadcast(hot), "gram", "left_anti").join(twice.where(F.col("c") * HOT_SHARE <= total).select("gram"), "gram")
    return cut(runs.join(F.broadcast(hot), "gram").unionByName(rest).distinct())


def open_runs(flagged: DataFrame, spans: DataFrame) -> DataFrame:
    """The runs of the grams that some run has which no removed span holds whole. spans: (f1, f2, starts, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for grams, first, last, starts, ends in zip(*(batch.column(i) for i in range(5)), strict=True):
                grams, first, last = (np.array(x.as_py(), np.int64) for x in (grams, first, last))
                held = np.zeros(len(grams), bool)
                if starts.is_valid:
                    spans = np.array(merge_spans(*span_list(starts, ends).T), np.int64).reshape(-1, 2)
                    k = np.maximum(np.searchsorted(spans[:, 0], first, "right") - 1, 0)
                    held = (spans[k, 0] <= first) & (last <= spans[k, 1])
                out.append(grams[~held])
            yield pa.record_batch([pa.array(np.unique(np.concatenate(out)))], names=["gram"])

    lists = flagged.groupBy("f1", "f2").agg(*(F.collect_list(c).alias(c) for c in ("gram", "a", "b"))).join(spans, ["f1", "f2"], "left")
    still = cut(lists.select("gram", "a", "b", "starts", "ends").mapInArrow(trimmed(run), "gram long").distinct())
    return cut(flagged.join(still, "gram", "left_semi"))


WINDOWS = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("hashes", "texts", "which", "starts", "ends"))])
WINDOWS_DDL = "bucket long, hashes binary, texts binary, which binary, starts binary, ends binary"


def window_rows(bucket: np.ndarray, hashes: np.ndarray, texts: np.ndarray, which: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Windows packed by bucket; texts has the two hashes of each text, which says the text of each window."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    rows = []
    for i, j in zip(bounds, np.r_[bounds[1:], len(order)] if len(order) else bounds, strict=True):
        p = order[i:j]
        own, number = np.unique(which[p], return_inverse=True)
        rows.append((int(bucket[p[0]]), hashes[p].tobytes(), texts[own].tobytes(), *(planes(x.astype(np.int32)) for x in (number.ravel(), starts[p], ends[p]))))
    return batch_of(WINDOWS, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in WINDOWS])


def windows_of(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(hashes, f1, f2, starts, ends) of packed windows."""
    out = []
    for h, texts, *small in zip(*(table.column(c) for c in WINDOWS.names[1:]), strict=True):
        which, starts, ends = (from_planes(x.as_buffer(), np.int32) for x in small)
        texts = np.frombuffer(texts.as_buffer(), np.int64).reshape(-1, 2)[which]
        out.append((np.frombuffer(h.as_buffer(), U), texts[:, 0], texts[:, 1], starts, ends))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shared_windows(texts: DataFrame, words: int, buckets: int) -> DataFrame:
    """The windows of flagged runs, packed by a bucket of their hash. texts: (f1, f2, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            for i, (text, runs) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                buf = np.frombuffer(text.as_buffer(), np.uint8)
                sequence, _, first, end = word_sequence(buf, np.array([0, len(buf)]))
                at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs.as_py()]))
                held.append((bs.Hasher(sequence).of(at, at + words), np.full(len(at), i), first[at], end[at + words - 1]))
            if held:
                hashes, which, starts, ends = (np.concatenate(x) for x in zip(*held, strict=True))
                both = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
                yield window_rows((hashes % U(buckets)).astype(np.int64), hashes, both, which, starts, ends)

    return texts.mapInArrow(trimmed(run), WINDOWS_DDL)


def passages(windows: DataFrame, buckets: int) -> DataFrame:
    """(f1, f2, starts, ends) of the windows that more than one text has; they travel packed by a bucket of their text."""
    schema = pa.schema([("f1", pa.int64()), ("f2", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])

    def several(table: pa.Table) -> pa.Table:
        h, f1, f2, a, b = windows_of(table)
        order = np.lexsort((f2, f1, h))
        h, f1, f2, a, b = (x[order] for x in (h, f1, f2, a, b))
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(h)] - 1 if len(h) else starts
        hit = np.repeat((f1[starts] != f1[ends]) | (f2[starts] != f2[ends]), ends - starts + 1)
        both, which = np.unique(np.stack([f1[hit], f2[hit]], axis=1), axis=0, return_inverse=True)
        which = which.ravel()
        bucket = (bs.mix(both[:, 0].view(U) if both.shape[0] else np.zeros(0, U)) % U(buckets)).astype(np.int64)[which]
        return pa.Table.from_batches([window_rows(bucket, np.zeros(len(which), U), both, which, a[hit], b[hit])])

    def by_text(table: pa.Table) -> pa.Table:
        _, f1, f2, a, b = windows_of(table)
        if not len(f1):
            return schema.empty_table()
        by = np.lexsort((a, f2, f1))
        f1, f2, a, b = (x[by] for x in (f1, f2, a, b))
        bounds = np.flatnonzero(np.r_[True, (f1[1:] != f1[:-1]) | (f2[1:] != f2[:-1])])
        pieces = list(zip(bounds, np.r_[bounds[1:], len(f1)], strict=True))
        return pa.table([f1[bounds], f2[bounds], pa.array([a[i:j].tobytes() for i, j in pieces], pa.binary()), pa.array([b[i:j].tobytes() for i, j in pieces], pa.binary())], schema=schema)

    found = windows.groupBy("bucket").applyInArrow(trimmed_groups(several), WINDOWS_DDL)
    return found.groupBy("bucket").applyInArrow(trimmed_groups(by_text), "f1 long, f2 long, starts binary, ends binary")


def whole(c) -> F.Column:
    """A number as 32 bits, little-endian."""
    return F.unhex(F.concat(*(F.substring(F.lpad(F.hex(c), 8, "0"), i, 2) for i in (7, 5, 3, 1))))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, range_bytes: int = 1 << 20, words: int = WORDS, sampled: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(base, decisions): decisions has (doc_id, f1, f2, starts, ends, passage_starts, passage_ends) of the rows with repeats.

    starts and ends bound the bytes covered by strings of `length` bytes that occur elsewhere; the others bound passages of `words` words or more that
    another text has too, but for some that lie in the first kind's spans everywhere. Spans are packed as 32-bit integers, not merged.
    """
    spark = docs.sparkSession
    lean(spark)
    base = base_rows(docs)
    table = anchor_table(base, scratch(spark, "anchors"), length, gram, words)
    # one row for each group of equal texts: that of the smallest id
    classes = cut(table.groupBy("f1", "f2", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max(F.size("word_runs") > 0).alias("long_words")))
    copied = classes.where((F.col("copies") > 1) & ((F.col("n") >= length) | F.col("long_words")))

    def flagged_texts(flagged: DataFrame) -> DataFrame:
        """(f1, f2, text, runs) of the texts with flagged runs; only these texts are shuffled."""
        wanted = cut(flagged.groupBy("f1", "f2").agg(F.collect_list(F.struct("gram", "lo", "hi")).alias("runs")).join(classes.select("f1", "f2", "rep"), ["f1", "f2"]))
        own = lambda i: F.xxhash64("f1", F.coalesce(i, F.lit(-1).cast("long")))
        bitmap = spark.sparkContext.broadcast(key_bitmap(wanted.select(own(F.col("rep")))))
        texts = pick_rows(base.withColumn("own", own(F.col("doc_id"))), bitmap, "own")
        same = [texts["f1"] == wanted["f1"], texts["f2"] == wanted["f2"], texts["doc_id"].eqNullSafe(wanted["rep"])]
        return texts.join(wanted, same).select(texts["f1"], texts["f2"], F.col("text").cast("binary").alias("text"), "runs")

    flagged = twice_found(table, "runs")
    free_shuffles(spark)
    total = flagged.agg(F.sum(F.col("hi") - F.col("lo") + length), F.count("*")).first()
    size, n = int(total[0] or 0), int(total[1])
    ranges = max(parts(spark), -(-size // range_bytes)) if n else 1
    # splitters from about 64 suffixes per range, `sampled` at most, chosen by hash
    one_in = max(1, n // min(64 * ranges, sampled))
    sample = flagged.where(F.pmod(F.xxhash64("f1", "lo", F.lit(3)), F.lit(one_in)) == 0).select("gram").toPandas()["gram"].to_numpy(np.int64)
    sample = np.sort(sample)
    # eight of the sample at least between two splitters; ranges beyond those are cut by hash
    stretches = min(ranges, max(1, len(sample) // 8))
    splitters = sample[np.linspace(0, len(sample) - 1, stretches + 1)[1:-1].astype(np.int64)] if stretches > 1 else np.zeros(0, np.int64)
    found = cut(sort_ranges(contexts(flagged_texts(flagged), splitters, length, -(-ranges // stretches)), length, max(8, ranges)))
    free_shuffles(spark)
    spans = found.where("bucket = -1").unionByName(across_boundaries(found.where("bucket >= 0"), length)).select("f1", "f2", "starts", "ends")
    all_of = lambda rows: rows.select("f1", "f2", whole(F.lit(0)).alias("starts"), whole(F.col("n")).alias("ends"))
    spans = cut(spans.join(copied.where(F.col("n") >= length).select("f1", "f2"), ["f1", "f2"], "left_anti").unionByName(all_of(copied.where(F.col("n") >= length))))
    joined = cut(spans.groupBy("f1", "f2").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")))
    free_shuffles(spark)
    # passages of words; where every run of a gram lies in removed spans, nothing is left to find
    buckets = max(parts(spark), -(-size // (16 * range_bytes)))
    windows = shared_windows(flagged_texts(open_runs(twice_found(table, "word_runs"), joined)), words, buckets)
    free_shuffles(spark)
    short = copied.where(F.col("n") < length)
    shared = cut(passages(windows, buckets).join(short.select("f1", "f2"), ["f1", "f2"], "left_anti").unionByName(all_of(short)))
    free_shuffles(spark)
    shared = shared.groupBy("f1", "f2").agg(F.collect_list("starts").alias("passage_starts"), F.collect_list("ends").alias("passage_ends"))
    both = joined.join(shared, ["f1", "f2"], "full")
    return base, cut(table.select("doc_id", "f1", "f2").distinct().join(both, ["f1", "f2"]))


def span_list(starts: pa.Scalar, ends: pa.Scalar) -> np.ndarray:
    """Packed spans as rows of (start, end)."""
    return np.stack([np.frombuffer(b"".join(x.as_py()), np.int32) if x.is_valid else np.zeros(0, np.int32) for x in (starts, ends)], axis=1)


def changed_rows(base: DataFrame, decisions: DataFrame, ddl: str, schema: pa.Schema, make, columns: tuple[str, ...] = ("doc_id", "f1", "f2")) -> DataFrame:
    """make(kept columns, bytes, removed spans, spans of either kind) as rows, for the rows of `base` that `decisions` names; no other text is shuffled."""
    bitmap = base.sparkSession.sparkContext.broadcast(key_bitmap(decisions.select("f1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, *ends = (batch.column(names.index(c)) for c in ("text", "starts", "ends", "passage_starts", "passage_ends"))
            rows = []
            for i in range(batch.num_rows):
                removed, shared = span_list(ends[0][i], ends[1][i]), span_list(ends[2][i], ends[3][i])
                either = np.concatenate([removed, shared])
                rows.append(make([batch.column(k)[i].as_py() for k in range(len(columns))], text[i].as_buffer().to_pybytes(), merge_spans(*removed.T), merge_spans(*either.T)))
            if rows:
                yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])

    hit = pick_rows(base, bitmap)
    same = [hit["f1"] == decisions["f1"], hit["f2"] == decisions["f2"], hit["doc_id"].eqNullSafe(decisions["doc_id"])]
    hit = hit.join(decisions, same).select(*(hit[c] for c in (*columns, "text")), "starts", "ends", "passage_starts", "passage_ends")
    return hit.mapInArrow(trimmed(run), ddl)


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, range_bytes: int = 1 << 20, words: int = WORDS, sampled: int = 200_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated) of every row.

    n_repeated counts the bytes of repeats of either kind: those removed, and those of passages of `words` words or more that another text has too.
    """
    names = ["doc_id", "f1", "f2", "n_removed", "n_spans", "kept", "n_repeated"]
    schema = pa.schema([(c, pa.string() if c == "kept" else pa.int64()) for c in names])
    total = lambda spans: sum(b - a for a, b in spans)

    def make(own, data, removed, either):
        return *own, total(removed), len(removed), hashlib.sha256(kept_bytes(data, removed)).hexdigest(), total(either)

    base, decisions = repeated_spans(docs, length, gram, range_bytes, words, sampled)
    changed = cut(changed_rows(base, decisions, "doc_id long, f1 long, f2 long, n_removed long, n_spans long, kept string, n_repeated long", schema, make).distinct())
    data = F.col("text").cast("binary")
    rows = base.select("doc_id", "f1", "f2", F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    same = [rows["f1"] == changed["f1"], rows["f2"] == changed["f2"], rows["doc_id"].eqNullSafe(changed["doc_id"])]
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(changed, same, "left").select(rows["doc_id"], "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"), none("n_repeated"))


def cleaned(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, n_chars) without repeats of either kind.

    Bytes of characters that a passage's edge cuts go as well; n_chars is counted anew where a text changed; a text may lose all its bytes, its row stays.
    """
    base, decisions = repeated_spans(docs, length, words=words)
    schema = pa.schema([("doc_id", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("new", pa.string())])

    def make(own, data, removed, either):
        return *own, kept_bytes(data, either).decode("utf-8", "ignore")

    changed = cut(changed_rows(base, decisions, "doc_id long, f1 long, f2 long, new string", schema, make).distinct())
    free_shuffles(docs.sparkSession)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars", F.xxhash64(text).alias("f1"), F.xxhash64(F.lit(29), text).alias("f2"))
    touched = may_hold(docs.sparkSession.sparkContext.broadcast(key_bitmap(changed.select("f1"))))
    plain = rows.mapInArrow(touched(False), rows.schema).select(*columns)
    hit = rows.mapInArrow(touched(True), rows.schema)
    same = [hit["f1"] == changed["f1"], hit["f2"] == changed["f2"], hit["doc_id"].eqNullSafe(changed["doc_id"])]
    length_of = F.when(F.col("new").isNull(), F.col("n_chars")).otherwise(F.char_length("new")).alias("n_chars")
    hit = hit.join(changed, same, "left").select(hit["doc_id"], F.coalesce("new", "text").alias("text"), "lang", "source", length_of.cast("long").alias("n_chars"))
    return plain.unionByName(hit)


def may_hold(bitmap):
    """Filters of rows (second column: first hash) by whether the bitmap may hold them."""

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(batch.schema.names.index("f1")).to_numpy()) == wanted))

        return trimmed(run)

    return side


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated passages of 400 bytes."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
