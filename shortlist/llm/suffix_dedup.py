"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes when it is covered by a string of ``LENGTH`` (50) bytes that also
starts in a document with a smaller id. Positions are ranked by longer and
longer prefixes, and leave as soon as their rank is that of one document only.
A rank here is a 64-bit hash of the prefix: equal ranks mean equal strings,
which is all that a threshold needs; Spark sorts the ranks and compares
neighbours. Hashes double: 1, 2, 4, 8, 16, 20 bytes give the first rank; 32,
48 and 50 (pairs of ranks at offsets 16, 32 and 48) the last.

Sorting all positions would shuffle some 20 times the text. Instead positions
that share their first-level rank travel as one row: position p is ranked by
the smallest 20-byte rank among the 31 that lie within its 50 bytes, which is
equal wherever the 50 bytes stand. Neighbouring positions mostly share it, so
there is a run of about 16 positions a row.

0. ``whole_copies``: a text that is all of a smaller document's text goes as
   a whole, by its hash, and takes no part in the rest.
1. ``first_ranks``: Spark sorts the 20-byte ranks; those of one document only
   leave. Inside a batch a rank is sent once, however many documents have it.
2. ``open_runs``: documents meet their surviving ranks. Inside a part of the
   batch equal 50-byte strings are resolved on the spot: all but those of the
   smallest id go. Only runs with a string that is still open are sent, so a
   passage that a third of all documents share is sent once a part.
3. ``resolve``: Spark sorts the runs by rank; the 50-byte ranks of equal first
   rank are sorted, and all but those of the smallest id go.
4. ``remove_repeats``: the ranges meet the texts again.

Matches never cross documents, and all strings are judged on the input.

Defined results: a null text is empty; texts under 50 bytes stay whole; a null
id comes after all others and is not smaller than another null; of repeated
ids neither is smaller, so rows of one id are not judged against each other;
an empty table gives an empty result. ``doc_id`` must be an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import col, join_groups
from shortlist.llm.vectors import BASE, BYTE_VALUE, U64, chunks, raw_texts
from shortlist.session import cut_lineage

LENGTH = 50
SHORT = 20
WIDTH = LENGTH - SHORT + 1
PIECE = 1 << 18
#: Bytes of text whose strings are resolved together in a task.
PART = 4 << 20
#: Ranges (16 bytes each) up to which they are broadcast to the texts.
BROADCAST_RANGES = 200_000
#: Ids of whole copies (8 bytes each) up to which they are broadcast.
BROADCAST_IDS = 2_000_000
ROWS = 20_000
SPREAD = U64(0xD6E8FEB86659FD93)
LAST_ID = (1 << 63) - 1


def _power(n: int) -> np.uint64:
    return U64(pow(int(BASE), n, 1 << 64))


def _doubled(h: np.ndarray, n: int, follow: np.ndarray, m: int) -> np.ndarray:
    """Ranks of n + m bytes from those of n bytes and of the m that follow."""
    size = len(h) - m
    return h[:size] + _power(n) * follow[n:n + size]


def prefix_ranks(raw: np.ndarray, full: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """For every position with LENGTH bytes after it: its first rank, and with
    ``full`` its rank by all LENGTH bytes."""
    if len(raw) < LENGTH:
        return np.zeros(0, U64), np.zeros(0, U64)
    h1 = BYTE_VALUE[raw]
    h2 = _doubled(h1, 1, h1, 1)
    h4 = _doubled(h2, 2, h2, 2)
    h8 = _doubled(h4, 4, h4, 4)
    h16 = _doubled(h8, 8, h8, 8)
    low = _doubled(h16, 16, h4, 4) * SPREAD
    n = 1
    while n * 2 <= WIDTH:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    low = np.minimum(low[:len(raw) - LENGTH + 1], low[WIDTH - n:])
    if not full:
        return low, None
    h32 = _doubled(h16, 16, h16, 16)
    h48 = _doubled(h32, 32, h16, 16)
    return low, _doubled(h48, 48, h2, 2)


def blocks(raw: np.ndarray, offsets: np.ndarray, full: bool) -> Iterator[tuple]:
    """Texts as (document, position, first rank, full rank) arrays of all
    their positions with LENGTH bytes, about PIECE bytes at a time. A long
    text comes in pieces that overlap by LENGTH - 1 bytes."""
    for a, b in chunks(offsets, PIECE):
        if b - a == 1:
            begin, end = int(offsets[a]), int(offsets[b])
            for at in range(begin, max(begin + 1, end - LENGTH + 1), PIECE):
                low, h = prefix_ranks(raw[at:min(end, at + PIECE + LENGTH - 1)], full)
                yield np.full(len(low), a), np.arange(at - begin, at - begin + len(low)), low, h
            continue
        begin, end = int(offsets[a]), int(offsets[b])
        low, h = prefix_ranks(raw[begin:end], full)
        own = offsets[a:b + 1] - begin
        doc = np.repeat(np.arange(a, b), np.diff(own))[:len(low)]
        pos = np.arange(len(low)) - own[doc - a]
        fits = np.arange(len(low)) + LENGTH <= own[doc - a + 1]
        yield doc[fits], pos[fits], low[fits], h[fits] if full else None


def run_starts(doc: np.ndarray, pos: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Indexes at which a run of neighbouring positions of equal first rank
    begins."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    return np.flatnonzero(np.r_[True, new])


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each group of equal keys."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else \
        np.zeros(0, np.int64)


def upper_half(low: np.ndarray) -> np.ndarray:
    return (low >> U64(32)).astype(np.uint32).view(np.int32)


def ranges(pos: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) indexes of stretches of neighbouring positions."""
    new = pos[1:] != pos[:-1] + 1
    for k in keys:
        new |= k[1:] != k[:-1]
    first = np.flatnonzero(np.r_[True, new])
    return first, np.r_[first[1:], len(pos)] - 1


def first_ranks(docs: DataFrame) -> DataFrame:
    """docs (id, ord, text) -> (id, lows: upper halves of the first ranks it
    shares with another document). Half a rank is enough to find it again
    among a document's own; a chance hit only sends a run in vain."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = raw_texts(batch.column(2))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            docs_, lows = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
            for doc, pos, low, _ in blocks(raw, offsets, False):
                at = run_starts(doc, pos, low)
                docs_.append(doc[at])
                lows.append(low[at])
            doc, low = np.concatenate(docs_), np.concatenate(lows)
            order = np.lexsort((doc, low))
            doc, low = doc[order], low[order]
            first = groups(low)
            size = np.diff(np.r_[first, len(low)])
            ends = first + size - 1
            several = doc[first] != doc[ends] if len(first) else np.zeros(0, bool)
            table = pa.RecordBatch.from_arrays(
                [pa.array(low[first].view(np.int64)), pa.array(ids[doc[first]]),
                 pa.nulls(len(first), pa.list_(pa.int32()))], ["low", "id", "lows"])
            for at in range(0, len(first), ROWS):
                yield table.slice(at, ROWS)
            # Ranks that several documents of the batch have are settled for
            # all of them here.
            known = np.repeat(several, size)
            doc, low = doc[known], low[known]
            order = np.lexsort((low, doc))
            doc, low = doc[order], low[order]
            at = groups(doc)
            lists = [np.unique(upper_half(low[a:b])) for a, b in zip(at, np.r_[at[1:], len(doc)])]
            own = ids[doc[at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(own), pa.array(lists, pa.list_(pa.int32()))], ["low", "id", "lows"])

    ranked = docs.mapInArrow(find, "low bigint, id bigint, lows array<int>")
    counted = ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("low")))
    shared = counted.filter("n > 1 or lows is not null").select(
        "id", F.coalesce("lows", F.array(F.shiftright("low", 32).cast("int"))).alias("lows"))
    return shared.groupBy("id").agg(F.flatten(F.collect_list("lows")).alias("lows"))


RUNS = "low bigint, id bigint, ord bigint, start bigint, stop bigint, bytes binary"
RUN_NAMES = ["low", "id", "ord", "start", "stop", "bytes"]


def _rows(low, ids, ord_, start, stop, data) -> Iterator[pa.RecordBatch]:
    table = pa.RecordBatch.from_arrays(
        [pa.array(low), pa.array(ids), pa.array(ord_), pa.array(start), pa.array(stop),
         pa.array(data, pa.binary()) if data is not None else pa.nulls(len(low), pa.binary())], RUN_NAMES)
    for at in range(0, len(low), ROWS):
        yield table.slice(at, ROWS)


def open_runs(docs: DataFrame) -> DataFrame:
    """docs (id, ord, text, lows) -> rows of two kinds: settled ranges
    [start, stop) of positions whose string goes (no bytes), and runs with an
    open string, with their bytes."""
    def part(ids, ords, raw, offsets, lows) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ords, kind="stable")  # the smallest id first
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        kept = []
        for doc, pos, low, h in blocks(raw, offsets, True):
            at = run_starts(doc, pos, low)
            if not len(at):
                continue
            shared = np.zeros(len(at), bool)
            run_doc = doc[at]
            for a, b in zip(g := groups(run_doc), np.r_[g[1:], len(run_doc)]):
                shared[a:b] = np.isin(upper_half(low[at[a:b]]), lows[run_doc[a]])
            stay = np.repeat(shared, np.diff(np.r_[at, len(doc)]))
            kept.append((doc[stay], pos[stay], low[stay], h[stay]))
        if not kept:
            return
        doc, pos, low, h = (np.concatenate(x) for x in zip(*kept))
        if not len(doc):
            return
        by = np.lexsort((place[doc], h))
        first = groups(h[by])
        least = np.repeat(ords[doc[by[first]]], np.diff(np.r_[first, len(by)]))
        gone = np.empty(len(doc), bool)
        gone[by] = ords[doc[by]] > least
        if gone.any():
            d, p = doc[gone], pos[gone]
            a, b = ranges(p, d)
            own = ids[d[a]]
            yield from _rows(own, own, ords[d[a]], p[a], p[b] + 1, None)
        at = run_starts(doc, pos, low)
        at = at[np.logical_or.reduceat(~gone, at)] if len(at) else at
        ends = np.searchsorted(run_starts(doc, pos, low), at, side="right")
        stops = np.r_[run_starts(doc, pos, low), len(doc)][ends]
        start, last = pos[at], pos[stops - 1]
        begin = offsets[doc[at]] + start
        end = offsets[doc[at]] + last + LENGTH
        data = [raw[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())]
        yield from _rows(low[at].view(np.int64), ids[doc[at]], ords[doc[at]], start, last + 1, data)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = raw_texts(batch.column(2))
            ids, ords = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in chunks(offsets, PART):
                lows = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(3).slice(a, b - a)]
                yield from part(ids[a:b], ords[a:b], raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], lows)

    return docs.mapInArrow(find, RUNS)


def resolve(runs: DataFrame) -> DataFrame:
    """The rows of ``open_runs`` -> (id, start, stop), ranges of positions
    whose string goes. Runs of equal first rank come together in order, and
    are resolved some megabytes at a time."""
    def some(low, ids, ords, start, data) -> Iterator[pa.RecordBatch]:
        size = np.array([len(x) for x in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        offsets = np.r_[0, np.cumsum(size)]
        runs_, places, ranks = [], [], []
        for run, pos, _, h in blocks(raw, offsets, True):
            runs_.append(run)
            places.append(pos)
            ranks.append(h)
        run, pos, h = (np.concatenate(x) for x in (runs_, places, ranks))
        by = np.lexsort((ords[run], h))
        first = groups(h[by])
        least = np.repeat(ords[run[by[first]]], np.diff(np.r_[first, len(by)]))
        gone = np.empty(len(run), bool)
        gone[by] = ords[run[by]] > least
        if gone.any():
            r, p = run[gone], pos[gone]
            a, b = ranges(p, r)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[r[a]]), pa.array(start[r[a]] + p[a]), pa.array(start[r[a]] + p[b] + 1)],
                ["id", "start", "stop"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            settled = batch.column(5).is_null()
            done = batch.filter(settled)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(i) for i in (1, 3, 4)], ["id", "start", "stop"])
            batch = batch.filter(pc.invert(settled))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > PART:
                table = pa.Table.from_batches(held).combine_chunks()
                low = table.column(0).to_numpy()
                cut = int(np.searchsorted(low, low[-1]))  # the last rank may go on
                if cut:
                    yield from flush(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from flush(pa.Table.from_batches(held))

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, ids, ords, start = (table.column(i).to_numpy() for i in range(4))
        yield from some(low, ids, ords, start, table.column(5).to_pylist())

    return runs.repartition("low").sortWithinPartitions("low").mapInArrow(find, "id bigint, start bigint, stop bigint")


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, ord, text) with a unique id and the order of ``doc_id``."""
    ord_ = F.coalesce(col(doc_id).cast("bigint"), F.lit(LAST_ID)).alias("ord")
    ids = docs.groupBy(ord_).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1").isEmpty():
        return docs.select(ord_, col(doc_id).alias("doc_id"), col(text).alias("text")).select(
            F.col("ord").alias("id"), "ord", "text", "doc_id")
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("id"), ord_, col(text).alias("text"),
                                   col(doc_id).alias("doc_id")))


def whole_copies(numbered: DataFrame) -> DataFrame:
    """(id, n_bytes) of the documents whose whole text is that of a smaller
    id. All their bytes go, and as that smaller document has every string of
    theirs, nobody else's result needs them."""
    texts = numbered.select("id", "ord", F.sha2("text", 256).alias("hash"), F.octet_length("text").alias("n_bytes"))
    texts = cut_lineage(texts.filter(F.col("n_bytes") >= LENGTH))
    first = texts.groupBy("hash").agg(F.min("ord").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_groups(texts, cut_lineage(first), "hash", "n").filter("ord > least").select(
        "id", F.col("n_bytes").cast("bigint").alias("n_bytes"))


def repeated_ranges(numbered: DataFrame) -> DataFrame:
    """(id, ranges: array of (start, stop) byte ranges to remove, unordered
    and overlapping) of a frame (id, ord, text)."""
    copies = cut_lineage(whole_copies(numbered))
    few = copies.count() <= BROADCAST_IDS
    texts = numbered.select("id", "ord", "text").join(
        F.broadcast(copies.select("id")) if few else copies.select("id"), "id", "left_anti")
    shared = cut_lineage(first_ranks(texts))
    met = texts.join(shared, "id").select("id", "ord", "text", "lows")
    found = resolve(open_runs(met))
    covered = F.struct("start", (F.col("stop") + (LENGTH - 1)).alias("stop"))
    whole = F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("stop"))
    return found.groupBy("id").agg(F.collect_list(covered).alias("ranges")).unionByName(
        copies.select("id", F.array(whole).alias("ranges")))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed byte ranges,
    maximal, in order), kept (the remaining bytes)."""
    numbered = _numbered(docs, doc_id, text)
    found = cut_lineage(repeated_ranges(numbered))
    total = found.agg(F.sum(F.size("ranges"))).first()[0] or 0
    joined = numbered.join(F.broadcast(found) if total <= BROADCAST_RANGES else found, "id", "left").select(
        "doc_id", "text", "ranges")
    kind = numbered.schema["doc_id"].dataType.simpleString()
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = raw_texts(batch.column(1))
            data = raw.tobytes()
            spans, kept = [], []
            for i, r in enumerate(batch.column(2)):
                body = data[offsets[i]:offsets[i + 1]]
                gone = merged(r.as_py()) if r.is_valid else []
                if gone:
                    ends = [0, *(b for _, b in gone)]
                    begins = [*(a for a, _ in gone), len(body)]
                    body = b"".join(body[a:b] for a, b in zip(ends, begins))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, pairs), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, "
                                  "spans array<struct<start: bigint, stop: bigint>>, kept binary")
