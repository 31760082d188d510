"""Periodic runs of words, found with a suffix automaton.

A run is a stretch of words with smallest period q (words q apart are
identical) of at least ``max(MIN_WORDS, 2 * q)`` words that no neighbouring
word extends with period q. Repeating templates, stuck generators and looped
lists are such runs; ``collapsed`` keeps the first period of each.

A text's words are appended to a suffix automaton. Its suffix links form a
tree in which the path from a prefix's state to the root holds the suffixes of
that prefix. Each state on a path carries the end of its last occurrence, so
the states of one end form a vertical segment. Appending word i is an access
as in a link-cut tree: the path of its prefix is recoloured with i, and each
segment met on the way, of an earlier end e and with L words in its longest
state, says that the longest suffix last seen at e has L words. If the
distance d = i - e is at most L, the last L + d words have period d: a square
and all of it to the left. The segments only ever show smallest periods (an
occurrence at a smaller distance would be the later one), and every word of a
run from its second period on shows it, so the last word to do so is its end.

The tree no longer changes once all words are appended, so the preferred paths
need no splay trees: each heavy path keeps its segments as a stack, of which
an access pops the covered ones. That is O(n log n) steps amortised.

Few texts repeat anything, so stretches without a run are first put aside by
an exact argument: every word of a run of twelve or more words lies in a
sequence of six words that occurs twice in the run. Sequences are compared as
64-bit hashes for whole batches; equal ones always agree, so no run is lost,
and the automaton compares the words themselves. This is repeated within what
is left until nothing goes.

A row's work and memory depend on its text alone: some 0.4 KB for each word of
its longest repetitive stretch.

Defined results: a null or empty text has no runs and an empty collapsed text;
repeated rows and repeated or null ids are rows of their own, in the order of
the input; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shortlist.llm.common import col
from shortlist.llm.vectors import U64, chunks, mix, raw_texts, word_hashes

MIN_WORDS = 12
#: Words of the sequences that must repeat: half of MIN_WORDS.
GRAM = MIN_WORDS // 2
_FACTOR = U64(0x9E3779B97F4A7C15)
Order = Callable[[object, int], "np.ndarray | None"]


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, words of the longest suffix) of each state, and the state
    of each prefix. State 0 is the root."""
    moves, link, size = [{}], [-1], [0]
    last, at = 0, []
    for w in words:
        new = len(link)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in moves[p]:
            moves[p][w] = new
            p = link[p]
        if p >= 0:
            q = moves[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = new + 1
                moves.append(moves[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(w) == q:
                    moves[p][w] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        at.append(new)
    return link, size, at


def heavy_heads(link: list[int], size: list[int]) -> list[int]:
    """The uppermost state of each state's heavy path in the link tree."""
    order = np.argsort(np.array(size), kind="stable").tolist()
    below, heavy = [1] * len(link), [-1] * len(link)
    most = [0] * len(link)
    for v in reversed(order[1:]):
        p, n = link[v], below[v]
        below[p] += n
        if n > most[p]:
            most[p], heavy[p] = n, v
    head = list(range(len(link)))
    for v in order[1:]:
        p = link[v]
        if heavy[p] == v and p:
            head[v] = head[p]
    return head


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least MIN_WORDS words, by
    start, then period."""
    link, size, at = automaton(words)
    head = heavy_heads(link, size)
    up = [link[h] for h in head]
    paths: list[list | None] = [None] * len(link)
    ends: dict[tuple[int, int], int] = {}
    for i, v in enumerate(at):
        known = -1
        while v:
            h, deep = head[v], size[v]
            path = paths[h]
            if path is None:
                paths[h] = [(deep, i)]
            else:
                # segments from the upper end: whole ones go, the last one may reach below v
                met = []
                while path and path[-1][0] <= deep:
                    met.append(path.pop())
                if path and (not met or met[-1][0] < deep):
                    met.append((deep, path[-1][1]))
                if met:
                    lower = met[-1][1]
                    for longest, e in met:
                        if longest >= i - e and (e != known or e != lower):
                            ends[i - longest - (i - e) + 1, i - e] = i
                    known = met[0][1]
                path.append((deep, i))
            v = up[v]
    found = [(a, b - a + 1, q) for (a, q), b in ends.items() if b - a + 1 >= MIN_WORDS]
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of a batch of word hashes that may hold runs: each word of them
    lies in a sequence of GRAM words that occurs twice in its text (``texts``:
    the number of each word's text)."""
    n = len(words) - GRAM + 1
    if n < 2:
        return []
    key = texts[:n].astype(U64)
    for j in range(GRAM):
        key = key * _FACTOR + words[j:n + j]
    key = mix(key)
    order = np.argsort(key)
    ranked = key[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return []
    twice = np.zeros(n, bool)
    twice[order[same]] = twice[order[same + 1]] = True
    twice &= texts[:n] == texts[GRAM - 1:]
    begins = np.flatnonzero(twice)
    step = np.zeros(len(words) + 1, np.int32)
    step[begins] += 1
    step[begins + GRAM] -= 1
    inside = np.cumsum(step[:-1]) > 0
    cut = np.r_[True, texts[1:] != texts[:-1], True]
    first = np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]]))
    last = np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + 1
    return [(a, b) for a, b in zip(first.tolist(), last.tolist()) if b - a >= MIN_WORDS]


def repetitive(words: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """``stretches`` within stretches, until none shrinks."""
    done, open_ = [], stretches(words, texts)
    while open_:
        a, b = open_.pop()
        inner = stretches(words[a:b], np.zeros(b - a, np.int64))
        if inner == [(0, b - a)]:
            done.append((a, b))
        else:
            open_ += [(a + x, a + y) for x, y in inner]
    return sorted(done)


def _numbered(words: list[bytes]) -> list[int]:
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def _reorder(words: np.ndarray, counts: np.ndarray, ids: list, order: Order | None) -> dict[int, np.ndarray]:
    """Applies ``order`` to the words of each text in place; the orders."""
    orders, begin = {}, 0
    for k, (i, n) in enumerate(zip(ids, counts.tolist())):
        if order is not None and n and (to := order(i, n)) is not None:
            words[begin:begin + n] = words[begin:begin + n][to]
            orders[k] = to
        begin += n
    return orders


def batch_runs(texts: pa.Array, ids: list, order: Order | None = None) -> Iterator[tuple[list, str]]:
    """(runs, collapsed text) of each text. ``order(id, n)`` may name the
    sequence in which a text's n words are read."""
    raw, offsets = raw_texts(texts)
    for a, b in chunks(offsets):
        part, at = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        hashes, counts = word_hashes(part, at)
        orders = _reorder(hashes, counts, ids[a:b], order)
        begins = np.cumsum(counts) - counts
        number = np.repeat(np.arange(b - a), counts)
        found: dict[int, list[tuple[int, int]]] = {}
        for x, y in repetitive(hashes, number):
            k = int(number[x])
            found.setdefault(k, []).append((x - int(begins[k]), y - int(begins[k])))
        data = part.tobytes()
        for k in range(b - a):
            words = data[at[k]:at[k + 1]].split()
            if k in orders:
                words = [words[j] for j in orders[k].tolist()]
            runs = []
            for x, y in found.get(k, ()):
                runs += [(x + s, n, q) for s, n, q in runs_of(_numbered(words[x:y]))]
            if runs:
                step = np.zeros(len(words) + 1, np.int64)
                for s, n, q in runs:
                    step[s + q] += 1
                    step[s + n] -= 1
                words = [words[j] for j in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
            yield runs, b" ".join(words).decode("utf-8")


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: Order | None = None) -> DataFrame:
    """One row per document: doc_id, runs (array of start, length, period by
    start, then period) and collapsed (the words that no run holds after its
    first period, joined by one space)."""
    two = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                runs, kept = zip(*batch_runs(some.column(1), some.column(0).to_pylist(), order))
                lists = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(lists, pa.list_(RUN)), pa.array(kept, pa.string())],
                    ["doc_id", "runs", "collapsed"])

    return two.mapInArrow(find, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                                "collapsed string")
