"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Texts are cut into pre-tokens. The pre-tokens of those pieces of a batch that
are not yet known lie one after another in a flat array of symbols. In each round every
sequence merges all occurrences of its own lowest-ranked pair at once; ranks
are looked up again only beside the merged symbols, and sequences without a
pair left the arrays. What survives is counted.

The vocabulary is a ``tokenizers`` JSON file whose path is a parameter; its
special tokens inside a text count as one token each and end the pre-token
before them, as that library does by default. No tokens are added, nothing is
cut off.

Memory: a task holds ``CHUNK_BYTES`` of text as pre-tokens (or one text) and
about ``KNOWN`` counted pieces of up to ``KNOWN_CHARS`` characters.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; a
null or repeated doc_id and repeated rows give a row each; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from shortlist.llm.common import col

#: Fixed value: how byte-level BPE cuts a text.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
LIMIT = 512
CHUNK_BYTES = 2 << 20
KNOWN = 1_000_000
KNOWN_CHARS = 40
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable
    ones for themselves, the others from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merge table as sorted arrays, and the counts of known pieces of text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.width = max(vocab.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.known: dict[str, float] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], NO_RANK)

    def count(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token (none of them empty)."""
        raw = [t.encode("utf-8") for t in tokens]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        result = length.copy()
        ids = np.arange(len(raw))  # the sequences that are still in the arrays
        first = np.cumsum(length) - length
        last = np.zeros(len(sym), bool)
        last[first + length - 1] = True
        rank = np.full(len(sym), NO_RANK)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(ids):
            best = np.minimum.reduceat(rank, first)
            alive = best < NO_RANK
            if not alive.all():  # finished sequences leave
                result[ids[~alive]] = length[~alive]
                stay = np.repeat(alive, length)
                sym, rank, last = sym[stay], rank[stay], last[stay]
                ids, length, best = ids[alive], length[alive], best[alive]
                first = np.cumsum(length) - length
                if not len(ids):
                    break
            hit = rank == np.repeat(best, length)
            at = np.flatnonzero(hit)
            # Of overlapping occurrences (aaa) every second one merges.
            chain = np.r_[True, at[1:] != at[:-1] + 1]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(chain, place, 0))) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new_at = at - np.arange(len(at))
            length = length - np.add.reduceat(~keep, first)
            sym, rank, last = sym[keep], rank[keep], last[keep]
            first = np.cumsum(length) - length
            start = np.zeros(len(sym), bool)
            start[first] = True
            rank[new_at] = NO_RANK
            right = new_at[~last[new_at]]
            before = new_at[~start[new_at]] - 1
            for i in (right, before):
                rank[i] = self.ranks(sym[i], sym[i + 1])
        return result

    def plain(self, parts: list[str]) -> list[int]:
        """Token counts of strings without special tokens, pre-token by
        pre-token."""
        found = [TOKENS(part) for part in parts]
        new = list({t for tokens in found for t in tokens})
        counts = dict(zip(new, self.count(new).tolist())) if new else {}
        return [sum(map(counts.__getitem__, tokens)) for tokens in found]

    def totals(self, texts: list[str]) -> list[int]:
        """Token counts of texts. A space before anything but white space
        always begins a pre-token, so a text falls into pieces there, and a
        piece has the same count wherever it stands. A piece that is empty or
        begins with white space belongs to the one before: its count is
        unknown (nan), and so is the sum; such parts are counted whole."""
        total = [0] * len(texts)
        parts: list[tuple[int, str, list[str]]] = []
        for i, text in enumerate(texts):
            cut = self.special.split(text) if self.special else [text]
            total[i] = len(cut) - 1
            parts += [(i, part, part.split(" ")) for part in cut if part]
        if len(self.known) > KNOWN:
            self.known.clear()
        new = list({p for _, _, pieces in parts for p in pieces[1:]}.difference(self.known))
        inner = [p for p in new if p and not SPACE(p)]
        self.known.update(dict.fromkeys(new, math.nan))
        self.known.update(zip(inner, self.plain([" " + p for p in inner])))
        first = self.plain([pieces[0] for _, _, pieces in parts])
        whole = []
        for (i, part, pieces), n in zip(parts, first):
            n += sum(map(self.known.__getitem__, pieces[1:]))
            if math.isnan(n):
                whole.append((i, part))
            else:
                total[i] += n
        for (i, _), n in zip(whole, self.plain([part for _, part in whole])):
            total[i] += n
        for p in inner:
            if len(p) > KNOWN_CHARS:
                del self.known[p]
        return total


TOKENS = regex.compile(PATTERN).findall
SPACE = regex.compile(r"\p{White_Space}").match


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One table per Python worker and file."""
    return Merges(path)


def token_counts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    two = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merges(tokenizer)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.cumsum(size) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(size)]
            n: list[int] = []
            for a, b in zip(cuts, cuts[1:]):
                n += table.totals(texts.slice(a, b - a).to_pylist())
            n_tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), n_tokens, pc.greater(n_tokens, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = two.schema["doc_id"].dataType.simpleString()
    return two.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
