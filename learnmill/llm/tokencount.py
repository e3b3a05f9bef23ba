"""Operator 8, token counts by rank-synchronous merging of ragged arrays.

The new pre-tokens of a batch of texts lie one after another in one numpy array of symbols. In each round every
sequence finds the lowest rank among its neighbouring pairs, and all pairs of that rank are merged in all
sequences at once; sequences without a pair of the vocabulary are done. The symbols left are the tokens.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map
from .wordbpe import Vocabulary, default_vocabulary, vocabulary

#: Most entries of a worker's memo of counts, which is emptied at the end of each task, characters of text handled at once (one text at
#: least), and symbols from which on a sequence is merged by itself.
MEMO, AT_ONCE, LONG = 400_000, 3_000_000, 2000


class RankMerger:
    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.wide = max(vocab.tokens) + 1
        self.none = len(vocab.merges) + 1
        self.shift = np.uint64(64 - max(8, (16 * len(vocab.merges)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.ranks, self.news = np.full(size + 64, -1, np.int64), np.full(size + 64, self.none, np.int32), np.zeros(size + 64, np.int32)
        self.probes = 1
        pairs = np.array([a * self.wide + b for a, b in vocab.merges], np.int64)
        for key, slot, (rank, new) in zip(pairs.tolist(), self.slot(pairs).tolist(), vocab.merges.values(), strict=True):
            probes = 1
            while self.keys[slot] >= 0:
                slot, probes = slot + 1, probes + 1
            self.keys[slot], self.ranks[slot], self.news[slot] = key, rank, new
            self.probes = max(self.probes, probes)
        self.memo: dict[str, int] = {}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair, by open addressing; none where the vocabulary has no such pair."""
        at = self.slot(keys)
        held = self.keys[at]
        for _ in range(self.probes - 1):
            miss = np.flatnonzero((held != keys) & (held >= 0))
            if not len(miss):
                break
            at[miss] += 1
            held[miss] = self.keys[at[miss]]
        return np.where(held == keys, self.ranks[at], self.none), self.news[at]

    def counts(self, sequences: list[list[int]]) -> np.ndarray:
        """Tokens of each sequence of symbol ids."""
        sizes = np.array([len(x) for x in sequences], np.int64)
        out = sizes.copy()
        flat = np.concatenate([np.asarray(x, np.int64) for x in sequences]) if len(sequences) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        none = self.none
        while len(flat) > 1:
            rank, new = self.look_up(flat[:-1] * self.wide + flat[1:])
            rank[owner[:-1] != owner[1:]] = none
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(flat)))
            least = np.repeat(lowest, lengths)
            merge = (rank == least) & (rank < none)
            # in a run of overlapping pairs (a a a) every second one is merged, from the left
            places = np.flatnonzero(merge)
            if len(places):
                first = np.append(True, np.diff(places) != 1)
                start_of_run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - start_of_run) % 2 == 0]
                flat[places] = new[places]
                out -= np.bincount(owner[places], minlength=len(out))
            keep = least < none
            keep[places + 1] = False
            flat, owner = flat[keep], owner[keep]
        return out

    def count_long(self, symbols: list[int]) -> int:
        """Tokens of one long sequence: as in counts, but the places of each rank are kept, so that a round costs only what it merges."""
        flat = np.array(symbols, np.int64)
        n = len(flat)
        left, right = np.arange(-1, n - 1), np.arange(1, n + 1)  # neighbours that are still there; -1 and n: none
        rank = np.full(n, self.none, np.int64)  # of the pair that starts at a place
        rank[:-1], _ = self.look_up(flat[:-1] * self.wide + flat[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < self.none]
            places = places[np.argsort(rank[places], kind="stable")]
            for part in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(part)

        wait(np.arange(n - 1))
        left_over = n
        while heap:
            least = heapq.heappop(heap)
            places = np.unique(np.concatenate(waiting.pop(least)))
            places = places[rank[places] == least]
            if not len(places):
                continue
            # in a run of overlapping pairs every second one is merged, from the left
            first = np.append(True, right[places[:-1]] != places[1:])
            start_of_run = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - start_of_run) % 2 == 0]
            gone = right[places]
            _, new = self.look_up(flat[places] * self.wide + flat[gone])
            flat[places], rank[gone] = new, self.none
            right[places] = right[gone]
            inside = places[right[places] < n]
            left[right[inside]] = inside
            left_over -= len(places)
            before = left[places]
            changed = np.unique(np.concatenate([places, before[before >= 0]]))
            last = right[changed] >= n
            rank[changed[last]] = self.none
            changed = changed[~last]
            if len(changed):
                rank[changed], _ = self.look_up(flat[changed] * self.wide + flat[right[changed]])
                wait(changed)
        return left_over

    def learn(self, pieces: list[str]) -> None:
        """Puts the counts of these pieces into the memo."""
        parts = [[p] if p.isalpha() else self.v.pre_tokens(p) for p in pieces]
        words = list(dict.fromkeys(x for p in parts for x in p if isinstance(x, str)))
        fresh = [w for w in words if w not in self.memo]
        long = [w for w in fresh if len(w) > LONG]
        short = [w for w in fresh if len(w) <= LONG]
        known = {w: self.memo.get(w) for w in words} | dict(zip(short, self.counts([self.v.symbols(w) for w in short]).tolist(), strict=True))
        known |= {w: self.count_long(self.v.symbols(w)) for w in long}
        self.memo |= known
        for piece, part in zip(pieces, parts, strict=True):
            self.memo[piece] = sum(1 if isinstance(x, int) else known[x] for x in part)

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.v.pieces(t) if t else [] for t in texts]
        fresh = [x for x in set().union(*cut) if x not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = list(set().union(*cut))
        if fresh:
            self.learn(fresh)
        return [sum(map(self.memo.__getitem__, pieces)) for pieces in cut]


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(vocabulary(path))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 2048) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit), one for each input row, over whole texts; null and empty
    texts have no bytes and no tokens. Rows are counted one by one, so repeats get equal counts and a null id stays null; other columns are ignored,
    an empty table gives an empty one, nothing is shuffled. Memory grows with the longest text, time a little faster than its length. path names a vocabulary file that every executor has."""
    path = path or default_vocabulary()

    def counted(tool, batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j] or "") <= AT_ONCE):
                    size += len(texts[j] or "")
                    j += 1
                counts += tool.count(texts[i:j])
                i = j
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    def run(batches):
        tool = merger(path)
        try:
            yield from counted(tool, batches)
        finally:
            tool.memo.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
