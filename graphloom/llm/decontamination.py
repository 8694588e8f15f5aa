"""Benchmark decontamination: CGK embedding and bit-sampling LSH, then exact edit distance.

Symbols are words: runs of letters and digits, lower-cased. An item of n words is found in a document if
some stretch of the document is within floor(n / 5) word edits of it (similarity 0.8).

1. Of floor(n / 5) + 1 disjoint blocks of an item, so many edits leave one whole. Item-sized windows
   are taken wherever a document holds a whole block, at every start that the edits allow. This loses
   nothing, and spares the walks below on the rest of the text. Items of fewer than ``MIN_WORDS`` words allow no
   edit: their only block is the item, and where it is found the search ends.
2. A CGK random walk maps a window to a string in which windows a few edits apart differ in
   few places. Samples of ``SAMPLES`` places make ``WALKS * TABLES`` keys; equal keys give candidates, whatever
   block led there.
3. Candidates' surroundings are searched exactly, by Myers' bit-vector automaton over words.

Documents are read once and never shuffled. The items' index is broadcast in blocks of ``BLOCK_BYTES`` of
item text at most; a larger benchmark takes a pass for each block.

Null texts are empty and hold nothing. Short items are reported wherever they occur word for word, which need
not mean that a document was copied: ``clean`` keeps such documents unless it is told otherwise. Items without
words are in no document; null and repeated items are reported like any other, each under its item_id.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import documents, prepare, table

MIN_WORDS, EDITS_PER_WORD = 5, 5
#: The kind of items that are found as they are.
EXACT = -1
WALKS, TABLES, SAMPLES = 16, 8, 3
BLOCK_BYTES = 16 << 20
WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


def lowered(text: str) -> str:
    """Lower-cased, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word_hashes(text: str) -> list[int]:
    return list(map(xxhash.xxh64_intdigest, WORD.findall(lowered(text))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _grams(w: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the q-word strings of ``w``."""
    n = max(0, len(w) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * _ODD + w[j : j + n]
    return _mix(h)


def edits(n: int) -> int:
    return n // EDITS_PER_WORD


def nearest(pattern: list[int], text: list[int], anchored: bool = False) -> list[int]:
    """Edit distances of the pattern to the nearest stretch that ends at each word of ``text``; anchored: to
    the text from its start."""
    n = len(pattern)
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    mask, top = (1 << n) - 1, 1 << n - 1
    pv, mv, score, out = mask, 0, n, []
    for c in text:
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | anchored) & mask
        mh = mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        out.append(score)
    return out


def closest(pattern: list[int], text: list[int]) -> tuple[int, int, int]:
    """(distance, start, end) of the nearest stretch of ``text``: the first that ends, then the shortest."""
    scores = nearest(pattern, text)
    best = min(scores, default=len(pattern))
    if best >= len(pattern):
        return len(pattern), 0, 0
    end = scores.index(best) + 1
    back = nearest(pattern[::-1], text[end - 1 :: -1] if end else [], anchored=True)
    return best, end - 1 - back.index(best), end


class Index:
    """The items of a block: their blocks of whole words, and the LSH keys of their embeddings."""

    def __init__(self, items: list[tuple[int | None, str]], seed: int = 1, least_words: int = 1) -> None:
        self.ids, self.words, seen = [], [], set()
        for i, text in items:
            w = word_hashes(text)
            if len(w) >= least_words and (i, text) not in seen:
                seen.add((i, text))
                self.ids.append(i)
                self.words.append(w)
        r = np.random.default_rng(seed)
        self.salts = r.integers(1, 1 << 63, (WALKS,), np.uint64) | np.uint64(1)
        self.kind = [self._kind(len(w)) for w in self.words]
        self.places, keys, owners = {}, [], []
        for kind in sorted(set(self.kind) - {EXACT}):
            steps = 2 * self._floor(kind)
            self.places[kind] = r.integers(0, steps, (WALKS, TABLES, SAMPLES))
            own = [k for k, x in enumerate(self.kind) if x == kind]
            longest = max(len(self.words[k]) for k in own)
            x = np.zeros((len(own), longest + 1), np.uint64)
            for row, k in enumerate(own):
                x[row, : len(self.words[k])] = self.words[k]
            found = self.keys(kind, x.ravel(), np.arange(len(own)) * (longest + 1), np.array([len(self.words[k]) for k in own]))
            keys.append(found.ravel())
            owners.append(np.repeat(own, found.shape[1]))
        self.lsh, self.owner = self._sorted(keys, owners)
        blocks, places = defaultdict(list), defaultdict(list)
        for k, w in enumerate(self.words):
            parts = edits(len(w)) + 1
            q = len(w) // parts
            a = np.array(w, np.uint64)
            for o in range(0, parts * q, q):
                blocks[q].append(_grams(a[o : o + q], q))
                places[q].append(np.array([k << 32 | o]))
        self.blocks = {}
        for q in blocks:
            h, place = self._sorted(blocks[q], places[q])
            hit = np.zeros(1 << _FILTER_BITS, bool)
            hit[h >> np.uint64(64 - _FILTER_BITS)] = True
            self.blocks[q] = (h, place, hit)

    @staticmethod
    def _kind(n: int) -> int:
        """Items of like lengths share the places that are sampled."""
        return EXACT if n < MIN_WORDS else int(np.log(n / MIN_WORDS) / np.log(1.5) + 1e-9)

    @staticmethod
    def _floor(kind: int) -> int:
        return int(np.ceil(MIN_WORDS * 1.5**kind - 1e-6))

    @staticmethod
    def _sorted(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        v = np.concatenate(values) if values else np.zeros(0, np.int64)
        order = np.argsort(k, kind="stable")
        return k[order], v[order]

    def keys(self, kind: int, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """LSH keys, WALKS * TABLES of them, of windows of ``words`` (beyond its size a window reads 0)."""
        places = self.places[kind]
        steps = int(places.max()) + 1
        padded = np.concatenate((words, np.zeros(1, np.uint64)))
        at = np.zeros((len(starts), WALKS), np.int64)
        walked = np.empty((steps, len(starts), WALKS), np.uint64)
        for j in range(steps):
            c = padded[np.where(at < sizes[:, None], starts[:, None] + at, len(words))]
            walked[j] = c
            at += (_mix((c + np.uint64(j)) * self.salts) >> np.uint64(40) & np.uint64(1)).astype(np.int64)
        out = np.empty((len(starts), WALKS, TABLES), np.uint64)
        for r in range(WALKS):
            for t in range(TABLES):
                h = np.full(len(starts), (kind * WALKS + r) * TABLES + t + 1, np.uint64)
                for p in places[r, t]:
                    h = h * _ODD + walked[p, :, r]
                out[:, r, t] = _mix(h)
        return out.reshape(len(starts), -1)

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(document, item) -> starts of windows. The documents are words[starts[i]:ends[i]]."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        of_word = np.repeat(np.arange(len(starts)), ends - starts)
        for q, (h, place, hit) in self.blocks.items():
            g = _grams(words, q)
            p = np.flatnonzero(hit[g >> np.uint64(64 - _FILTER_BITS)])
            p = p[of_word[p] == of_word[p + q - 1]]
            lo, hi = np.searchsorted(h, g[p]), np.searchsorted(h, g[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            p, k, o = np.repeat(p, n), place[entry] >> 32, place[entry] & 0xFFFFFFFF
            for x, item, s in zip(of_word[p].tolist(), k.tolist(), (p - o).tolist(), strict=True):
                if self.kind[item] == EXACT:
                    if (x, item) not in out:  # the first will do
                        out[x, item].add(s)
                    continue
                t = edits(len(self.words[item]))
                s = np.arange(max(s - t, int(starts[x])), min(s + t, int(ends[x]) - 1) + 1)
                found[self.kind[item]].append(np.stack((s, np.full(len(s), x))))
        for kind, parts in found.items():
            s, x = np.unique(np.concatenate(parts, axis=1), axis=1)
            for at in range(0, len(s), 4096):
                own, doc = s[at : at + 4096], x[at : at + 4096]
                keys = self.keys(kind, words, own, ends[doc] - own)
                lo, hi = np.searchsorted(self.lsh, keys), np.searchsorted(self.lsh, keys, "right")
                rows, columns = np.nonzero(hi > lo)
                n = (hi - lo)[rows, columns]
                entry = np.repeat(lo[rows, columns] - np.cumsum(n) + n, n) + np.arange(n.sum())
                for start, d, item in set(zip(np.repeat(own[rows], n).tolist(), np.repeat(doc[rows], n).tolist(), self.owner[entry].tolist(), strict=True)):
                    out[d, item].add(start)
        return out

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, distance, words, start, end) of each text's nearest stretch to each item that it holds;
        start and end in characters."""
        each = [word_hashes(t) for t in texts]
        ends = np.cumsum([len(w) for w in each])
        starts = ends - [len(w) for w in each]
        words = np.fromiter((x for w in each for x in w), np.uint64, int(ends[-1]) if len(ends) else 0)
        for (d, k), own in sorted(self.candidates(words, starts, ends).items()):
            pattern, base, best = self.words[k], int(starts[d]), None
            n, t = len(pattern), edits(len(pattern))
            regions: list[list[int]] = []
            for s in sorted(own):
                lo, hi = max(s - base - t, 0), s - base + n + 2 * t
                if regions and lo <= regions[-1][1]:
                    regions[-1][1] = hi
                else:
                    regions.append([lo, hi])
            for lo, hi in regions:
                distance, a, b = closest(pattern, each[d][lo:hi])
                if distance <= t and (best is None or distance < best[0]):
                    best = (distance, lo + a, lo + b)
            if best:
                spans = [m.span() for m in WORD.finditer(lowered(texts[d]))]
                yield d, k, best[0], n, spans[best[1]][0], spans[best[2] - 1][1]


def item_blocks(items: DataFrame, item_col: str, text_col: str, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of bounded size; one block is on the driver at a time."""
    block, size = [], 0
    for i, text in items.select(F.col(item_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((i, text))
        size += len(text)
    yield block


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, item_id, distance, n_words, similarity, start, end): documents and the items they hold,
    with the nearest stretch, in characters."""
    names = ["doc_id", "doc_key", "item_id", "distance", "n_words", "similarity", "start", "end"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    d = documents(docs, id_col, text_col)
    out = None
    for block in item_blocks(items, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, keys, texts = (b.column(c).to_pylist() for c in ("doc_id", "doc_key", "text"))
                rows = [(ids[x], keys[x], index.value.ids[k], far, n, 1 - far / n, s, e) for x, k, far, n, s, e in index.value.search(texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        part = d.mapInArrow(run, "doc_id long, doc_key long, item_id long, distance long, n_words long, similarity double, start long, end long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``least_words`` or more, with all their columns; no shuffle."""
    prepare(docs.sparkSession)
    for block in item_blocks(items, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(Index(block, least_words=least_words))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [t or "" for t in b.column(text_col).to_pylist()]
                held = {x for x, *_ in index.value.search(texts)}
                yield b.filter(pa.array([i not in held for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key")
