"""Content-defined anchors: what repeats of fixed-length windows have in common, for the exact substring operators.

A window of L units (words or bytes) is assigned to the leftmost of its k-unit strings whose hash is least: its
anchor. Equal windows have equal anchors at equal offsets, so a window can only repeat if its anchor's hash
does. Neighbouring windows share anchors; a maximal run of them is a segment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, utf8

#: Units handled at once, but for a longer text, of which four times as many; places take 28 bits of a sort key.
CHUNK = 1 << 20
_PLACE = np.uint64((1 << 28) - 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

Hasher = Callable[[bytes], np.ndarray]  # a text's units as uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def string_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of k units, by doubling."""
    parts, h, size, at = [], units, 1, 0
    while True:
        if k & size:
            parts.append((at, h))
            at += size
        size *= 2
        if size > k:
            break
        h = mixed(h[: len(h) - size // 2] * _M1 + h[size // 2 :])
    n = len(units) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for at, h in parts:
        out = out * _M2 + h[at : at + n]
    return mixed(out)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


Segments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def segments(units: np.ndarray, starts: np.ndarray, length: int, k: int, most: int = 4 * CHUNK) -> Segments:
    """(document, anchor, first window, last window, hash) of the segments of documents that follow one another in
    ``units``, from starts[i] to starts[i + 1]; places count from the document's start.

    A document of more than ``most`` units, which is alone in its chunk, is taken piece by piece."""
    if len(starts) != 2 or len(units) <= most:
        return _segments(units, starts, length, k)
    found: list[Segments] = []
    for at in range(0, len(units) - length + 1, most):  # windows of one piece and the units that they reach
        piece = units[at : at + most + length - 1]
        d, a, i, j, h = _segments(piece, np.array([0, len(piece)]), length, k)
        found.append((d, a + at, i + at, j + at, h))
    d, a, i, j, h = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))  # one that goes on in the next piece is one segment
    return d[first], a[first], i[first], j[np.concatenate((first[1:], [len(a)])) - 1], h[first]


def _segments(units: np.ndarray, starts: np.ndarray, length: int, k: int) -> Segments:
    docs = np.flatnonzero(np.diff(starts) >= length)
    if not len(docs):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    h = string_hashes(units, k)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    least = sliding_minimum(key, length - k + 1)
    n = np.diff(starts)[docs] - length + 1  # windows of each document
    at = np.repeat(starts[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())
    doc = np.repeat(docs, n)
    anchor = (least[at] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    d, a = doc[first], anchor[first]
    return d, a - starts[d], at[first] - starts[d], at[last] - starts[d], h[a]


def unit_chunks(texts: list[bytes], hasher: Hasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, units, starts) of groups of whole texts."""
    held, total, first = [], 0, 0
    for i, t in enumerate(texts):
        u = hasher(t)
        if held and total + len(u) > CHUNK:
            yield first, np.concatenate(held), np.cumsum([0, *map(len, held)])
            held, total, first = [], 0, i
        held.append(u)
        total += len(u)
    if held:
        yield first, np.concatenate(held), np.cumsum([0, *map(len, held)])


def repeated_anchors(docs: DataFrame, hasher: Hasher, length: int, k: int, hot: int) -> tuple[DataFrame, bool]:
    """(doc_key, places), and whether any place is hot: for each document the anchors whose hash occurs more than once, as
    (place, hot); hot if it occurs more than ``hot`` times. Documents without any are left out.

    Counts are aggregated before the shuffle; the join back splits skewed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("doc_key").to_numpy()
            for first, units, starts in unit_chunks(utf8(b), hasher):
                d, a, _, _, h = segments(units, starts, length, k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[d + first]), pa.array(a.astype(np.int32))], ["h", "doc_key", "place"])

    found = cut(docs.select("doc_key", "text").mapInArrow(run, "h long, doc_key long, place int"), "anchors")
    counts = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    counts = cut(counts.select("h", (F.col("n") > hot).alias("hot")), "anchor-counts")
    places = found.join(counts, "h").groupBy("doc_key").agg(F.collect_list(F.struct("place", "hot")).alias("places"))
    return places, bool(counts.where("hot").head(1))


def chosen_segments(batch: pa.RecordBatch, hasher: Hasher, length: int, k: int, hot: bool) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, row of the batch, anchor, first window, last window, hash) of the segments of documents (text, places)
    whose anchors are in places and as hot as asked for."""
    places = batch.column("places")
    rows = [i for i, v in enumerate(places.is_valid().to_pylist()) if v]
    texts = utf8(batch)
    own = [texts[i] for i in rows]
    values = places.drop_null()
    flat = values.flatten()
    sizes = np.diff(values.offsets.to_numpy()) if len(rows) else np.zeros(0, np.int64)
    wanted = np.repeat(np.arange(len(rows)), sizes) << 32 | flat.field("place").to_numpy().astype(np.int64)
    wanted = wanted[flat.field("hot").to_numpy(zero_copy_only=False) == hot]
    for first, units, starts in unit_chunks(own, hasher) if len(wanted) else ():
        d, a, i, j, h = segments(units, starts, length, k)
        keep = np.isin((d + first) << 32 | a, wanted)
        yield own, np.array(rows, np.int64)[d[keep] + first], a[keep], i[keep], j[keep], h[keep]


def window_hashes(units: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window."""
    return string_hashes(units, length), string_hashes(mixed(units ^ _M2), length)


HOT_WINDOWS = "w1 long, w2 long, doc_id long, doc_key long, start int"


def hot_windows(chosen: DataFrame, hasher: Hasher, length: int, k: int) -> DataFrame:
    """The windows of hot segments, one by one, under 128-bit hashes (w1, w2): equal ones can be aggregated before a
    shuffle, so no frequent anchor gathers in one place. ``chosen`` has doc_id, doc_key, text and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("doc_key").to_numpy()
            for texts, rows, _, i, j, _ in chosen_segments(b, hasher, length, k, True):
                valid = np.cumsum(b.column("places").is_valid().to_numpy(zero_copy_only=False)) - 1
                for row in np.unique(rows).tolist():
                    own = rows == row
                    at = np.concatenate([np.arange(x, y + 1) for x, y in zip(i[own].tolist(), j[own].tolist(), strict=True)])
                    w1, w2 = window_hashes(hasher(texts[valid[row]]), length)
                    yield pa.RecordBatch.from_arrays([pa.array(w1[at].view(np.int64)), pa.array(w2[at].view(np.int64)), pa.array([ids[row].as_py()] * len(at), pa.int64()), pa.array(np.full(len(at), keys[row])), pa.array(at.astype(np.int32))], ["w1", "w2", "doc_id", "doc_key", "start"])

    return chosen.mapInArrow(run, HOT_WINDOWS).distinct()


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n units are in [start, end) of any span."""
    edges = np.zeros(n + 1, np.int64)
    if spans:
        s = np.array(spans)
        np.add.at(edges, s[:, 0], 1)
        np.add.at(edges, s[:, 1], -1)
    return np.cumsum(edges[:n]) > 0
