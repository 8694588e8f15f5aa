"""Removal of byte strings of a given length that also start elsewhere, by merging sorted suffix runs.

Suffixes are sorted at content-defined anchors only (see anchors.py): an entry is the text from an anchor to the end
of its segment's last window, with the text before it back to the first window's start. Anchors whose hash
occurs once are left out beforehand.

1. Tasks sort their entries and exchange front-coded runs: the length of the prefix shared with the
   entry before, and the rest.
2. A loser tree merges the runs of a bucket. Each contender carries the length of the prefix it
   shares with the last winner; the longer one wins without a look at the bytes, equal ones are compared from there on.
3. The merged order's common prefix lengths, and those of the left contexts sorted backwards, tell for every
   offset which windows are equal: those in one run of right contexts and in one run of left contexts, both
   long enough. So windows are compared exactly, without hashes.

An anchor that occurs more than ``HOT`` times would fill one bucket; its windows are counted one by one
under 128-bit hashes instead, aggregated before the shuffle.

Null texts are empty. Matches never cross documents. Rows that are equal in doc_id and text are
one document, so they are no repeat of each other; equal texts under two ids are.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.anchors import chosen_segments, covered, hot_windows, repeated_anchors
from graphloom.llm.common import documents, partitions, table, utf8

LENGTH, ANCHOR = 400, 64
HOT = 50_000
#: Bytes of entries that a task sorts at once into its runs.
RUN_BYTES = 40 << 20


def byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """How many bytes a and b share at their start, of which ``known`` are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


Entry = tuple[bytes, bytes, int, int, int]  # right, left, doc_key, anchor, least offset


def front_coded(entries: list[Entry]) -> bytes:
    """A sorted run."""
    entries.sort(key=lambda e: e[0])
    shared, rest, before = [], [], b""
    for e in entries:
        n = common_prefix(before, e[0])
        shared.append(n)
        rest.append(e[0][n:])
        before = e[0]
    return zstandard.compress(pickle.dumps((shared, rest, [e[1:] for e in entries])), 3)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(right, bytes shared with the one before, the others) in order."""
    before = b""
    for n, rest, others in zip(*pickle.loads(zstandard.decompress(run)), strict=True):
        before = before[:n] + rest
        yield before, n, others


def merged(runs: list[Iterator[tuple[bytes, int, tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """The runs' entries in order, each with the prefix it shares with the one before it."""
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple[bytes, int, tuple] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size  # with the last winner
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        n = common_prefix(x, y, shared[a])
        if n == len(x) or n < len(y) and x[n] < y[n]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def first(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(first(2 * node), first(2 * node + 1))
        return winner

    w = first(1)
    while heads[w] is not None:
        yield heads[w][0], shared[w], heads[w][2]
        heads[w] = next(runs[w], None)
        shared[w] = heads[w][1] if heads[w] else 0
        node = (w + size) // 2
        while node:
            w, losers[node] = play(losers[node], w)
            node //= 2


def repeated_windows(runs: list[Iterator[tuple[bytes, int, tuple]]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_key, start, end) of what windows that repeat among the runs cover, by entry."""
    rights, others, place = [], [], set()
    shared: list[int] = []
    carry = 1 << 30
    for right, n, other in merged(runs):
        carry = min(carry, n)
        if (other[1], other[2]) in place:  # a row that is repeated
            continue
        place.add((other[1], other[2]))
        rights.append(len(right))
        others.append(other)
        shared.append(carry)
        carry = 1 << 30
    m = len(others)
    if not m:
        return (np.zeros(0, np.int64),) * 3
    shared[0] = 0
    back = [o[0][::-1] for o in others]
    by_left = sorted(range(m), key=back.__getitem__)
    left_shared = np.array([0, *(common_prefix(back[x], back[y]) for x, y in zip(by_left, by_left[1:]))])  # noqa: B905
    by_left = np.array(by_left)
    right_shared, least = np.array(shared), np.array([o[3] for o in others])
    most = np.array([len(o[0]) for o in others])
    low, high = int(least.min()), int(most.max())
    again = np.zeros((m, high - low + 3), bool)  # by offset of the anchor in the window
    left_group = np.empty(m, np.int64)
    for a in range(low, high + 1):
        eligible = np.flatnonzero((least <= a) & (a <= most))
        if len(eligible) < 2:
            continue
        right_group = np.cumsum(right_shared < length - a)
        left_group[by_left] = np.cumsum(left_shared < a)
        pair = right_group[eligible] * (m + 1) + left_group[eligible]
        order = np.argsort(pair, kind="stable")
        same = pair[order[1:]] == pair[order[:-1]]
        again[eligible[order[1:][same]], a - low + 1] = True
        again[eligible[order[:-1][same]], a - low + 1] = True
    edges = np.diff(again.astype(np.int8), axis=1)
    row, start = np.nonzero(edges > 0)
    end = np.nonzero(edges < 0)[1]  # the same rows, in the same order
    key = np.array([o[1] for o in others])[row]
    anchor = np.array([o[2] for o in others])[row]
    # Offsets start + low to end + low - 1: windows from anchor - offset on.
    return key, anchor - (end + low - 1), anchor - (start + low) + length


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_key, spans): byte spans (s, e) of each document that has any to remove; they may overlap."""
    d = documents(docs, id_col, text_col)
    places, any_hot = repeated_anchors(d, byte_units, length, k, hot)
    chosen = d.join(places, "doc_key")
    buckets = 4 * partitions(d.sparkSession)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            runs = [front_coded(x) for x in held.values()]
            names = list(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(runs, pa.binary())], ["bucket", "run"])

        for b in batches:
            keys = b.column("doc_key").to_pylist()
            valid = np.cumsum(b.column("places").is_valid().to_numpy(zero_copy_only=False)) - 1
            for texts, rows, a, i, j, h in chosen_segments(b, byte_units, length, k, False):
                for row, p, x, y, bucket in zip(rows.tolist(), a.tolist(), i.tolist(), j.tolist(), (h % np.uint64(buckets)).tolist(), strict=True):
                    t = texts[valid[row]]
                    held.setdefault(bucket, []).append((t[p : y + length], t[x:p], keys[row], p, p - y))
                    size += y + length - x
                if size > RUN_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column("bucket").to_pylist(), b.column("run").to_pylist(), strict=True))
        for _, own in groupby(rows, key=lambda x: x[0]):
            found = repeated_windows([decoded(r) for _, r in own], length)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["doc_key", "s", "e"])

    runs = chosen.mapInArrow(sort, "bucket int, run binary").repartition(partitions(d.sparkSession), "bucket").sortWithinPartitions("bucket")
    spans = runs.mapInArrow(merge, "doc_key long, s long, e long")
    if any_hot:
        windows = hot_windows(chosen, byte_units, length, k).drop("doc_id")
        again = windows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
        spans = spans.union(windows.join(again, ["w1", "w2"]).select("doc_key", F.col("start").cast("long"), (F.col("start") + length).cast("long")))
    return spans.groupBy("doc_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """(doc_id, doc_key, n_bytes, n_removed, n_spans, kept_sha256[, kept]): texts without the spans, as bytes."""
    names = ["doc_id", "doc_key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    types = [pa.int64()] * 5 + [pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, k, t, own in zip(b.column("doc_id").to_pylist(), b.column("doc_key").to_pylist(), utf8(b), b.column("spans").to_pylist(), strict=True):
                gone, runs, kept = 0, 0, t
                if own:
                    mask = covered(len(t), [(x["s"], x["e"]) for x in own])
                    gone, runs = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
                out.append((d, k, len(t), gone, runs, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names)

    joined = documents(docs, id_col, text_col).join(spans, "doc_key", "left")
    return joined.mapInArrow(run, "doc_id long, doc_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return without_spans(docs, repeated_spans(docs), with_kept=False).drop("doc_key")


#: Every window of every text, by its md5 sum; texts in hexadecimal, two digits a byte, in pieces of 1,000 windows.
SQL = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select doc_id, c * 1000 as base, substr(h, c * 2000 + 1, 2798) as part from docs, unnest(range(0, greatest((len(h) // 2 - 400) // 1000 + 1, 0))) as u(c)),
windows as (select doc_id, base + i as s, md5(substr(part, 2 * i + 1, 800)) as w from parts, unnest(range(0, least(1000, len(part) // 2 - 399))) as u(i)),
again as (select w from windows group by w having count(*) > 1),
starts as (select doc_id, s, coalesce(s - lag(s) over (partition by doc_id order by s) > 400, true) as fresh from windows join again using (w)),
numbered as (select doc_id, s, sum(fresh::int) over (partition by doc_id order by s) as k from starts),
spans as (select doc_id, min(s) as a, max(s) + 400 as b from numbered group by doc_id, k),
sums as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id),
pieces as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from spans union all select doc_id, max(b), null from spans group by doc_id),
kept as (select p.doc_id, string_agg(substr(h, 2 * x + 1, coalesce(2 * (y - x), len(h))), '' order by x) as k from pieces p join docs d on d.doc_id = p.doc_id group by p.doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
from docs d left join sums s on s.doc_id = d.doc_id left join kept p on p.doc_id = d.doc_id
"""
