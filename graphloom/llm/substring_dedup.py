"""Removal of word spans that occur earlier, by matching statistics on suffix automata of reference shards.

Against a given reference (``spans_in_reference``) the reference is cut into shards of bounded size; each shard's
automaton is broadcast and the documents are streamed through it.

When the corpus is its own reference (``repeated_spans``), sending every shard to every document would cost the square of
the corpus. There a shard is the text around the occurrences of one anchor (see anchors.py): equal windows have
equal anchors, so the shard a window is routed to holds all text it can match. What comes to a shard is
collapsed to distinct entries; these are streamed in the order of their first occurrence, each through the automaton of
those before it, and then added to it. A window that the automaton knows occurs earlier; so
do all windows of an entry's later copies. An anchor that occurs more than ``HOT`` times would make an unbounded
shard; its windows are taken one by one under 128-bit hashes, aggregated before the shuffle.

Words are runs of other than ASCII white space, compared as bytes. Documents are ordered by doc_id, null first,
then by doc_key. Null texts have no words. Rows equal in doc_id and text are one document and get the same
result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.anchors import chosen_segments, covered, hot_windows, repeated_anchors
from graphloom.llm.common import documents, partitions, table, utf8

LENGTH, ANCHOR = 20, 6
HOT = 50_000
#: Words of a broadcast reference shard, and bytes of entries that a task holds before it sends them.
SHARD_WORDS, SEND_BYTES = 500_000, 40 << 20
_LEAST = -(1 << 63)


def word_units(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Automaton:
    """A suffix automaton of several sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: object) -> int:
        """The state of q's strings that end in p's and c."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, self.next[last][c], c)
                continue
            new = self._state(self.length[last] + 1, 0, {})
            p, last = last, new
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][c], c)

    def matching(self, sequence: list) -> list[int]:
        """For each place the length of the longest stretch ending there that the sequences hold."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in following[state]:
                state = link[state]
                size = length[state]
            if c in following[state]:
                state = following[state][c]
                size += 1
            out.append(size)
        return out


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    start = None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            yield start, i - 1
            start = None


Entry = tuple[int, bytes, tuple[int, int, int]]  # anchor's hash, words, (doc_id, doc_key, first window)


def earlier_windows(entries: list[Entry], length: int) -> Iterator[tuple[int, int, int]]:
    """(doc_key, start, end) of words covered by windows that occur earlier, of entries of one shard."""
    copies: dict[bytes, set[tuple[int, int, int]]] = {}
    for _, words, at in entries:
        copies.setdefault(words, set()).add(at)
    order = sorted(copies, key=lambda w: min(copies[w]))
    automaton = Automaton() if len(order) > 1 else None
    for words in order:
        first, sequence = min(copies[words]), words.split()
        for at in copies[words]:
            if at != first:
                yield at[1], at[2], at[2] + len(sequence)
        if automaton:
            known = automaton.matching(sequence) if words is not order[0] else [0] * len(sequence)
            for x, y in _runs([n >= length for n in known[length - 1 :]]):
                yield first[1], first[2] + x, first[2] + y + length
            automaton.add(sequence)


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_key, spans): word spans (s, e) of each document that occur earlier in the corpus; they may overlap."""
    d = documents(docs, id_col, text_col)
    places, any_hot = repeated_anchors(d, word_units, length, k, hot)
    chosen = d.join(places, "doc_key")
    buckets = 8 * partitions(d.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Entry]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            blobs = [zstandard.compress(pickle.dumps(sorted(x)), 3) for x in held.values()]
            names = list(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        for b in batches:
            ids = [_LEAST if x is None else x for x in b.column("doc_id").to_pylist()]
            keys = b.column("doc_key").to_pylist()
            valid = np.cumsum(b.column("places").is_valid().to_numpy(zero_copy_only=False)) - 1
            split: tuple[int, list[bytes]] = (-1, [])
            for texts, rows, _, i, j, h in chosen_segments(b, word_units, length, k, False):
                for row, x, y, anchor, bucket in zip(rows.tolist(), i.tolist(), j.tolist(), h.tolist(), (h % np.uint64(buckets)).tolist(), strict=True):
                    if split[0] != row:
                        split = (row, texts[valid[row]].split())
                    words = b" ".join(split[1][x : y + length])
                    held.setdefault(bucket, []).append((anchor, words, (ids[row], keys[row], x)))
                    size += len(words) + 100
                if size > SEND_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column("bucket").to_pylist(), b.column("entries").to_pylist(), strict=True))
        for _, own in groupby(rows, key=lambda x: x[0]):
            entries = sorted((e for _, blob in own for e in pickle.loads(zstandard.decompress(blob))), key=lambda e: e[0])
            found = [x for _, shard in groupby(entries, key=lambda e: e[0]) for x in earlier_windows(list(shard), length)]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["doc_key", "s", "e"])

    sent = chosen.mapInArrow(send, "bucket int, entries binary").repartition(partitions(d.sparkSession), "bucket").sortWithinPartitions("bucket")
    spans = sent.mapInArrow(match, "doc_key long, s long, e long")
    if any_hot:
        windows = hot_windows(chosen, word_units, length, k).withColumn("at", F.struct(F.coalesce("doc_id", F.lit(_LEAST)).alias("n"), "doc_key", "start"))
        firsts = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
        later = windows.join(firsts, ["w1", "w2"]).where("at <> first")
        spans = spans.union(later.select("doc_key", F.col("start").cast("long"), (F.col("start") + length).cast("long")))
    return spans.groupBy("doc_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def spans_in_reference(docs: DataFrame, reference: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", reference_text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_key, spans): word spans of documents that the reference holds, of ``length`` words or more.

    One pass over the documents for each shard; a reference text longer than a shard is cut with an overlap."""
    d = documents(docs, id_col, text_col)
    context = d.sparkSession.sparkContext

    def shards() -> Iterator[Automaton]:
        made, size = Automaton(), 0
        for (text,) in reference.select(F.coalesce(F.col(reference_text), F.lit(""))).toLocalIterator():
            words = text.encode().split()
            for at in range(0, len(words) - length + 1, shard_words):
                part = words[at : at + shard_words + length - 1]
                if size and size + len(part) > shard_words:
                    yield made
                    made, size = Automaton(), 0
                made.add(part)
                size += len(part)
        yield made

    found = None
    for shard in shards():
        known = context.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for key, t in zip(b.column("doc_key").to_pylist(), utf8(b), strict=True):
                    sizes = known.value.matching(t.split())
                    rows += [(key, x, y + length) for x, y in _runs([n >= length for n in sizes[length - 1 :]])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["doc_key", "s", "e"])

        part = d.mapInArrow(run, "doc_key long, s long, e long")
        found = part if found is None else found.union(part)
    return found.groupBy("doc_key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """(doc_id, doc_key, n_words, n_removed, kept_sha256[, kept]): the words outside the spans, joined by spaces."""
    names = ["doc_id", "doc_key", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_kept
    types = [pa.int64()] * 4 + [pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, k, t, own in zip(b.column("doc_id").to_pylist(), b.column("doc_key").to_pylist(), utf8(b), b.column("spans").to_pylist(), strict=True):
                words = t.split()
                n = len(words)
                if own:
                    gone = covered(n, [(x["s"], x["e"]) for x in own]).tolist()
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                kept = b" ".join(words)
                out.append((d, k, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in c] if i == 5 else c, t) for i, (c, t) in enumerate(zip(zip(*out, strict=True), types, strict=False))], names)

    joined = documents(docs, id_col, text_col).join(spans, "doc_key", "left")
    return joined.mapInArrow(run, "doc_id long, doc_key long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_kept)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return without_spans(docs, repeated_spans(docs), with_kept=False).drop("doc_key")


SQL = r"""
with worded as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
windows as (
    select doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) as w from worded, unnest(range(1, greatest(len(words) - 18, 1))) as u(i)),
firsts as (select w, min(struct_pack(d := doc_id, i := i)) as first from windows group by w),
later as (select doc_id, i from windows join firsts using (w) where struct_pack(d := doc_id, i := i) <> first),
gone as (select distinct doc_id, i + k as i from later, unnest(range(20)) as u(k)),
each as (select doc_id, i, words[i] as word from worded, unnest(range(1, len(words) + 1)) as u(i)),
judged as (select e.doc_id, e.i, e.word, g.i is not null as gone from each e left join gone g on g.doc_id = e.doc_id and g.i = e.i)
select w.doc_id, len(w.words)::bigint as n_words, (count(*) filter (j.gone))::bigint as n_removed,
    sha256(coalesce(string_agg(j.word, ' ' order by j.i) filter (not j.gone), '')) as kept_sha256
from worded w left join judged j on j.doc_id = w.doc_id group by w.doc_id, w.words
"""
