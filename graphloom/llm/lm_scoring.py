"""Language-model scores by context-tree weighting over bytes, beside a unigram word baseline.

The model reads a text with A-Z lower-cased, as bytes and one 0 at the end, each byte as eight binary
decisions. For every decision (the bits of the byte so far) there is a tree of contexts, the 0 to DEPTH
bytes before it (0 before the start). A context's own estimate is Krichevsky and Trofimov's; the tree mixes the
estimates of all depths with the weights that the training data give each: half own estimate, half
product of the longer contexts, all the way up. A context that training never saw has counts of zero, and so
predicts 1/2 at its own and every greater depth. The score is the log10 probability of the text,
the code length per byte is -score / log10(2) / bytes.

Training counts byte strings of DEPTH + 1 in all training texts: tasks send sorted counts by the TOP nearest context
bytes, and each such subtree, of 2^24 strings at most, is weighted where it lands. There are several times as many buckets of
subtrees as partitions. What the upper levels need is summed by context; they are broadcast (2^24 estimates at most, some
10^5 in text), and so are the log10 probabilities of the byte strings seen most often, at most MAX_NODES. All other strings of
the documents go to their subtree, which scores them with all of its contexts: none is left out, whatever the size.

The baseline needs every word's count. The HEAD_WORDS most frequent short words are broadcast; the others are
joined, a row for each document and word.

Null texts are empty: one end. A null doc_id counts as training. Equal rows get equal scores and count twice
in training. Without training documents every estimate is 1/2.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, documents, partitions, table, utf8

DEPTH, TOP = 5, 3
MAX_NODES = 3 << 20
HEAD_WORDS, HEAD_BYTES = 200_000, 64
FOLDS, HELD_OUT = 7, 2
LEAST_BUCKETS = 64
CHUNK = 1 << 21
_CACHE_BITS = 21


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


# Byte strings. A code holds the byte to tell in its lowest byte, the byte before it above that, and so on.


def chunks(texts: list[bytes], depth: int = DEPTH, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, starts, documents): codes of all bytes of the texts; documents[k]'s begin at starts[k], and go on in the
    next chunk if a text is long."""
    held: list[tuple[int, bytes]] = []
    total = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"".join(x for _, x in held), np.uint8)
        n = len(buf) - depth
        code = np.zeros(n, np.uint64)
        for j in range(depth + 1):
            code |= buf[depth - j : depth - j + n].astype(np.uint64) << np.uint64(8 * j)
        sizes = np.array([len(x) for _, x in held])
        at = np.cumsum(sizes) - sizes
        valid = np.ones(len(buf), bool)
        for j in range(depth):
            valid[at + j] = False
        return code[valid[depth:]], at - depth * np.arange(len(held)), np.array([d for d, _ in held])

    for d, t in enumerate(texts):
        t = bytes(depth) + t + b"\0"
        for at in range(0, len(t) - depth, size):
            part = t[at : at + size + depth]
            if held and total + len(part) > size:
                yield out()
                held, total = [], 0
            held.append((d, part))
            total += len(part)
    if held:
        yield out()


def _buckets(spark) -> int:
    """How many buckets share the subtrees."""
    return min(max(LEAST_BUCKETS, 4 * partitions(spark)), 1 << 16)


def _split(codes: np.ndarray, values: np.ndarray, buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    """Buckets by the nearest TOP context bytes, and the codes and values of each, in their order."""
    near = codes >> np.uint64(8) & np.uint64((1 << 8 * TOP) - 1)
    bucket = ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(0xFFFFFF)) % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    codes, values = codes[order], values[order]
    edges = np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=buckets)))).tolist()
    full = [k for k in range(buckets) if edges[k] < edges[k + 1]]
    return full, *([x[edges[k] : edges[k + 1]].tobytes() for k in full] for x in (codes, values))


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


# Weighting.


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2, by Stirling's series at x + 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of Krichevsky and Trofimov's probability of n0 zeros and n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def _decisions(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, n0, n1) of the binary decisions in sorted codes: a key has 1 and the bits so far in its lowest byte."""
    out = []
    byte, above = codes & np.uint64(255), codes & ~np.uint64(255)
    for level in range(8):
        key = above | np.uint64(1 << level) | byte >> np.uint64(8 - level)
        bit = (byte >> np.uint64(7 - level) & np.uint64(1)).astype(np.float64)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n, ones = np.add.reduceat(counts.astype(np.float64), first), np.add.reduceat(counts * bit, first)
        out.append((key[first], n - ones, ones))
    key, n0, n1 = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(key, kind="stable")
    return key[order], n0[order], n1[order]


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _weights(own: np.ndarray, longer: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, weight of the own estimate)."""
    if longer is None:
        return own, np.ones_like(own)
    both = np.logaddexp(own, longer) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << 8 * (depth + 1)) - 1)


def subtrees(codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> tuple[dict[int, tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]:
    """Of sorted codes that hold all of some contexts of TOP bytes: {depth: (key, log odds of a one, weight, n)},
    and (key, n0, n1, ln weighted probability of the longer contexts) at depth TOP - 1."""
    nodes, below, top = {}, None, min(TOP, depth)
    for d in range(depth, top - 1, -1):
        c, n = _grouped(codes & _mask(d), counts) if d < depth else (codes, counts)
        key, n0, n1 = _decisions(c, n)
        weighted, w = _weights(_kt(n0, n1), below[1] if below else None)
        nodes[d] = (key, np.log((n1 + 0.5) / (n0 + 0.5)), w, n0 + n1)
        below = _grouped(key & _mask(d - 1), weighted, n0, n1)
        below = (below[0], below[1], below[2], below[3])
    key, longer, n0, n1 = below
    return nodes, (key, n0, n1, longer)


class Model:
    """Predicts bytes from estimates by depth, each sorted by key."""

    def __init__(self, upper: tuple[np.ndarray, ...] | None, nodes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int = DEPTH) -> None:
        """upper: (key, n0, n1, ln weighted probability of longer contexts) at depth TOP - 1, in any order."""
        self.depth, self.nodes = depth, dict(nodes)
        if upper is not None and len(upper[0]):
            key, n0, n1, longer = _grouped(upper[0], *(x.astype(float) for x in upper[1:]))
            for d in range(min(TOP, depth) - 1, -1, -1):
                weighted, w = _weights(_kt(n0, n1), longer)
                self.nodes[d] = (key, np.log((n1 + 0.5) / (n0 + 0.5)).astype(np.float32), w.astype(np.float32))
                key, longer, n0, n1 = _grouped(key & _mask(max(d - 1, 0)), weighted, n0, n1)
        self.nodes = {d: x for d, x in self.nodes.items() if len(x[0])}
        self.seen = None

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities of distinct codes."""
        total = np.zeros(len(codes))
        byte, above = codes & np.uint64(255), codes & ~np.uint64(255)
        for level in range(8):
            key = above | np.uint64(1 << level) | byte >> np.uint64(8 - level)
            one = (byte >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            mixed, rest = np.zeros(len(codes)), np.ones(len(codes))
            live = np.arange(len(codes))
            for d in range(self.depth + 1):
                if d not in self.nodes or not len(live):
                    break
                keys, odds, weight = self.nodes[d]
                want = key[live] & _mask(d)
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                found = keys[at] == want
                live, at = live[found], at[found]
                x = odds[at].astype(np.float64)
                p = 1 / (1 + np.exp(np.where(one[live], -x, x)))
                w = weight[at].astype(np.float64)
                mixed[live] += rest[live] * w * p
                rest[live] *= 1 - w
            total += np.log10(mixed + rest / 2)  # what has not been seen predicts 1/2
        return total

    def score(self, codes: np.ndarray) -> np.ndarray:
        """log10 probabilities of any codes; those seen before are remembered in a table of fixed size."""
        if self.seen is None:
            self.seen = (np.full(1 << _CACHE_BITS, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << _CACHE_BITS))
        known, values = self.seen
        slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        out = values[slot]
        new = np.flatnonzero(known[slot] != codes)
        if len(new):
            distinct, back = np.unique(codes[new], return_inverse=True)
            found = self.log10(distinct)
            out[new] = found[back]
            slot = ((distinct * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
            known[slot], values[slot] = distinct, found
            settled = known[slot] == distinct  # of codes that share a slot the last one has both
            values[slot[settled]] = found[settled]
        return out


class Frequent(Model):
    """Knows the probabilities of some codes; those of others are NaN."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, depth: int = DEPTH) -> None:
        order = np.argsort(codes)
        self.codes, self.values, self.depth, self.seen = codes[order], values[order], depth, None

    def log10(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), np.nan)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.values[at], np.nan)


def log10_probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts))
    for codes, starts, docs in chunks(texts, model.depth):
        np.add.at(out, docs, np.add.reduceat(model.score(codes), starts))
    return out


# The tables.


def gathered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, c) and (bucket, codes, counts) of the training texts in ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = size = 0

        def strings() -> pa.RecordBatch:
            full, codes, counts = _split(*_summed(*(np.concatenate(x) for x in zip(*held, strict=True))), buckets)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.binary()), pa.nulls(len(full), pa.int64()), pa.array(full, pa.int32()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())], names)

        def counted() -> pa.RecordBatch:
            w, c = list(words.keys()), list(words.values())
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(c, pa.int64()), *(pa.nulls(len(w), t) for t in (pa.int32(), pa.binary(), pa.binary()))], names)

        for b in batches:
            texts = [t.lower() for d, t in zip(b.column("doc_id").to_pylist(), utf8(b), strict=True) if not held_out(d)]
            ends += len(texts)
            for t in texts:
                words.update(t.split())
            if len(words) > 400_000:
                yield counted()
            for codes, _, _ in chunks(texts):
                held.append(np.unique(codes, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held[:] = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield strings()
                        size = 0
        words[b" "] = ends  # no word is a space: it stands for the ends
        yield counted()
        if held:
            yield strings()

    names, buckets = ["word", "c", "bucket", "codes", "counts"], _buckets(docs.sparkSession)
    both = cut(docs.select("doc_id", "text").mapInArrow(run, "word binary, c long, bucket int, codes binary, counts binary"), "lm-counts")
    words = cut(both.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "lm-words")
    return words, both.where("bucket is not null").select("bucket", "codes", "counts")


def _merged(rows: Iterator[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts, of rows that end in codes and counts."""
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(np.concatenate([codes, *(x for x, _ in held)]), np.concatenate([counts, *(x for _, x in held)]))

    for *_, c, n in rows:
        held.append((np.frombuffer(c, np.uint64), np.frombuffer(n, np.int64)))
        size += len(held[-1][0])
        if size > 2_000_000:
            codes, counts = merged()
            held, size = [], 0
    return merged()


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    return (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in names), strict=True))


def _lower(codes: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    return {d: x[:3] for d, x in subtrees(codes, counts)[0].items()} if len(codes) else {}


def trained(strings: DataFrame) -> tuple[DataFrame, dict[int, tuple[np.ndarray, ...]], dict[int, int]]:
    """Of the counted strings (bucket, codes, counts): each bucket's in one row, the TOP upper levels of the model, and
    how many codes there are by the logarithm of their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in groupby(_rows(batches, "bucket", "codes", "counts"), key=lambda x: x[0]):
            codes, counts = _merged(own)
            top = subtrees(codes, counts)[1]
            levels = np.bincount(np.log2(counts).astype(np.int64)).astype(np.int64)
            row = (bucket, codes.tobytes(), counts.tobytes(), levels.tobytes(), *(x.tobytes() for x in top))
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["bucket", "codes", "counts", "levels", "a", "b", "c", "d"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches, "a", "b", "c", "d"):
            key, *sums = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, float, float, float), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, *sums)], ["key", "n0", "n1", "longer"])

    dealt = strings.repartition(partitions(strings.sparkSession), "bucket").sortWithinPartitions("bucket")
    made = cut(dealt.mapInArrow(run, "bucket int, codes binary, counts binary, levels binary, a binary, b binary, c binary, d binary"), "lm-strings")
    tops = made.select("a", "b", "c", "d").mapInArrow(unpack, "key long, n0 double, n1 double, longer double")
    tops = tops.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "longer"))).toArrow()  # 2^24 rows at most
    upper = tuple(tops.column(c).to_numpy() for c in ("key", "n0", "n1", "longer"))
    sizes: Counter = Counter()
    for r in made.select("levels").toLocalIterator():
        sizes.update(dict(enumerate(np.frombuffer(r.levels, np.int64).tolist())))
    return made.select("bucket", "codes", "counts"), Model((upper[0].view(np.uint64), *upper[1:]), {}).nodes, sizes


def _model(upper: dict[int, tuple[np.ndarray, ...]], codes: np.ndarray, counts: np.ndarray) -> Model:
    return Model(None, {**upper, **_lower(codes, counts)})


def frequent(strings: DataFrame, upper, sizes: dict[int, int], most: int) -> Frequent:
    """The probabilities of the codes seen most often, ``most`` at most."""
    least = 0
    while sum(n for k, n in sizes.items() if k >= least) > most:
        least += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c, n in _rows(batches, "bucket", "codes", "counts"):
            codes, counts = np.frombuffer(c, np.uint64), np.frombuffer(n, np.int64)
            often = codes[counts >= 1 << least]
            if len(often):
                found = _model(upper.value, codes, counts).log10(often)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (often, found)], ["codes", "found"])

    rows = cut(strings.mapInArrow(run, "codes binary, found binary"), "lm-frequent")
    codes, found = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for r in rows.toLocalIterator():
        codes.append(np.frombuffer(r.codes, np.uint64))
        found.append(np.frombuffer(r.found, float))
    return Frequent(np.concatenate(codes), np.concatenate(found))


def rare_scores(strings: DataFrame, rare: DataFrame, upper) -> DataFrame:
    """(doc_key, score): what the codes of ``rare`` (bucket, codes, docs) add, each bucket with its whole subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_rows(batches, "bucket", "kind", "codes", "more"), key=lambda x: x[0]):
            model = None
            for _, kind, c, more in own:  # the strings come first
                codes = np.frombuffer(c, np.uint64)
                if kind == 0:
                    model = _model(upper.value, codes, np.frombuffer(more, np.int64))
                    continue
                model = model or _model(upper.value, np.zeros(0, np.uint64), np.zeros(0, np.int64))
                docs, back = np.unique(np.frombuffer(more, np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(np.bincount(back, model.score(codes), len(docs)))], ["doc_key", "score"])

    both = strings.select("bucket", F.lit(0).alias("kind"), "codes", F.col("counts").alias("more")).union(rare.select("bucket", F.lit(1), "codes", F.col("docs")))
    dealt = both.repartition(partitions(strings.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(run, "doc_key long, score double")


class Head:
    """The logarithms of frequent words' counts, packed; a worker unpacks them."""

    def __init__(self, words: pa.Array, counts: np.ndarray) -> None:
        self.words, self.sizes, self.counts = b"".join(words.to_pylist()), np.array([len(w) for w in words.to_pylist()], np.uint8), counts

    def logs(self) -> dict[bytes, float]:
        ends = np.cumsum(self.sizes, dtype=np.int64).tolist()
        return {self.words[s:e]: math.log10(c + 1) for s, e, c in zip([0, *ends], ends, self.counts.tolist())}  # noqa: B905  one start more


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_nodes: int = MAX_NODES, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row."""
    d = documents(docs, id_col, text_col)
    words, strings = gathered(d)
    context = d.sparkSession.sparkContext
    strings, upper, sizes = trained(strings)
    upper = context.broadcast(upper)
    often = context.broadcast(frequent(strings, upper, sizes, max_nodes))
    n, v = words.agg(F.sum("c"), F.count("*")).first()
    n = n or 0
    short = words.where(F.length("word") <= HEAD_BYTES)
    ends = next((r.c for r in words.where(F.col("word") == F.lit(b" ")).collect()), 0)
    found = short.where(F.col("word") != F.lit(b" ")).orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    head = context.broadcast(Head(found.column("word").combine_chunks(), found.column("c").to_numpy()))
    del found
    end_log, known_end, unit = math.log10(ends + 1), int(ends > 0), math.log10(n + v + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.logs()
        own = Frequent(often.value.codes, often.value.values)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rest() -> pa.RecordBatch:
            full, codes, docs = _split(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(full), t) for t in kinds), pa.array(full, pa.int32()), pa.array(codes, pa.binary()), pa.array(docs, pa.binary())], names)

        for b in batches:
            texts = [t.lower() for t in utf8(b)]
            tokens, hits, logs, tails = [], [], [], []
            for t in texts:
                found = t.split()
                values = [known[w] for w in found if w in known]
                tokens.append(len(found) + 1)
                hits.append(len(values) + known_end)
                logs.append(math.fsum(values) + end_log)
                tails.append([{"word": w, "n": k} for w, k in Counter(w for w in found if w not in known).items()] if len(values) < len(found) else [])
            ids, keys, total = b.column("doc_id"), b.column("doc_key").to_numpy(), np.zeros(len(texts))
            for codes, starts, at in chunks(texts):
                found = own.score(codes)
                lost = np.flatnonzero(np.isnan(found))
                held.append((codes[lost], keys[at[np.searchsorted(starts, lost, "right") - 1]]))
                size += len(lost)
                found[lost] = 0
                np.add.at(total, at, np.add.reduceat(found, starts))
                if size > 1_000_000:
                    yield rest()
                    size = 0
            columns = [ids, b.column("doc_key"), pa.array([held_out(x) for x in ids.to_pylist()], pa.bool_()), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array(logs, pa.float64()), pa.array(tails, tail), pa.array(total)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(texts), t) for t in (pa.int32(), pa.binary(), pa.binary()))], names)
        if size:
            yield rest()

    buckets = _buckets(d.sparkSession)
    names = ["doc_id", "doc_key", "held_out", "n_bytes", "n_tokens", "hits", "logs", "tail", "score", "bucket", "codes", "docs"]
    tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), tail, pa.float64()]
    schema = "doc_id long, doc_key long, held_out boolean, n_bytes long, n_tokens long, hits long, logs double, tail array<struct<word:binary, n:long>>, score double, bucket int, codes binary, docs binary"
    both = cut(d.mapInArrow(run, schema), "lm-scored")
    scored = both.where("bucket is null").drop("bucket", "codes", "docs")
    tails = rare_scores(strings, both.where("bucket is not null").select("bucket", "codes", "docs"), upper)
    rare = scored.select("doc_key", F.explode("tail").alias("t")).select("doc_key", "t.word", "t.n")
    found = rare.join(words, "word").select("doc_key", F.col("n").alias("hits"), (F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.lit(0).alias("rows"), F.lit(0.0).alias("score"))
    # Equal rows share a doc_key: each of them gets its share of what the key gathers.
    parts = found.union(tails.select("doc_key", F.lit(0), F.lit(0.0), F.lit(0), "score")).union(scored.select("doc_key", F.lit(0), F.lit(0.0), F.lit(1), F.lit(0.0)))
    per_key = parts.groupBy("doc_key").agg(F.sum("hits").alias("more_hits"), F.sum("logs").alias("more_logs"), F.sum("rows").alias("rows"), F.sum("score").alias("more_score"))
    out = scored.drop("tail").join(per_key, "doc_key").withColumn("score", F.col("score") + F.col("more_score") / F.col("rows"))
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("hits") + F.expr("more_hits div rows")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more_logs") / F.col("rows") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        "score",
        (-F.col("score") / math.log10(2) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
