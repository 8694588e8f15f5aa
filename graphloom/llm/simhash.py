"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 or less meet at a variant that flips at most two bits of one and
at most one of the other. Every distinct fingerprint emits itself and its 64 one-bit variants;
those of even weight also emit two-bit variants, which suffices because an odd distance joins an
even and an odd weight, and only pairs of bits in one half of the word, because of any three bits
two lie in one half. A variant and the flips that made it fit 8 bytes. Variants are shuffled by
their scrambled value; where several fingerprints meet, a star of links, each verified, joins them.
A variant's group is bounded by the ball (1,057), whatever the data.

Equal fingerprints are collapsed first. Texts without words have fingerprint zero and link like
any other; null texts are empty. A null doc_id counts as the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, documents, partitions, table, utf8
from graphloom.llm.components import components

SEED, BITS, RADIUS = 42, 64, 3
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SCRAMBLE = 0x9E3779B97F4A7C15
_UNSCRAMBLE = np.uint64(pow(_SCRAMBLE, -1, 1 << 64))
_SCRAMBLE = np.uint64(_SCRAMBLE)
_ONES = [1 << i for i in range(BITS)]
_PAIRS = [1 << i | 1 << j for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
#: What a code flips: 0 nothing, 1 to 64 one bit, above that two.
_FLIPS = np.array([0, *_ONES, *_PAIRS], np.uint64)
_CODE_BITS = 11  # 1,057 codes; a bucket number of as many bits at least makes room for the code


def fingerprint(text: bytes, words: int = 3) -> int:
    """The fingerprint of a text in UTF-8."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    else:
        joined, ends, at = b" ".join(w), [], -1
        for x in w:
            at += len(x) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :])]  # noqa: B905  starts is longer
    return majority(np.array(hashes, "<u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set."""
    h = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(h[:, i], minlength=256) @ _SET for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, fp long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in utf8(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc_key"), pa.array(fp)], ["doc_id", "doc_key", "fp"])

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, doc_key long, fp long")


def variants(fp: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, packed) of all variants of distinct fingerprints, by bucket: packed is the rest of
    the scrambled variant over the code."""
    even = np.bitwise_count(fp) % 2 == 0
    parts = [(fp[~even], BITS + 1), (fp[even], len(_FLIPS))]
    v = np.concatenate([(f[:, None] ^ _FLIPS[None, :n]).ravel() for f, n in parts]) * _SCRAMBLE
    codes = np.concatenate([np.tile(np.arange(n, dtype=np.uint64), len(f)) for f, n in parts])
    bucket = (v >> np.uint64(BITS - bucket_bits)).astype(np.int64)
    packed = (v & np.uint64((1 << BITS - bucket_bits) - 1)) << np.uint64(_CODE_BITS) | codes
    order = np.argsort(bucket.astype(np.uint16) if bucket_bits <= 16 else bucket, kind="stable")
    return bucket[order], packed[order]


def met(bucket: int, packed: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that share a variant in this bucket: to one that flips one bit at most,
    if there is any (two that flip two bits each may be four apart)."""
    packed = np.sort(packed)
    rest, codes = packed >> np.uint64(_CODE_BITS), packed & np.uint64((1 << _CODE_BITS) - 1)
    first = np.flatnonzero(np.concatenate(([True], rest[1:] != rest[:-1])))
    sizes = np.diff(np.concatenate((first, [len(rest)])))
    group = np.repeat(np.arange(len(first)), sizes)
    several = sizes[group] > 1
    v = (rest[several] | np.uint64(bucket) << np.uint64(BITS - bucket_bits)) * _UNSCRAMBLE
    code, group = codes[several], group[several]
    source = v ^ _FLIPS[code]
    # Codes ascend in a group, so one-bit flips come right after the fingerprint itself, if that is there.
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    reps = np.repeat(starts, np.diff(np.concatenate((starts, [len(group)]))))
    second = np.minimum(reps + 1, max(len(group) - 1, 0))
    centre = np.where((code[reps] == 0) & (group[second] == group), second, reps) if len(group) else reps
    good = (code[centre] <= BITS) & (code[centre] > 0)
    a, b = source[good], source[centre[good]]
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    return a[near], b[near]


def _forest(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> None:
    """Merges links into a union-find forest."""

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)


#: Fingerprints whose balls a task emits, on average.
EMITTED = 8_000
#: Links held in a task before it passes on what they connect.
FOREST_NODES = 500_000


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints (fp) as all pairs within the radius do."""
    per_bucket = 2_000_000
    bits = max(_CODE_BITS, min(24, (n * 561 // per_bucket).bit_length()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fp: np.ndarray) -> pa.RecordBatch:
            bucket, packed = variants(fp, bits)
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.concatenate((first[1:], [len(bucket)]))
            blobs = [packed[s:e].tobytes() for s, e in zip(first.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "packed"])

        held, size = [], 0
        for b in batches:
            held.append(b.column("fp").to_numpy().view(np.uint64))
            size += len(held[-1])
            if size >= 8000:
                yield out(np.concatenate(held))
                held, size = [], 0
        if size:
            yield out(np.concatenate(held))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, x) for b in batches for k, x in zip(b.column("bucket").to_pylist(), b.column("packed").to_pylist(), strict=True))
        parent: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            pairs = np.array([(x, p) for x, p in parent.items() if x != p], np.uint64).reshape(-1, 2).view(np.int64)
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for bucket, group in groupby(rows, key=lambda r: r[0]):
            packed = np.frombuffer(b"".join(x for _, x in group), np.uint64)
            _forest(*met(bucket, packed, bits), parent)
            if len(parent) > FOREST_NODES:
                yield out()
        yield out()

    # A fingerprint becomes some 561 variants of 8 bytes: as many tasks as give each a few MB of them.
    spread = distinct.select("fp").repartition(max(partitions(distinct.sparkSession), -(-n // EMITTED)))
    balls = spread.mapInArrow(emit, "bucket int, packed binary")
    dealt = balls.repartition(partitions(distinct.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, fp, component_id): component_id is the smallest doc_id of the documents reachable
    over links of 3 differing bits or fewer."""
    least = -(1 << 63)
    own = cut(fingerprints(docs, words, id_col, text_col), "fingerprints")
    own = own.withColumn("n", F.coalesce("doc_id", F.lit(least)))
    distinct = cut(own.groupBy("fp").agg(F.min("n").alias("rep")), "distinct")
    # Two fingerprints have different least documents, unless rows of one doc_id differ: those link too.
    edges = links(distinct, distinct.count())
    edges = edges.join(distinct.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    found = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    reps = distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("c"))
    return own.join(reps, "fp").select("doc_id", "doc_key", "fp", F.when(F.col("c") != least, F.col("c")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
