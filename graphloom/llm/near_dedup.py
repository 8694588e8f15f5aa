"""Near-duplicates of a similarity of 0.8 or more by SimHash, for the pipeline: five-word shingles, verified on the texts.

Two documents are near-duplicates if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more (a text of
fewer words is one shingle; texts without words are alike). Texts of equal sets are collapsed first.

1. The ball hashing of simhash.py, on fingerprints of these shingles, links sets at 3 differing bits or fewer.
2. At a similarity of 0.8 two fingerprints differ in about 10 bits of 64, where balls that meet would cost millions of variants
   for each document. So pairs that are farther apart are found by ``BANDS`` bands of ``ROWS`` least shingle hashes, of which
   a pair of similarity 0.8 shares one with probability 0.998.

Every pair is verified on the texts before it links. Where sets share a band, each is paired with the least of them. What
that leaves are bands with sets outside their most frequent component: clouds of texts of a similarity below 0.8 to each other,
which share bands by chance. The sets of such bands meet again over their rare shingles: in one order for all sets, by how many
of these sets hold a shingle, two sets of 0.8 share one of the first fifth (and one more) of each, and where the first that they share
stands says how many they can share at most. This loses no pair, and of a cloud whose texts each have over a ninth of their own it
leaves none. The sets are paired with the least that holds such a shingle, and those that are then outside its most
frequent component with all of other components. So every two sets that share a band are compared, connected, or ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, cut_counted, documents, partitions, utf8
from graphloom.llm.components import components
from graphloom.llm.simhash import links as ball_links
from graphloom.llm.simhash import majority

WORDS, BANDS, ROWS = 5, 20, 6
#: Hashes, by shingle and function, held at once.
_HELD = 1 << 21
#: Pairs a task compares: so many at least, and, where there are more tasks than partitions, at most.
PAIRS, MOST_PAIRS = 1_000, 50_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct hashes, sorted, of a text's shingles."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e]) for s, e in zip(starts, ends[min(words, len(w)) - 1 :])]  # noqa: B905  starts is longer
    return np.unique(np.array(hashes, np.uint64))


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and salts of n hash functions."""
    r = np.random.default_rng(n)
    return r.integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set's bands."""
    n = BANDS * ROWS
    factors, salts = _functions(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, _HELD // n)
    for at in range(0, len(found), step):
        x = (found[None, at : at + step] ^ salts[:, None]) * factors[:, None]
        least = np.minimum(least, x.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets is 4/5 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _linked(pairs: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """Those of the n pairs (a, b) of sets that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            known: dict[int, np.ndarray] = {}
            keep = []
            for a, b, s, t in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), utf8(x, "s"), utf8(x, "t"), strict=True):
                for k, text in ((a, s), (b, t)):
                    if k not in known:
                        known[k] = shingles(text)
                keep.append(alike(known[a], known[b]))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # A pair is 16 bytes and costs two texts: left alone, all of them would be one or two tasks.
    tasks = min(-(-n // PAIRS), max(partitions(pairs.sparkSession), -(-n // MOST_PAIRS)))
    dealt = pairs.repartition(max(1, tasks))
    both = dealt.join(texts.select(F.col("key").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    """(key): the sets in pairs."""
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def _texts(d: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of these sets."""
    needed = keys.join(sets.select("key", "doc_key"), "key")
    return cut(d.select("doc_key", "text").join(needed, "doc_key").groupBy("key").agg(F.first("text").alias("text")), "texts")


def _by_simhash(sets: DataFrame) -> DataFrame:
    """(a, b): pairs that connect all sets whose fingerprints are equal or in each other's ball."""
    leads = cut(sets.groupBy("fp").agg(F.min("key").alias("lead")), "leads")
    of = lambda name: leads.select(F.col("fp").alias(name), F.col("lead").alias(f"lead_{name}"))
    near = ball_links(leads, leads.count()).join(of("a"), "a").join(of("b"), "b")
    near = near.select(F.least("lead_a", "lead_b").alias("a"), F.greatest("lead_a", "lead_b").alias("b"))
    same = sets.select("fp", "key").join(leads, "fp").where("key > lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    return near.union(same).distinct()


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, key, size, at, component) of the sets in bands that hold several components."""
    own = members.join(found.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "size", "at", F.coalesce("component", "key").alias("component"))
    own = cut(own, "labelled")
    several = own.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("band")
    return own.join(several, "band", "left_semi")


def _pairs(labelled: DataFrame, centres: DataFrame, tested: DataFrame) -> DataFrame:
    """(a, b): members of bands with those centres of these bands that are of another component, but for tested ones and
    those that cannot share 4/9 of their shingles together: before the places ``at`` in both they share none."""
    c = centres.select("band", F.col("key").alias("x"), F.col("size").alias("length"), F.col("at").alias("place"), F.col("component").alias("other"))
    shared = 1 + F.least(F.col("size") - F.col("at"), F.col("length") - F.col("place"))
    apart = (F.col("component") != F.col("other")) & (9 * shared >= 4 * (F.col("size") + F.col("length")))
    apart = labelled.alias("m").join(c.alias("c"), (F.col("m.band") == F.col("c.band")) & apart)
    return apart.select(F.least("key", "x").alias("a"), F.greatest("key", "x").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")


def _leasts(labelled: DataFrame) -> DataFrame:
    """(band, key, size, at, component) of the least set of each band."""
    return labelled.groupBy("band").agg(F.min(F.struct("key", "size", "at", "component")).alias("c")).select("band", "c.*")


def _outside(labelled: DataFrame) -> DataFrame:
    """(band, key, size, at, component) of the sets that are not in their band's most frequent component."""
    main = labelled.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    return labelled.join(main, "band").where("component <> main").select("band", "key", "size", "at", "component")


def _several(members: DataFrame, least: int = 2) -> DataFrame:
    """The members of bands that have so many."""
    return members.join(members.groupBy("band").agg(F.count("*").alias("n")).where(f"n >= {least}").select("band"), "band", "left_semi")


def _rare(d: DataFrame, sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, size, band, at) of these sets: the first fifth of a set's shingles, and one more, rarest first, but for those that no
    other of them holds. ``band`` is the shingle, ``at`` its place in the order of the whole set."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t) for t in utf8(b)]
            own = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(s) for s in found], pa.int64()), own], ["key", "size", "own"])

    own = _texts(d, sets, keys).mapInArrow(split, "key long, size long, own array<long>")
    own = cut(own.select("key", "size", F.explode("own").alias("band")), "shingles")
    shared = own.join(own.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band")
    one = Window.partitionBy("key")
    at = F.col("size") - F.count("*").over(one) + F.row_number().over(one.orderBy("n", "band"))
    return cut(shared.select("key", "size", "band", at.alias("at")).where("5 * (at - 1) <= size"), "rare")


def _joined(d: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of the sets that have near-duplicates."""
    tested, n = cut_counted(_by_simhash(sets), "pairs")
    links = cut(_linked(tested, n, _texts(d, sets, _ends(tested))), "links")
    found = components(links)

    def compare(labelled: DataFrame, centres: DataFrame) -> None:
        nonlocal tested, links, found
        pairs, n = cut_counted(_pairs(labelled, centres, tested), "pairs")
        if n:
            tested = tested.union(pairs)
            links = links.union(cut(_linked(pairs, n, _texts(d, sets, _ends(pairs))), "links"))
            found = components(links)

    members = cut(_several(sets.select("key", "size", F.lit(1).alias("at"), F.explode("bands").alias("band"))), "band-members")
    labelled = _labelled(members, found)
    compare(labelled, _leasts(labelled))
    # Both sets of a band of two have now been compared.
    clouds = _labelled(_several(members, 3), found)
    keys, n = cut_counted(clouds.select("key").distinct(), "cloud")
    if n:
        members = _several(_rare(d, sets, keys))
        labelled = _labelled(members, found)
        compare(labelled, _leasts(labelled))
        labelled = _labelled(members, found)
        compare(_outside(labelled), labelled)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, component_id): component_id is the smallest doc_id of the documents reachable over near-duplicates."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in utf8(b)]
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            found = [bands(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [b.column("doc_id"), b.column("doc_key"), pa.array(keys), sizes, pa.array(fp), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_key", "key", "size", "fp", "bands"])

    least = -(1 << 63)
    d = documents(docs, id_col, text_col)
    own = cut(d.mapInArrow(sign, "doc_id long, doc_key long, key long, size long, fp long, bands array<long>"), "signatures")
    own = own.withColumn("n", F.coalesce("doc_id", F.lit(least)))
    sets = cut(own.groupBy("key").agg(F.min("n").alias("rep"), F.min("doc_key").alias("doc_key"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
    found = _joined(d, sets)
    reps = sets.select("key", "rep").join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    firsts = reps.groupBy("component").agg(F.min("rep").alias("c"))
    named = reps.join(firsts, "component").select("key", "c")
    return own.join(named, "key").select("doc_id", "doc_key", F.when(F.col("c") != least, F.col("c")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document of the smallest doc_id, with all its columns; of several rows of that id the
    one of the least doc_key, once."""
    found = near_duplicates(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Two texts of one doc_id may lead different components.
    keepers = found.groupBy("component_id").agg(F.min("doc_key").alias("doc_key")).select("doc_key")
    names = tuple(docs.columns)
    own = documents(docs, id_col, text_col, names).select("doc_key", *(f"_{i}" for i in range(len(names))))
    once = own.join(keepers.distinct(), "doc_key").groupBy("doc_key").agg(*(F.first(f"_{i}").alias(f"_{i}") for i in range(len(names))))
    return once.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
