"""Best-fit packing of tokenized documents, with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens, dealt to partitions of bounded size
and packed there by best-fit decreasing. A dual-feasible-function lower bound on the partition's own
pieces certifies its bin count when the two are equal. Partitions with a gap give up the pieces
of their bins that are not full; those are dealt anew among them and packed again, until all is
certified or no bin is saved.

Null and empty texts are documents of the end id alone. Every row is packed, repeated rows too.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, documents, table

CAPACITY, END_ID = 4096, 1
#: Pieces a partition holds on average; its packing is done in one task.
PART_PIECES = 100_000
#: Bytes of texts that are encoded at once, rows of them whose ids are put together at once.
TEXT_BYTES, ROWS = 16 << 20, 500
#: Words that a worker remembers at most, each of so many bytes at most.
CACHED_WORDS, CACHED_LENGTH = 1_000_000, 64


def taken(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the sequences that lie in ``flat`` one after the other, those of ``index``, and their lengths."""
    n = lengths[index]
    starts, before = (np.cumsum(lengths) - lengths)[index], np.cumsum(n) - n
    return flat[np.repeat(starts - before, n) + np.arange(int(n.sum()))], n


class Encoder:
    """Little-endian uint32 ids of texts.

    The tokenizer drops white space and looks at nothing across it, so the ids of the chunks between spaces and
    line ends make up those of a text. A chunk of plain Latin letters and ASCII marks after them is two of the
    tokenizer's words, whatever its case. Arrow finds a batch's distinct chunks and words; only words that are not
    remembered go to the tokenizer, many in one text, where the token that ends a word tells them apart.
    """

    PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿŒœŸß]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
    WORD = r"^([a-zà-öø-ÿœß]+|[!-&(-/:-@\[-`{-~]+)$"

    def __init__(self, tokenizer_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.known, self.ids, self.lengths = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words, and how many each has."""
        ids, lengths = array("I"), []
        for at in range(0, len(words), 4000):
            for e in self.tokenizer.encode_batch_fast(words[at : at + 4000], add_special_tokens=False):
                ids.extend(e.ids)
                lengths.append(len(e.ids))
        return np.array(ids, "<u4"), np.array(lengths, np.int64)

    def joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``one_by_one`` of what are single words to the tokenizer."""
        ids = array("I")
        for at in range(0, len(words), 500):
            for e in self.tokenizer.encode_batch_fast([" ".join(words[at : at + 500])], add_special_tokens=False):
                ids.extend(e.ids)
        flat = np.array(ids, "<u4")
        ends = np.flatnonzero(self.ends[flat]) + 1
        # Every word has one end at least, so as many ends as words are one for each.
        return (flat, np.diff(ends, prepend=0)) if len(ends) == len(words) else self.one_by_one(words)

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after the other, and how many each has."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        single = pc.match_substring_regex(new, self.WORD)
        new = pa.concat_arrays([new.filter(single), new.filter(pc.invert(single))])
        n = pc.sum(single).as_py() or 0
        found = self.joined(new[:n].to_pylist()), self.one_by_one(new[n:].to_pylist())
        known = pa.concat_arrays([self.known, new])
        ids, lengths = (np.concatenate(x) for x in ((self.ids, found[0][0], found[1][0]), (self.lengths, found[0][1], found[1][1])))
        flat, own = taken(ids, lengths, pc.index_in(words, value_set=known).to_numpy())
        if len(known) > CACHED_WORDS:
            known, ids, lengths = words, flat, own
        short = pc.less_equal(pc.binary_length(known), CACHED_LENGTH).to_numpy(zero_copy_only=False)
        short[CACHED_WORDS:] = False
        self.ids, self.lengths = (ids, lengths) if short.all() else taken(ids, lengths, np.flatnonzero(short))
        self.known = known if short.all() else known.filter(pa.array(short))
        return flat, own

    def encoded(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; none is null."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        starts, chunks = split.offsets.to_numpy(), split.values.dictionary_encode()
        distinct, at = chunks.dictionary, chunks.indices.to_numpy()
        parts = pc.extract_regex(distinct, self.PLAIN)
        letters, marks = (pc.struct_field(parts, i) for i in (0, 1))
        words = pa.concat_arrays([pc.coalesce(pc.utf8_lower(letters), distinct), pc.coalesce(marks, pa.scalar(""))]).dictionary_encode()
        both = words.indices.to_numpy().reshape(2, -1).T.ravel()  # a chunk's two words, chunk after chunk
        flat, n = taken(*self.of_words(words.dictionary), both)
        n = n.reshape(-1, 2).sum(axis=1)
        for k in range(0, len(texts), ROWS):
            own = starts[k : k + ROWS + 1]
            ids, each = taken(flat, n, at[own[0] : own[-1]])
            ends = np.concatenate(([0], np.cumsum(each)))[own - own[0]].tolist()
            yield from (ids[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False))

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(self.encoded(pa.array(texts, pa.string())))


@lru_cache(2)
def encoder(tokenizer_file: str) -> Encoder:
    """One for each worker process: its next task finds the words of the last."""
    return Encoder(tokenizer_file)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about TEXT_BYTES."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > TEXT_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(b)
        size += b.nbytes
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_key, piece, start, length, ids_crc32[, ids]) of each text's pieces; ids are bytes of uint32."""
    names = ["doc_id", "doc_key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer_file), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in gathered(batches):
            rows = []
            for d, k, ids in zip(b.column("doc_id").to_pylist(), b.column("doc_key").to_pylist(), encode.encoded(b.column("text")), strict=True):
                ids += end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((d, k, n, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which must descend, and the fill of each bin."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, n = 0, 0  # bit g: some bin has a gap of g
    bins, offsets, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, x in enumerate(lengths.tolist()):
        if fitting := open_gaps >> x:
            gap = x + (fitting & -fitting).bit_length() - 1
            b = stacks[gap].pop()
            if not stacks[gap]:
                open_gaps ^= 1 << gap
        else:
            gap, b, n = capacity, n, n + 1
            fills.append(0)
        bins[i], offsets[i] = b, capacity - gap
        fills[b] += x
        stacks[gap - x].append(b)
        open_gaps |= 1 << gap - x
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 60) -> int:
    """The largest bound that two families of dual feasible functions give on the bins of ``lengths``.

    One rounds what is over C - e up to C and what is under e down to 0, for every length e up to C/2;
    the other, for each k, rounds x to floor((k+1) x / C) kths of C (x itself if the division is whole).
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity, most_k)


def bound_of_counts(counts: np.ndarray | dict[int, int], capacity: int, most_k: int = 60) -> int:
    """``lower_bound`` of so many pieces of each length."""
    count = np.array([counts.get(i, 0) for i in range(capacity + 1)], np.int64) if isinstance(counts, dict) else counts
    x = np.arange(capacity + 1)
    upto, total = np.cumsum(count), np.cumsum(count * x)
    e = x[1 : capacity // 2 + 1]
    middle = total[capacity - e] - total[e - 1]
    best = int(max((upto[-1] - upto[capacity - e] - (-middle // capacity)).max(initial=0), -(-total[-1] // capacity)))
    for k in range(1, most_k + 1):
        whole = (k + 1) * x % capacity == 0
        scaled = int((count * np.where(whole, k * x, (k + 1) * x // capacity * capacity)).sum())
        best = max(best, -(-scaled // (capacity * k)))
    return best


PLACED = "doc_id long, doc_key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap long, certified boolean"


def _packed(items: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["length", "doc_id", "doc_key", "piece"], ascending=[False, True, True, True], kind="stable")
        lengths = f["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit(lengths, capacity)
        f["sequence_id"] = (number << 56) + (int(key[0]) << 28) + bins
        f["offset"], f["gap"] = offsets, capacity - fills[bins]
        f["certified"] = len(fills) <= lower_bound(lengths, capacity)
        return f[[c.split()[0] for c in PLACED.split(", ")]]

    own = [c.split()[0] for c in PLACED.split(", ")][:6]
    dealt = items.select(*own, F.pmod(F.xxhash64(F.lit(number), "doc_key", "piece"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(run, PLACED)


def pack(items: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> DataFrame:
    """Places ``pieces``: adds sequence_id, offset, and whether a lower bound certified its partition's count.

    A round takes the bins with a gap of partitions that are not certified, and of the others the bins
    with a wide gap (their last ones), as long as the bound over all pieces allows for fewer bins.
    """
    def number_of_bins(df: DataFrame) -> int:
        return df.where("offset = 0 and length > 0").count()

    lengths = dict(items.groupBy("length").count().collect())  # capacity + 1 rows at most
    n = sum(lengths.values())
    bound = bound_of_counts(lengths, capacity)
    placed = cut(_packed(items, 0, max(1, -(-n // part_pieces)), capacity), "packed-0")
    done: list[DataFrame] = []
    bins = number_of_bins(placed)
    for r in count(1):
        if bins <= bound:
            break
        pooled = f"gap > 0 and (not certified or gap >= {capacity // 16})"
        gaps = placed.where(pooled)
        left = gaps.count()
        if not left:
            break
        again = cut(_packed(gaps, r, max(1, -(-left // part_pieces)), capacity), f"packed-{r}")
        saved = number_of_bins(gaps) - number_of_bins(again)
        if saved <= 0:
            break
        bins -= saved
        done.append(placed.where(f"not ({pooled})"))
        placed = again
    for d in done:
        placed = placed.unionByName(d)
    return placed


def packed(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """The pieces of ``docs`` and their places."""
    import public_tokenizers

    items = cut(pieces(docs, tokenizer_file or public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(items).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
