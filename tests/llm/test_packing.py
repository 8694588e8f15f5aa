import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from fixtures import awkward, frame
from tokenizers import Tokenizer

from graphloom.llm import packing
from graphloom.llm.common import cut
from graphloom.llm.packing import Encoder, best_fit, lower_bound, pack, pieces

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_equal_the_tokenizer_and_fill_their_sequences(spark):
    t, rows = Tokenizer.from_file(FILE), awkward()
    placed = pack(cut(pieces(frame(spark, rows), FILE), "pieces"), part_pieces=20).collect()
    want = []
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((d, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed], key=str) == sorted(want, key=str)
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= lower_bound(np.array([r.length for r in placed]), 4096) + 1
    assert pack(pieces(frame(spark, []), FILE)).count() == 0


def test_ids_are_kept_on_request(spark):
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in pieces(frame(spark, [(1, "the the")]), FILE, with_ids=True).collect()]
    assert ids == [[*Tokenizer.from_file(FILE).encode("the the", add_special_tokens=False).ids, 1]]


def test_chunks_equal_the_tokenizer():
    t, e, r = Tokenizer.from_file(FILE), Encoder(FILE), random.Random(8)
    letters = list("abzAZéÉñßœŒÿŸøØàÇ'.,!?-_`~|<>{}[]()0 9\n\t\x1c\u00a0İKÅµſ日") + ["e\u0301", "'s", "'LL", "<|endoftext|>", "\r\n", "***", "\u200b"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(20_000)]
    for text, ids in zip(texts, e(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def brute(lengths, capacity):
    """The fewest bins, by search."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_bound_never_exceeds_the_optimum():
    r = random.Random(5)
    for _ in range(150):
        capacity = r.choice([10, 17, 24])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 8))), reverse=True)
        bins, offsets, fills = best_fit(np.array(lengths), capacity)
        least = brute(lengths, capacity)
        assert lower_bound(np.array(lengths), capacity) <= least <= len(fills)
        assert fills.max() <= capacity and sum(fills) == sum(lengths)
    assert lower_bound(np.array([6, 6, 6, 4]), 10) == 3


def test_words_are_encoded_once_and_many_in_one_text(monkeypatch):
    """One text for hundreds of new words, none for known ones; forgetting changes no ids."""
    t, e, sent = Tokenizer.from_file(FILE), Encoder(FILE), []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return t.encode_batch_fast(texts, **more)

    e.tokenizer = Counted()
    texts = [f"{chr(97 + i % 26)}word{chr(97 + i // 26)}... Mixed, ÉTÉ!? {'x' * 70} {i % 9} <|endoftext|>\n" for i in range(300)] + [""]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for cached, most in ((10**6, 12), (10**6, 1), (40, 1), (0, 12), (0, 12)):
        monkeypatch.setattr(packing, "CACHED_WORDS", cached)
        sent.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == want
        assert 0 < len(sent) <= most
        assert len(e.known) <= cached


def test_gathered_batches_keep_rows_and_order(monkeypatch):
    monkeypatch.setattr(packing, "TEXT_BYTES", 300)
    batches = [pa.RecordBatch.from_arrays([pa.array(["abc" * (i % 40)] * (i % 4), pa.string())], ["text"]) for i in range(50)]
    rows = [b.column("text").to_pylist() for b in packing.gathered(iter(batches))]
    assert sum(rows, []) == [x for b in batches for x in b.column("text").to_pylist()]
    assert 3 < len(rows) < 50
