import random

import public_tokenizers
from fixtures import awkward, frame
from tokenizers import Tokenizer, models, pre_tokenizers

from graphloom.llm.token_counts import Counter, piece_vocabulary, token_counts


def tokenizer(vocabulary):
    t = Tokenizer(models.Unigram([("\0none\0", 0.0), *vocabulary], 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizer(spark):
    vocabulary = piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = tokenizer(vocabulary)
    rows = [*awkward(), (80, " lead  and  two"), (81, "▁own ▁▁"), (82, "日本語 字字字 ok"), (83, " "), (84, "a" * 5000)]
    got = token_counts(frame(spark, rows), vocabulary).collect()
    want = [(d, len(t.encode(x or "").ids) if x else 0) for d, x in rows]
    assert sorted([(r.doc_id, r.n_pieces) for r in got], key=str) == sorted(want, key=str)
    assert token_counts(frame(spark, []), vocabulary).count() == 0


def test_ties_and_unknowns_on_random_vocabularies():
    r = random.Random(3)
    for _ in range(60):
        pieces = {"".join(r.choice("ab▁c") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 25))}
        vocabulary = [(p, -float(r.randint(1, 4))) for p in sorted(pieces)]
        # The lowest score sets the unknown's penalty in both.
        t, c = tokenizer(vocabulary), Counter(vocabulary)
        for _ in range(60):
            text = "".join(r.choice("abcd ") for _ in range(r.randint(1, 14)))
            assert c.text(text)[1] == len(t.encode(text).ids), (vocabulary, text)


def test_empty_vocabulary():
    assert Counter([]).text("ab cd") == (2, 2, -60.0)
