"""Token counts of a unigram vocabulary without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary matches of a word; a Viterbi pass over its
ends carries the best score and the number of pieces. Ties go as in the tokenizer: among equal
scores the piece that starts first, the longest, stays. A character that no one-character piece
covers may become unknown at the lowest score less 10; neighbouring unknowns count as one piece.

A word starts at each space, shown as U+2581; a text gets one in front unless it begins with one.
Null and empty texts have no pieces. Equal rows get equal counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import documents, table

SPACE, UNKNOWN_PENALTY = "▁", 10.0
#: Words whose counts a worker remembers at most; then it forgets them all.
CACHED_WORDS, CACHED_LENGTH = 300_000, 64

Vocabulary = list[tuple[str, float]]


def piece_vocabulary(model_file: str) -> Vocabulary:
    """The pieces and scores of a sentencepiece file, less control, unknown and byte pieces."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Counter:
    """Counts pieces of words under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        if vocabulary:
            self.matches.make_automaton()
        self.empty = not len(self.matches)
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, w: str) -> tuple[int, float]:
        n = len(w)
        best: list[float | None] = [0.0] + [None] * n
        pieces, unknown = [0] * (n + 1), [False] * (n + 1)
        found = iter(()) if self.empty else self.matches.iter(w)
        at = next(found, None)
        for end in range(1, n + 1):
            single = False
            while at is not None and at[0] == end - 1:  # the longest match first
                length, score = at[1]
                single |= length == 1
                here = best[end - length] + score
                if best[end] is None or here > best[end]:
                    best[end], pieces[end], unknown[end] = here, pieces[end - length] + 1, False
                at = next(found, None)
            if not single:
                here = best[end - 1] + self.unknown
                if best[end] is None or here > best[end]:
                    best[end], pieces[end], unknown[end] = here, pieces[end - 1] + (not unknown[end - 1]), True
        return pieces[n], best[n]

    def text(self, text: str) -> tuple[int, int, float]:
        """Words, pieces, score."""
        if not text:
            return 0, 0, 0.0
        text = text.replace(" ", SPACE)
        words = (text if text[0] == SPACE else SPACE + text).split(SPACE)[1:]
        pieces, score, seen = 0, 0.0, self.seen
        for w in words:
            got = seen.get(w)
            if got is None:
                got = self.word(SPACE + w)
                if len(w) <= CACHED_LENGTH:
                    if len(seen) >= CACHED_WORDS:
                        seen.clear()
                    seen[w] = got
            pieces += got[0]
            score += got[1]
        return len(words), pieces, score


def token_counts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_pieces, score) of each whole text; no shuffle. ``vocabulary`` goes with the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            rows = [counter.text(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64())))], ["doc_id", "n_words", "n_pieces", "score"])

    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), piece_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
