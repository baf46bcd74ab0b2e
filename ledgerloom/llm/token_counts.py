"""Token counts of a unigram tokenizer, without making the tokens.

The best cut of a text is the one with the largest sum of piece scores (Viterbi). All pieces that end
at a character come from an Aho-Corasick automaton over the vocabulary; the dynamic programme carries
the best score and the number of pieces, and no way back. Ties and unknown characters are treated as
the tokenizers library's Unigram model does:

* of equal sums, the one whose last piece begins first wins;
* a character that is no piece itself may be unknown, at the lowest score less 10;
* unknown characters become one piece for each byte if the vocabulary has byte pieces, else a run of
  them is one piece.

No piece goes on after a space, so a text is cut at its spaces and each word is solved once as long
as it is remembered. With whole-number scores, as in the given vocabulary, sums are exact and the cut
at spaces changes nothing.
"""

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import small_batches

SPACE = "▁"  # fixed: how the vocabulary writes a space
UNKNOWN_PENALTY = 10.0  # fixed: the library's
REMEMBERED = 1 << 18  # words whose counts a task remembers


class Vocabulary:
    """Counts pieces for a list of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        if not pieces:
            raise ValueError("the vocabulary is empty")
        self.automaton = ahocorasick.Automaton()
        last = {}
        for piece, score in pieces:
            if piece:
                last[piece] = float(score)
        for piece, score in last.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{i:02X}>" in last for i in range(256))
        crossing = any(SPACE in piece.lstrip(SPACE) for piece in last)
        self.cut_at_spaces = SPACE in last and not crossing
        self.memory = {}

    def _solve(self, text):
        """(score, pieces) of the best cut."""
        n = len(text)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        run, single = [False] * (n + 1), bytearray(n + 1)
        best[0] = 0.0
        unknown, by_bytes, done = self.unknown, self.by_bytes, 0

        def close(end):
            """All pieces that end here are in: allow for an unknown character."""
            if not single[end]:
                score = best[end - 1] + unknown
                if score > best[end]:
                    best[end] = score
                    if by_bytes:
                        count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
                    else:
                        count[end] = count[end - 1] + (not run[end - 1])
                    run[end] = True

        # The longest piece of an end comes first, so the first of equal sums begins first.
        for at, (size, piece_score) in self.automaton.iter(text):
            end = at + 1
            while done < at:
                done += 1
                close(done)
            score = best[end - size] + piece_score
            if score > best[end]:
                best[end], count[end], run[end] = score, count[end - size] + 1, False
            if size == 1:
                single[end] = 1
        while done < n:
            done += 1
            close(done)
        return best[n], count[n]

    def _of_unit(self, unit):
        found = self.memory.get(unit)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            found = self.memory[unit] = self._solve(unit)
        return found

    def count(self, text: str | None):
        """(score, pieces) of a whole text; null and empty texts have no pieces."""
        if not text:
            return 0.0, 0
        if not self.cut_at_spaces:
            return self._solve(SPACE + text.replace(" ", SPACE))
        score, pieces, spaces = 0.0, 0, SPACE
        parts = text.split(" ")
        last = len(parts) - 1
        for i, part in enumerate(parts):
            if part:
                one = self._of_unit(spaces + part)
                score, pieces, spaces = score + one[0], pieces + one[1], SPACE
            elif i < last:
                spaces += SPACE
        if not parts[-1]:
            one = self._of_unit(spaces)
            score, pieces = score + one[0], pieces + one[1]
        return score, pieces


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def _vocabulary(path):
    return Vocabulary(read_pieces(path))


def counted(text: Column, path: str) -> Column:
    """Struct (score, n_tokens) of a text column."""

    @F.arrow_udf("struct<score: double, n_tokens: bigint>")
    def of(texts: pa.Array) -> pa.Array:
        vocabulary = _vocabulary(path)
        rows = [vocabulary.count(t.as_py()) for t in texts]
        fields = [
            pa.array([r[0] for r in rows], pa.float64()),
            pa.array([r[1] for r in rows], pa.int64()),
        ]
        return pa.StructArray.from_arrays(fields, names=["score", "n_tokens"])

    return of(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_tokens, score) for each row of `docs`.

    `path` is a sentencepiece model file on every executor; its pieces and scores are read as a
    unigram vocabulary, with one space added before the text. Null and empty texts have 0 tokens and
    the score 0. Repeated rows stay; other columns of `docs` play no part.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), counted(F.col(text_col), path).alias("_found")).select(
        id_col, "_found.n_tokens", "_found.score"
    )
