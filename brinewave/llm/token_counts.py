"""Token counts of a unigram vocabulary without tokens: Aho-Corasick and a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a position; the
dynamic program keeps for each position the best score, the number of pieces on the best
path and whether it ends in an unknown piece. No path is stored.

Rules, as in the public unigram tokenizers: blanks become U+2581 and one is put in front;
scores are summed in double precision from the left; of equal sums the piece that starts
first (the longest) wins; a character that is no piece of its own may be unknown at the
lowest score less 10; runs of unknowns are one token, or, with byte pieces, one per byte.

Texts are cut where no piece can reach across: before a blank that follows another character, and around characters in no piece,
if the vocabulary allows it. Counts of such chunks are remembered, up to ``MEMORY`` of
them per task. Scores of the given vocabulary are whole numbers, so sums by chunk are exact.

The vocabulary file is a parameter and is broadcast (some tens of thousands of pieces).
Null and empty texts have no tokens. Empty tables give no rows; repeated rows each get one.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame

from brinewave.llm.common import map_texts

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 200_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """Pieces with scores; ``bytes_known`` if every byte has a piece to fall back on."""

    pieces: list[tuple[str, float]]
    bytes_known: bool
    lowest: float
    automaton: object = field(default=None, repr=False)
    memory: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "automaton": None, "memory": {}}

    def ready(self) -> "Vocabulary":
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for piece, score in self.pieces:
                self.automaton.add_word(piece, (len(piece), score))
            self.automaton.make_automaton()
            known = {c for piece, _ in self.pieces for c in piece}
            self.splits_blank = BLANK in {p for p, _ in self.pieces} and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in self.pieces)
            self.splits_line = "\n" not in known and self.bytes_known
        return self

    def chunk(self, text: str) -> tuple[int, int, float]:
        """(tokens, unknown characters, score) of the best segmentation of a chunk."""
        found = self.memory.get(text)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = self.memory[text] = self._viterbi(text)
        return found

    def _viterbi(self, text: str) -> tuple[int, int, float]:
        n = len(text)
        by_end: list[list | None] = [None] * n
        for end, value in self.automaton.iter(text):
            if by_end[end] is None:
                by_end[end] = [value]
            else:
                by_end[end].append(value)
        lost = self.lowest - UNKNOWN_PENALTY
        best, count, strange, loose = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for i in range(1, n + 1):
            top, start, single = None, i, False
            for size, score in by_end[i - 1] or ():
                total = best[i - size] + score
                if top is None or total > top or (total == top and i - size < start):
                    top, start = total, i - size
                single = single or size == 1
            if not single:
                total = best[i - 1] + lost
                if top is None or total > top:
                    best[i], loose[i], strange[i] = total, True, strange[i - 1] + 1
                    count[i] = count[i - 1] + (len(text[i - 1].encode("utf-8", "surrogatepass")) if self.bytes_known else not loose[i - 1])
                    continue
            best[i], count[i], strange[i] = top, count[start] + 1, strange[start]
        return count[n], strange[n], best[n]

    def count(self, text: str) -> tuple[int, int, float]:
        """(tokens, unknown characters, score) of a text."""
        if not text:
            return 0, 0, 0.0
        tokens = unknown = 0
        score = 0.0
        plain = BLANK + text.replace(" ", BLANK)
        lines = plain.split("\n") if self.splits_line else [plain]
        breaks = len(lines) - 1
        if breaks:
            a, b, c = self.chunk("\n")
            tokens, unknown, score = breaks * a, breaks * b, breaks * c
        for line in lines:
            if not line:
                continue
            for part in _CHUNKS.findall(line) if self.splits_blank else [line]:
                a, b, c = self.memory.get(part) or self.chunk(part)
                tokens += a
                unknown += b
                score += c
        return tokens, unknown, score


_CHUNKS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces and scores of a SentencePiece file, read as a unigram vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in every
              if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return Vocabulary(pieces, sum(model.is_byte(i) for i in every) == 256, min(s for _, s in pieces))


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, keys: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    """(keys, n_tokens, n_unknown, score) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(texts: list[str]) -> dict[str, list]:
        known = shared.value.ready()
        tokens, unknown, score = zip(*[known.count(t) for t in texts])
        return {"n_tokens": tokens, "n_unknown": unknown, "score": score}

    return map_texts(docs, keys, "n_tokens bigint, n_unknown bigint, score double", work, text)
