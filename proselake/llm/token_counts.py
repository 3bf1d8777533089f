"""Token counts under a unigram model: Viterbi that carries only the best score and its number of pieces.

The vocabulary's pieces and scores come from a SentencePiece model file. Aho-Corasick enumerates every piece in a
stretch of text; for each end the dynamic programme keeps the best sum and its count. Of equal sums the one whose last
piece starts first stays, and a character without a piece of its own costs the least score less 10 and as many
tokens as it has UTF-8 bytes: the tokenizer's own rules, with sums that do not round. No piece crosses from another
character into a blank mark, nor holds a line feed, so stretches between them are solved on their own and kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import utf8

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Solved stretches that a worker keeps; beyond it the store starts anew.
KEPT = 400_000
#: Longer stretches are solved but not kept.
KEPT_LENGTH = 64


@dataclass
class Unigram:
    """Pieces with scores, and how to cut and count a text by them."""

    pieces: list[tuple[str, float]]
    byte_fallback: bool = True
    prefix: bool = True
    _tree: object = field(default=None, repr=False)
    _kept: dict = field(default_factory=dict, repr=False)

    @staticmethod
    def load(path: str) -> Unigram:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        pieces = [(m.id_to_piece(i), m.get_score(i)) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return Unigram(pieces, any(m.is_byte(i) for i in ids), m.encode("a", out_type=str)[0].startswith(BLANK))

    def __getstate__(self):
        return {**self.__dict__, "_tree": None, "_kept": {}}

    def _ready(self):
        if self._tree is None:
            tree = ahocorasick.Automaton()
            for piece, score in self.pieces:
                tree.add_word(piece, (len(piece), score))
            tree.make_automaton()
            self._unknown = min(s for _, s in self.pieces) - 10.0
            self._inside = any(BLANK in p.lstrip(BLANK) or "\n" in p for p, _ in self.pieces)
            self._tree = tree
        return self._tree

    def solve(self, stretch: str) -> tuple[float, int]:
        """The best score of a non-empty stretch, blanks as marks, and its number of tokens."""
        tree, unknown = self._ready(), self._unknown
        n = len(stretch)
        best: list = [None] * (n + 1)
        count, begin = [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        at, single = 0, False

        def close(end: int, single: bool) -> None:
            """The unknown piece of the character before ``end``, which starts last of all."""
            if not single and (best[end] is None or best[end - 1] + unknown > best[end]):
                best[end] = best[end - 1] + unknown
                count[end] = count[end - 1] + (len(stretch[end - 1].encode()) if self.byte_fallback else 1)
                begin[end] = end - 1

        for last, (size, score) in tree.iter(stretch):
            end = last + 1
            while at + 1 < end:  # ends that no piece has
                at += 1
                close(at, single)
                single = False
            start = end - size
            got = best[start] + score if best[start] is not None else None
            if got is not None and (best[end] is None or got > best[end] or (got == best[end] and start < begin[end])):
                best[end], count[end], begin[end] = got, count[start] + 1, start
            single = single or size == 1
        while at < n:
            at += 1
            close(at, single)
            single = False
        return best[n], count[n]

    def _count(self, stretch: str) -> int:
        n = self.solve(stretch)[1]
        if len(stretch) <= KEPT_LENGTH:
            if len(self._kept) >= KEPT:
                self._kept.clear()
            self._kept[stretch] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text; none of an empty one."""
        if not text:
            return 0
        self._ready()
        text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if self._inside:
            return self.solve(text)[1]
        kept, total = self._kept, text.count("\n")
        for line in text.split("\n"):
            if BLANK + BLANK in line or line.endswith(BLANK):
                stretches = re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+$", line)
            else:
                first, *others = line.split(BLANK)
                stretches = [BLANK + x for x in others]
                if first:
                    stretches.append(first)
            for x in stretches:
                n = kept.get(x)
                total += self._count(x) if n is None else n
        return total


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long, n_bytes long`` of every row.

    Whole texts are counted, with the tokenizer's blank before the first word. Null and empty texts have no token;
    repeated rows count alike; null ids are carried. Other columns are neither read nor returned.
    """
    held = docs.sparkSession.sparkContext.broadcast(Unigram.load(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value  # one for each worker, with what it has solved
        for batch in batches:
            _, at = utf8(batch.column(1))
            counts = np.fromiter((model.count(t.as_py() or "") for t in batch.column(1)), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(np.diff(at))], names=["doc_id", "n_tokens", "n_bytes"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_bytes long")
