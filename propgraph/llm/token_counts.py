"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text splits into pre-tokens at spaces; no piece of the vocabulary holds a space after another
character, so the best segmentation of the text is that of its pre-tokens. Distinct pre-tokens go
into a trie. A node keeps the best forward score of its prefix and the tokens on that path, computed
once from its ancestors whatever the number of pre-tokens that share it; the nodes where pre-tokens
end give their counts, which are stored and looked up from then on.

The forward step looks only at pieces that end in the prefix, through a trie of reversed pieces.
Scores are log-probabilities by Zipf's law over the pieces' order in the vocabulary file. A character
in no piece costs the least score less 10 and counts one token a byte. The trie and the stored counts
are dropped when they reach a bound, so memory does not grow with the text; very long pre-tokens are
computed without entering it.

Null and empty texts have no tokens. A null id passes through; repeated rows have equal counts. An
empty table gives no rows. Only the id and text columns are looked at, so names of others do not matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: the mark that stands for a space in the vocabulary.
SPACE = "▁"

NODES = 400_000
LONG = 200
PENALTY = 10.0


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a SentencePiece model with their scores: minus the logarithm of the place among ordinary pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            out[model.id_to_piece(i)] = -math.log(len(out) + 1.0)
    return out


class Counter:
    """The trie of one vocabulary, for one Python worker."""

    def __init__(self, pieces: dict[str, float], nodes: int = NODES):
        self.bound = nodes
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        # the trie of reversed pieces: at None the score of a piece that starts here
        self.reversed: dict = {}
        for piece, score in pieces.items():
            at = self.reversed
            for c in reversed(piece):
                at = at.setdefault(c, {})
            at[None] = score
        apart = not any("\n" in p for p in pieces) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.pattern = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if apart else "(?s).+")
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.counts: dict[str, int] = {}

    def _forward(self, text: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of ``text[:end]`` from those of its prefixes (lists by length)."""
        c = text[end - 1]
        score, count = best[end - 1] + self.unknown, tokens[end - 1] + (1 if c < "\x80" else len(c.encode()))
        at, i = self.reversed.get(c), end - 1
        while at is not None:
            if None in at:
                s = best[i] + at[None]
                if s > score or (s == score and tokens[i] + 1 < count):
                    score, count = s, tokens[i] + 1
            if not i:
                break
            i -= 1
            at = at.get(text[i])
        return score, count

    def count(self, token: str) -> int:
        """Tokens of one pre-token."""
        if len(token) > LONG:
            best, tokens = [0.0], [0]
            for end in range(1, len(token) + 1):
                s, n = self._forward(token, end, best, tokens)
                best.append(s)
                tokens.append(n)
            return tokens[-1]
        if len(self.best) > self.bound:
            self.clear()
        child, node_best, node_tokens = self.child, self.best, self.tokens
        node, best, tokens = 0, [0.0], [0]
        for end, c in enumerate(token, 1):
            after = child.get((node, c))
            if after is None:
                s, n = self._forward(token, end, best, tokens)
                after = len(node_best)
                child[node, c] = after
                node_best.append(s)
                node_tokens.append(n)
            node = after
            best.append(node_best[node])
            tokens.append(node_tokens[node])
        self.counts[token] = tokens[-1]
        return tokens[-1]

    def __call__(self, text: str | None) -> tuple[int, int]:
        """Tokens and pre-tokens of a text."""
        if not text:
            return 0, 0
        own = self.pattern.findall(SPACE + text.replace(" ", SPACE))
        known = list(map(self.counts.get, own))
        if None in known:
            for i, n in enumerate(known):
                if n is None:
                    n = self.counts.get(own[i])
                    known[i] = self.count(own[i]) if n is None else n
        return sum(known), len(own)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(load_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_pretokens`` of every whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            got = [own(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
