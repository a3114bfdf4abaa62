"""Token counts under a unigram segmentation, by dynamic programming shared over a trie.

A pre-token is a word with the word-start mark before it. Its token count is the length of its most probable
segmentation into vocabulary pieces (ties: fewer tokens). The forward score of a prefix depends on the prefix alone, so
distinct pre-tokens are inserted in a trie and every trie node holds the forward score and count of its prefix, computed
once; a word's count is stored at its terminal. Characters outside the vocabulary fall back to one token per UTF-8 byte.

The vocabulary is that of a SentencePiece file. Such BPE files give merge ranks and no probabilities; the pieces'
log-probabilities are set by a Zipf-Mandelbrot rule over the rank, p(r) ~ 1 / (r + 2.7).

The trie is built over a batch's new pre-tokens; its terminals' counts stay with the Python worker for later batches, until there are ``MAX_WORDS``, when they start anew. That bounds memory and changes no
result. No data moves between tasks.

Defined cases: null, empty and blank texts have no pre-tokens and 0 tokens; repeated rows are counted each.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MAX_WORDS = 1_000_000
#: Documents whose new pre-tokens share a trie.
BATCH = 1024
#: A byte token's log-probability lies so far below the rarest piece's.
BYTE_PENALTY = 10.0


def vocabulary(model_file: str) -> dict[str, float]:
    """Piece -> log-probability, from a SentencePiece file; control, byte and padding pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(sp))]
    pieces = [p for i, s in enumerate(special) if not s and (p := sp.id_to_piece(i))]
    total = math.log(math.fsum(1 / (r + 2.7) for r in range(len(pieces))))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(pieces)}


class Trie:
    """Token counts of distinct pre-tokens; the forward score of every trie node is computed once.

    Pre-tokens are inserted in sorted order, which visits the trie depth first: all that is open at any time is the path
    to the last word, and a word shares with it the nodes of their common prefix. So one stack of (score, count) holds
    all nodes that can still be shared; ``terminal`` keeps the count of every word inserted.
    """

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.terminal: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Store the token count of each of ``words`` (ascending, distinct, without their mark)."""
        get, longest, byte, terminal = self.scores.get, self.longest, self.byte, self.terminal
        score, count, last = [0.0], [0], ""
        for word in words:
            text = MARK + word
            k, top = 0, min(len(text), len(last))
            while k < top and text[k] == last[k]:
                k += 1
            del score[k + 1 :], count[k + 1 :]
            for j in range(k + 1, len(text) + 1):
                width = 1 if text[j - 1] < "\x80" else len(text[j - 1].encode("utf-8", "surrogatepass"))
                best, n = score[-1] + byte * width, count[-1] + width
                for i in range(j - longest if j > longest else 0, j):
                    s = get(text[i:j])
                    if s is not None:
                        s += score[i]
                        if s > best or s == best and count[i] + 1 < n:
                            best, n = s, count[i] + 1
                score.append(best)
                count.append(n)
            terminal[word] = count[-1]
            last = text


_tries: dict[str, Trie] = {}


def _trie(model_file: str) -> Trie:
    if model_file not in _tries:
        _tries[model_file] = Trie(vocabulary(model_file))
    return _tries[model_file]


def count_texts(texts: list[str | None], trie: Trie) -> tuple[list[int], list[int]]:
    """(pre-tokens, tokens) of each text."""
    found = [WORD.findall(t) if t else [] for t in texts]
    if len(trie.terminal) > MAX_WORDS:
        trie.terminal.clear()
    terminal = trie.terminal
    trie.insert(sorted({w for x in found for w in x if w not in terminal}))
    return [len(x) for x in found], [sum(map(terminal.__getitem__, x)) for x in found]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_file)
        for b in batches:
            words, tokens = [], []
            for k in range(0, b.num_rows, BATCH):
                part = count_texts(b.column("text").slice(k, BATCH).to_pylist(), trie)
                words += part[0]
                tokens += part[1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_pretokens", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")
