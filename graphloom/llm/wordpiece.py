"""Token counts by a linear longest-match automaton: a vocabulary trie with failure links and precomputed counts of popped pieces."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import kept_in_worker, slices, tidy, utf8

MAX_VOCABULARY_BYTES = 64 << 20
MEMORY_WORDS = 1_000_000
#: The unknown flag of a word's entry stands above its count.
UNKNOWN = 1 << 40


class PieceCounter:
    """Greedy word-piece lengths of words given as bytes, without building the pieces.

    ``first`` holds pieces that may begin a word, ``rest`` those that may follow. An empty piece in ``first`` begins a word that no
    other does, and counts as one. A word that can't be covered counts as one unknown piece.
    Every byte is read once; each failure step gives up at least one byte of the pending prefix, so time is linear in the word.
    """

    def __init__(self, first, rest):
        self.child: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, words in ((0, first), (1, rest)):
            for w in words:
                at = root
                for b in w:
                    if (to := self.child[at].get(b)) is None:
                        to = self.child[at][b] = len(self.child)
                        self.child.append({})
                        piece.append(False)
                    at = to
                piece[at] |= at > 1
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        if b"" in first:
            self.fail[0], self.popped[0] = 1, 1
        level = [0, 1]
        while level:  # by depth, so that links of shorter prefixes are known
            below = []
            for at in level:
                for b, to in self.child[at].items():
                    below.append(to)
                    if piece[to]:
                        self.fail[to], self.popped[to] = 1, 1
                        continue
                    z, n = self.fail[at], self.popped[at]
                    while z >= 0 and b not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[to], self.popped[to] = self.child[z][b], n
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 + UNKNOWN if it can't be covered, 0 if it is empty."""
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for b in word:
            while (to := child[at].get(b)) is None:
                n += popped[at]
                if (at := fail[at]) < 0:
                    return 1 + UNKNOWN
            at = to
        while at > 1:
            n += popped[at]
            if (at := fail[at]) < 0:
                return 1 + UNKNOWN
        return n


def pieces_of(path: str) -> tuple[list[bytes], list[bytes]]:
    """A byte-level vocabulary read as word pieces: those that begin with a space may begin a word (the space alone as an empty piece), the others may follow."""
    from graphloom.llm.bpe import _byte_symbols

    to_byte = {s: b for b, s in enumerate(_byte_symbols())}
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file of {len(text)} characters; at most {MAX_VOCABULARY_BYTES} are broadcast")
    spec = json.loads(text)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    plain = [bytes(to_byte[c] for c in s) for s in spec["model"]["vocab"] if s not in special]
    return [p[1:] for p in plain if p[:1] == b" " and not set(p[1:]) & set(b" \t\n\v\f\r")], [p for p in plain if p and not set(p) & set(b" \t\n\v\f\r")]


def token_counts(docs: DataFrame, first: list[bytes], rest: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text; words are runs of anything but space and \\x09-\\x0D.

    Null and empty texts count nothing; repeated rows are counted each; other columns are left out, so their names can't clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast((first, rest))

    def work(batches):
        counter = kept_in_worker("pieces", shared.value, lambda: PieceCounter(*shared.value))
        memory: dict[bytes, int] = {}
        for batch in slices(batches, 1):
            n_words, n_tokens, n_unknown = [], [], []
            for t in utf8(batch.column(1)):
                words = t.split()  # bytes split at exactly these characters
                try:
                    total = sum(map(memory.__getitem__, words))
                except KeyError:
                    new = set(words).difference(memory)
                    if len(memory) + len(new) > MEMORY_WORDS:
                        memory.clear()
                        new = set(words)
                    memory.update((w, counter.count(w)) for w in new)
                    total = sum(map(memory.__getitem__, words))
                n_words.append(len(words))
                n_tokens.append(total % UNKNOWN)
                n_unknown.append(total // UNKNOWN)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(tidy(work), "doc_id long, n_words long, n_tokens long, n_unknown long")
