"""Byte-level BPE: speculate with greedy longest matches, verify all adjacent pairs at once, merge exactly what fails."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graphloom.llm.common import extended, kept_in_worker, slices, tidy

#: The pre-tokenizer's pattern, a fixed value of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary file is broadcast; one beyond this size is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters from which a text is worked on in runs.
LONG_TEXT = 1 << 20
#: Bytes of text whose words are held as Python strings at a time.
SLICE_BYTES = 3 << 20
#: The same where the ids of these texts go out too.
ID_SLICE_BYTES = 1 << 20
#: Distinct words that a worker remembers before it starts afresh.
MEMORY_WORDS = 350_000
#: Between words while all are matched at once; no byte stands for it.
SEPARATOR = "\u0100"

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACE = " \\t\\n\\r\\x0b\\x0c"
_UNUSUAL = re.compile("[^\u0000-\u007fÀ-ÖØ-öø-ɏ]")
_QUICK = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^{_SPACE}{_LATIN}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WHOLE = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"[^\p{White_Space}", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})"))


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def token_bytes(spec: dict) -> list[bytes]:
    """The bytes of every token id of a tokenizer file."""
    to_byte = {s: b for b, s in enumerate(_byte_symbols())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
    for s, i in spec["model"]["vocab"].items():
        out[i] = s.encode() if s in special else bytes(to_byte[c] for c in s)
    for s, i in special.items():
        out[i] = s.encode()
    return out


def decoded_text(of: list[bytes], ids: Iterable[int]) -> str:
    return b"".join([of[i] for i in ids]).decode("utf-8", errors="replace")


class BpeModel:
    """A vocabulary with merges, read from the JSON text of a byte-level BPE tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = token_bytes(spec)
        size = len(self.bytes_of)
        self.byte_id = [vocab[s] for s in _byte_symbols()]
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), (r, z))
            if self.rank[z] < 0 and x != z:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.span = size
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            b = self.bytes_of[i]
            if b and self.merge_exactly(b) == [i]:  # else no merge leads to it
                self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.id_text = [*map(str, range(size))]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merges by rank, then from the left: by rescanning a short word, with a heap over linked pieces for a long one."""
        ids: list[int] = [self.byte_id[b] for b in word]
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merge.get, (1 << 60, -1)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) is not none:
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        merge = self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = z, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merge.get((z, ids[k])):
                    heapq.heappush(heap, (m[0], i, z, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, ids[h], z, m[1]))
        return [x for x in ids if x >= 0]

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches from the left in every word: tokens, and the word that each belongs to."""
        joined = SEPARATOR.join([w.decode("latin-1") for w in words])
        ends, tokens = [], []
        for end, token in self.automaton.iter_long(joined):
            ends.append(end)
            tokens.append(token)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        return np.array(tokens, np.int64), np.searchsorted(starts, np.array(ends, np.int64), side="right") - 1

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.span + y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max) if len(self.pair_keys) else np.full(len(x), np.iinfo(np.int64).max)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of neighbours: whether merging their bytes by rank leaves this boundary standing.

        The merges that built both tokens are undone, latest first (of equal ones the right first, as merging goes from the left).
        The pieces at the boundary stood side by side until the merge just undone: theirs must not have come earlier.
        """
        ok = np.ones(len(x), bool)
        live = np.arange(len(x))
        x, y = x.astype(np.int64), y.astype(np.int64)
        until = np.full(len(x), np.iinfo(np.int64).max)
        while len(live):
            bad = self._pair_rank(x, y) < until
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            on_left = rx > ry
            until = np.where(on_left, rx, ry + 1)
            x, y = np.where(on_left, self.right[x], x), np.where(on_left, y, self.left[y])
        return ok

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of every word; only those with an incompatible pair are merged anew."""
        flat, owner = self.propose(words)
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        ids = flat.tolist()
        out = [ids[i:j] for i, j in zip(bounds, bounds[1:])]
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inside[~self.compatible(flat[inside], flat[inside + 1])]
        for w in np.unique(owner[bad]).tolist():
            out[w] = self.merge_exactly(words[w])
        return out


class BpeCoder:
    """Encodes and decodes texts with a memory of words."""

    def __init__(self, model: BpeModel, memory_words: int = MEMORY_WORDS):
        self.model, self.limit = model, memory_words
        self.memory: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Word lists of bounded length, each with the special token after it or None."""
        parts = self.model.split_special.split(text) if self.model.split_special and any(s in text for s in self.model.special) else [text]
        for k in range(0, len(parts), 2):
            pattern = _WHOLE if _UNUSUAL.search(parts[k]) else _QUICK
            if len(parts[k]) < LONG_TEXT:
                yield pattern.findall(parts[k]), None
            else:
                found = (m[0] for m in pattern.finditer(parts[k]))
                while some := list(islice(found, 100_000)):
                    yield some, None
            if k + 1 < len(parts):
                yield [], self.model.special[parts[k + 1]]

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.memory]
        if len(self.memory) + len(new) > self.limit:
            self.memory.clear()
            new = list(dict.fromkeys(words))
        self.memory.update(zip(new, map(self.entry, new, self.model.encode_words([w.encode() for w in new])), strict=True))

    def entry(self, word: str, ids: list[int]):
        return tuple(ids)

    def found(self, texts: list[str]) -> Iterator[list]:
        """For each text the entries of its words, in order. New words of texts of usual length are learnt together."""
        split = [[*self.pieces(t)] if len(t) < LONG_TEXT else None for t in texts]
        new = set().union(*[words for pieces in split if pieces for words, _ in pieces]).difference(self.memory)
        if new:
            self.learn(new)
        for text, pieces in zip(texts, split, strict=True):
            yield self.chain(self.pieces(text) if pieces is None else pieces)

    def chain(self, pieces) -> Iterator[list]:
        for words, special in pieces:
            if special is not None:
                yield [self.entry("", [special])]
            elif words:
                yield self.entries(words)

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        return [[i for run in runs for entry in run for i in entry] for runs in self.found(texts)]

    def entries(self, words: list[str]) -> list:
        try:
            return [*map(self.memory.__getitem__, words)]
        except KeyError:
            self.learn(words)
            return [*map(self.memory.__getitem__, words)]

    def decode(self, ids: Iterable[int]) -> str:
        return decoded_text(self.model.bytes_of, ids)


class PackedCoder(BpeCoder):
    """Remembers a word's ids as the bytes of 32-bit integers, so that the ids of many texts never stand as Python lists."""

    def entry(self, word: str, ids: list[int]):
        return array("i", ids).tobytes()

    def id_lists(self, texts: list[str]) -> pa.ListArray:
        found = [b"".join([b"".join(run) for run in runs]) for runs in self.found(texts)]
        ends = np.cumsum([0] + [len(f) // 4 for f in found])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))

    def texts_of(self, lists: pa.ListArray) -> pa.Array:
        """What each list of ids decodes to; only one list at a time is unpacked."""
        ids, ends = lists.values.to_numpy(), lists.offsets.to_pylist()
        return pa.array((self.decode(ids[i:j].tolist()) for i, j in zip(ends, ends[1:])), pa.string())


class DigestCoder(BpeCoder):
    """Remembers for a word its count, its ids as text and the bytes that these decode to."""

    def entry(self, word: str, ids: list[int]):
        return len(ids), ",".join([self.model.id_text[i] for i in ids]), b"".join([self.model.bytes_of[i] for i in ids])

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        for runs in self.found(texts):
            n, ids_hash, back, begun = 0, hashlib.sha256(), [], False
            for run in runs:
                counts, ids, raw = zip(*run, strict=True)
                n += sum(counts)
                ids_hash.update((("," if begun else "") + ",".join(ids)).encode())
                back.append(b"".join(raw))
                begun = True
            yield n, ids_hash.hexdigest(), hashlib.sha256(b"".join(back).decode("utf-8", errors="replace").encode()).hexdigest()


def _vocabulary(docs: DataFrame, path: str):
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file of {len(text)} characters; at most {MAX_VOCABULARY_BYTES} are broadcast")
    return docs.sparkSession.sparkContext.broadcast(text)


def _model(text: str) -> BpeModel:
    return kept_in_worker("bpe", text, lambda: BpeModel(text))


def _coded(docs: DataFrame, vocabulary_path: str, text: str, made: dict[str, T.DataType], work_on) -> DataFrame:
    """``docs`` with the columns ``made``, which ``work_on(coder, texts)`` gives as arrays for a slice of texts."""
    shared = _vocabulary(docs, vocabulary_path)
    kept = [c for c in docs.columns if c not in made]
    at = kept.index(text)

    def work(batches):
        coder = PackedCoder(_model(shared.value), MEMORY_WORDS // 2)
        for batch in slices(batches, at, ID_SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work_on(coder, [t or "" for t in batch.column(at).to_pylist()])], [*batch.schema.names, *made])

    slim = docs.select(*[docs[f"`{c}`"] for c in kept])
    return slim.mapInArrow(tidy(work), extended(slim.schema, **made))


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", output: str = "token_ids") -> DataFrame:
    """Adds ``output``, the token ids (array of int) of the whole ``text``.

    Null and empty texts have no tokens. Every other column stays as it is, whatever its name; a column already named ``output`` is replaced.
    Repeated rows stay repeated. Very long texts are worked on in runs of 100,000 words.
    """
    return _coded(docs, vocabulary_path, text, {output: T.ArrayType(T.IntegerType())}, lambda coder, texts: [coder.id_lists(texts)])


def round_trip(docs: DataFrame, vocabulary_path: str, text: str = "text", output: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``output``, the token ids of the whole ``text``, and ``decoded``, the text that these ids stand for: ``encode`` and ``decode`` in one step. Null and odd rows are treated as by these."""

    def both(coder: PackedCoder, texts: list[str]):
        ids = coder.id_lists(texts)
        return [ids, coder.texts_of(ids)]

    return _coded(docs, vocabulary_path, text, {output: T.ArrayType(T.IntegerType()), decoded: T.StringType()}, both)


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """Adds ``output``, the text that the array ``ids`` stands for; bytes that are no UTF-8 become U+FFFD. Null or no ids: empty text."""
    shared = _vocabulary(docs, vocabulary_path)
    kept = [c for c in docs.columns if c != output]
    at = kept.index(ids)

    def work(batches):
        of = kept_in_worker("bpe bytes", shared.value, lambda: token_bytes(json.loads(shared.value)))
        for batch in batches:
            column = batch.column(at)
            texts = [decoded_text(of, column[i].as_py() or ()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, output])

    slim = docs.select(*[docs[f"`{c}`"] for c in kept])
    return slim.mapInArrow(tidy(work), extended(slim.schema, **{output: T.StringType()}))


def round_trip_digests(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass. The workers keep their memory of words from task to task."""
    shared = _vocabulary(docs, vocabulary_path)

    def work(batches):
        coder = kept_in_worker("bpe digests", shared.value, lambda: DigestCoder(_model(shared.value)))
        for batch in slices(batches, 1, SLICE_BYTES):
            found = [*coder.digests([t or "" for t in batch.column(1).to_pylist()])]
            n, ids, back = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(tidy(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
