"""Word-level BPE by speculation and verification.

A text is split at special tokens and white space; each distinct piece is cut
into words once per worker. For new words a greedy longest match proposes
tokens. The proposal equals the BPE result exactly when no merge would cross
any boundary between neighbours, and that can be decided pair by pair: undo the
latest merge on either side of the boundary step by step, and look whether the
two tokens then touching could have merged earlier. This test runs over arrays
of all distinct neighbour pairs of a batch. Words with a failing pair are merged
exactly with a heap.

Defined cases: a null text counts as empty and has no tokens; very long texts
and very long words are handled whole (heap merging is n log n); documents are
independent, so repeated rows, null ids and ties need no rule; an empty table
gives an empty result. Only the id and text columns are read, so further
columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces and words kept per worker. Past this the later half is dropped: what
#: a worker met early is what it meets often.
CACHED_PIECES = 200_000
#: Words of up to so many characters are merged by scanning instead of a heap.
SHORT_WORD = 48
_END = "\n"  # stands for the end-of-word suffix; byte-level characters never include it
# Separators that str.split() cuts at although they are no Unicode white space.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_characters() -> list[str]:
    """The printable stand-in of every byte value: printable Latin-1 characters
    stand for themselves, all others for 256, 257, ... in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class WordBpe:
    """Tokenizer of one vocabulary file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        self.token_text = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token_text[i] = text
        self.marked = {t.removesuffix(suffix) + _END if t.endswith(suffix) and t != suffix else t: i for t, i in vocab.items()}
        self.starts = {t[:k] for t in self.marked for k in range(1, len(t) + 1)}
        n = len(self.token_text)
        self.left, self.right, self.rank = (np.full(n, -1, np.int64) for _ in range(3))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            made = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = rank, made
            self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], rank
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self._pair_keys = keys[order]
        self._pair_ranks = np.arange(len(keys))[order]
        self._bytes = byte_characters()
        self.sound = self._sound_tokens()
        self._pieces: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    # -- verification -------------------------------------------------------
    def _crossing_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._pair_keys, key), len(self._pair_keys) - 1)
        return np.where(self._pair_keys[at] == key, self._pair_ranks[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: would BPE keep the boundary between them?
        With ``limit``, only merges across the boundary of a lower rank count."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), 1 << 39, np.int64) if limit is None else limit.astype(np.int64)
        while len(live):
            crossed = self._crossing_rank(a, b) < limit
            ok[live[crossed]] = False
            # Undo the later of the two last merges. Of equal merges the left one
            # comes first, so a crossing of the right one's own rank still wins.
            undo_left = self.rank[a] > self.rank[b]
            limit = np.where(undo_left, self.rank[a], self.rank[b] + 1)
            go = ~crossed & (np.maximum(self.rank[a], self.rank[b]) >= 0)
            a, b = np.where(undo_left, self.right[a], a)[go], np.where(undo_left, b, self.left[b])[go]
            live, limit = live[go], limit[go]
        return ok

    def _sound_tokens(self) -> np.ndarray:
        """Tokens that BPE makes of their own characters."""
        sound = self.rank < 0
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        clean = self.compatible(self.left[made], self.right[made], self.rank[made])
        for token, fine in zip(made.tolist(), clean.tolist(), strict=True):
            sound[token] = fine and sound[self.left[token]] and sound[self.right[token]]
        return sound

    # -- encoding -----------------------------------------------------------
    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word whose last character is ``_END``."""
        out, at, n, marked, starts = [], 0, len(word), self.marked, self.starts
        while at < n:
            best, to = None, at
            for end in range(at + 1, n + 1):
                part = word[at:end]
                if part not in starts:
                    break
                if end != n - 1 and part in marked:  # the suffix never stands alone
                    best, to = marked[part], end
            if best is None:
                raise ValueError("a byte is missing in the vocabulary")
            out.append(best)
            at = to
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: lowest rank first, leftmost first among equals."""
        symbols = [self.marked[c] for c in word[:-2]] + [self.marked[word[-2:]]]
        n, merges = len(symbols), self.merges
        if n <= SHORT_WORD:
            pairs = [merges.get(p) for p in zip(symbols, symbols[1:], strict=False)]
            while any(pairs):
                i = min((p[0], i) for i, p in enumerate(pairs) if p)[1]
                symbols[i : i + 2] = [pairs[i][1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = merges.get((symbols[i - 1], symbols[i]))
                if i < len(pairs):
                    pairs[i] = merges.get((symbols[i], symbols[i + 1]))
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := self.merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or self.merges.get((symbols[i], symbols[j]), (0, -1))[1] != made:
                continue
            symbols[i], symbols[j] = made, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (m := self.merges.get((symbols[k], symbols[after[k]]))):
                    heapq.heappush(heap, (m[0], k, m[1]))
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word (in byte characters, ended by ``_END``)."""
        found = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        good = np.ones(len(found), bool)
        good[owner[~self.sound[flat]]] = False
        inner = owner[1:] == owner[:-1]
        pairs, which = np.unique(flat[:-1][inner] << 32 | flat[1:][inner], return_inverse=True)
        keeps = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        good[owner[1:][inner][~keeps[which]]] = False
        for i in np.flatnonzero(~good).tolist():
            found[i] = self.merge(words[i])
        return found

    def _learn(self, pieces: list[str]) -> None:
        cuts = [self.words.findall(p) for p in pieces]
        new = list(set(itertools.chain.from_iterable(cuts)).difference(self._words))
        stand_in = self._bytes
        marked = [(w if w.isascii() and w.isprintable() else "".join([stand_in[b] for b in w.encode()])) + _END for w in new]
        for word, tokens in zip(new, self.encode_words(marked), strict=True):
            self._words[word] = array("I", tokens).tobytes()
        for piece, cut in zip(pieces, cuts, strict=True):
            self._pieces[piece] = b"".join([self._words[w] for w in cut])

    def _segments(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Pieces between white space, special tokens apart."""
        parts = [text]
        if self.cut is not None and "<|" in text:
            parts, at = [], 0
            for m in self.cut.finditer(text):
                parts += [text[at : m.start()], m.group()]
                at = m.end()
            parts.append(text[at:])
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part], []
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            yield None, [p for p in _SPACE.split(part) if p] if _NOT_SPACE.search(part) else part.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text as unsigned 32-bit arrays."""
        for name in ("_pieces", "_words"):
            if len(getattr(self, name)) > CACHED_PIECES:
                setattr(self, name, dict(itertools.islice(getattr(self, name).items(), CACHED_PIECES // 2)))
        cut = [list(self._segments(t)) for t in texts]
        known = self._pieces
        new = set(itertools.chain.from_iterable(pieces for segments in cut for _, pieces in segments)).difference(known)
        if new:
            self._learn(list(new))
        out = []
        for segments in cut:
            parts = []
            for special, pieces in segments:
                if special is not None:
                    parts.append(array("I", [special]).tobytes())
                parts += map(known.__getitem__, pieces)
            out.append(np.frombuffer(b"".join(parts), np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary file names no decoder: token texts joined by spaces."""
        return " ".join(map(self.token_text.__getitem__, ids.tolist()))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """One instance per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


OUTPUTS = {
    "ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string",
}
_STEP = 64  # texts at a time inside an Arrow batch


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """(doc_id, *outputs) for every row: token ids, the text decoded from them,
    and their digests (ids as little-endian unsigned 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                made: dict[str, list] = {name: [] for name in outputs}
                for ids in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    text = bpe.decode(ids)
                    for name, values in made.items():
                        if name == "ids":
                            values.append(ids.astype(np.int32))
                        elif name == "decoded":
                            values.append(text)
                        elif name == "n_tokens":
                            values.append(len(ids))
                        elif name == "ids_sha256":
                            values.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                        else:
                            values.append(hashlib.sha256(text.encode()).hexdigest())
                types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(v, types.get(n, pa.string())) for n, v in made.items()]],
                    names=[id_col, *made],
                )

    read = docs.select(id_col, text_col)
    kind = read.schema[id_col].dataType.simpleString()
    return read.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *[f"{n} {OUTPUTS[n]}" for n in outputs]]))
