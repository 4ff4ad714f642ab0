"""BPE encoding and decoding (operator 6): speculate and verify.

For every distinct word of a slice a greedy longest match proposes tokens. The proposal is
the word's encoding if every adjacent pair of its tokens is compatible, that is if merging
the two tokens' bytes together would leave the boundary between them alone. All adjacent
pairs of all new words are tested at once by numpy, undoing merges from the latest to the
earliest on both sides of the boundary. Only words with a failing pair undergo exact merging.

The vocabulary file is read on the driver (its path is a parameter) and broadcast: a few MB
whatever the input. Encoded words are kept within a task up to ``KEPT_WORDS``; then the store
starts anew, which costs time and changes nothing else. At the task's end it is given back, so
that idle workers hold the vocabulary only.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import struct
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabletidy.llm.common import map_rows

KEPT_WORDS = 200_000
END = "</w>"
NEVER = 1 << 60

#: Fixed value: the split pattern of the tokenizer's pre-tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: The same for texts of Latin-1 letters, already in lower case.
LATIN_WORD = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \t\n\x0b\x0c\r\x85\xa0a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def pack(ids) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """The vocabulary, its merges as arrays, and the words encoded so far."""

    def __init__(self, spec: dict):
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for name, i in itertools.chain(vocab.items(), self.special.items()):
            self.names[i] = name
        unread = [x["content"] for x in spec["added_tokens"] if any(x.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
        if unread:
            raise ValueError(f"added tokens that look at their surroundings or at normalised text are not supported: {unread}")
        # of two that start at one place the longer one counts
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_alphabet()
        self.to_letters = {b: c for b, c in enumerate(self.letters)}
        size = self.size = len(self.names)
        self.order = np.full(size, -1, np.int64)  # when a token is made; -1: a single symbol
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys = []
        self.made: list[int] = []  # by rank
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys.append(x * size + y)
            self.made.append(z)
            if self.order[z] < 0:
                self.order[z], self.left[z], self.right[z] = rank, x, y
        self.rank_of = {k: rank for rank, k in enumerate(keys)}
        self.pair_ranks = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[self.pair_ranks]
        self.vocab = vocab
        # a token can be proposed if merging its own symbols gives it back
        tokens = [t for t in vocab if t not in self.special]
        sure = [t for t in tokens if self.order[vocab[t]] < 0 or self._whole(vocab[t])]
        self.longest = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.is_end = np.zeros(size, bool)
        for t in sure:
            ends = t.endswith(END) and t != END
            self.is_end[vocab[t]] = ends
            self.longest.add_word(t[: -len(END)] + "\n" if ends else t, vocab[t])
        self.longest.make_automaton()
        self.words: dict[str, bytes] = {}  # a word's tokens as 32-bit numbers

    def _whole(self, token: int) -> bool:
        name = self.names[token]
        last = name.endswith(END)
        return self.exact(name[: -len(END)] if last else name, last) == (token,)

    def exact(self, letters: str, ends: bool = True) -> tuple[int, ...]:
        """Merge the pair of least rank, the leftmost of equals, until no pair merges."""
        ids = [self.vocab[c] for c in letters]
        if ends:
            ids[-1] = self.vocab[letters[-1] + END]
        if len(ids) > 64:
            return self._exact_long(ids)
        size, rank_of, made = self.size, self.rank_of.get, self.made
        ranks = [rank_of(a * size + b, NEVER) for a, b in itertools.pairwise(ids)]
        while ranks and (least := min(ranks)) < NEVER:
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] * size + ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank_of(ids[i] * size + ids[i + 1], NEVER)
        return tuple(ids)

    def _exact_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same for long words, with a queue of pairs: n log n steps."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                a, b = ids[i], ids[after[i]]
                if (rank := self.rank_of.get(a * self.size + b)) is not None:
                    heapq.heappush(queue, (rank, i, a, b))

        for i in range(len(ids)):
            offer(i)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has merged since
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(x for x in ids if x >= 0)

    def propose(self, spelt: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: tokens, the word of each, and whether
        a word's last token carries the end of the word (if not, it has no proposal)."""
        found = list(self.longest.iter_long("\n".join(spelt) + "\n"))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        stops = np.cumsum(np.fromiter(map(len, spelt), np.int64, len(spelt)) + 1) - 1
        owner = np.searchsorted(stops, pairs[:, 0])
        complete = np.zeros(len(spelt), bool)
        complete[owner[self.is_end[pairs[:, 1]]]] = True
        return pairs[:, 1], owner, complete

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does the boundary between them survive merging?

        The later made of the two is undone (of equals the right one, as merging goes from
        left to right). A merge across the boundary of a lower rank than what was undone
        last would have come first, and so breaks the boundary.
        """
        pairs, back = np.unique(a * self.size + b, return_inverse=True)
        a, b = pairs // self.size, pairs % self.size
        good, open_ = np.ones(len(pairs), bool), np.arange(len(pairs))
        limit = np.full(len(pairs), NEVER)
        while len(open_):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            across = rank < limit
            good[open_[across]] = False
            made_a, made_b = self.order[a], self.order[b]
            more = ~across & (np.maximum(made_a, made_b) >= 0)
            first = made_a > made_b
            limit = np.where(first, made_a, made_b + 1)[more]
            a, b = np.where(first, self.right[a], a)[more], np.where(first, b, self.left[b])[more]
            open_ = open_[more]
        return good[back]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not kept yet, all at once."""
        new = [w for w in words if w not in self.words]
        if not new:
            return
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words = {}
            new = list(words)
        table = self.to_letters
        spelt = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table) for w in new]
        tokens, owner, good = self.propose(spelt)
        inner = owner[:-1] == owner[1:]
        good[owner[:-1][inner][~self.compatible(tokens[:-1][inner], tokens[1:][inner])]] = False
        stops = np.searchsorted(owner, np.arange(len(new)), "right").tolist()
        packed, start, kept = tokens.astype("<i4").tobytes(), 0, self.words
        for w, letters, stop, ok in zip(new, spelt, stops, good.tolist(), strict=True):
            kept[w] = packed[4 * start : 4 * stop] if ok else pack(self.exact(letters))
            start = stop

    def split(self, text: str) -> list[str | tuple[str]]:
        """The words of a text in order; a special token's own string is one of them, as a tuple."""
        if self.special_split and len(parts := self.special_split.split(text)) > 1:
            return [w for k, p in enumerate(parts) for w in ([(p,)] if k % 2 else self._words(p))]
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")  # nothing to compose there, and each letter has one lower case
        except UnicodeEncodeError:
            # each letter in lower case on its own: no special form of a word's last letter
            return WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return LATIN_WORD.findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.split(t) for t in texts]
        words = set(itertools.chain.from_iterable(split))
        special = {w for w in words if isinstance(w, tuple)}
        self.learn(words - special)
        known = self.words | {w: pack([self.special[w[0]]]) for w in special} if special else self.words
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids) -> str:
        """The tokens' own strings joined by one space (the tokenizer names no decoder)."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def codec(spec: bytes) -> Codec:
    return Codec(json.loads(spec))


SCHEMA = "doc_id long, ids array<int>, decoded string"


def bpe(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids, decoded.

    ``vocabulary`` is the path of a word-level BPE file on the driver. Null and empty texts
    and texts of white space only have no tokens and decode to the empty text. A special
    token's string inside a text becomes that token.
    """
    with open(vocabulary, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(spec.value)
        ids = c.encode([t or "" for t in part.column(1).to_pylist()])
        decoded = [c.decode(x.tolist()) for x in ids]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = pa.array(np.concatenate(ids) if ids else np.array([], np.int32), pa.int32())
        return pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    def done() -> None:
        codec(spec.value).words = {}

    picked = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_rows(picked, "text", SCHEMA, rows, done).withColumnRenamed("doc_id", id_col)
