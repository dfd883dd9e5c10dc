"""Byte-level BPE through a trie of distinct words, and decoding.

In BPE with ranked merges the encoding of a prefix ends in one token, and what precedes this token is the
encoding of the shorter prefix.  So a single *last token* per prefix describes all encodings.  The new distinct
words of a batch form a trie, kept as the sorted words: sorted order is the trie's depth-first order, and the
common prefix with the word before is the path that both share.  The traversal keeps the path's states on a
stack (the last token, and the longest suffix that can still grow into a token) and computes a state once for
all words that share the prefix.  A token may follow the token before it when no merge across their boundary
comes up before the merges that build the two.

Every task works on its own texts: nothing is shuffled, and the kept encodings are bounded in number.
Null text counts as empty; an empty text has no tokens.  Repeated rows are encoded each for itself, and other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, functions as F

from ledgerspark.llm.base import slices, text_or_empty

#: The published split of byte-level BPE into words (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_WORDS = 400_000
KEPT_PAIRS = 500_000
NEVER = 1 << 30
#: White space before a space; the places where a space follows anything else.
SPACES = re.compile(r"\s |^ ")
UNIT_STARTS = re.compile(r"(?<=\S)(?= )")


def byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from U+0100 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        split, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or spec["normalizer"] or split["add_prefix_space"]:
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        letters = byte_of_letter()
        names = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in name) for name, i in names.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.formed: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (names[left], names[right]), names[left + right]
            self.rank.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.formed[whole] = pair, rank
        self.special = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("special tokens that take white space or word ends are not supported")
            self.special[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        self.prefixes = {token[:n] for token in self.id_of for n in range(len(token) + 1)}

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE of a short byte string, lowest rank first and leftmost of equals."""
        ids = [self.id_of[bytes([b])] for b in data]
        while len(ids) > 1:
            rank, at = min((self.rank.get(pair, NEVER), i) for i, pair in enumerate(zip(ids, ids[1:])))
            if rank == NEVER:
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while it is built, each with the rank of the merge that ends it."""
        pieces, ends = [], NEVER
        while True:
            pieces.append((token, ends))
            if token not in self.parts:
                return pieces
            ends = self.formed[token]
            token = self.parts[token][side]


class TrieEncoder:
    """Encodes texts by the trie of each batch's new words; keeps a bounded number of encodings."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(WORD_PATTERN)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.packed = {i: struct.pack("<i", i) for i in vocabulary.bytes_of}
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.steps: dict[int, int] = {}
        self.states: dict[bytes, int] = {b"": 0}
        self.state_bytes: list[bytes] = [b""]
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()]

    def _step(self, state: int, byte: int) -> int:
        """The longest suffix, with this byte added, that some token starts with."""
        grown = self.state_bytes[state] + bytes([byte])
        while grown not in self.vocabulary.prefixes:
            grown = grown[1:]
        if grown not in self.states:
            self.states[grown] = len(self.suffixes)
            self.state_bytes.append(grown)
            tokens = (self.vocabulary.id_of.get(grown[i:]) for i in range(len(grown)))
            stand = (t for t in tokens if t is not None and self.vocabulary.merged(self.vocabulary.bytes_of[t]) == [t])
            self.suffixes.append(tuple((t, len(self.vocabulary.bytes_of[t])) for t in stand))
        self.steps[(state << 8) | byte] = self.states[grown]
        return self.states[grown]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        if (token, side) not in self.edges:
            self.edges[token, side] = self.vocabulary.edge(token, side)
        return self.edges[token, side]

    def _follows(self, left: int, right: int) -> bool:
        """Whether the boundary between two neighbouring tokens survives all merges."""
        rank_of = self.vocabulary.rank.get
        survives = True
        for a, a_ends in self._edge(left, 1):
            for b, b_ends in self._edge(right, 0):
                rank = rank_of((a, b))
                # Of equal ranks the left token's own merge comes first, the right token's comes after.
                if rank is not None and rank < a_ends and rank <= b_ends:
                    survives = False
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[(left << 32) | right] = survives
        return survives

    def learn(self, words: list[str]) -> None:
        """Encode distinct words by one depth-first pass over their trie."""
        if len(self.words) + len(words) > KEPT_WORDS:
            self.words.clear()
        coded = sorted((w.encode("utf-8", "replace"), w) for w in words)
        steps, suffixes, packed, pair_of = self.steps.get, self.suffixes, self.packed, self.pairs.get
        states, last, width = [0], [-1], [0]
        before = b""
        for data, word in coded:
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], width[shared + 1 :]
            state = states[shared]
            for depth in range(shared + 1, len(data) + 1):
                byte = data[depth - 1]
                step = steps((state << 8) | byte)
                state = self._step(state, byte) if step is None else step
                for token, length in suffixes[state]:
                    if length == depth:
                        break
                    left = last[depth - length]
                    fits = pair_of((left << 32) | token)
                    if fits or (fits is None and self._follows(left, token)):
                        break
                states.append(state)
                last.append(token)
                width.append(length)
            at, ids = len(data), []
            while at:
                ids.append(packed[last[at]])
                at -= width[at]
            self.words[word] = b"".join(ids[::-1])
            before = data

    def _fill(self, known: dict[str, bytes], units: set[str], lead: str) -> None:
        """Encode the units not yet known, each behind ``lead``, by way of their words."""
        fresh = [u for u in units if u not in known]
        if len(known) + len(fresh) > KEPT_WORDS:  # start anew with the units of this batch
            known.clear()
            fresh = list(units)
        split = self.pattern.findall
        for i in range(0, len(fresh), KEPT_WORDS):
            part = [(u, split(lead + u)) for u in fresh[i : i + KEPT_WORDS]]
            words = {w for _, ws in part for w in ws}
            if not words <= self.words.keys():
                new = [w for w in words if w not in self.words]
                if len(self.words) + len(new) > KEPT_WORDS:
                    new = list(words)
                self.learn(new)
            for unit, ws in part:
                known[unit] = b"".join(map(self.words.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian 32-bit numbers.

        A text is cut before each space that follows a character other than white space.  The pattern never
        matches across such a cut, so the words of a unit do not depend on the text around it.
        """
        pieces = []
        for text in texts:
            for i, piece in enumerate([text] if self.special is None else self.special.split(text)):
                if i % 2:
                    pieces.append((None, piece))
                elif SPACES.search(piece):
                    pieces.append((UNIT_STARTS.split(piece), ()))
                else:
                    first, *rest = piece.split(" ")
                    pieces.append(((first,), rest))
            pieces.append(None)
        self._fill(self.plain, {u for p in pieces if p and p[0] for u in p[0]}, "")
        self._fill(self.spaced, set().union(*(p[1] for p in pieces if p and p[0])), " ")
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        special = {t: self.packed[i] for t, i in self.vocabulary.special.items()}
        out, parts = [], []
        for piece in pieces:
            if piece is None:
                out.append(b"".join(parts))
                parts = []
            elif piece[0] is None:
                parts.append(special[piece[1]])
            else:
                parts.extend(map(plain, piece[0]))
                parts.extend(map(spaced, piece[1]))
        return out


@lru_cache(maxsize=2)
def _encoder(raw: bytes) -> TrieEncoder:
    return TrieEncoder(Vocabulary(raw))


@lru_cache(maxsize=2)
def _token_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, with the start and length of each id."""
    tokens = Vocabulary(raw).bytes_of
    lengths = np.zeros(max(tokens) + 1, np.int64)
    for i, token in tokens.items():
        lengths[i] = len(token)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.zeros(int(lengths.sum()), np.uint8)
    for i, token in tokens.items():
        data[starts[i] : starts[i] + len(token)] = np.frombuffer(token, np.uint8)
    return data, starts, lengths


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col`` and ``ids array<int>``.

    ``tokenizer`` names a tokenizer file that the driver can read; its bytes (one or two MB, whatever the
    input's size) go to the tasks as a broadcast variable.
    """
    raw = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder = _encoder(raw.value)
        for whole in batches:
            for batch in slices(whole, 1):
                packed = encoder.encode(batch.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["id", "ids"]
                )

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids as column ``out``; bytes that are no UTF-8 become U+FFFD, null ids an empty text.

    A column named ``out`` is replaced.
    """
    raw = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    others = [c for c in encoded.columns if c != out]
    frame = encoded.select(*[F.col(f"`{c}`") for c in others])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    at = others.index(ids_col)

    def run(batches):
        data, starts, lengths = _token_bytes(raw.value)
        for batch in batches:
            column = batch.column(at)
            texts = []
            for row in range(batch.num_rows):
                ids = column[row].values
                ids = np.zeros(0, np.int32) if ids is None else ids.to_numpy(zero_copy_only=False)
                size = lengths[ids]
                shift = starts[ids] - (np.cumsum(size) - size)
                spread = np.repeat(shift, size)
                spread += np.arange(len(spread))
                texts.append(data[spread].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*others, out])

    return frame.mapInArrow(run, f"{schema}, `{out}` string")
