"""Byte-level BPE encoding and decoding by backtracking over longest matches.

Bytes are mapped one to one to Latin-1 characters, so that an Aho-Corasick
automaton over the vocabulary finds every token at every place of a word in
one pass.  The encoder then walks the word, always trying the longest token
first.  Two tokens may stand side by side only if merging their bytes by rank
would leave exactly these two; that answer is memoised by pair.  Where no token
fits, the last one is taken back, and the place it ended at is never entered
again, so a word costs time in proportion to its matches.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

MEMO_WORDS = 250_000
MEMO_CHUNKS = 400_000
MEMO_PAIRS = 500_000
MEMO_WORD_CHARS = 48
LOOSE_SPACE = re.compile(r"\s ")
SAFE_CUT = regex.compile(r"(?V1)(?<=\S)(?= )")


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines: base64 bytes, rank."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in pairs]


class Adjacency:
    """Says whether two tokens can be neighbours in an encoding; memoised."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.halves: list[tuple[int, int] | None] = [None] * len(tokens)
        self.memo: dict[tuple[int, int], bool] = {}
        self.reachable = bytearray(len(tokens))
        for i, token in enumerate(tokens):
            if len(token) == 1:
                self.reachable[i] = 1
                continue
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None and max(left, right) < i and self.reachable[left] and self.reachable[right] and self._stable(left, right, i):
                    self.halves[i] = (left, right)
                    self.reachable[i] = 1
                    break

    def _stable(self, left: int, right: int, below: int) -> bool:
        """Do left and right stay apart under all merges of a rank less than ``below``?

        Unmerges, newest merge first, the inner edges of both; at each point the
        two pieces that touch must not merge earlier than what was just undone.
        """
        limit = below
        while True:
            joint = self.rank.get(self.tokens[left] + self.tokens[right])
            if joint is not None and joint < limit:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is not None and (b is None or left > right):
                limit, left = min(limit, left), a[1]
            elif b is not None:
                # At equal rank the leftmost pair merges first, hence the right piece yields to an equal merge.
                limit, right = min(limit, right + 1), b[0]
            else:
                return True

    def __call__(self, left: int, right: int) -> bool:
        known = self.memo.get((left, right))
        if known is None:
            if len(self.memo) >= MEMO_PAIRS:
                self.memo.clear()
            known = self.memo[left, right] = self._stable(left, right, len(self.tokens))
        return known


class Memo(dict):
    """Remembers what ``make`` gives for short keys, in two generations of ``most`` entries each."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= MEMO_WORD_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts: each match of the pattern by itself."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.next_to = Adjacency(tokens)
        self.rank = self.next_to.rank
        self.matches = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(tokens):
            if self.next_to.reachable[i]:
                self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.words = Memo(self._word, MEMO_WORDS)
        self.digested = Memo(lambda chunk: self._digested(" " + chunk), MEMO_CHUNKS)

    def ids(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.matches(text))))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes they decode to.

        No match of the pattern crosses a place between a character that isn't
        white space and a space, so a text is cut there and what the pieces
        give is remembered.  Texts with other places before a space take the
        general cut.
        """
        if not text:
            parts = []
        elif LOOSE_SPACE.search(text):
            parts = [self._digested(piece) for piece in SAFE_CUT.split(text) if piece]
        else:
            first, *rest = text.split(" ")
            parts = [self._digested(first)] if first else []
            parts += map(self.digested.__getitem__, rest)
        counts, decimal, raw = zip(*parts, strict=True) if parts else ((), (), ())
        return sum(counts), hashlib.sha256(" ".join(decimal).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()

    def _digested(self, piece: str) -> tuple[int, str, bytes]:
        ids = self.ids(piece)
        return len(ids), " ".join(map(str, ids)), decode(ids, self.tokens)

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        whole = self.rank.get(raw)
        return (whole,) if whole is not None else tuple(self.encode_bytes(raw))

    def encode_bytes(self, raw: bytes) -> list[int]:
        text = raw.decode("latin-1")
        # Most words need no backtracking: the longest matches one after another can all be neighbours.
        ids = [token for _, (_, token) in self.automaton.iter_long(text)]
        pairs = self.next_to
        memo = pairs.memo
        left = ids[0]
        for right in ids[1:]:
            fits = memo.get((left, right))
            if not (pairs(left, right) if fits is None else fits):
                return self._backtrack(raw, text)
            left = right
        return ids

    def _backtrack(self, raw: bytes, text: str) -> list[int]:
        size, rank, next_to = len(raw), self.rank, self.next_to
        # The longest match wins: matches that start together come in order of length.
        longest = {end - match[0]: match for end, match in self.automaton.iter(text)}
        dead: set[int] = set()
        ids: list[int] = []
        places: list[int] = []
        at = 0
        while at < size:
            length, token = longest.get(at - 1, (0, -1))
            while length and (token is None or at + length in dead or (ids and not next_to(ids[-1], token))):
                length -= 1
                token = rank.get(raw[at : at + length])
            if length:
                ids.append(token)
                places.append(at)
                at += length
                continue
            if not ids:
                raise ValueError("the vocabulary lacks a byte of this text")
            # Nothing fits from here after the last token: take it back and never end there again.
            dead.add(at)
            ids.pop()
            at = places.pop()
        return ids


_kept: list[tuple[tuple, Encoder]] = []


def encoder_for(tokens: list[bytes], pattern: str) -> Encoder:
    """This process's encoder; a worker that runs many tasks keeps what it remembers."""
    key = (len(tokens), hash(tuple(tokens)), pattern)
    if not _kept or _kept[0][0] != key:
        _kept[:] = [(key, Encoder(tokens, pattern))]
    return _kept[0][1]


def digest_batches(batches, tokens: list[bytes], pattern: str):
    encoder = encoder_for(tokens, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [encoder.digest(text.as_py() or "") for text in part.column("text")]
            counts, of_ids, of_bytes = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def id_batches(batches, tokens: list[bytes], pattern: str):
    encoder = encoder_for(tokens, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids = [encoder.ids(t.as_py() or "") for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def decode(ids, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every text.  Null text counts as empty and has no ids; rows with null or repeated ids are encoded like any other."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: id_batches(batches, tokens.value, pattern), f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes that ``ids`` stand for; a null list gives null."""
    tokens = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def turn(batches):
        for b in batches:
            raw = [None if x is None else decode(x, tokens.value) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(turn, f"doc_id {kind}, raw binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded where the text is.  An empty table gives an empty result."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: digest_batches(batches, tokens.value, pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
