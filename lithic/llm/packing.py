"""Best-fit packing of token sequences with vector capacities.

A document becomes its ids and an end id; only documents longer than a
sequence are cut.  Pieces are dealt by hash into blocks of a bounded number of
pieces; within a block, longest first, each piece goes to the open sequence
with the smallest weighted norm of what would be left of its three capacities
(tokens, documents, attention cost = sum of squared lengths), among those in
which it fits under every one of them.  A block opens as many sequences as it
needs: there is no cap on bins.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo
from .shared import materialize, released

LENGTH = 2048
BLOCK_PIECES = 12_000
MEMO_WORDS = 250_000
END_ID = 0
#: Of what would be left of tokens, documents and attention cost.
WEIGHTS = (1.0, 0.5, 0.5)
#: Letters below this are one character each in composed form, and lower-case alike everywhere.
PLAIN_LETTERS = "\u0250"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of a text as little-endian 32-bit bytes.

    Where the tokenizer drops white space before it merges, texts are cut at
    spaces and line breaks and what a word gives is remembered.  Words of plain
    letters go to the merging model at once, as nothing else would change them.
    Other tokenizers get whole texts, and so do texts that may hold one of the
    tokenizer's added tokens, which it looks for before anything else.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(definition)
        self.model, self.letters = self.inner.model, byte_letters()
        kinds = json.loads(definition)
        self.added = [t["content"].lower() for t in kinds.get("added_tokens") or []]
        normal = [n["type"] for n in (kinds["normalizer"] or {}).get("normalizers", [])]
        before = (kinds["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in before] == ["Split", "ByteLevel"] and before[0]["invert"] and before[0]["behavior"] == "Removed" and "\\s" in before[0]["pattern"]["Regex"] and not before[1]["add_prefix_space"]
        self.words = Memo(self._word, MEMO_WORDS)

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.inner.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if len(word) > 1 and word[-1] in ".," and word[-2].lower().isalpha():
            return self.words[word[:-1]] + self.words[word[-1]]
        low = word.lower()
        if low.isalpha() and max(low) < PLAIN_LETTERS:
            spelled = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
            return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        return self._ids(word)

    def __call__(self, text: str) -> bytes:
        low = text.lower()
        if not self.by_word or any(t in low for t in self.added):
            return self._ids(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


_kept: list[tuple[int, WordTokenizer]] = []


def tokenizer_for(definition: str) -> WordTokenizer:
    if not _kept or _kept[0][0] != hash(definition):
        _kept[:] = [(hash(definition), WordTokenizer(definition))]
    return _kept[0][1]


def piece_batches(batches, definition: str, length: int, end_id: int):
    encode, end = tokenizer_for(definition), np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows, starts, lengths, sums = [], [], [], []
            for row, text in enumerate(part.column("text")):
                raw = encode(text.as_py() or "") + end
                for start in range(0, len(raw), 4 * length):
                    cut = raw[start : start + 4 * length]
                    rows.append(row)
                    starts.append(start // 4)
                    lengths.append(len(cut) // 4)
                    sums.append(zlib.crc32(cut))
            starts_ = np.asarray(starts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts_ // length, pa.int32()), pa.array(starts_), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Per piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32.  Null text counts as empty: one piece, the end id."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda b: released(piece_batches(b, definition.value, length, end_id)), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights=WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``lengths`` come longest first.

    Ties go to the bin opened first.
    """
    caps, w = np.asarray(capacity, float), np.asarray(weights, float) / np.square(np.asarray(capacity, float))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, ids, opened, used = np.empty((3, 1024)), np.empty(1024, np.int64), 0, 0
    least = lengths[-1] if len(lengths) else 0
    for n, size in enumerate(lengths):
        need = np.array([size, 1.0, float(size) * size])
        if (need > caps).any():
            raise ValueError("a piece is larger than an empty sequence")
        after = left[:, :used] - need[:, None]
        fits = (after >= 0).all(axis=0)
        where = int(np.where(fits, w @ np.square(after), np.inf).argmin()) if used else 0
        if not used or not fits[where]:
            if used == left.shape[1]:
                left, ids = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([ids, np.empty_like(ids)])
            where, used = used, used + 1
            left[:, where], ids[where], opened = caps, opened, opened + 1
        bins[n], offsets[n] = ids[where], int(caps[0] - left[0, where])
        left[:, where] -= need
        if left[0, where] < least or left[1, where] < 1:  # nothing that is still to come fits
            used -= 1
            left[:, where : used], ids[where : used] = left[:, where + 1 : used + 1].copy(), ids[where + 1 : used + 1].copy()
    return bins, offsets


def pack(parts: DataFrame, length: int = LENGTH, max_documents: int | None = None, max_attention: float | None = None, weights=WEIGHTS) -> DataFrame:
    """Add sequence_id and offset to pieces.

    Without caps on documents and attention cost these are set so that only
    tokens bind, while what is left of all three still chooses the sequence.
    Repeated rows are packed each; rows with null ids too; pieces of one length
    go by id and piece, bins of one norm by age; an empty table gives an empty
    result.
    """
    capacity = (float(length), float(max_documents or length), float(max_attention or length * length))
    parts = materialize(parts, "pieces")
    blocks = max(1, -(-parts.count() // BLOCK_PIECES))

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = best_fit(part["length"].to_numpy(), capacity, weights)
        return part.assign(sequence_id=(part["block"].to_numpy().astype(np.int64) << 32) + bins, offset=offsets).drop(columns="block")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))).groupBy("block").applyInPandas(fill, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, **caps) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer_path, length), length, **caps)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .shared import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
