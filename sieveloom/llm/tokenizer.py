"""Byte-level BPE with a public vocabulary, run by sentencepiece.

The vocabulary file lists the byte strings of the pieces by rank.  From it a
sentencepiece BPE model is serialised directly: each piece is written with
bytes mapped to printable characters and scored by its negative rank, so the
merge of lowest rank wins as in byte-level BPE; normalisation is the identity.
Texts are first split as the vocabulary requires, each distinct piece of text
is encoded once per worker and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import re
import struct
from pathlib import Path

#: Folder of the vocabulary files; a parameter of every operator that encodes.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct pieces of text kept encoded in a worker; beyond it the cache starts afresh.
CACHE_ENTRIES = 400_000

# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split in the standard library's classes, exact for texts without UNUSUAL characters.
_USUAL_SPLIT = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Outside of it both splits agree (tested over every character): ASCII, Latin, Greek, Cyrillic, Hebrew letters, common punctuation.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ωА-яא-ת‐- ‰-‾€﻿�]")
_general = None


def split(text: str) -> list[str]:
    """Pieces of a text; joined they give the text back."""
    if text.isascii() and "\x1c" not in text and "\x1d" not in text and "\x1e" not in text and "\x1f" not in text or not _UNUSUAL.search(text):
        return _USUAL_SPLIT.findall(text)
    global _general
    if _general is None:
        import regex

        _general = regex.compile(SPLIT_PATTERN)
    return _general.findall(text)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol-buffer field: bytes, int (varint) or float (32 bit)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece ``i`` stands for ``pieces[i]``; the last id is the unknown piece."""
    to_char = byte_characters()
    out = bytearray()
    for rank, piece in enumerate(pieces):
        out += _field(1, _field(1, "".join(to_char[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, float(-len(pieces))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normalizer))


def read_pieces(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> list[bytes]:
    ranked = {}
    for line in Path(folder, name).read_bytes().splitlines():
        if line:
            piece, rank = line.split()
            ranked[int(rank)] = base64.b64decode(piece)
    return [ranked[i] for i in range(len(ranked))]


class Encoder(dict):
    """Maps a piece of text to the tuple of its ids; missing ones are encoded and kept."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = VOCABULARY):
        super().__init__()
        import sentencepiece

        self.bytes_of = read_pieces(folder, name)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.bytes_of))
        self.to_char = {i: c for i, c in enumerate(byte_characters())}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.model.encode(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_char)))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[piece] = ids
        return ids

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "surrogatepass")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Encoder:
    """The worker's encoder; workers are reused, so the model is made once in each."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = Encoder(folder, name)
    return _encoders[folder, name]
