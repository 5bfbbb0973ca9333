"""Fast exact ids of a lower-casing BPE vocabulary with word-end symbols."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np

#: Words and pre-tokens kept in a worker's memos; a memo is emptied when full.
MEMO_WORDS = 600_000
#: Stands for the end-of-word suffix; this byte never occurs in UTF-8.
WORD_END = b"\xff"


@cache
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _byte_of() -> dict[str, int]:
    """The byte of each printable stand-in that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return out | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _fast(path: str):
    """(piece -> ranks, rank -> its id's bytes): the vocabulary's merges as byte ranks.

    A word's bytes get WORD_END appended; joining it to the last byte comes
    before every other merge, as if the last symbol had the suffix at once.
    """
    from tiktoken._tiktoken import CoreBPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of, suffix, vocab = _byte_of(), model["end_of_word_suffix"], model["vocab"]

    def octets(token: str) -> bytes:
        end = token.endswith(suffix)
        return bytes(byte_of[c] for c in (token[: -len(suffix)] if end else token)) + (WORD_END if end else b"")

    ranks: dict[bytes, int] = {}
    ids: list[int] = []

    def add(piece: bytes, token: str) -> None:
        if piece not in ranks:
            ranks[piece] = len(ids)
            ids.append(vocab[token])

    sign = {b: c for c, b in byte_of.items()}
    for b in range(256):
        add(bytes([b]), sign[b])
    for b in range(256):
        add(bytes([b]) + WORD_END, sign[b] + suffix)
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        add(octets(a) + octets(b), a + b)
    return CoreBPE(ranks, {}, r"[\s\S]+"), [i.to_bytes(4, "little") for i in ids]


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x21, 0x130) if unicodedata.category(chr(c))[0] in kinds and c != 0xAD)


#: Words that the fast way takes: Latin letters, digits and signs that neither
#: composition nor the Unicode rules of lower-casing touch in odd ways.
PLAIN = re.compile(f"[{_class('LNPS')}]+").fullmatch
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('LN')}]+").findall


class Encoder(dict):
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes; just
    those of the tokenizers library for the vocabulary at ``path``, special
    tokens not added.

    The vocabulary's pre-tokenizer never joins characters across white space,
    so a text's ids are those of its space-separated parts in order, and a
    part's ids can be remembered: this is a dictionary of parts, filled as
    they are asked for. Parts are split at space and 0x09-0x0D only, which is
    what bytes.split does. Plain Latin parts are cut into pre-tokens here and
    merged by ranks; any other part goes to the tokenizers library.
    """

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.tokens: dict[str, bytes] = {}
        self.bpe, self.ids = _fast(path)

    def __missing__(self, part: bytes) -> bytes:
        word = part.decode()
        if "<|" in word or not (word.isascii() or PLAIN(word)):
            got = np.array(_slow(self.path).encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        elif (low := word.lower()).isalpha():
            got = self._token(low)
        else:
            got = b"".join([self._token(t) for t in PRE_TOKENS(low)])
        self[part] = got
        return got

    def _token(self, token: str) -> bytes:
        got = self.tokens.get(token)
        if got is None:
            ids = self.ids
            got = b"".join([ids[r] for r in self.bpe.encode_single_piece(token.encode() + WORD_END)])
            self.tokens[token] = got
        return got

    def encode(self, text: str) -> bytes:
        if len(self) > MEMO_WORDS:
            self.clear()
        if len(self.tokens) > MEMO_WORDS:
            self.tokens.clear()
        return b"".join(map(self.__getitem__, text.encode().split()))
