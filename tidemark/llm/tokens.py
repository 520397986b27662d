"""Token ids of a public byte-level BPE tokenizer file.

``coder(path)`` reads the tokenizers JSON and encodes with its vocabulary as
ranks; the two agree when the merges are listed in the order of their ids,
which is checked on loading.  Libraries follow different Unicode versions when
they split a text into words, so a text with characters outside long-settled
blocks is split by the tokenizers library itself.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

#: Default vocabulary file; a parameter everywhere.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, by the public byte-level rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every token, the merges' order and the special tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.ids = {bytes(map(alphabet.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in pairs]
        if order != sorted(order):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}


@lru_cache(2)
def vocabulary(path: str = TOKENIZER) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(2)
def coder(path: str = TOKENIZER) -> tiktoken.Encoding:
    v = vocabulary(path)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)


@lru_cache(2)
def library(path: str = TOKENIZER) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Anything but Latin, Greek, Cyrillic, kana, the basic CJK block and Hangul, whose classes all versions share.
_UNSETTLED = regex.compile("[^\x00-\u0557\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_SPLIT = regex.compile(public_tokenizers.PATTERN)


def settled(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _UNSETTLED.search(text)


def pretokens(text: str, path: str = TOKENIZER) -> list[str]:
    """The words of a text without special tokens, as the tokenizer splits it before its merges."""
    if settled(text):
        return _SPLIT.findall(text)
    return [text[a:b] for _, (a, b) in library(path).pre_tokenizer.pre_tokenize_str(text)]


def sections(text: str, path: str = TOKENIZER) -> list[str]:
    """A text cut at its special tokens: ordinary text and special tokens by turns, ordinary text first."""
    special = [s for s in vocabulary(path).special if s in text]
    return regex.split(f"({'|'.join(map(regex.escape, special))})", text) if special else [text]


def encode(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Ids of a text (uint32); strings of special tokens in it give their ids, as in the tokenizers library."""
    if settled(text):
        return coder(path).encode_to_numpy(text, allowed_special="all")
    return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)
