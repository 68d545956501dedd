"""Byte-level BPE of whole texts by parts that are encoded once and then looked up.

The pre-tokenizer of ``byte_bpe_50k.json`` always starts a new pre-token at a
space that a non-space follows, so a text splits there into parts that are encoded
independently; most parts recur, and the map of known parts answers for them.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import public_tokenizers
import regex

#: Known parts a worker keeps; further ones are encoded each time they come. Results never change.
KEPT = 400_000
SPECIAL = "<|endoftext|>"
_PRE_TOKENS = regex.compile(public_tokenizers.PATTERN)
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's tokenizer, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@functools.lru_cache(maxsize=4)
def proven(path: str) -> dict[str, int]:
    """The whole-token table: each vocabulary string that, encoded alone, is its own single token.

    Found by letting the library encode every vocabulary string that is valid text: one passes only if the result
    is exactly its own id, which proves that it is one pre-token and that the
    merges reach it. Depends on the vocabulary only, so its size is bounded by it.
    """
    return _proven(path)[0]


@functools.lru_cache(maxsize=4)
def _proven(path: str) -> tuple[dict[str, int], bool]:
    """The table, and whether no string of the vocabulary failed."""
    from tokenizers.decoders import ByteLevel

    made, decoder = library(path), ByteLevel()
    tried = [(text, i) for token, i in sorted(made.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]) if "\ufffd" not in (text := decoder.decode([token]))]
    found = made.encode_batch([text for text, _ in tried], add_special_tokens=False)
    out = {text: i for (text, i), got in zip(tried, found, strict=True) if got.ids == [i]}
    return out, len(out) == len(tried)


@functools.lru_cache(maxsize=4)
def ranks(path: str):
    """tiktoken over the same vocabulary (the .tiktoken file beside the .json), or None where there is none.

    It takes a pre-token that is a vocabulary string for that token without playing the merges, so it stands in for the library only if
    the whole vocabulary is proven.
    """
    beside = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(beside) or not _proven(path)[1]:
        return None
    import tiktoken

    with open(beside, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def plain(text: str) -> bool:
    """Only Latin letters and common punctuation, whose classes no Unicode version has changed."""
    return text.isascii() or not _OTHER.search(text)


def encode_part(path: str, part: str) -> list[int]:
    """Ids of one part. Plain Latin text goes by the rank table, any other by the library itself."""
    fast = ranks(path)
    if fast is not None and plain(part):
        return fast.encode_ordinary(part)
    return library(path).encode(part, add_special_tokens=False).ids


class _Map(dict):
    """From part to what ``make`` gives for it."""

    def __init__(self, make, seed):
        super().__init__(seed)
        self._make = make

    def __missing__(self, part):
        found = self._make(part)
        if len(self) < KEPT:
            self[part] = found
        return found


def parts(text: str) -> list[str]:
    """The parts of a text; joined by single spaces they are the text again.

    All but the first are to be encoded with a space before them.
    """
    found = text.split(" ")
    for k in range(1, len(found)):
        if not found[k] or found[k][0].isspace():
            break
    else:
        return found
    whole = [found[0]]
    for x in found[1:]:
        if not x or x[0].isspace():
            whole[-1] += " " + x
        else:
            whole.append(x)
    return whole


class Encoder:
    """Whole texts to ids (packed little-endian unsigned 32-bit) or to counts."""

    def __init__(self, path: str):
        self.path = path

    @functools.cached_property
    def _counts(self) -> _Map:
        """Counts of parts; those of the proven tokens stand from the start."""
        seed = dict.fromkeys((s[1:] for s in proven(self.path) if s.startswith(" ")), 1)
        return _Map(lambda part: self._count(" " + part), seed)

    def _count(self, part: str) -> int:
        """Tokens of a part: its pre-tokens that are proven count one each, only the others are merged."""
        if not plain(part):
            return len(encode_part(self.path, part))
        table = proven(self.path)
        return sum(1 if x in table else len(encode_part(self.path, x)) for x in _PRE_TOKENS.findall(part))

    def ids(self, text: str) -> bytes:
        fast = ranks(self.path)
        if fast is None or SPECIAL in text or not plain(text):
            return np.array(library(self.path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    def count(self, text: str) -> int:
        if SPECIAL in text:
            return len(library(self.path).encode(text, add_special_tokens=False).ids)
        found = parts(text)
        first = self._count(found[0]) if found[0] else 0
        return first + sum(map(self._counts.__getitem__, found[1:]))


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process: later tasks find the parts that earlier ones met."""
    return Encoder(path)
