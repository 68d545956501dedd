"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

Instead of merging pair by pair, the encoder walks a word left to right: the
automaton gives the longest token that starts at each place, a token may follow another
only if the pair is compatible (merging the two tokens' bytes together would give
exactly these two tokens), and where no compatible token leads on, it steps back and tries the
next shorter one. Every place is marked at most once as a dead end, so the work is linear
in the word, and the one chain that survives is the exact result of the merges.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import _words
from matrel.llm._io import table

#: Words a worker keeps with their ids; further ones are encoded each time they come. Results never change.
KEPT = 300_000
END = "</w>"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class BacktrackingBpe:
    """One vocabulary with its merges, where each word's last symbol carries an end mark.

    A word's symbols are the byte alphabet's characters; the last one is taken with the
    end mark as one symbol. Internally the end mark is one private character, so that
    tokens are plain strings for the automaton.
    """

    MARK = "\ue000"

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        def inner(token: str) -> str:
            return token.removesuffix(END) + self.MARK if token.endswith(END) and token != END else token

        self.ids = {inner(t): i for t, i in vocabulary.items()}
        self.rank = {(inner(a), inner(b)): k for k, (a, b) in enumerate(merges)}
        made = {a + b: k for (a, b), k in self.rank.items()}
        self.split: dict[str, tuple[str, str]] = {a + b: (a, b) for (a, b) in self.rank}
        self.level = {t: made.get(t, -1) for t in self.ids}
        self._known: dict[tuple[str, str], bool] = {}
        # Only tokens that their own merges reach can occur.
        self.tokens = {t for t in self.ids if self._reached(t)}
        self._automaton = ahocorasick.Automaton()
        for t in self.tokens:
            self._automaton.add_word(t[::-1], len(t))
        self._automaton.make_automaton()
        self._prefixes: dict[str, list[str]] = {}

    def _symbols(self, word: str) -> list[str]:
        if word.endswith(self.MARK) and len(word) > 1:
            return [*word[:-2], word[-2:]]
        return list(word)

    def _reached(self, token: str) -> bool:
        return self.merge(token) == [token]

    def merge(self, word: str) -> list[str]:
        """The merges played by rank, pair by pair: the definition, used offline and in tests."""
        parts = self._symbols(word)
        while len(parts) > 1:
            ranked = [(self.rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.rank]
            if not ranked:
                break
            _, k = min(ranked)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the merges of left + right give exactly these two tokens.

        They do unless some merge crosses the border before it is absorbed: walking down
        both tokens' merge trees along the border, no pair across it may come earlier than the
        merges that built its two sides.
        """
        found = self._known.get((left, right))
        if found is None:
            found = self._compatible(left, right)
            if len(self._known) < KEPT:
                self._known[left, right] = found
        return found

    def _compatible(self, left: str, right: str) -> bool:
        a, b, limit = left, right, 1 << 60
        while True:
            # a pair across the border would be merged if it came before `limit`,
            # the merge that absorbed one of its sides (the left of equals goes first)
            k = self.rank.get((a, b))
            if k is not None and k < limit:
                return False
            ka, kb = self.level[a], self.level[b]
            if ka < 0 and kb < 0:
                return True
            if ka > kb:
                limit = ka
                a = self.split[a][1]
            else:
                # the right token's first pair is merged at kb; at equal ranks the border pair, further left, would be first
                limit = kb + 1
                b = self.split[b][0]

    def longest_from(self, word: str) -> list[int]:
        """For each place, the length of the longest token that starts there (0: none). One pass of the automaton over the reversed word."""
        n = len(word)
        out = [0] * n
        for at, length in self._automaton.iter(word[::-1]):
            start = n - 1 - at
            if length > out[start]:
                out[start] = length
        return out

    def shorter(self, token: str) -> str | None:
        """The next shorter token that is a prefix of this one."""
        known = self._prefixes.get(token)
        if known is None:
            known = [token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.tokens]
            self._prefixes[token] = known
        return known[0] if known else None

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the byte alphabet, without its end mark."""
        word += self.MARK
        last = len(word) - 1  # the end mark is never a token's first character here
        longest = self.longest_from(word)
        n = len(word)
        open_at = [True] * (n + 1)
        chain: list[str] = []
        at = 0
        token: str | None = word[: longest[0]] if longest[0] else None
        while True:
            if token is None:
                if not chain:
                    # a symbol that is no token at all: the plain merges decide
                    return [self.ids[t] for t in self.merge(word) if t in self.ids]
                back = chain.pop()
                at -= len(back)
                token = self.shorter(back)
                continue
            end = at + len(token)
            if end == last and n > 1:
                ok = False  # would leave the end mark alone
            else:
                ok = open_at[end] and (not chain or self.compatible(chain[-1], token))
            if not ok:
                token = self.shorter(token)
                if token is None and chain:
                    open_at[at] = False
                    back = chain.pop()
                    at -= len(back)
                    token = self.shorter(back)
                continue
            chain.append(token)
            at = end
            if at == n:
                return [self.ids[t] for t in chain]
            token = word[at : at + longest[at]] if longest[at] else None
            if token is None:
                open_at[at] = False


class WordBpe:
    """Texts to ids and back for a lower-casing, white-space-dropping word BPE file."""

    _SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", regex.V0)
    #: Unicode's white space, without the four separators that only Python counts as such.
    _WHITE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    _CONTROL = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        added = spec["added_tokens"]
        self.special = {x["content"]: x["id"] for x in added}
        self._special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        vocabulary = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.core = BacktrackingBpe({t: i for t, i in vocabulary.items() if t not in self.special}, merges)
        names = dict(vocabulary) | self.special
        back = {i: t for t, i in names.items()}
        #: The offset table: token i's bytes are ``blob[offsets[i]:offsets[i + 1]]``.
        pieces = [back.get(i, "").encode() for i in range(max(back) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.blob = b"".join(pieces)
        self._pieces = [self.blob[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]
        self._alphabet = byte_alphabet()
        outer = self

        class Known(dict):
            def __missing__(self, word):
                found = np.array(outer._encode(word), "<u4").tobytes()
                if len(self) < KEPT:
                    self[word] = found
                return found

        self._known = Known()

        class Parts(dict):
            def __missing__(self, part):
                symbols = part if part.isascii() and part.isprintable() else "".join(map(outer._alphabet.__getitem__, part.encode()))
                found = outer.core.encode_word(symbols)
                if len(self) < KEPT:
                    self[part] = found
                return found

        self._parts = Parts()

    def _encode(self, word: str) -> list[int]:
        """Ids of a part of a text between white space."""
        if word.isascii():
            word = word.lower()
        else:
            word = self._library.normalizer.normalize_str(word)
        out: list[int] = []
        for found in self._SPLIT.findall(word):
            out += self._parts[found]
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, packed as little-endian unsigned 32-bit."""
        if self._special is not None and "<|" in text and self._special.search(text):
            return b"".join(self.special[s].to_bytes(4, "little") if s in self.special else self.ids(s) for s in self._special.split(text) if s)
        words = [w for w in self._WHITE.split(text) if w] if self._CONTROL.search(text) else text.split()
        return b"".join(map(self._known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the tokens' bytes by the offset table, with single spaces between."""
        return b" ".join(map(self._pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One for each worker process."""
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows ``key, ids (array of int), decoded``: each whole text's ids and what they decode to.

    A null text counts as empty (no ids, empty decoded text); special strings inside a
    text become their special ids; a null key stays null; repeated rows give repeated rows; an
    empty table gives an empty one; further columns are ignored, whatever their names.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(path)
        for batch in batches:
            for part in _words.slices(batch, "text"):
                packed = [coder.ids(t) if t else b"" for t in part.column(1).to_pylist()]
                ids = pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32()))
                decoded = pa.array([coder.decode(p).decode() for p in packed], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded], names=["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_words.tidy(run), f"key {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encode_decode``, with digests in place of the ids and the decoded text, taken where they are made.

    Returns ``key, n_tokens, ids_sha256, decoded_sha256``.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(path)
        for batch in (part for whole in batches for part in _words.slices(whole, "text")):
            n, ids_hex, text_hex = [], [], []
            for t in batch.column(1).to_pylist():
                packed = coder.ids(t) if t else b""
                n.append(len(packed) // 4)
                ids_hex.append(hashlib.sha256(packed).hexdigest())
                text_hex.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_words.tidy(run), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
