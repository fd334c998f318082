"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words (pre-tokens) of a chunk form a trie, held as their sorted list: going from a word to the next one
goes back to their common prefix and down again, which is the trie's depth-first order.  Along the way three numbers are
kept for each depth: the last token of the BPE encoding of that prefix, its length, and the state of an automaton that names the
tokens which end there.  A prefix's last token follows from the shorter prefixes' (the one token that ends there and has a stable
boundary with the last token before it), so an encoding of a shared prefix is found once, and a word's ids are read
off by walking back over the last tokens.

The vocabulary is read once, on the driver, into flat tables of a few bytes a token; Python workers get these by broadcast.
What a worker remembers (words, automaton, boundaries) has bounds, which cost time only, and stays between tasks.

Defined results: null or empty text: no ids, decoded to "".  Repeated rows and ids stay as they are, one row each;
columns besides id and text are ignored, whatever their names.  Texts of any length are encoded whole.  An empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, whole_text

# The byte alphabet's printable bytes and the published pre-token pattern of byte-level BPE.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: The same for texts without the characters that re's \w, \d and \s class otherwise (numbers that are no digits, some separators).
FAST_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

NEVER = 1 << 60
#: Words that a Python worker remembers in each of two generations: about 20 MB each.
REMEMBERED_WORDS = 120_000
#: Boundaries between tokens, and moves of the automaton, that it remembers.
REMEMBERED_BOUNDARIES = 250_000
#: Characters of text that are handled at once.
CHUNK_CHARS = 500_000


@functools.cache
def unusual_class() -> str:
    """The characters that FAST_PATTERN would class otherwise, and all beyond the first plane, as the ranges of a character class."""
    kinds = ((c, chr(c), unicodedata.category(chr(c))) for c in range(0x10000))
    odd = [n for n, c, kind in kinds if kind in ("Nl", "No") or c.isalnum() != (kind[0] in "LN") or c.isspace() and c in "\x1c\x1d\x1e\x1f"]
    starts = [n for n, before in zip(odd, [-2, *odd], strict=False) if n != before + 1]
    ends = [n for n, after in zip(odd, [*odd[1:], -2], strict=True) if n != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip([*starts, 0x10000], [*ends, sys.maxunicode], strict=True))


@dataclass
class Tables:
    """A byte-level BPE vocabulary in flat tables; token i is raw[start[i] : start[i + 1]]."""

    raw: bytes
    start: np.ndarray
    #: Pairs of tokens that merge, by rank.
    lefts: np.ndarray
    rights: np.ndarray
    #: The rank of the merge that makes a token, or -1.
    made: np.ndarray
    #: Whether a token's own bytes are encoded as this one token.
    stands: np.ndarray
    special: dict[str, int]
    unusual: str
    digest: str


def read_tables(source: str) -> Tables:
    """The tables of a tokenizers .json file's text."""
    data = json.loads(source)
    other = iter(range(0x100, 0x200))
    byte_of = {chr(b if b in PRINTABLE else next(other)): b for b in sorted(range(256))}
    raw = lambda token: bytes(byte_of[c] for c in token)
    vocab = {raw(token): i for token, i in data["model"]["vocab"].items()}
    special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
    bytes_of = {i: token for token, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    size = max(bytes_of) + 1
    made = np.full(size, -1, dtype=np.int32)
    pairs: dict[tuple[int, int], None] = {}
    for merge in data["model"]["merges"]:
        left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
        pair = vocab[left], vocab[right]
        if pair not in pairs:
            if made[vocab[left + right]] < 0:
                made[vocab[left + right]] = len(pairs)
            pairs[pair] = None
    lefts, rights = (np.array([p[k] for p in pairs], dtype=np.int32) for k in (0, 1))
    tokens = [bytes_of.get(i, b"") for i in range(size)]
    start = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    tables = Tables(b"".join(tokens), start, lefts, rights, made, np.zeros(size, dtype=bool), special, unusual_class(), hashlib.sha256(source.encode()).hexdigest())
    bpe = ByteBpe(tables)
    usable = [i for token, i in vocab.items() if len(token) == 1 or made[i] >= 0 and bpe.stands(i)]
    tables.stands[usable] = True
    return tables


class ByteBpe:
    """Encodes and decodes by a vocabulary."""

    def __init__(self, tables: Tables):
        self.size = len(tables.made)
        self.lefts, self.rights, self.made = (array("i", x.tobytes()) for x in (tables.lefts, tables.rights, tables.made))
        self.rank = dict(zip((tables.lefts.astype(np.int64) * self.size + tables.rights).tolist(), range(len(tables.lefts)), strict=True))
        self.flat, self.start = np.frombuffer(tables.raw, dtype=np.uint8), tables.start.astype(np.int64)
        self.length = np.diff(self.start)
        at = tables.start
        self.tokens = {tables.raw[at[i] : at[i + 1]]: i for i in np.flatnonzero(tables.stands).tolist()}
        self.by_bytes = sorted(self.tokens)
        self.special = {w: np.array([i], dtype=np.int32).tobytes() for w, i in tables.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.is_unusual = re.compile(f"[{tables.unusual}]").search
        self.words_exactly, self.words_fast = regex.compile(PATTERN).findall, re.compile(FAST_PATTERN).findall
        self.known: dict[str, bytes] = dict(self.special)
        self.older: dict[str, bytes] = {}
        self._start_automaton()

    def _start_automaton(self) -> None:
        self.suffix, self.state_of = [b""], {b"": 0}
        self.moves: dict[int, tuple[int, list]] = {}
        self.entries: dict[int, tuple[int, int, dict[int, bool]]] = {}
        self.boundaries = 0

    def stands(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this one token: no other merge crosses its parts' boundary before."""
        n = self.made[token]
        left, right = self.lefts[n], self.rights[n]
        return not self._crossed(left, right, n) and all(self.made[x] < 0 or self.stands(x) for x in (left, right))

    def _crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether BPE would merge over the boundary of two neighbours; of equal ranks, the merge further left comes first.

        At either edge stood, one after another, the parts that the token was built from, each until the merge that took it.
        """
        made, lefts, rights, rank, size = self.made, self.lefts, self.rights, self.rank, self.size
        a, a_until = left, before
        while True:
            b, b_until = right, NEVER
            while True:
                n = rank.get(a * size + b)
                if n is not None and n < a_until and n < before and n <= b_until:
                    return True
                b_until = made[b]
                if b_until < 0:
                    break
                b = lefts[b_until]
            a_until = made[a]
            if a_until < 0:
                return False
            a = rights[a_until]

    def _move(self, key: int) -> tuple[int, list]:
        """The automaton's next state (the longest end of the text that begins a token), and the tokens that end there, the longest first."""
        s = self.suffix[key >> 8] + bytes((key & 255,))
        while s:
            at = bisect_left(self.by_bytes, s)
            if at < len(self.by_bytes) and self.by_bytes[at].startswith(s):
                break
            s = s[1:]
        state = self.state_of.setdefault(s, len(self.suffix))
        if state == len(self.suffix):
            self.suffix.append(s)
        found = []
        for k in range(len(s)):
            token = self.tokens.get(s[k:])
            if token is not None:
                found.append(self.entries.setdefault(token, (len(s) - k, token, {})))
        self.moves[key] = state, found
        return state, found

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word, in one depth-first pass over the trie of the words."""
        if self.boundaries + len(self.moves) > REMEMBERED_BOUNDARIES:
            self._start_automaton()
        moves, move, crossed = self.moves, self._move, self._crossed
        out, path, last, size, states = {}, b"", [-1], [0], [0]  # at [d]: of the prefix of d bytes
        for word in sorted(words):  # by code points, which is the order of UTF-8 bytes
            raw = word.encode()
            depth, most = 0, min(len(raw), len(path))
            while depth < most and raw[depth] == path[depth]:
                depth += 1
            del last[depth + 1 :], size[depth + 1 :], states[depth + 1 :]
            state, end = states[depth], depth
            for byte in raw[depth:]:
                end += 1
                key = state << 8 | byte
                state, found = moves.get(key) or move(key)
                for k, token, fits in found:
                    if k == end:
                        break
                    before = last[end - k]
                    ok = fits.get(before)
                    if ok is None:
                        ok = fits[before] = not crossed(before, token)
                        self.boundaries += 1
                    if ok:
                        break
                last.append(token)
                size.append(k)
                states.append(state)
            ids, at = [], len(raw)
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = array("i", ids).tobytes()
            path = raw
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special strings inside a text are their own tokens, as the library's default has it."""
        cut = [self._pieces(t) for t in texts]
        fresh = set().union(*cut).difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED_WORDS:
            self.older, self.known = self.known, dict(self.special)
            fresh = set().union(*cut).difference(self.known)
        again = fresh.intersection(self.older)
        self.known |= {w: self.older[w] for w in again}
        self.known |= self.encode_words(fresh - again)
        ids_of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, words)), dtype=np.int32) for words in cut]

    def _pieces(self, text: str) -> list[str]:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else self.is_unusual(text)
        find = self.words_exactly if odd else self.words_fast
        if not self.split_special or not any(s in text for s in self.special):
            return find(text)
        return [w for part in self.split_special.split(text) for w in ([part] if part in self.special else find(part))]

    def decode_batch(self, ids: list) -> list[str]:
        """Texts of id lists; bytes that are no UTF-8 become the replacement character."""
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *map(np.asarray, ids)]).astype(np.int64)
        length = self.length[flat]
        ends = np.concatenate(([0], np.cumsum(length)))
        data = self.flat[np.repeat(self.start[flat] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        at = ends[np.cumsum([0, *map(len, ids)])].tolist()
        return [data[lo:hi].decode("utf-8", "replace") for lo, hi in zip(at, at[1:], strict=False)]


_LOADED: dict[str, ByteBpe] = {}


def loaded(tables: Tables) -> ByteBpe:
    """The vocabulary's encoder: one in a Python worker, kept for its next task."""
    if tables.digest not in _LOADED:
        _LOADED.clear()
        _LOADED[tables.digest] = ByteBpe(tables)
    return _LOADED[tables.digest]


def chunks(lengths: list[int], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that much length, or of one row."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def _mapped(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, column: str, kind: pa.DataType) -> DataFrame:
    """(id, ids, column) for each row: the decoded text, or whether decoding gives the text again."""
    with open(tokenizer_path, encoding="utf-8") as f:
        tables = docs.sparkSession.sparkContext.broadcast(read_tables(f.read()))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out_schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, {column} {'string' if kind == pa.string() else 'boolean'}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tables.value)
        gc.disable()  # millions of small objects and no cycles: collections would take most of the time
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_pylist()
            for lo, hi in chunks(lengths):
                texts = batch.column(1)[lo:hi].to_pylist()
                ids = bpe.encode_batch(texts)
                ends = np.cumsum([0] + [len(x) for x in ids]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                decoded = bpe.decode_batch(ids)
                value = decoded if kind == pa.string() else [a == b for a, b in zip(decoded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists, pa.array(value, kind)], ["id", "ids", column])
        give_back()

    return rows.mapInArrow(run, out_schema).withColumnRenamed("id", id_col)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for each row; no shuffle, memory bounded by an Arrow batch and what a worker remembers.

    tokenizer_path: a tokenizers .json file that the driver can read; executors get its tables by broadcast (about 2 MB).
    """
    return _mapped(docs, tokenizer_path, id_col, text_col, "decoded", pa.string())


def encode_checked(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, round_trip boolean) for each row: whether decoding gives the text again, found where the ids are made."""
    return _mapped(docs, tokenizer_path, id_col, text_col, "round_trip", pa.bool_())
