"""Operator 9: BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import few_rows, id_text

#: The vocabulary used by the query, by its name among the public tokenizer files.
VOCABULARY = "word_bpe_49k.json"
#: Words whose encoding a worker keeps; characters split into words at once.
KEPT_WORDS, PIECE = 200_000, 1 << 20
#: How the vocabulary splits normalised text into words.
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE = "\t-\r \x85\xa0  -     　"
ASCII_WORDS = re.compile(rf"{SUFFIXES}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
LATIN_WORDS = re.compile(
    rf"{SUFFIXES}|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ɏ0-9²³¹¼-¾]+"
)
BEYOND_LATIN = re.compile("[^\x00-\x7fß-öø-ɏ\x80-\xbf×÷]")
#: Where a text may be cut between words: before white space, and behind a digit, which is a word of its own.
BREAK = re.compile(rf"[{SPACE}]|(?<=[0-9])(?=[A-Za-z])")
#: Letters and numbers of Unicode 16, by which the library splits, that Python's tables may lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Capitals of Unicode 16 and 17 and their small letters, which the library knows.
NEW_CAPITALS = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
NEW_CAPITAL = re.compile("[" + "".join(map(chr, NEW_CAPITALS)) + "]")


@functools.cache
def any_words() -> regex.Pattern:
    """The words of any script: letters and numbers as Python's Unicode tables have them and those newer than these."""
    ranges = {"L": list(map(list, NEW_LETTERS)), "N": list(map(list, NEW_NUMBERS))}
    for c in range(sys.maxunicode + 1):
        kind = ranges.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            if kind and kind[-1][1] == c - 1:
                kind[-1][1] = c
            else:
                kind.append([c, c])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in ranges[k]) for k in "LN")
    return regex.compile(rf"{SUFFIXES}|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-level BPE vocabulary with word-end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.size = max(vocab.values()) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters])
        self.final = np.array([vocab[c + end] for c in letters])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs])
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ids_of = {t: str(i) for t, i in self.special.items()}
        self.text_of = {t: t for t in self.special}

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens among them as they stand."""
        parts = self.splitter.split(text) if self.splitter and "<|" in text else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif part.isascii():
                out += ASCII_WORDS.findall(part.lower())
            else:
                # lower-case letter by letter: a final sigma has no form of its own here
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if NEW_CAPITAL.search(low):
                    low = low.translate(NEW_CAPITALS)
                out += (any_words() if BEYOND_LATIN.search(low) else LATIN_WORDS).findall(low)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of non-empty words, in one flat array, and where each word starts in it.

        All words' symbols lie in one array.  In every round each word's pairs
        are looked up in the sorted pair keys by binary search, and all places of
        the word's lowest-ranked pair are merged, from the left where they
        overlap.  Words without a known pair leave the array.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols, of = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.final[flat[ends]]
        none = len(self.keys)
        done_symbols, done_of = [], []
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            known = (self.keys[at] == key) & (of[:-1] == of[1:])
            rank = np.full(len(symbols), none)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            lowest = np.minimum.reduceat(rank, starts)
            each = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
            ended = each == none
            if ended.any():
                done_symbols.append(symbols[ended])
                done_of.append(of[ended])
            hit = np.flatnonzero((rank == each) & ~ended)
            if len(hit):  # of neighbouring places, which overlap, take every second
                begin = np.concatenate([[True], np.diff(hit) != 1])
                run = np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            keep = ~ended
            symbols[hit] = self.merged[rank[hit]]
            keep[hit + 1] = False
            symbols, of = symbols[keep], of[keep]
        if not done_of:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        of = np.concatenate(done_of)
        order = np.argsort(of, kind="stable")
        return np.concatenate(done_symbols)[order], np.searchsorted(of[order], np.arange(len(words)))

    def learn(self, words: set[str]) -> None:
        """Encode words and keep the results as texts of ids and of tokens."""
        new = list(words)
        ids, starts = self.merge([w.encode() for w in new])
        names, marks = list(map(str, ids.tolist())), list(map(self.tokens.__getitem__, ids.tolist()))
        bounds = [*starts.tolist(), len(names)]
        for w, a, b in zip(new, bounds, bounds[1:]):
            self.ids_of[w], self.text_of[w] = " ".join(names[a:b]), " ".join(marks[a:b])

    def coded(self, texts: list[str]) -> list[tuple[str, str]]:
        """For each text its decimal ids and its decoded text."""
        split = [self.words(t) for t in texts]
        new = set().union(*split).difference(self.ids_of)
        if new:
            self.learn(new)
        out = [(" ".join(map(self.ids_of.__getitem__, w)), " ".join(map(self.text_of.__getitem__, w))) for w in split]
        if len(self.ids_of) > KEPT_WORDS:
            for w in new:
                del self.ids_of[w], self.text_of[w]
        return out

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces of about PIECE characters that end where a word does.

        A single word is taken as a whole: memory grows with its length.
        """
        at = 0
        while len(text) - at > PIECE:
            m = BREAK.search(text, at + PIECE)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> list[int]:
        """Token ids of one text."""
        return [int(i) for p in self.pieces(text or "") for i in self.coded([p])[0][0].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the vocabulary names no decoder, so marks stay."""
        return " ".join(self.tokens[i] for i in ids)


@functools.cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _groups(texts: list[str]) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n > PIECE:
            yield held
            held, n = [], 0
    if held:
        yield held


def _digests(bpe: WordBpe, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    """Token count and the two digests of each text; long texts go through piece by piece."""
    for group in _groups(texts):
        if len(group) == 1 and len(group[0]) > PIECE:
            n, ids, out, glue = 0, hashlib.sha256(), hashlib.sha256(), ""
            for p in bpe.pieces(group[0]):
                a, b = bpe.coded([p])[0]
                if a:
                    n += a.count(" ") + 1
                    ids.update((glue + a).encode())
                    out.update((glue + b).encode())
                    glue = " "
            yield n, ids.hexdigest(), out.hexdigest()
        else:
            for a, b in bpe.coded(group):
                yield a.count(" ") + bool(a), hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text.

    Returns one row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256`` (decimal
    ids joined by one space), ``decoded_sha256``.  Null and empty texts have no
    tokens; rows with null or repeated ids each get theirs.  An empty table gives no
    rows; other columns are ignored.  ``path`` is read on the executors, where the tokenizer files are installed.
    """
    name = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name or vocabulary_path())
        for b in few_rows(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n, ids, out = zip(*_digests(bpe, texts)) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every whole text; rules as for the digests."""
    name = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name or vocabulary_path())
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
