"""Byte-level BPE by a trie over distinct words with last-token states.

A text is cut into words as the vocabulary file's pre-tokenizer does. Distinct words go into a
trie of bytes. The encoding of a prefix is fixed by its last token: it is the token that ends
there, starts where a shorter prefix ends, and may follow that prefix's own last token (merging
the two tokens' bytes gives just those two back). So each trie node holds one token, found from
the nodes above it, depth first; prefixes shared by many words are solved once, and a word is
read off by walking back from its node.

Each group of texts walks one trie, of the words it has not met before; ids of words are kept
from group to group and start anew when they reach a bound, which changes no result. No shuffle is needed, and a lost task is just run again.

Texts are taken by number and by bytes, and the words of a text a bounded number at a time, so what a
task holds beyond one text, its ids and their text does not grow with the length of texts or words.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows
are encoded row by row; a very long text is encoded whole, as is a word of any length; an empty table gives no rows; other columns are not read. The added
token's own string in a text gives its id, as in the library's default.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from lumenframe.llm.words import id_and_text

#: Words kept with their ids, and their characters, at which a task starts anew.
MOST_WORDS, MOST_CHARS = 300_000, 1 << 23
#: Words that are looked up at once, and ids that are decoded at once.
AT_ONCE = 1 << 19
#: Verdicts on token pairs that are kept.
MOST_PAIRS = 1 << 20
#: Bytes at a token's end that tell how long it may be.
ENDING = 3


def _class(points: list[int]) -> str:
    """A character class of sorted code points."""
    edges = [i for i in range(1, len(points)) if points[i] != points[i - 1] + 1]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b - 1]:08x}" for a, b in zip([0, *edges], [*edges, len(points)]))


@lru_cache(2)
def word_pattern(top: int = sys.maxunicode) -> re.Pattern:
    """The published pre-tokenizing pattern for texts of code points up to ``top``, its classes
    spelled out.

    Of code points that only newer Unicode versions call letters or numbers, the tokenizers
    library's own pre-tokenizer is asked which its version does.
    """
    newer, space = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"\s")
    joins = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    found: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for point in range(top + 1):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            found[kind[0]].append(point)
        elif kind[0] in "ZC" and kind != "Cs":
            if space.match(c):
                found["S"].append(point)
            elif kind == "Cn" and newer.match(c):
                found["L" if len(joins("a" + c)) == 1 else "N"] += [point] * (len(joins("a" + c)) == 1 or len(joins("1" + c)) == 1)
    letters, numbers, spaces = (_class(found[k]) for k in "LNS")
    return re.compile(
        rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text, ``AT_ONCE`` at a time; most texts are Latin-1, for which small classes do."""
    try:
        text.encode("latin-1")
        pattern = word_pattern(0xFF)
    except UnicodeEncodeError:
        pattern = word_pattern()
    if len(text) <= AT_ONCE:
        yield pattern.findall(text)
    else:
        yield from map(list, itertools.batched((m[0] for m in pattern.finditer(text)), AT_ONCE))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, ids and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, byte = spec["model"], _byte_of_char()
        if model["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.bytes_of = {i: bytes(byte[c] for c in token) for token, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}
        self.sizes = [len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)]
        self.pairs: dict[tuple[int, int], bool] = {}
        made = {token: (rank, pair) for pair, (rank, token) in sorted(self.merges.items(), key=lambda m: -m[1][0])}
        # Each token's right and left edge: (part, rank of the merge that ends the part's standing alone).
        self.right_edge, self.left_edge = ({t: self._edge(t, made, side) for t in self.bytes_of} for side in (1, 0))
        # Only tokens that their own bytes merge back into can stand in an encoding.
        whole = {i for b, i in self.id_of.items() if len(b) == 1}
        for token, (rank, (left, right)) in reversed(made.items()):
            if left in whole and right in whole and not self._crossed(left, right, rank):
                whole.add(token)
        self.reachable = {b: i for b, i in self.id_of.items() if i in whole}
        # How long a token may be that ends in given bytes; any other ending belongs to shorter tokens only.
        self.longest_ending: dict[bytes, int] = {}
        for b in self.reachable:
            if len(b) >= ENDING:
                self.longest_ending[b[-ENDING:]] = max(len(b), self.longest_ending.get(b[-ENDING:], 0))

    @staticmethod
    def _edge(token: int, made: dict, side: int) -> list[tuple[int, int]]:
        parts = [(token, sys.maxsize)]
        while token in made:
            rank, pair = made[token]
            token = pair[side]
            parts.append((token, rank))
        return parts

    def _crossed(self, left: int, right: int, until: int) -> bool:
        """Whether, before rank ``until``, some merge crosses between two tokens side by side.

        It would be of a part at the left token's right edge with one at the right token's left
        edge, both still standing alone at its rank. Of equal ranks the leftmost goes first: before
        the crossing on the left, after it on the right.
        """
        merges = self.merges
        return any(
            (m := merges.get((x, y))) is not None and m[0] < min(x_end, until) and m[0] <= y_end
            for x, x_end in self.right_edge[left]
            for y, y_end in self.left_edge[right]
        )

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = not self._crossed(left, right, sys.maxsize)
        return known


def read_off(state: list[int], length: int, sizes: list[int]) -> list[int]:
    """A word's ids, walked back from its last token."""
    ids = []
    while length:
        ids.append(state[length])
        length -= sizes[state[length]]
    return ids[::-1]


def encode_words(words: list[bytes], v: Vocabulary) -> Iterator[list[int]]:
    """Ids of sorted words, by a depth-first walk of their trie.

    ``state`` is the path to the current node: the last token of each prefix. Sorted words are
    the trie's leaves in depth-first order, so the path is cut back to where the next word
    branches off, and only the nodes below are solved.
    """
    state, last = [-1], b""
    reachable, ending, known, may_follow = v.reachable.get, v.longest_ending.get, v.pairs.get, v.may_follow
    for word in words:
        shared, most = 0, min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del state[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            # Tokens that end here, the longest first.
            for start in range(max(0, end - ending(word[max(0, end - ENDING) : end], ENDING - 1)), end):
                token = reachable(word[start:end])
                if token is None:
                    continue
                fits = not start or known((state[start], token))
                if fits or fits is None and may_follow(state[start], token):
                    state.append(token)
                    break
        last = word
        yield read_off(state, len(word), v.sizes)


def _taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start : start + size]``, one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        added = sorted(v.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.token_bytes = np.frombuffer(b"".join(v.bytes_of.get(i, b"") for i in range(len(v.sizes))), np.uint8)
        self.token_size = np.array(v.sizes, np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.chars = 0
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def split(self, text: str) -> Iterator[list[str]]:
        """Words and added tokens, in order, in lists of bounded length."""
        if not self.cut or not self.cut.search(text):
            yield from words_of(text)
            return
        for i, piece in enumerate(self.cut.split(text)):
            yield from [[piece]] if i % 2 else words_of(piece)

    def _learn(self, new: set[str]) -> None:
        """Adds the encodings of distinct words to those kept."""
        added = self.vocabulary.added
        special = sorted(new & added.keys())
        encoded = sorted(w.encode() for w in new if w not in added)
        found = [*encode_words(encoded, self.vocabulary), *([added[w]] for w in special)]
        self.words.update(zip([*(w.decode() for w in encoded), *special], itertools.count(len(self.words))))
        self.chars += sum(map(len, new))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.int32)])

    def _ids(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of lists of words, and how many each list has."""
        if len(self.words) > MOST_WORDS or self.chars > MOST_CHARS:
            self._forget()
        if new := set(itertools.chain.from_iterable(split)).difference(self.words):
            self._learn(new)
        count = np.fromiter(map(len, split), np.int64, len(split))
        flat = itertools.chain.from_iterable(split)
        which = np.fromiter(map(self.words.__getitem__, flat), np.int64, count.sum())
        sizes = self.sizes[which]
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(count)]
        return _taken(self.flat, self.starts[which], sizes), np.diff(ends, prepend=0)

    def _groups(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
        """The texts' lists of words with the texts' numbers, about ``AT_ONCE`` words at a time."""
        numbers, lists, held = [], [], 0
        for number, text in enumerate(texts):
            for words in self.split(text) if text else ():
                numbers.append(number)
                lists.append(words)
                held += len(words)
                if held >= AT_ONCE:
                    yield numbers, lists
                    numbers, lists, held = [], [], 0
        if lists:
            yield numbers, lists

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and how many each text has."""
        found, counts = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        for numbers, lists in self._groups(texts):
            ids, sizes = self._ids(lists)
            found.append(ids)
            np.add.at(counts, numbers, sizes)
        return np.concatenate(found), counts

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Each text's token bytes as text; bytes that are not UTF-8 become replacement characters."""
        some = (ids[at : at + AT_ONCE] for at in range(0, len(ids), AT_ONCE))
        data = b"".join(_taken(self.token_bytes, self.token_start[i], self.token_size[i]).tobytes() for i in some)
        ends = np.concatenate(([0], np.cumsum(self.token_size[ids])))[np.cumsum(counts)].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


@lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


#: Texts encoded at once, and their bytes where that is more than one text.
TEXTS, TEXT_BYTES = 512, 1 << 22


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``TEXTS`` rows and ``TEXT_BYTES`` bytes of text at most; a longer text is a slice of its own."""
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(ends, ends[at] + TEXT_BYTES, "right")) - 1
        end = min(max(fits, at + 1), at + TEXTS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def coded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_tokens, ids, decoded) of batches of ids and texts."""
    for part in itertools.chain.from_iterable(map(parts, batches)):
        ids, counts = encoder.encode_batch(part.column(1).to_pylist())
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), ids)
        texts = pa.array(encoder.decode_batch(ids, counts), pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), lists, texts], names=["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each whole text and the text they give back."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded(_encoder(path), batches)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string")
