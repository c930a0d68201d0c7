"""Token ids of many texts at once: each different word and each different piece is encoded once."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a tokenizer file must prepare texts for the quick way to be exact.
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": PIECE_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Words of these characters alone are in normal form, keep it in lower case, and hold no white space.
PLAIN_WORD = r"^[\x{21}-\x{7E}\x{A1}-\x{12F}\x{131}-\x{17F}]*$"
PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180))]
#: Different pieces an encoder remembers before it keeps those of the latest part alone, and bytes of text a part has.
CACHE, PART = 400_000, 4_000_000


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in PLAIN if unicodedata.category(c)[0] == kind)


def _pieces() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\n{letters}{numbers}]+|\n")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own and b != 0x0A]
    shift = sum(b < 0x0A for b in rest)  # the line feed has a letter too, but parts words here
    table = {b: chr(b) for b in own}
    return table | {b: chr(256 + i + (i >= shift)) for i, b in enumerate(rest)} | {0x0A: "\n"}


def spans(texts: pa.Array, limit: int = PART) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text makes one of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    begin = 0
    while begin < len(sizes):
        base = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield begin, end
        begin = end


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat``, one after another, and the size of each."""
    taken = sizes[at]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts[at] - (ends - taken), taken)
    places += np.arange(total)
    return flat.take(places), taken


class Numbers(dict):
    """Pieces numbered in the order in which they were first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class WordEncoder:
    """Ids of whole texts, equal to those of the tokenizer without special tokens added.

    A tokenizer that lower-cases, drops white space and cuts between letters, numbers and other
    signs encodes the words of a text one by one, and the pieces of a word too.  Words of plain
    characters are cut here and their pieces encoded by the tokenizer's own model, each different
    piece once; other words, and those where a special token may stand, go through the whole
    tokenizer, each different one once a part.  Any other tokenizer encodes each text whole.
    """

    def __init__(self, path: str, remember: int = CACHE):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as stream:
            config = json.load(stream)
        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.by_word = (
            (config.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and (config.get("pre_tokenizer") or {}).get("pretokenizers") == PRE_TOKENIZERS
            and config["model"]["type"] == "BPE"
            and all(t["content"].startswith("<|") and not t["normalized"] for t in config["added_tokens"])
        )
        self.model, self.pieces, self.letters = self.tokenizer.model, _pieces(), _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known = Numbers({"\n": 0})  # stands between words and has no ids
        self.flat, self.sizes = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.latest = np.zeros(1, dtype=np.int64)

    def _keep_latest(self) -> None:
        """Forget the pieces that the latest part had no use for."""
        kept = np.unique(np.append(self.latest, 0))
        pieces = list(self.known)
        self.known = Numbers((pieces[i], n) for n, i in enumerate(kept.tolist()))
        self.flat, self.sizes = gather(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, kept)
        self.latest = np.zeros(1, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self._whole(texts.to_pylist())
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        flat, sizes = self._words(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False)
        ids, taken = gather(flat, np.cumsum(sizes) - sizes, sizes, at)
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(taken)))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter((i for ids in found for i in ids), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the words."""
        plain = pc.and_(
            pc.match_substring_regex(words, PLAIN_WORD), pc.invert(pc.match_substring(words, "<|"))
        )
        is_plain = plain.to_numpy(zero_copy_only=False).astype(bool)
        flat, some = self._plain(words.filter(plain))
        more, others = self._whole(words.filter(pc.invert(plain)).to_pylist())
        sizes = np.concatenate((some, others))
        order = np.argsort(np.concatenate((np.flatnonzero(is_plain), np.flatnonzero(~is_plain))))
        return gather(np.concatenate((flat, more)), np.cumsum(sizes) - sizes, sizes, order)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if len(self.known) != len(self.sizes):  # an error left pieces without ids
            self._forget()
        if len(self.known) > self.remember:
            self._keep_latest()
        every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        found = self.pieces.findall(pc.binary_join(every, "\n")[0].as_py().lower())
        at = np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))
        del found
        if count := len(self.known) - len(self.sizes):
            new = list(islice(reversed(self.known), count))[::-1]
            spelled = "\n".join(new).encode().decode("latin-1").translate(self.letters).split("\n")
            ids = [[t.id for t in self.model.tokenize(p)] for p in spelled]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=count)
            more = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum()))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, more))
        self.latest = at
        flat, taken = gather(self.flat, np.cumsum(self.sizes) - self.sizes, self.sizes, at)
        word = np.cumsum(at == 0)
        return flat, np.bincount(word, weights=taken, minlength=len(words)).astype(np.int64)
