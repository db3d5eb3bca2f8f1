"""Token ids of whole texts, by a public tokenizer file, fast enough for a corpus."""

from __future__ import annotations

import os
import re

import numpy as np

#: Characters for which lower case, composition and classes are plain.
_PLAIN = re.compile("[\t\n\r -~\xa1-\xa9\xab-\xae\xb0\xb1\xb4-\xb8\xbb\xbf-įı-ɏ]*")
_PLAIN_ASCII = re.compile("[\t\n\r -~]*")


class Memo(dict):
    """Numbers words in the order in which they are first seen."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


#: How the vocabulary cuts plain lower-cased text into words.
_LETTER = "a-z\xb5\xdf-\xf6\xf8-ɏ"
_WORD = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[0-9]|[^\\s0-9{_LETTER}]+")
#: Stands for the vocabulary's end-of-word mark; no UTF-8 text holds this byte.
_WORD_END = b"\xff"


def _byte_of() -> dict[str, int]:
    """The byte behind each printable stand-in of byte-level vocabularies: bytes without one follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordTokens:
    """Ids of texts under a byte-level vocabulary of words, none of which goes across white space.

    Each different run between white space is encoded once and remembered (at most ``words`` of them, then
    anew). The merges of a plain word are done by tiktoken over the same vocabulary, several times as fast
    with the same ids; texts with special tokens or characters that need normalisation are encoded whole
    by tokenizers.
    """

    def __init__(self, path: str, words: int = 200_000, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), words
        self.library.encode_special_tokens = not special
        byte = _byte_of()
        own = set(self.library.get_added_tokens_decoder())
        ranks = {
            bytes(byte[ch] for ch in t.removesuffix("</w>")) + _WORD_END * t.endswith("</w>"): n
            for t, n in self.library.get_vocab().items() if n not in own
        }
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.memo = Memo()
        self.ids, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        if not self.memo.new:
            return
        merge, found, size = self.merge, [], []
        for run in self.memo.new:
            before = len(found)
            for word in _WORD.findall(run.lower()):
                found += merge(word.encode() + _WORD_END)
            size.append(len(found) - before)
        flat, size = np.array(found, np.uint32), np.array(size, np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids, self.start, self.size = np.r_[self.ids, flat], np.r_[self.start, start], np.r_[self.size, size]
        self.memo.new = []

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """An array of ids for each text, with ``end`` after its own ids if given."""
        if len(self.memo) > self.most:
            self._forget()
        words, many, whole = [], np.zeros(len(texts), np.int64), {}
        for k, t in enumerate(texts):
            plain = _PLAIN_ASCII.fullmatch(t) if t.isascii() else _PLAIN.fullmatch(t)
            if plain and "<|" not in t:
                own = t.split()
                many[k] = len(own)
                words += own
            else:
                whole[k] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
        number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        self._learn()
        size = self.size[number]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[number] - (ends - size), size)]
        cut = np.r_[0, ends][np.cumsum(many)]
        out, at = [], 0
        tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
        for k in range(len(texts)):
            own = whole[k] if k in whole else flat[at : cut[k]]
            at = cut[k]
            out.append(np.concatenate([own, tail]))
        return out


_OPEN: dict[tuple[str, bool], WordTokens] = {}


def word_tokens(path: str, special: bool = True) -> WordTokens:
    """One tokenizer for each file and Python worker; without ``special``, special tokens in texts are ordinary text."""
    if (path, special) not in _OPEN:
        _OPEN[path, special] = WordTokens(path, special=special)
    return _OPEN[path, special]
