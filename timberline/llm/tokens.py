"""Token ids of whole texts, with a memo of white-space separated words.

The vocabulary's normalizer works inside words (white space is dropped, and no
pre-token crosses it), so a text's ids are the ids of its words in order. Words
repeat, hence each distinct word is encoded once per worker, many new ones in one call: a word of
letters is one pre-token, whose last id alone is marked as a word's end. The memo is
bounded and restarts empty when full.
"""

from __future__ import annotations

import gc
import re
from itertools import chain

import numpy as np

MEMO = 900_000
JOINED = 500
#: ASCII punctuation without the apostrophe, which contractions begin with.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_APART = re.compile(rb"(?<=[a-z])([,.])(?=[ \n])").sub
_ENCODERS: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(word: bytes) -> bool:
    """Whether a word is letters, and stays so in lower case (a dotted capital I doesn't)."""
    try:
        return word.decode().isalpha() and b"\xc4\xb0" not in word
    except UnicodeDecodeError:
        return False


def _plain(text: bytes) -> bytes:
    """The text with fewer distinct words but the same ids: ASCII in lower case (the normalizer's work), and
    a comma or full stop apart from the letter before it (a pre-token of its own, as white space follows).
    """
    if b"<|" in text:  # special tokens mind their case
        return text
    return _APART(rb" \1", text.lower())


class WordEncoder:
    """ids(texts): for each UTF-8 text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(code.ids, "<u4").tobytes() for code in found]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters: one call, cut behind each id that ends a word."""
        code = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0]
        ids = np.array(code.ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or (len(cuts) and cuts[-1] != len(ids)):
            return self._encode([w.decode() for w in words])
        raw, at = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at)]

    def _learn(self, unknown: set[bytes]) -> None:
        memo, letters, others, parts = self.memo, [], [], []
        cores, ends = set(), set()
        for word in unknown:
            if word.isalpha():
                letters.append(word)
                continue
            core = word.strip(PUNCTUATION)
            if not core or b"<|" in word or not (core.isalpha() or _letters(core)):
                others.append(word)
            elif len(core) == len(word):
                letters.append(word)
            else:
                at = word.index(core)
                head, tail = word[:at], word[at + len(core) :]
                parts.append((word, head, core, tail))
                if core not in memo and core not in unknown:
                    cores.add(core)
                if head and head not in memo:
                    ends.add(head)
                if tail and tail not in memo:
                    ends.add(tail)
        letters += cores
        others += ends.difference(others)
        for at in range(0, len(letters), JOINED):
            group = letters[at : at + JOINED]
            memo.update(zip(group, self._encode_letters(group)))
        if others:
            memo.update(zip(others, self._encode([w.decode("utf-8", "replace") for w in others])))
        memo[b""] = b""
        for word, head, core, tail in parts:
            memo[word] = memo[head] + memo[core] + memo[tail]

    def release(self) -> None:
        """Forgets the memo, at a task's end: a reused worker would hold it through other stages."""
        self.memo = {}
        gc.enable()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        # ASCII white space only: every piece boundary is white space for the tokenizer, too
        words = [_plain(t).split() for t in texts]
        unknown = set(chain.from_iterable(words)).difference(self.memo)
        if unknown:
            self._learn(unknown)
        get = self.memo.__getitem__
        return [b"".join(map(get, w)) for w in words]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    # a large memo without cycles: collecting garbage would only walk over it
    gc.disable()
    return _ENCODERS[path]
