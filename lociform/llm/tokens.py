"""The two byte-pair tokenizers of the public vocabulary folder, in fast forms."""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain, filterfalse

import numpy as np


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: a byte
    that is printable stands for itself, the others take the letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


def byte_bpe(path: str | None = None):
    """An encoder of a byte-level BPE file of the ``tokenizers`` library: ``encode_to_numpy(text)`` gives the same ids.

    The file's ids are its merge ranks, so the vocabulary can be handed to the faster
    merge loop of tiktoken; strings of special tokens in a text are ordinary text.
    """
    import public_tokenizers
    import tiktoken

    letters = byte_letters()
    held = json.load(open(path or path_of("byte_bpe_50k.json"), encoding="utf-8"))
    special = {t["content"] for t in held["added_tokens"]}
    ranks = {bytes(letters[c] for c in w): i for w, i in held["model"]["vocab"].items() if w not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordBpe:
    """The ``tokenizers`` library on the distinct words of a slice, with a bounded memory of earlier words.

    White space never reaches this vocabulary's pieces, so a text's ids are those of its
    words (runs between white space) one after the other.
    """

    SPACES = re.compile("[\t-\r ]+")
    SEPARATORS = re.compile("[\x1c-\x1f]")
    #: Letters that are one code point in any normal form that the library makes, of simple case.
    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]{1,64})([.,;:!?]?)")
    #: The bytes that can end such a letter in lower case, and what marks each as the last of a run.
    ENDS = {b: bytes([b - 32]) for b in range(97, 123)} | {b: bytes([b - 0x9F]) for b in range(0x9F, 0xC0)}

    def __init__(self, path: str | None = None, cached: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or path_of("word_bpe_49k.json"))
        self.tokenizer.encode_special_tokens = True
        self.cached, self.memory, self.parts = cached, {}, {}
        self.merge = self.letters(path or path_of("word_bpe_49k.json"))
        self.marks = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ".,;:!?"}

    def words(self, text: str) -> list[str]:
        """Runs between white space; the four separators of ASCII, which are none to the library, stay in their words."""
        return self.SPACES.split(text) if self.SEPARATORS.search(text) else text.split()

    def letters(self, path: str):
        """tiktoken's merge loop over the file's ids for runs of small Latin letters. A run's last byte, which the file marks
        as the end of a word, takes a byte that such runs have no other use for; ids follow the order of merges."""
        import tiktoken

        letters = byte_letters()
        usual = {*range(97, 123), 0xC3, *self.ENDS}
        ranks = {}
        for word, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items():
            body, end = word.removesuffix("</w>"), word.endswith("</w>")
            held = bytes(letters.get(c, 0) for c in body)
            if held and usual.issuperset(held) and (not end or held[-1] in self.ENDS):
                ranks[held[:-1] + self.ENDS[held[-1]] if end else held] = i
        for byte in range(256):  # bytes that no run has
            ranks.setdefault(bytes([byte]), (1 << 31) + byte)
        return tiktoken.Encoding("letters", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def learn(self, new: list[str]) -> None:
        """Put the ids of new words into the memory. A word that is one run of Latin letters, with one mark behind it at most,
        is left alone by the normaliser and the splitter, so it needs the merges only; any other goes through the whole library."""
        memory, parts, match, merge, ends, left = self.memory, self.parts, self.PLAIN.fullmatch, self.merge, self.ENDS, []
        for w in new:
            m = match(w)
            if m is None:
                left.append(w)
                continue
            run, mark = m.groups()
            run = run.lower()
            ids = parts.get(run)
            if ids is None:
                if len(parts) >= self.cached:
                    parts.clear()
                held = run.encode()
                ids = parts[run] = array("I", merge(held[:-1] + ends[held[-1]])).tobytes()
            memory[w] = ids + self.marks[mark] if mark else ids
        for i in range(0, len(left), 4096):
            part = left[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memory[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        words = [self.words(t) for t in texts]
        new = set(filterfalse(self.memory.__contains__, chain.from_iterable(words)))
        full = len(self.memory) + len(new) > self.cached
        if full and 2 * len(new) > len(distinct := set(chain.from_iterable(words))):  # other texts than before
            self.memory, new = {}, distinct
        self.learn(list(new))
        last = array("I", [end]).tobytes()
        known = self.memory.__getitem__
        out = [np.frombuffer(b"".join([*map(known, ws), last]), "<u4") for ws in words]
        for w in new:  # frequent words came early and stay; the number of long ones doesn't bound their size
            if full or len(w) > 64:
                del self.memory[w]
        return out


#: One encoder for each process and file; reading a vocabulary takes a second.
_HELD: dict = {}


def held(kind, path: str | None):
    key = (kind, path)
    if key not in _HELD:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
        _HELD[key] = kind(path)
    return _HELD[key]
