"""Token ids of whole texts, word by word, so that a word is encoded once for each worker and not once for each use."""

from __future__ import annotations

import gc
import os
import re

import numpy as np

#: A single white space between two other characters: no pattern of the supported tokenizers reaches over it from the left.
_CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\x0b\x0c]\S)")
#: White space next to white space, where cutting has to look closer than at single spaces.
_RUN = re.compile(r"\s\s")
#: Signs that form tokens of their own after an ASCII letter or digit; the apostrophe is not among them, as contractions start with it.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: What a word costs in the dictionary beside its characters and ids.
_WORD_BYTES = 200


class WordwiseTokenizer:
    """``encode(texts)`` gives for each text the bytes of its ids, as little-endian unsigned 32-bit integers.

    The ids equal those of the tokenizers library for the whole text with none added at its ends. The content of an added token
    in a text (such as <|endoftext|>) is that token, as by the library's default: such texts are cut around it first. Texts are then cut
    in front of single white space, where byte-level and word-level BPE both start a new word; each distinct word goes to the
    library once and then stays in a dictionary. At half of ``keep_bytes`` a new dictionary begins, which takes over what is
    asked for again, and the one before the last goes. Signs after a word that ends in an ASCII letter or digit
    are looked up by themselves (normalizing and splitting treat both apart there), and new words of letters go to the
    library many at a time, to be told apart by the tokens that start or end a word.
    """

    def __init__(self, path: str, keep_bytes: int = 240_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only added tokens that match the text as it is are supported")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.around = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.keep_bytes = keep_bytes
        self.forget()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.by_end = bool(suffix)
        self.marks = np.array([t.endswith(suffix) if suffix else t.startswith("Ġ") for t in tokens])

    def forget(self) -> None:
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.former: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.held = 0

    @staticmethod
    def words(text: str) -> tuple[list[str], list[str]]:
        """Words that bring their own white space, and then words that follow a space, or start with a line feed instead."""
        if _RUN.search(text):
            return _CUT.split(text), []
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first], rest

    def _ask(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ask_together(self, words: list[str]) -> list[bytes]:
        """Words of letters with a space in front, joined in texts of 500 words."""
        out = []
        groups = [words[at : at + 500] for at in range(0, len(words), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(self.marks[ids])
            if self.by_end:
                cuts = np.concatenate([[0], cuts + 1])
            else:
                cuts = np.append(cuts, len(ids))
            if len(cuts) != len(group) + 1 or cuts[0] != 0 or cuts[-1] != len(ids):
                out += self._ask(group)
                continue
            raw = ids.tobytes()
            at = (4 * cuts).tolist()
            out += [raw[s:e] for s, e in zip(at, at[1:])]
        return out

    def _learn(self, new: set[str], lead: str) -> None:
        """Look up words that follow ``lead``: a space, or nothing for words that bring their own white space."""
        known, bare = self.known[lead], self.known[""]
        split, cores, signs = [], set(), set()
        for w in new:
            core = w.rstrip(_SIGNS)
            if len(core) < len(w) and core and core[-1].isascii() and core[-1].isalnum():
                split.append((w, core))
                cores.add(core)
                signs.add(w[len(core) :])
            else:
                cores.add(w)
        cores = cores.difference(known)
        plain = [c for c in cores if c.isalpha()] if lead else []
        found = dict(zip(plain, self._ask_together([lead + c for c in plain])))
        other = list(cores.difference(found))
        found.update(zip(other, self._ask([c if c[:1] == "\n" else lead + c for c in other])))
        self._keep(found, known)
        signs = list(signs.difference(bare))
        bare.update(zip(signs, self._ask(signs)))
        whole = {w: known[core] + bare[w[len(core) :]] for w, core in split}
        self._keep(whole, known)

    def _keep(self, words: dict[str, bytes], known: dict[str, bytes]) -> None:
        known.update(words)
        self.held += _WORD_BYTES * len(words) + sum(map(len, words)) + sum(map(len, words.values()))

    def _encode(self, texts: list[str]) -> list[bytes]:
        both = [self.words(t) if t else ([], []) for t in texts]
        parts = []
        for lead, side in (("", 0), (" ", 1)):
            known, former = self.known[lead], self.former[lead]
            new = set().union(*[cut[side] for cut in both]).difference(known)
            if new and former:
                self._keep(again := {w: former[w] for w in new if w in former}, known)
                new.difference_update(again)
            if new:
                self._learn(new, lead)
            parts.append([b"".join(map(known.__getitem__, cut[side])) for cut in both])
        return list(map(bytes.__add__, *parts))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and a collection would walk through all lists of words
        try:
            return self._encode_parts(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_parts(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 256):
            if self.held > self.keep_bytes // 2:
                self.known, self.former, self.held = {"": {}, " ": {}}, self.known, 0
            rows = [self.around.split(t) if t and any(a in t for a in self.added) else [t or ""] for t in texts[at : at + 256]]
            coded = iter(self._encode([s for row in rows for s in row[::2]]))
            out += [b"".join([self.added[s] if k % 2 else next(coded) for k, s in enumerate(row)]) for row in rows]
        return out


_LOADED: dict[str, WordwiseTokenizer] = {}


def release() -> None:
    """Drop this worker's words: workers are reused, and operators that don't tokenize need the memory."""
    for t in _LOADED.values():
        t.forget()


def tokenizer(path: str) -> WordwiseTokenizer:
    """The tokenizer of this Python worker; workers are reused, so it loads once."""
    if path not in _LOADED:
        _LOADED[path] = WordwiseTokenizer(path)
    return _LOADED[path]
