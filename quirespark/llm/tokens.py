"""Whole texts to token ids with a public tokenizer file, at the speed of a dictionary for words seen before.

The library encodes. But where a text's white space is plain, a tokenizer that never merges across it gives the same ids
for a text as for its words one by one, and most words come again; so each word is encoded once and its ids are kept in a
bounded table. Texts with other white space go to the library cut between words only, and tokenizers of other kinds get every text whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: White space other than space and line feed, as any library may see it.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: A word that every pattern splits alike: Latin letters, whose case and normal form are settled, and then punctuation.
PLAIN = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]*)")
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
#: Characters that are encoded at once; a longer text is cut between words.
CUT = 1 << 18
#: Words kept. A full table stays as it is, since frequent words come early, until RENEWED words more weren't in it.
KEPT = 700_000
RENEWED = 2_000_000


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """word -> packed ids; a word that isn't there is encoded, and kept while there is room.

    ``spaced``: a word stands for itself with a space before it, unless it begins with a line feed. ``lower``: lower case first.
    """

    def __init__(self, tokenizer: Tokenizer, dtype: str, spaced: bool, lower: bool):
        self.encode, self.split, self.code = tokenizer.encode, tokenizer.model.tokenize, "H" if dtype == "<u2" else "I"
        self.spaced, self.lower, self.missed, self.letters = spaced, lower, 0, _byte_letters()

    def packed(self, text: str) -> bytes:
        return array(self.code, self.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        """Ids of what the tokenizer's pattern leaves whole."""
        return array(self.code, [x.id for x in self.split(text.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def new(self, word: str) -> bytes:
        if not (m := PLAIN.fullmatch(word)):
            return self.packed(" " + word if self.spaced and word[:1] != "\n" else word)
        line, letters, marks = m.groups()
        end = self.part(marks) if marks else b""
        if line:
            return self.part(line) + self.part(letters) + end
        if marks or (self.lower and letters != letters.lower()):
            return self[letters.lower() if self.lower else letters] + end
        return self.part(" " + letters if self.spaced else letters)

    def __missing__(self, word: str) -> bytes:
        found = self.new(word)
        if len(self) < KEPT:
            if len(word) <= 64:
                self[word] = found
        else:
            self.missed += 1
            if self.missed >= RENEWED:
                self.missed = 0
                self.clear()
        return found


class TextIds:
    """Ids of texts. ``dtype``: two bytes an id if the vocabulary allows, else four; little-endian.

    ``plain_marks``: the strings of special tokens in a text are ordinary text, so that no text can end a document; otherwise they are their tokens, as the library has it by default.
    """

    def __init__(self, path: str, plain_marks: bool = True):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_marks
        added = self.tokenizer.get_added_tokens_decoder().values()
        # each with the signs that it begins with, which are quickly looked for
        self.marks = [(t.content, re.match(r"[^\w\s]*", t.content)[0]) for t in added if t.content and not (plain_marks and t.special)]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer")}
        self.kind = self._kind(spec.get("normalizer"), spec.get("pre_tokenizer") or {})
        self.words = WordIds(self.tokenizer, self.dtype, self.kind == "spaced", self.kind == "bare")

    @staticmethod
    def _kind(normalizer: dict | None, pre: dict) -> str:
        """'spaced': words keep the space before them; 'bare': white space is dropped; 'other'."""
        if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return "spaced"
        if pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and r"|[^\s" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
            kinds = {x["type"] for x in (normalizer or {"normalizers": []}).get("normalizers", [])}
            return "bare" if kinds <= {"NFC", "Replace", "Lowercase"} else "other"
        return "other"

    def _cuts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > CUT and (m := BETWEEN_WORDS.search(text, at + CUT)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _packed(self, text: str) -> list[bytes]:
        words = self.words
        if self.kind == "other" or not text or ODD_SPACE.search(text):
            return [words.packed(text)]
        if self.kind == "bare":
            return list(map(words.__getitem__, text.split()))
        head, body = ("", text[1:]) if text[0] == " " else ("\n", text)
        if not body or body[0] in " \n" or body[-1] == " " or body.endswith("\n\n") or "  " in body or " \n" in body or "\n " in body or "\n\n\n" in body:
            return [words.packed(text)]
        units = body.replace("\n", " \n").split(" ")
        if head:  # the first word has no space before it
            return [words.packed(units[0]), *map(words.__getitem__, units[1:])]
        return list(map(words.__getitem__, units))

    def __call__(self, text: str | None) -> np.ndarray:
        """All ids of one whole text; none for a null."""
        if text and any(head in text and (m in text or m.lower() in text.lower()) for m, head in self.marks):
            return np.frombuffer(self.words.packed(text), self.dtype)  # the library finds them in the whole text
        cuts = [text or ""] if self.kind == "other" else self._cuts(text or "")  # other kinds may merge across a blank
        return np.frombuffer(b"".join(x for cut in cuts for x in self._packed(cut)), self.dtype)


@lru_cache(maxsize=4)
def text_ids(path: str, plain_marks: bool = True) -> TextIds:
    """One encoder per tokenizer file and Python worker, so that its table lives on from task to task."""
    return TextIds(path, plain_marks)
