"""Token ids by the tokenizers library, a word at a time.

A vocabulary file says how a text is cut before merges.  For texts of plain
characters (printable ASCII, white space and Latin letters with marks) the
same cut is made here with a regular expression; each distinct piece then
goes through the library once per process and is kept in a bounded
dictionary.  A text with any other character goes through the library whole.
``tests/llm`` compares this with encoding whole texts.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

from .common import blocks, process_cache

#: Entries of one generation; when it is full it becomes the elder one, from which pieces still in use come back.
CACHE_ENTRIES = 250_000
#: Longer pieces aren't kept.
CACHE_CHARS = 48
#: Characters whose classes are the same here and in the library, and that normal forms leave alone.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-įı-ɏ]*")
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"
_SHORT = r"'(?:[stmd]|re|ve|ll)"
#: The cuts that the vocabulary files state, for plain characters.
BYTE_LEVEL = re.compile(rf"{_SHORT}| ?{_LETTERS}+| ?[0-9]+| ?{_MARKS}+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"{_SHORT}|{_LETTERS}+|[0-9]|{_MARKS}+")


class Signs(dict):
    """The model's signs for a character's bytes, as the library's byte-level step makes them."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = "".join(p for p, _ in self.step.pre_tokenize_str(chr(code)))
        return self[code]


class Pieces(dict):
    """Ids of pieces; one that isn't here comes from the elder generation or from the library."""

    def __init__(self, make, elder: dict[str, bytes]):
        self.make, self.elder = make, elder

    def __missing__(self, p: str) -> bytes:
        v = self.elder.get(p)
        if v is None:
            v = self.make(p)
        if len(p) <= CACHE_CHARS:
            self[p] = v
        return v


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.signs = self.tokenizer.model, Signs()
        cuts = {("ByteLevel", False): (BYTE_LEVEL, False), ("Sequence", True): (WORD_LEVEL, True)}
        # a file of another kind is used through whole texts alone
        self.cut, self.lower = cuts.get(self._kind(), (None, False))
        self.known = Pieces(self.piece, {})

    def _kind(self) -> tuple[str, bool]:
        probe = "Ab c'll d1,2  e_éf\n"
        pre, norm = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        text = norm.normalize_str(probe) if norm else probe
        pieces = [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
        kind = (type(pre).__name__, norm is not None)
        ours = {False: BYTE_LEVEL.findall(probe), True: WORD_LEVEL.findall(probe.lower())}[kind[1]]
        return kind if pieces == ours else ("", False)

    def whole(self, text: str) -> bytes:
        """The library's ids of one text."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, p: str) -> bytes:
        """The model's ids of one piece."""
        return array("I", [t.id for t in self.model.tokenize(p.translate(self.signs))]).tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text."""
        if len(self.known) > CACHE_ENTRIES:
            self.known = Pieces(self.piece, dict(self.known))
        get, cut, lower, plain, out = self.known.__getitem__, self.cut, self.lower, _PLAIN.fullmatch, []
        for t in texts:
            if not t:
                out.append(b"")
            elif cut is None or not plain(t):
                out.append(self.whole(t))
            else:
                out.append(b"".join(map(get, cut.findall(t.lower() if lower else t))))
        return out


def encoder(path: str) -> PieceEncoder:
    """The process's encoder for a vocabulary file."""
    kept = process_cache().setdefault("encoders", {})
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def encoded(batches, path: str, end: bytes) -> Iterator[tuple[int | None, bytes]]:
    """``(doc_id, ids)`` of each row of (doc_id, text) batches; a null text is empty."""
    many = encoder(path).encode_many
    for b in blocks(batches):
        texts = b.column(1).to_pylist()
        yield from zip(b.column(0).to_pylist(), (ids + end for ids in many([t or "" for t in texts])))
