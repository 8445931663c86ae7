"""Token ids by the tokenizers library, with the ids of each chunk remembered.

Byte-pair merging never crosses a pre-token, and both public vocabularies
start a new pre-token at a single space between two visible characters (the
space goes with what follows) and at a line feed between two visible
characters. A text may therefore be cut there and its chunks encoded apart;
the ids joined are those of the whole text. Natural text repeats its words, so
most chunks are found in a dictionary and the library sees each only once.
Whatever is not plainly of that shape (tabs, doubled spaces, empty lines,
invisible characters) stays inside a larger chunk. A text that holds the string
of an added token (``<|endoftext|>``) goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

#: Chunks in each of the two generations that a worker remembers, some 50 MB: a full young one becomes the old one.
REMEMBERED = 250_000
#: Longer chunks are not remembered.
LONGEST = 64

#: A space between two plainly visible characters.
BREAK = re.compile("(?<=[!-~À-ɏͰ-ϿЀ-ӿ]) (?=[!-~À-ɏͰ-ϿЀ-ӿ])")


#: A word of Latin letters, perhaps with a full stop or comma: one pre-token, perhaps two.
_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")

#: Packers of up to fifteen ids.
_PACKERS = [struct.Struct(f"<{n}I").pack for n in range(16)]


class _Chunks(dict):
    """Chunk to its ids as little-endian unsigned 32-bit integers.

    A plain word is normalised here and goes straight to the library's model,
    which skips the normaliser and the pre-tokeniser; both are asked once, at
    the start, how they treat letters and the space before a word.
    """

    def __init__(self, tokenizer, before: str):
        super().__init__()
        self.tokenizer, self.before, self.tokenize = tokenizer, before, tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}
        shown = tokenizer.pre_tokenizer.pre_tokenize_str
        self.lower = bool(tokenizer.normalizer) and tokenizer.normalizer.normalize_str("A") == "a"
        self.mark = shown(before + "a")[0][0][:-1]
        self.letters = {ord(x): shown(x)[0][0] for x in map(chr, range(0xC0, 0x100)) if _WORD.fullmatch(x)}
        self.ends = {x: self._packed(tokenizer.encode(x, add_special_tokens=False).ids) for x in ".,"} | {"": b""}

    @staticmethod
    def _word(chunk: str) -> str:
        """The chunk without a full stop or comma after it if that is a word as of ``_WORD``, else nothing; ASCII needs no expression."""
        if chunk.isascii():
            core = chunk[:-1] if chunk[-1:] in (".", ",") else chunk
            return core if core.isalpha() else ""
        return found[1] if (found := _WORD.fullmatch(chunk)) else ""

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return _PACKERS[len(ids)](*ids) if len(ids) < len(_PACKERS) else struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.old.get(chunk)) is not None:
            pass
        elif len(chunk) <= LONGEST and (word := self._word(chunk)):
            core = word.lower() if self.lower else word
            if core != chunk:  # its plain form is asked for first
                out = self[core] + self.ends[chunk[len(word) :]]
            else:
                ids = [x.id for x in self.tokenize(self.mark + (core if core.isascii() else core.translate(self.letters)))]
                out = _PACKERS[len(ids)](*ids) if len(ids) < 16 else self._packed(ids)
        else:
            out = self._packed(self.tokenizer.encode(self.before + chunk, add_special_tokens=False).ids)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """The library's ``encode(text, add_special_tokens=False)`` with the file as it is loaded.

    A null text is empty. Equal texts get equal ids, whatever came before.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._first, self._later = _Chunks(tokenizer, ""), _Chunks(tokenizer, " ")

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, packed; empty for null or empty text."""
        if not text:
            return b""
        if self._added and self._added.search(text):
            return _Chunks._packed(self._tokenizer.encode(text, add_special_tokens=False).ids)
        first, later = self._first, self._later
        lines = text.split("\n")
        if "  " in text or not all(x and x[0] != " " and x[-1] != " " and x.isprintable() for x in lines):
            head, *rest = BREAK.split(text)
            return first[head] + b"".join(map(later.__getitem__, rest))
        out = []
        for line in lines:
            head, *rest = line.split(" ")
            out.append(first[head] + b"".join(map(later.__getitem__, rest)))
        return first["\n"].join(out)


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
