"""Token ids of whole texts by a given tokenizer, word by word with a memory.

The tokenizer drops white space and never joins what white space parts, so a text is the
sequence of its words, and a word that was met before needs a look-up only. A word that
ends in marks of punctuation is its stem and the marks. Letters A-Z are folded before the
look-up, as the tokenizer folds them, but for texts that hold a special token's opening.

That holds for tokenizers that prepare texts as the default one does, which is read from the
file; with any other, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from schemagauge.llm.kernels import FOLD

#: Marks that the tokenizer keeps apart, as one part, from letters before them.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = b"<|"
# Words remembered by a process in each of two generations; the older one is forgotten.
REMEMBERED = 300_000
# Letters that are composed already and whose lower case is a letter of the same kind.
_LETTERS = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte: itself if it can be seen, or else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in seen)}


_BYTES = _byte_letters()

#: How a tokenizer has to prepare a text so that it may be read word by word.
_NORMALISER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_PARTS = [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", None)]


def _by_words(tokenizer) -> bool:
    """Whether the ids of a text are those of its words, and words are prepared as they are here."""
    told = json.loads(tokenizer.to_str())
    listed = lambda x, name: [(y["type"], y.get("pattern", {}).get("Regex")) for y in (x or {}).get(name, [])]
    return (
        listed(told["normalizer"], "normalizers") == _NORMALISER
        and listed(told["pre_tokenizer"], "pretokenizers") == _PARTS
        and told["model"]["type"] == "BPE"
        and not told["model"]["dropout"]
    )

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _by_words(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of words. What the normaliser leaves as it is goes to the model at once."""
        out, rest, at = [], [], []
        tokenize = self.tokenizer.model.tokenize
        for i, word in enumerate(words):
            text = word.decode()
            if _LETTERS.fullmatch(text):
                piece = text if text.isascii() else text.lower().encode().decode("latin-1").translate(_BYTES)
                out.append(array("I", [x.id for x in tokenize(piece)]).tobytes())
            else:
                out.append(b"")
                rest.append(text)
                at.append(i)
        for i, found in zip(at, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            out[i] = array("I", found.ids).tobytes()
        return out

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        fresh, marked = set(), []
        for word in words:
            if word in self.known:
                continue
            if word in self.older:
                self.known[word] = self.older[word]
                continue
            stem = word.rstrip(MARKS)
            if 0 < len(stem) < len(word) and (stem.isalpha() or (not stem.isascii() and stem.decode().isalpha())):
                marked.append((word, stem, word[len(stem) :]))
                fresh.update(marked[-1][1:])
            else:
                fresh.add(word)
        fresh = list(fresh - self.known.keys())
        self.known |= zip(fresh, self._encoded(fresh))
        for word, stem, mark in marked:
            self.known[word] = self.known[stem] + self.known[mark]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            plain = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in plain]
        split = [(t if SPECIAL in t else t.translate(FOLD)).split() for t in texts]
        words = set().union(*split)
        if not words <= self.known.keys():
            self._learn(words)
        look_up = self.known.__getitem__
        return [b"".join(map(look_up, s)) for s in split]


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
