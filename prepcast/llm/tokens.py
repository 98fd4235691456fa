"""Text to token ids with a public tokenizer file, word by word through a cache.

The tokenizer drops white space and none of its pieces crosses an ASCII space,
so a text's ids are those of its space-separated words one after the other;
only words not met before reach the tokenizer. The cache lives in the Python
worker and is emptied when full, so its memory is bounded.
"""

from __future__ import annotations

import json
import os
import re
from array import array

CACHE_WORDS = 350_000
LONG_WORD = 256
#: Words of Latin-1 letters: one piece, which normalising lowers at most.
_PLAIN = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
PLAIN = re.compile(_PLAIN).fullmatch
#: Such a word, and a run of marks behind it, which is the next piece.
MARKED = re.compile(rb"(" + _PLAIN + rb")([!-&(-/:-@\[-`{-~]+)").fullmatch
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level tokenizers show each byte as a character: these bytes as they are, the others from 256 on.
BYTE_LEVEL = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: The steps before the model for which the above holds.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class Encoder:
    """ids(text) -> little-endian uint32 bytes of a text's ids, without special tokens.

    Words are looked up with ASCII capitals lowered, as the tokenizer lowers them
    itself (not in a text with ``<|``: special tokens are matched as written). A
    point or comma after a letter or digit is a piece of its own, and so is a run of marks
    after a word of Latin letters: such a word is its stem and the mark or run. Two generations of at most ``cache_words`` words are
    kept: words of the older one that come up again move to the newer one.
    New words of Latin letters go straight to the tokenizer's model if the steps
    before it are those known to pass them on as they are; the others go through it all.
    """

    def __init__(self, file: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.wide = self.tok.get_vocab_size() > 65536
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cache_words = cache_words
        steps = json.loads(self.tok.to_str())
        self.model = self.tok.model if (steps["normalizer"], steps["pre_tokenizer"], steps["post_processor"]) == (NORMALIZER, PRE_TOKENIZER, None) and not steps["truncation"] and not steps["padding"] else None
        self.marks = (b".", b",")

    def _encode(self, words: list[bytes]) -> list[bytes]:
        out = self.tok.encode_batch_fast([w.decode("utf-8") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in out]

    def _learn(self, words: set[bytes]) -> None:
        new, old, marks = self.new, self.old, self.marks
        stems, rest = {}, []
        for w in words:
            if (known := old.get(w)) is not None:
                new[w] = known
            elif w.isalpha():
                rest.append(w)
            elif self.model is not None and (cut := MARKED(w)):
                stems[w] = cut.groups()
            elif w[-1:] in marks and w[-2:-1].isalnum():
                stems[w] = w[:-1], w[-1:]
            else:
                rest.append(w)
        more = {part for both in stems.values() for part in both}
        rest += [x for x in more if x not in new and x not in words]
        if self.model is not None:
            split, others = self.model.tokenize, []
            for w in rest:
                if PLAIN(w):
                    piece = w.decode() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(BYTE_LEVEL)
                    new[w] = array("I", [t.id for t in split(piece)]).tobytes()
                else:
                    others.append(w)
            rest = others
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            new.update(zip(part, self._encode(part)))
        for w, (stem, mark) in stems.items():
            new[w] = new[stem] + new[mark]

    def ids(self, text: bytes) -> bytes:
        words = (text if b"<|" in text else text.lower()).split()
        if len(self.new) > self.cache_words:
            self.old, self.new = self.new, {}
        found = list(map(self.new.get, words))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            missing = {words[i] for i in gaps}
            self._learn(missing)
            for i in gaps:
                found[i] = self.new[words[i]]
            for w in missing:
                if len(w) > LONG_WORD:  # rare and large: not worth keeping
                    del self.new[w]
        return b"".join(found)


_ENCODERS: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if file not in _ENCODERS:
        _ENCODERS[file] = Encoder(file)
    return _ENCODERS[file]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
