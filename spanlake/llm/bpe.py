"""Byte-level BPE ids at speed: whole texts are encoded from the vocabulary by rank.

The order of the model's merges is the order of its ids (checked on loading; where that does not
hold, the ``tokenizers`` model itself encodes). Pre-tokenisation by a pattern that looks ahead is slow,
and it looks ahead only to leave the last of a run of white space to what follows. So texts are
cut there first, and the rest of the pattern needs no look ahead. Nothing is remembered between
texts, so the time does not depend on how many words a corpus has. Texts with an added token's
text go through the model whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: White space as patterns of the tokenizer have it: in a class of characters, and but for blanks and line ends.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = [c for c in map(chr, range(0x3001)) if re.match(f"[{_SPACE}]", c) and c not in " \n"]
_CUT = re.compile(f"(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary that the installed public set provides."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _by_rank(path: str, added: set[str]):
    """A rank encoder of the same vocabulary, or None if merge order and id order differ."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
        return None
    vocab, of = model["vocab"], byte_letters()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in added}
    return tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian uint32 bytes."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranked = _by_rank(path, set(self.added))

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder per worker process and vocabulary."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, text: str) -> bytes:
        encode = self.ranked.encode_ordinary
        if any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or any(c in text for c in _ODD):
            return array("I", [i for x in _CUT.split(text) for i in encode(x)]).tobytes()
        return array("I", encode(text)).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out, whole = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if self.ranked is None or any(a in text for a in self.added):
                whole.append(i)
            else:
                out[i] = self._text(text)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out
