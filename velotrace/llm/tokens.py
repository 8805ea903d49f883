"""Encoding whole texts by a tokenizer file, with a bounded cache of the ids of its pre-tokens."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

#: Characters on whose classes all Unicode versions agree; a text with any other goes to the library whole.
_SAFE = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250), *range(0x2010, 0x2028), 0x20AC)]
_OTHER = re.compile(f"[^{re.escape(''.join(_SAFE))}]")
_LETTER, _NUMBER = (re.escape("".join(c for c in _SAFE if unicodedata.category(c)[0] == kind)) for kind in "LN")
#: How the byte-level tokenizer splits text before it merges, on safe characters.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t\n\r {_LETTER}{_NUMBER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")
_SPACED = re.compile(f" [{_LETTER}]+")
#: Pre-tokens remembered by a worker before it starts anew.
CACHE = 400_000


class Encoder:
    """ids(texts) equals the library's encode_batch(texts, add_special_tokens=False).

    Texts in which the string of a special or added token stands go to the library whole. Of others each distinct
    pre-token is encoded by the library once and its ids kept as bytes; texts are then joined from those, since merges
    never cross pre-tokens. New pre-tokens of a space and letters are encoded many in one string,
    in which each is a pre-token again, and parted at the ids that begin with a space. Tested against the library's
    own whole-text encoding.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        pre = str(self.tokenizer.pre_tokenizer)
        self.byte_level = pre.startswith("ByteLevel(add_prefix_space=False") and self.tokenizer.normalizer is None
        self.cache: dict[str, bytes] = {}
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole_only = re.compile("|".join([_OTHER.pattern, *map(re.escape, added)]))
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for x, i in vocabulary.items() if x.startswith("Ġ")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain, rest = [], []
        for p in new:
            (plain if _SPACED.fullmatch(p) else rest).append(p)
        for lo in range(0, len(plain), 4096):
            groups = [plain[k : k + 256] for k in range(lo, min(lo + 4096, len(plain)), 256)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                first = np.flatnonzero(self.spaced[ids])
                if len(first) != len(group):
                    rest += group
                    continue
                data, ends = ids.tobytes(), (np.append(first, len(ids)) * self.dtype.itemsize).tolist()
                self.cache.update(zip(group, [data[a:b] for a, b in zip(ends, ends[1:])]))
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            self.cache.update(zip(some, self.whole(some)))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if not self.byte_level:
            return [np.frombuffer(x, self.dtype) for x in self.whole(texts)]
        parts = [None if self.whole_only.search(t) else _SPLIT.findall(t) for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        self._learn(list(set().union(*(x for x in parts if x)).difference(self.cache)))
        get = self.cache.__getitem__
        return [np.frombuffer(self.whole([t])[0] if p is None else b"".join(map(get, p)), self.dtype) for t, p in zip(texts, parts)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str = "<u4") -> Encoder:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, dtype) not in _encoders:
        _encoders[path, dtype] = Encoder(path, dtype)
    return _encoders[path, dtype]


def byte_bpe() -> str:
    """The place of the vocabulary that the registered queries take."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def crc32_ids(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
