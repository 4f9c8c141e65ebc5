"""Token ids of texts as bytes: a tokenizer file of the tokenizers library, with a bounded cache of pieces.

A byte-level tokenizer with its usual pattern never joins characters over a single space between two other
characters. So a text is the sequence of its space-separated pieces, and the ids of a piece are looked up
if it was met before. Texts to which this does not apply (runs of white space at a space, texts with the
string of a special token, other kinds of tokenizers) are encoded whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re

import numpy as np
import pyarrow as pa

END = 0
CACHED_PIECES = 1_200_000
_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """Ids by piece; pieces that are looked up in vain are noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: set[str] = set()

    def __missing__(self, piece: str) -> None:
        self.new.add(piece)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not spec.get("normalizer")
            and not spec.get("post_processor")
        )
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.newline = self._raw(["\n"])[0] if self.by_piece else None
        self.by_piece = self.by_piece and len(self.newline) == 1
        self.most, self.first, self.later = cached, _Known(), _Known()
        self.split = re.compile(r"(?<=\S) (?=\S)").split

    def forget(self) -> None:
        """Give the memory of the cached pieces back."""
        self.first, self.later = _Known(), _Known()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def _raw(self, texts):
        return [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, cache: "_Known", lead: str) -> None:
        """Encode the pieces that were not known in few calls: joined by line breaks, whose id parts them again."""
        pieces, cache.new = cache.new, set()
        if len(cache) + len(pieces) > self.most:
            cache.clear()
        plain = [p for p in pieces if p and not re.search(r"\s", p)]
        odd = pieces.difference(plain)
        # A piece with white space at its edge has no ids of its own: its text is encoded whole.
        edged = {p for p in odd if not p or p[0].isspace() or p[-1].isspace()}
        cache.update(dict.fromkeys(edged, False))
        inner = list(odd - edged)
        cache.update(zip(inner, (x.tobytes() for x in self._raw([lead + p for p in inner]))))
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self._raw(["".join(lead + p + "\n" for p in part)])[0]
            ends = np.flatnonzero(ids == self.newline[0])
            if len(ends) != len(part):
                cache.update((p, self._raw([lead + p])[0].tobytes()) for p in part)
                continue
            data, begin = ids.tobytes(), 0
            for p, end in zip(part, (ends * 4).tolist()):
                cache[p] = data[begin:end]
                begin = end + 4

    def _some(self, texts: list[str]) -> list[bytes]:
        first, later = self.first, self.later
        pieces = [t.split(" ") for t in texts]
        found = [[first[ps[0]], *map(later.__getitem__, ps[1:])] for ps in pieces]
        for cache, lead in ((first, ""), (later, " ")):
            if cache.new:
                self._learn(cache, lead)
        out = []
        for text, ps, got in zip(texts, pieces, found):
            if None in got:
                # Just learned; what was found before stays valid even if the cache was emptied in between.
                if got[0] is None:
                    got[0] = first[ps[0]]
                got = [later[p] if g is None else g for g, p in zip(got, ps)]
            try:
                out.append(b"".join(got))
            except TypeError:
                out.append(self._raw([text])[0].tobytes())
        return out

    def encode(self, texts: list[str | None], at_once: int = 1_000_000) -> list[bytes]:
        """The ids of each text; a null counts as empty. Works on about ``at_once`` characters at a time."""
        out: list[bytes] = [b""] * len(texts)
        some, held = [], 0

        def flush():
            for i, data in zip(some, self._some([texts[i] for i in some])):
                out[i] = data

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_piece or (self.special and self.special.search(text)):
                out[i] = self._raw([text])[0].tobytes()
                continue
            some.append(i)
            held += len(text)
            if held >= at_once:
                flush()
                some, held = [], 0
        if some:
            flush()
        return out


def encoder(path: str | None = None, cached: int = CACHED_PIECES) -> Encoder:
    """One encoder per worker process."""
    key = (path or default_tokenizer(), cached)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]
