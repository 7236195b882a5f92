"""Exact ids of a byte-level BPE file, by a fast merge engine that is filled from the same file."""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

#: Fixed value: the pre-tokenising pattern of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where no two characters of white space stand side by side: without looking ahead it runs faster.
SINGLE = r"""'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_DOUBLE = re.compile(r"\s\s")
_RUN = re.compile(r"\s{2000}")  # longer runs would exhaust the merge engine's expression


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: bytes that print stand for themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """`encode(text)` gives the ids that the tokenizers library gives (add_special_tokens=False), as little-endian u32.

    Texts with the string of a special token or with very long runs of white space go to that library itself; all
    others to a merge engine with the file's vocabulary, by the simpler of two equal expressions where it will do.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = _byte_alphabet()
        self.ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}

    def _engine(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def single(self):
        return self._engine(SINGLE)

    @cached_property
    def full(self):
        return self._engine(PATTERN)

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or _RUN.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        engine = self.full if _DOUBLE.search(text) else self.single
        return engine.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_cache: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process and file."""
    if path not in _cache:
        _cache[path] = ByteBpe(path)
    return _cache[path]
