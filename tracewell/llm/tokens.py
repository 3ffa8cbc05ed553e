"""Token ids of texts, exactly as the tokenizer file's own library gives them, inside tasks.

A byte-level BPE file (``.json``) is run by its ranks in ``tiktoken``, which gives the ids of the
``tokenizers`` library several times faster; texts with very long white-space runs, which its
pattern engine may refuse, go to ``tokenizers``. Other ``.json`` files run in ``tokenizers``,
``.model`` files in ``sentencepiece``.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np

#: The pre-token pattern of byte-level files (a fixed value of that file format).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_long_space = re.compile(r"\s{4000}")


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class ByteLevel:
    """A byte-level BPE file by its ranks; ``encode`` gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, spec: dict):
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.path, self.library = path, None

    def ids(self, text: str) -> list[int]:
        if len(text) > 4000 and _long_space.search(text):
            self.library = self.library or Library(self.path)
            return self.library.ids(text)
        if self.special.search(text):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        return _packed(self.ids(text))


class Library:
    """Any ``.json`` file, by the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        return _packed(self.ids(text))


class SentencePiece:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def encode(self, text: str) -> bytes:
        return _packed(self.ids(text))


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a tokenizer file, one per worker process."""
    if path.endswith(".model"):
        return SentencePiece(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
    results = [spec["model"]["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"].get("merges", ())]
    plain = plain and None not in results and all(map(int.__lt__, results, results[1:]))  # merges are in the order of their ids
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if plain and added and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"):
        return ByteLevel(path, spec)
    return Library(path)


def version(path: str) -> str:
    """What identifies a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
