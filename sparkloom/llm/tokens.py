"""Fast token ids of whole texts for the byte-level vocabularies that are given as tokenizers' json."""

from __future__ import annotations

import functools
import json

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def encoder(path: str):
    """An encoder of a tokenizers' json file with a byte-level BPE vocabulary, whose ids are ranks; tests hold it against the tokenizers library.

    Its special tokens are the json's added tokens, which ``encode_whole`` finds in texts and ``encode_ordinary`` does not.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, added = byte_letters(), spec.get("added_tokens", [])
    if any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that look at what stands around them")
    # Of two that begin at one place the longer one is meant.
    special = {x["content"]: x["id"] for x in sorted(added, key=lambda x: -len(x["content"]))}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_whole(path: str, text: str) -> list[int]:
    """The ids that the library gives with add_special_tokens=False: added tokens in the text have their own, the parts between are encoded by themselves."""
    return encoder(path).encode(text, allowed_special="all")
