"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Characters on whose classes all libraries agree: ASCII without control characters, and Latin letters. Texts with
#: others, or with a special token's name, are encoded by the tokenizers library itself.
PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
SPECIAL = "<|endoftext|>"


def encoder(json_path: str, ranks_path: str, pattern: str):
    """A function from a text to its ids (uint32), those of the tokenizers file at ``json_path`` without added special
    tokens. Ordinary texts go through the same vocabulary as ranks, which is several times faster. Both are loaded once
    in a worker process."""
    import tiktoken
    from tiktoken import registry

    name = f"ranks of {ranks_path}"
    if name not in registry.ENCODINGS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    quick = registry.ENCODINGS[name]
    full = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL not in text and PLAIN.fullmatch(text):
            return np.asarray(quick.encode_ordinary(text), np.uint32)
        if not full:
            from tokenizers import Tokenizer

            full.append(Tokenizer.from_file(json_path))
        return np.asarray(full[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def public_paths() -> tuple[str, str, str]:
    """The tokenizers file, the same vocabulary as ranks, and the pattern that splits words."""
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN
