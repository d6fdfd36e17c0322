"""Token ids of the public byte-level BPE vocabulary.

The vocabulary's two forms give the same ids; the rank form is encoded several times faster and is used where it can,
the tokenizers form where it fails and where a special string is to be one id (tests hold one against the other).
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable

import numpy as np

VOCABULARY = "byte_bpe_50k"


def special_strings(path: str) -> list[str]:
    """The strings of the added tokens, which stand in the file before the vocabulary."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    at = text.index('"added_tokens"')
    added, _ = json.JSONDecoder().raw_decode(text, text.index("[", at))
    return [x["content"] for x in added]


def encoder(place: str | None = None, *, special: bool = False) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids; place: the folder of the vocabulary files, the installed one by default.

    special: the strings of the vocabulary's special tokens are these tokens, as in the tokenizers library's plain call;
    else they are ordinary text.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = (lambda name: os.path.join(place, name)) if place else public_tokenizers.path
    with open(path(f"{VOCABULARY}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = special_strings(path(f"{VOCABULARY}.json")) if special else []
    slow: list = []  # few texts need the other form, which takes much more memory

    def encode(text: str) -> np.ndarray:
        if not any(x in text for x in added):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the pattern's engine gives up on some extreme texts
                if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
        if not slow:
            slow.append(Tokenizer.from_file(path(f"{VOCABULARY}.json")))
            slow[0].encode_special_tokens = not special
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def as_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")
