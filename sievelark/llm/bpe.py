"""Ids of a public byte-level BPE vocabulary, loaded once in each worker.

The vocabulary is named by the path of its `tokenizers` file. Where a rank file of the same
vocabulary lies beside it (same name, suffix .tiktoken), texts go through that one, which gives
the same ids several times faster; texts that hold a special token's string go through
`tokenizers` itself, so the ids are its ids in every case (tests/llm/test_packing.py compares them).
"""

from __future__ import annotations

import base64
import os

import numpy as np

_loaded: dict[str, "Vocabulary"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, as unsigned 32-bit integers."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]
