"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of text chunks."""

from __future__ import annotations

import base64
import re

# A space before a character that is not white space always begins a new token, so chunks can be cut there.
UNSAFE = re.compile(r" (?:\s|\Z)")
CACHED = 250_000


class _Chunks(dict):
    """Chunk to ids as little-endian 32-bit bytes; emptied when full."""
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        made = self[chunk] = self.encode(chunk)
        return made


class Encoder:
    """``ids(text)`` gives the ids that ``tokenizers`` gives for ``vocabulary`` without added special tokens.

    ``ranks`` is the same vocabulary as ranks, read by the faster library; texts that hold a special token's string go
    to ``tokenizers`` itself.
    """
    def __init__(self, vocabulary: str, ranks: str):
        import numpy as np
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        pack = lambda ids: np.array(ids, "<u4").tobytes()
        self.pack = pack
        self.head = _Chunks(lambda c: pack(self.fast.encode_ordinary(c)))
        self.rest = _Chunks(lambda c: pack(self.fast.encode_ordinary(" " + c)))

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.pack(self.slow.encode(text, add_special_tokens=False).ids)
        if UNSAFE.search(text):
            return self.pack(self.fast.encode_ordinary(text))
        first, *rest = text.split(" ")
        return self.head[first] + b"".join(map(self.rest.__getitem__, rest))
