"""Fast whole-text ids of a byte-level BPE file, for the operators that consume tokens (4 and 7)."""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np

from .common import HOLDERS

#: Fixed value: how byte-level BPE of this family splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: What keeps a text from the quick way: white space beside the ASCII one, and anything but Latin letters of two bytes.
OTHER = re.compile("[\x1c-\x1f\x85\xa0\u0250-\U0010ffff]")
#: Longer runs go the plain way, too: tiktoken's pattern search fails on some.
LONG_RUN = re.compile(r"[^\x20\x09-\x0D]{2000}|[\x20\x09-\x0D]{2000}")


class TokenIds:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Texts go through the tokenizers library, or, if they are Latin and the file of the same
    vocabulary as ranks lies beside, through tiktoken, which gives the same ids in less time.
    Nothing is kept between texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.quick = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary

    def encode(self, text: str) -> bytes:
        ids = self.quick(text) if self._plain(text) else self.lib.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        if self.quick is None or OTHER.search(text) or any(s in text for s in self.special):
            return False
        sizes = [*map(len, text.split())]
        # only with a long word, or much more white space than words, can there be a long run
        return (max(sizes, default=0) < 2000 and len(text) - sum(sizes) - len(sizes) < 1998) or not LONG_RUN.search(text)


@functools.cache
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


HOLDERS["tokens"] = token_ids.cache_clear
