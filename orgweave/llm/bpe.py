"""BPE encoding and decoding (operator 1).

Each pre-token is merged with a priority queue of merge ranks over a doubly linked
symbol list; queue entries whose pair has changed since they were pushed are stale
and skipped.  Decoding concatenates vocabulary strings.  Only the normaliser and the
pre-tokeniser come from the tokenizer file's own library; the merges are done here.

White space ends every pre-token, so a text is encoded word by word.  Equal words of a batch
are grouped first, and bounded caches keep the ids of words and of their pre-tokens with the decoding (the
concatenated vocabulary strings of the ids), so a document is put together from both.

Files with a decoder are refused: their ids would not decode by mere concatenation.

Nulls: a null text is an empty text (no ids, empty decoding); a null doc_id is passed
on.  Repeated rows give repeated results.  An empty table gives an empty result.
Other columns are ignored.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import HOLDERS, WORD, slices
from .flat import joined, replaced, words


#: Words of these characters (printable ASCII and Latin letters of two bytes) stay apart through normalisation when joined by spaces.
PLAIN = re.compile("[!-~\u00c0-\u024f]+")


def byte_letters() -> dict[int, int]:
    """The letters by which byte-level files write bytes: printable bytes as themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class BpeCodec(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, and its decoding with ``joint`` behind each symbol; missing words are encoded on demand."""

    LIMIT = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.strings = [""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.added.items()]:
            self.strings[i] = s
        if spec.get("decoder"):
            raise ValueError("a tokenizer file with a decoder")
        self.joint = " "
        lib = Tokenizer.from_file(path)
        self.normalizer, self.splitter = lib.normalizer, lib.pre_tokenizer
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.find, self.letters = self._splitter(spec), byte_letters()
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        chars = [*piece[:-1], piece[-1] + self.suffix]
        ids = [self.vocab[c] for c in chars if c in self.vocab]
        n = len(ids)
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks = self.merges
        queue = [(ranks[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = right[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue  # stale: one of its symbols has been merged since
            ids[i], ids[j] = ranks[pair][1], -1
            right[i] = right[j]
            right[j] = -1
            if right[i] >= 0:
                left[right[i]] = i
                if (p := (ids[i], ids[right[i]])) in ranks:
                    heapq.heappush(queue, (ranks[p][0], i, p))
            if left[i] >= 0 and (p := (ids[left[i]], ids[i])) in ranks:
                heapq.heappush(queue, (ranks[p][0], left[i], p))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = right[i]
        return out

    @staticmethod
    def _splitter(spec: dict) -> Callable[[str], list[str]] | None:
        """What finds the pieces of a word, if the file says so by a pattern and the bytes of what it matches."""
        import regex

        kind = spec.get("pre_tokenizer") or {}
        steps = kind.get("pretokenizers", [kind])
        if [x.get("type") for x in steps] != ["Split", "ByteLevel"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            return None
        cut = steps[0]
        return regex.compile(cut["pattern"]["Regex"]).findall if cut["behavior"] == "Removed" and cut["invert"] and "Regex" in cut["pattern"] else None

    def piece(self, piece: str) -> tuple[bytes, bytes]:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= self.LIMIT:
                self.pieces.clear()
            ids = self.merge(piece)
            found = self.pieces[piece] = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes(), "".join([self.strings[i] + self.joint for i in ids]).encode()
        return found

    def _of(self, pieces: list[str]) -> tuple[bytes, bytes]:
        if len(pieces) == 1:
            return self.piece(pieces[0])
        found = [*map(self.piece, pieces)]
        return b"".join([x for x, _ in found]), b"".join([x for _, x in found])

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        if len(self) >= self.LIMIT:
            self.clear()
        text = self.normalizer.normalize_str(word) if self.normalizer else word
        v = self[word] = self._of([piece for piece, _ in self.splitter.pre_tokenize_str(text)])
        return v

    def of(self, found: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decodings of distinct words; missing ones are normalised together."""
        if self.find is not None:
            plain = [w for w in found if w not in self and PLAIN.fullmatch(w)]
            text = " ".join(plain)
            texts = (self.normalizer.normalize_str(text) if self.normalizer else text).split(" ")
            if len(texts) == len(plain):
                if len(self) + len(plain) > self.LIMIT:
                    self.clear()
                for w, x in zip(plain, texts, strict=True):
                    cut = self.find(x)
                    self[w] = self._of(cut if x.isascii() else [c.encode().decode("latin-1").translate(self.letters) for c in cut])
        return [self[w] for w in found]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        parts = self.special.split(text) if self.special is not None else [text]
        return b"".join(np.uint32(self.added[part]).tobytes() if i % 2 else b"".join(self[w][0] for w in WORD.findall(part)) for i, part in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return self.joint.join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def round_trips(self, texts: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoding of each text."""
        found, bounds = words(texts)
        ids, back = (joined(x, bounds) for x in replaced(found, self.of))
        odd = np.zeros(len(texts), bool)
        for s in self.added:
            odd |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        for i, special in enumerate(odd.tolist()):
            if special:
                x = self.encode(texts[i].as_py())
                yield x, self.decode(x).encode()
            else:
                yield ids[i], back[i][: len(back[i]) - len(self.joint)] if len(back[i]) else b""


@functools.cache
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


HOLDERS["bpe"] = codec.cache_clear


def bpe_round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids])`` of each document.

    ``tokenizer`` is the path of a word-end BPE file of the tokenizers library whose
    pre-tokeniser drops white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in slices(batches, "text", 2 << 20, owner="bpe"):
            out = [(len(ids) // 4, sha(ids), sha(back), *[bytes(ids)] * with_ids) for ids, back in c.round_trips(b.column(1))]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
