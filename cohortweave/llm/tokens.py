"""Texts to ids of vocabulary files, by segments that the tokenizers treat alone, so that a repeated segment is encoded once."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import islice

import numpy as np

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
_SPACES = [c for c in map(chr, range(0x10000)) if c.isspace()]
_CUT = re.compile(r"(?<=\S) (?=\S)")
_JOINED = 20_000  # segments that are encoded as one text
LONGEST = 64  # code points of a segment that is worth keeping


def segments(text: str) -> list[str]:
    """The text cut at each blank between two characters that are no white space; joined by blanks they give it back."""
    loose = text[:1] == " " or text[-1:] == " " or any(c in text and (f" {c}" in text or f"{c} " in text) for c in _SPACES)
    return _CUT.split(text) if loose else text.split(" ")


class ByteBpe:
    """Byte-level BPE of a tokenizer file. Its splitter starts anew at a blank after a character that is no white space, so
    segments (all but a text's first with their blank) are encoded alone. Special tokens' strings are those tokens, or plain text."""

    def __init__(self, path: str = BYTE_BPE, special_as_text: bool = False, keep: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self.size = self.model.get_vocab_size()
        self.long = self.lengths()
        self.keep, self.spaced, self.first = keep, {}, {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def lengths(self) -> np.ndarray:
        """Bytes of each id's entry: a character of an entry stands for a byte."""
        long = np.zeros(self.size, np.int32)
        for token, i in self.model.get_vocab().items():
            long[i] = len(token)
        return long

    def spaced_ids(self, segments: list[str]) -> list[bytes]:
        """The ids of blank + segment for each."""
        return self._ids([" " + s for s in segments])

    def joined_ids(self, segments: list[str]) -> list[bytes]:
        """spaced_ids by way of few long texts: segments joined by blanks are a text's own, and its ids' lengths tell them apart.

        A segment with white space at an end is not one of such a text and goes alone.
        """
        out: list[bytes] = [b""] * len(segments)
        plain = [i for i, s in enumerate(segments) if s and not (s[0].isspace() or s[-1].isspace())]
        for k in range(0, len(plain), _JOINED):
            part = plain[k : k + _JOINED]
            pieces = [segments[i] for i in part]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            bounds = np.searchsorted(np.cumsum(self.long[ids]), np.cumsum([len(x.encode()) + 1 for x in pieces])) + 1
            flat, last = ids.tobytes(), 0
            for i, end in zip(part, (4 * bounds).tolist(), strict=True):
                out[i], last = flat[last:end], end
        rest = sorted(set(range(len(segments))) - set(plain))
        for i, x in zip(rest, self.spaced_ids([segments[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut, got, new = [segments(t) for t in texts], [], {}
        sizes = [len(self.first), len(self.spaced)]
        heads = list({c[0] for c in cut} - self.first.keys())
        self.first.update(zip(heads, self._ids(heads), strict=True))
        for c in cut:
            head = c[0]
            c[0] = ""  # its place is filled from the first segments
            parts = list(map(self.spaced.get, c))
            parts[0] = self.first[head]
            if None in parts:
                new.update([(s, None) for s, x in zip(c, parts) if x is None])
            got.append(parts)
        self.spaced.update(zip(new, self.joined_ids(list(new)), strict=True))
        out = [b"".join([self.spaced[s] if x is None else x for s, x in zip(c, p)] if None in p else p) for c, p in zip(cut, got, strict=True)]
        for known, size in zip((self.first, self.spaced), sizes, strict=True):
            fresh = list(islice(known, size, None))  # a dict keeps its order
            for i, s in enumerate(fresh):
                if i >= self.keep - size or len(s) > LONGEST:
                    del known[s]
        return out


@lru_cache(2)
def byte_bpe(path: str, special_as_text: bool = False) -> ByteBpe:
    """One per worker process, so that its tasks share what it has learnt."""
    return ByteBpe(path, special_as_text)


class PieceBpe:
    """Sentence-piece BPE of a model file, which puts a blank before each text."""

    def __init__(self, path: str = PIECE_BPE):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self._bytes(i) for i in range(n)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        if any(re.search("[^▁]▁", self.model.id_to_piece(i)) for i in range(n)):
            raise ValueError("a piece goes on over a blank, so segments cannot be encoded alone")

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def spells(self, text: str) -> bool:
        """Whether the pieces' bytes are those of blank + text: not where the model changes the text or it holds the blank's own sign."""
        return self.model.normalize(text).replace("▁", " ") == " " + text

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)
