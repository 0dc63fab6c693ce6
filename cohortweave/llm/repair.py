"""Re-Pair: frequent neighbouring pairs of ids become nonterminals, again and again; rules keep their expansion lengths."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"CWRP1\0"
_HEAD = struct.Struct("<6sHIII")  # magic, bytes of a symbol, first nonterminal, rules, symbols
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Grammar:
    """Symbols under `base` are ids; base + i stands for the pair rules[i] of earlier symbols and spells lengths[i] ids."""

    base: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def starts(self) -> np.ndarray:
        """Where each symbol's expansion begins, and the end of the last."""
        size = np.ones(self.symbols.size, np.int64)
        ruled = self.symbols >= self.base
        size[ruled] = self.lengths[self.symbols[ruled] - self.base]
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])

    def decode(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end (exclusive); only the symbols that reach into the range are expanded."""
        at = self.starts()
        end = int(at[-1]) if end is None else min(end, int(at[-1]))
        if begin >= end:
            return np.empty(0, np.uint32)
        first, last = int(np.searchsorted(at, begin, "right")) - 1, int(np.searchsorted(at, end, "left"))
        out = self._expanded(self.symbols[first:last])
        skip = begin - int(at[first])
        return out[skip : skip + end - begin].astype(np.uint32)

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols: those of all rules side by side, by levels, then each symbol's stretch of them."""
        flat = np.arange(self.base, self.base + len(self.rules), dtype=np.int32)
        while (ruled := flat >= self.base).any():
            place = np.arange(flat.size) + np.concatenate([[0], np.cumsum(ruled)[:-1]])
            longer = np.empty(flat.size + int(ruled.sum()), np.int32)
            pair = self.rules[flat[ruled] - self.base]
            longer[place[~ruled]] = flat[~ruled]
            longer[place[ruled]] = pair[:, 0]
            longer[place[ruled] + 1] = pair[:, 1]
            flat = longer
        table = np.concatenate([np.arange(self.base, dtype=np.int32), flat])
        size = np.concatenate([np.ones(self.base, np.int32), self.lengths.astype(np.int32)])
        begin = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths) - self.lengths]).astype(np.int32)
        long = size[symbols]
        since = np.cumsum(long, dtype=np.int64) - long
        return table[np.repeat(begin[symbols] - since, long) + np.arange(int(long.sum()))]


def _frequent(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """The pairs that occur `least` times or more, most frequent first, `most` of them."""
    ordered = np.sort(keys)
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(edges, ordered.size))
    often = counts >= least
    pairs, counts = ordered[edges[often]], counts[often]
    return pairs[np.argsort(-counts, kind="stable")[:most]]


def _ranks(keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """For each key its place in pairs, or len(pairs). Where two pairs share a slot, the more frequent has it; the other waits a round."""
    bits, kind = max(8, int(pairs.size).bit_length() + 3), keys.dtype.type
    mix, shift = kind(_MIX & np.uint64(np.iinfo(kind).max)), kind(8 * keys.dtype.itemsize - bits)
    slot = lambda k: (k * mix) >> shift
    table = np.full(1 << bits, pairs.size, np.int32)
    table[slot(pairs)[::-1]] = np.arange(pairs.size, dtype=np.int32)[::-1]
    rank = table[slot(keys)]
    rank[np.append(pairs, pairs[:1] * 0)[rank] != keys] = pairs.size
    return rank


def _chosen(rank: np.ndarray, none: int) -> np.ndarray:
    """Occurrences to replace, none overlapping: runs of one rank that are better than what is on both sides, every other of a run."""
    fresh = np.concatenate([[True], rank[1:] != rank[:-1]])
    heads = np.flatnonzero(fresh)
    best = rank[heads]
    left, right = np.append(none, best[:-1]), np.append(best[1:], none)
    good = (best < none) & (best < left) & (best < right)
    size = np.diff(np.append(heads, rank.size))
    single = heads[good & (size == 1)]
    runs = np.flatnonzero(good & (size > 1))
    more = [np.arange(heads[r], heads[r] + size[r], 2) for r in runs]
    return np.sort(np.concatenate([single, *more])) if more else single


def compress(ids: np.ndarray, base: int, least: int = 8, max_rules: int = 15_000, rounds: int = 8) -> Grammar:
    """Grammar of the ids, all under base. A round replaces many pairs, the more frequent first where occurrences overlap.

    It ends when no pair occurs `least` times, after max_rules rules, or after `rounds` rounds: these bound time and size of a
    rule table, never what is stored. Decoding gives back every id.
    """
    half = 16 if base + max_rules <= 1 << 16 else 32
    kind = np.uint32 if half == 16 else np.uint64
    symbols = ids.astype(kind)
    rules, lengths = [np.empty((0, 2), np.int64)], [np.ones(base, np.int64)]
    free = base
    for r in range(rounds):
        if symbols.size < 2 or free - base >= max_rules:
            break
        keys = (symbols[:-1] << kind(half)) | symbols[1:]
        pairs = _frequent(keys, least, -(-(max_rules - (free - base)) // (rounds - r)) if r < rounds - 1 else max_rules - (free - base))
        if not pairs.size:
            break
        rank = _ranks(keys, pairs)
        at = _chosen(rank, pairs.size)
        which = rank[at]
        used = np.flatnonzero(np.bincount(which, minlength=pairs.size))
        if not used.size:
            break
        name = np.zeros(pairs.size, kind)
        name[used] = free + np.arange(used.size)
        new = np.stack([pairs[used] >> kind(half), pairs[used] & kind((1 << half) - 1)], 1).astype(np.int64)
        known = np.concatenate(lengths) if len(lengths) > 1 else lengths[0]
        rules.append(new)
        lengths = [known, known[new[:, 0]] + known[new[:, 1]]]
        symbols[at] = name[which]
        stay = np.ones(symbols.size, bool)
        stay[at + 1] = False
        symbols, free = symbols[stay], free + used.size
    return Grammar(base, np.concatenate(rules), np.concatenate(lengths)[base:], symbols.astype(np.int64))


def dump(g: Grammar) -> bytes:
    """The block's bytes: head, rules (left, right), expansion lengths, symbols, all little-endian; symbols in 2 bytes where they fit."""
    width = 2 if g.base + len(g.rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = _HEAD.pack(MAGIC, width, g.base, len(g.rules), g.symbols.size)
    return head + g.rules.astype(kind).tobytes() + g.lengths.astype("<u4").tobytes() + g.symbols.astype(kind).tobytes()


def load(data: bytes) -> Grammar:
    """The block that dump wrote; anything else is an error."""
    magic, width, base, n_rules, n_symbols = _HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != _HEAD.size + n_rules * (2 * width + 4) + n_symbols * width:
        raise ValueError("not a whole Re-Pair block")
    kind, at = f"<u{width}", _HEAD.size
    rules = np.frombuffer(data, kind, 2 * n_rules, at).astype(np.int64).reshape(-1, 2)
    lengths = np.frombuffer(data, "<u4", n_rules, at := at + 2 * width * n_rules).astype(np.int64)
    return Grammar(base, rules, lengths, np.frombuffer(data, kind, n_symbols, at + 4 * n_rules).astype(np.int64))
