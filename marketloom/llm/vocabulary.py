"""A byte-level BPE vocabulary with a minimal perfect hash over its tokens."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import regex
import xxhash

#: Fixed value: the published pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_FOLDER = "/opt/tokenizers"
_SEED = 0x5EED


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines()) if token}


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(k, _SEED) for k in keys), dtype=np.uint64)


def _mix(h: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
    """A second hash of a hash under a salt (a finaliser of two multiplications)."""
    x = (h ^ (salt * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class PerfectHash:
    """Minimal perfect hash: n keys on n slots; a key's bucket names the salt that places it."""

    salts: np.ndarray
    keys: list[bytes]  # by slot: what tells members from others
    values: np.ndarray  # by slot

    @classmethod
    def build(cls, keys: list[bytes], values: list[int]) -> PerfectHash:
        h = _hashes(keys)
        if len(np.unique(h)) != len(h):
            raise ValueError("keys collide in 64 bits; choose another seed")
        n = len(h)
        buckets = max(1, n // 4)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        salts, taken = np.zeros(buckets, dtype=np.uint64), np.zeros(n, dtype=bool)
        slot_of = np.zeros(n, dtype=np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        trials = np.arange(1, 257, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for b in np.argsort(-np.diff(bounds), kind="stable"):
                rows = order[bounds[b] : bounds[b + 1]]
                if not len(rows):
                    break
                base = np.uint64(0)
                while True:
                    # a block of salts at once; the first that finds only free, distinct slots wins
                    slots = (_mix(h[rows][None, :], (trials + base)[:, None]) % np.uint64(n)).astype(np.int64)
                    free = ~taken[slots].any(axis=1)
                    if len(rows) > 1:
                        ranked = np.sort(slots, axis=1)
                        free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                    if free.any():
                        i = int(np.argmax(free))
                        salts[b], slot_of[rows] = trials[i] + base, slots[i]
                        taken[slots[i]] = True
                        break
                    base += np.uint64(256)
        placed, vals = [b""] * n, np.zeros(n, dtype=np.int64)
        vals[slot_of] = np.array(values, dtype=np.int64)
        for slot, key in zip(slot_of.tolist(), keys):
            placed[slot] = key
        return cls(salts, placed, vals)

    def lookup(self, keys: list[bytes]) -> np.ndarray:
        """The value of each key; -1 for keys that are not members."""
        h = _hashes(keys)
        with np.errstate(over="ignore"):
            slot = (_mix(h, self.salts[(h % np.uint64(len(self.salts))).astype(np.int64)]) % np.uint64(len(self.keys))).astype(np.int64)
        member = np.fromiter((self.keys[s] == k for s, k in zip(slot.tolist(), keys)), dtype=bool, count=len(keys))
        return np.where(member, self.values[slot], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token itself: lowest-rank merges by a heap over linked bytes."""
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[piece]]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n:
            continue
        right = parts[j]
        if len(left) + len(right) != size:  # one side has grown since
            continue
        parts[i], parts[j] = left + right, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            joined = parts[i] + parts[after[i]]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, i, len(joined)))
        if (h := before[i]) >= 0:
            joined = parts[h] + parts[i]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, h, len(joined)))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Two-tier encoding: whole pre-tokens by the perfect hash, the others by merging bytes."""

    def __init__(self, ranks: dict[bytes, int], hashed: PerfectHash, memo_size: int = 200_000):
        self.ranks, self.hashed, self.memo_size = ranks, hashed, memo_size
        self.split = regex.compile(PATTERN).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def _resolve(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        for piece, data, value in zip(pieces, raw, self.hashed.lookup(raw).tolist()):
            self.memo[piece] = (value,) if value >= 0 else tuple(merge_bytes(data, self.ranks))

    def _pieces(self, texts: list[str | None]) -> list[list[str]]:
        """Pre-tokens of each text, all of them in the memo."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.memo) > self.memo_size:
            self.memo.clear()
        new = {p for pieces in split for p in pieces if p not in self.memo}
        if new:
            self._resolve(list(new))
        return split

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; no ids for null and empty texts. Special tokens' strings are text."""
        split, memo = self._pieces(texts), self.memo
        return [[i for p in pieces for i in memo[p]] for pieces in split]

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text, without listing them."""
        split, memo = self._pieces(texts), self.memo
        return [sum(len(memo[p]) for p in pieces) for pieces in split]
