"""Public byte-pair vocabularies, read once per Python worker from a path that the caller gives."""

from __future__ import annotations

import functools
import json

import numpy as np


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Merges:
    """ids of bytes (and of word-final bytes), pair ranks, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab: dict[str, int] = j["model"]["vocab"]
        suffix = j["model"].get("end_of_word_suffix") or ""
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.first = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + suffix] for b in range(256)] if suffix else self.first
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(j["model"]["merges"]):
            whole = (a[: -len(suffix)] if suffix and a.endswith(suffix) else a) + b
            self.rank[vocab[a], vocab[b]] = (r, vocab[whole])
        self.bytes_of = {i: bytes(back[c] for c in (w[: -len(suffix)] if suffix and w.endswith(suffix) else w)) for w, i in vocab.items()}
        self.bytes_of |= {i: w.encode() for w, i in self.special.items()}

    def ordered(self) -> bool:
        """Whether no merge can yield a symbol that an earlier merge needs: then equal pairs of a word may merge at once."""
        born: dict[int, int] = {}
        for (a, b), (r, new) in self.rank.items():
            if born.get(a, -1) > r or born.get(b, -1) > r or new in born:
                return False
            born[new] = r
        return True

    @functools.cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pair keys (left << 32 | right), with their ranks and results."""
        keys = np.array([a << 32 | b for a, b in self.rank], dtype=np.int64)
        got = np.array(list(self.rank.values()), dtype=np.int64).reshape(-1, 2)
        order = np.argsort(keys)
        return keys[order], got[order, 0], got[order, 1]


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)
