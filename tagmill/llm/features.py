"""Hashed text features for the classifiers, computed for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points in one go: bounds the arrays to a few tens of MB.
CHUNK = 1 << 19
_M = np.uint32(0x9E3779B1)


def grams(texts: list[str], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, last + 1, buckets of all their character grams, text number of each).

    Grams of each order overlap; every text is put between spaces, and lower-cased. A text longer than CHUNK makes
    several parts, which the caller adds up.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
            size += len(texts[last]) + 2
            last += 1
        joined = "".join(f" {t} " for t in texts[first:last]).lower() if last - first > 1 else f" {texts[first]} ".lower()
        if last - first > 1:
            lengths = np.array([len(f" {t} ".lower()) for t in texts[first:last]])
        else:
            lengths = np.array([len(joined)])
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(first, last), lengths)
        top = max(orders) - 1
        for at in range(0, len(code), CHUNK + top):
            part, own = code[at : at + CHUNK + 2 * top], owner[at : at + CHUNK + 2 * top]
            h, found, of = part.copy(), [], []
            for n in range(1, top + 2):
                if n > 1:
                    h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _M + part[n - 1 :]
                if n in orders and len(h):
                    # a gram belongs to the part in which it begins, and lies within one text
                    keep = own[: len(h)] == own[n - 1 :]
                    keep[CHUNK + top :] = False
                    g = (h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * _M
                    found.append(((g >> np.uint32(7)) % np.uint32(buckets))[keep])
                    of.append(own[: len(h)][keep])
            yield first, last, np.concatenate(found) if found else np.zeros(0, np.uint32), np.concatenate(of) if of else np.zeros(0, np.int64)
        first = last


def summed(texts: list[str], table: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its grams' rows of ``table``, and the number of grams."""
    out, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for first, last, g, of in grams(texts, orders, len(table)):
        n[first:last] += np.bincount(of - first, minlength=last - first)
        for j in range(table.shape[1]):
            out[first:last, j] += np.bincount(of - first, weights=table[g, j], minlength=last - first)
    return out, n
