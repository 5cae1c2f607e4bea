"""Prediction by partial matching over bytes: frozen variable-order context trees, one per language.

A tree of order K holds the counts of every byte after every context of 0 to K bytes. The code length of a byte starts at the
longest known context; if the byte was never seen there, the escape (method C: as many escape counts as distinct bytes) is paid
and the next shorter context is tried, with the bytes of the longer one excluded; below order 0 a byte of the rest is uniform.
All trees are kept as sorted arrays over the union of the languages' contexts, so that a whole batch of text is scored at once:
each distinct window of K + 1 bytes in the batch is scored for all languages, then summed over the lines.
"""

from __future__ import annotations

import re

import numpy as np

_DIGITS = re.compile(r"\d+")
#: Windows whose costs are kept for the next batch; only speed depends on it.
_KEPT_WINDOWS = 1_000_000


def fold(text: str) -> bytes:
    """The bytes that are coded: lower case, white space runs as one space, digits left out."""
    return (" " + " ".join(_DIGITS.sub("", text.lower()).split())).encode("utf-8", "replace")


class ContextTrees:
    def __init__(self, samples: dict[str, list[str]], order: int = 5, max_bytes: int = 2_000_000):
        """samples: reference texts by language, of which the first max_bytes each are used (the models' size bound)."""
        if not 0 <= order <= 7:
            raise ValueError("order must be 0 to 7: a window has to fit into eight bytes")
        self.order, self.languages = order, sorted(samples)
        n = len(self.languages)
        grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for language in self.languages:
            data = b"".join(fold(t) for t in samples[language])[:max_bytes]
            windows = self._windows(np.frombuffer(data, np.uint8))
            grams.append([np.unique(self._last(windows, k + 1), return_counts=True) for k in range(order + 1)])
        self.keys, self.counts = [], []  # by order k: the grams of k + 1 bytes of all languages, and their counts
        for k in range(order + 1):
            keys = np.unique(np.concatenate([g[k][0] for g in grams])) if n else np.empty(0, np.uint64)
            counts = np.zeros((len(keys), n), np.float32)
            for i, g in enumerate(grams):
                counts[np.searchsorted(keys, g[k][0]), i] = g[k][1]
            self.keys.append(keys)
            self.counts.append(counts)
        self.contexts, self.total, self.distinct, self.excluded = [], [], [], []
        for k in range(order + 1):
            keys, counts = self.keys[k], self.counts[k]
            contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct, excluded = (np.zeros((len(contexts), n), np.float32) for _ in range(3))
            np.add.at(total, where, counts)
            np.add.at(distinct, where, (counts > 0).astype(np.float32))
            if k:  # what the bytes seen after this context count in the context one byte shorter
                shorter = self._find(self.keys[k - 1], self._last(keys, k))
                np.add.at(excluded, where, np.where(counts > 0, self.counts[k - 1][shorter], 0))
            self.contexts.append(contexts)
            self.total.append(total)
            self.distinct.append(distinct)
            self.excluded.append(excluded)

    def _windows(self, data: np.ndarray) -> np.ndarray:
        """For each byte the window that ends with it, as one integer; before the start stand zero bytes."""
        out = np.zeros(len(data), np.uint64)
        for back in range(self.order + 1):
            out[back:] |= data[: len(data) - back].astype(np.uint64) << np.uint64(8 * back)
        return out

    @staticmethod
    def _last(windows: np.ndarray, size: int) -> np.ndarray:
        return windows if size >= 8 else windows & np.uint64((1 << (8 * size)) - 1)

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        return np.searchsorted(keys, wanted)

    def window_costs(self, windows: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each window, by language."""
        n, languages = len(windows), len(self.languages)
        cost = np.zeros((n, languages), np.float32)
        active = np.ones((n, languages), bool)
        before_known = np.zeros((n, languages), bool)
        before_excluded = before_distinct = np.zeros((n, languages), np.float32)
        for k in range(self.order, -1, -1):
            gram, context = self._last(windows, k + 1), self._last(windows >> np.uint64(8), k)
            at = self._find(self.contexts[k], context) if k else np.zeros(n, np.int64)
            at = np.minimum(at, len(self.contexts[k]) - 1)
            hit = (self.contexts[k][at] == context)[:, None]
            total, distinct = np.where(hit, self.total[k][at], 0), np.where(hit, self.distinct[k][at], 0)
            known = total > 0
            at_gram = np.minimum(self._find(self.keys[k], gram), len(self.keys[k]) - 1)
            count = np.where((self.keys[k][at_gram] == gram)[:, None], self.counts[k][at_gram], 0)
            rest = total - np.where(before_known, before_excluded, 0)
            new = distinct - np.where(before_known, before_distinct, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                here = np.log2(rest + new)
                found = active & known & (count > 0)
                cost += np.where(found, here - np.log2(count), 0)
                cost += np.where(active & known & (count == 0) & (new > 0), here - np.log2(new), 0)
            active &= ~found
            before_excluded, before_distinct = np.where(hit, self.excluded[k][at], 0) if k else before_excluded, distinct
            before_known = known
        return cost + np.where(active, np.log2(256 - np.where(before_known, before_distinct, 0)), 0)

    def _costs_of(self, windows: np.ndarray) -> np.ndarray:
        """window_costs of sorted distinct windows, by way of those that earlier batches had."""
        known, costs = self.__dict__.get("_kept", (np.empty(0, np.uint64), np.empty((0, len(self.languages)), np.float32)))
        at = np.searchsorted(known, windows)
        old = np.zeros(len(windows), bool)
        if len(known):
            old = known[np.minimum(at, len(known) - 1)] == windows
        out = np.empty((len(windows), len(self.languages)), np.float32)
        out[old] = costs[at[old]]
        new = windows[~old]
        if len(new):
            out[~old] = fresh = self.window_costs(new)
            if len(known) + len(new) > _KEPT_WINDOWS:
                known, costs = windows, out
            else:
                place = np.searchsorted(known, new)
                known, costs = np.insert(known, place, new), np.insert(costs, place, fresh, axis=0)
            self._kept = (known, costs)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def line_costs(self, lines: list[str], block: int = 1 << 20) -> np.ndarray:
        """Code length in bits of each line by language: an array of lines x languages. An empty line costs 0."""
        out = np.zeros((len(lines), len(self.languages)), np.float64)
        coded = [fold(x) for x in lines]
        start = 0
        while start < len(lines):
            end, size = start, 0
            while end < len(lines) and (size == 0 or size + len(coded[end]) <= block):
                size += len(coded[end])
                end += 1
            # Lines are coded one by one: zero bytes stand between them as before a text's start.
            pad = b"\0" * self.order
            data = np.frombuffer(pad.join(coded[start:end]), np.uint8)
            sizes = np.array([len(x) for x in coded[start:end]], np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes + self.order)[:-1]])
            if len(data):
                windows, inverse = np.unique(self._windows(data), return_inverse=True)
                costs = self._costs_of(windows)
                flags = np.zeros(len(data) + 1, np.int8)
                np.add.at(flags, begins, 1)
                np.add.at(flags, np.minimum(begins + sizes, len(data)), -1)
                inside = np.cumsum(flags[:-1]).astype(bool)
                per_byte = costs[inverse[inside]]
                stops = np.concatenate([[0], np.cumsum(sizes)])
                whole = sizes > 0
                if whole.any():
                    out[start:end][whole] = np.add.reduceat(per_byte, stops[:-1][whole], axis=0, dtype=np.float64)
            start = end
        return out
