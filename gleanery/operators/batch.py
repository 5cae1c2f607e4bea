"""The best texts of many term sets at once, block by block over postings that lie by document.

All hits of all queries grow with queries times documents, so they are never made rows. A task reads the postings of its documents in blocks
and sends on only the best few of each term set:

* Terms in more than `rare` documents: queries differ mostly in their rare terms, so what is left of them without those are few different
  sets. Each is added up once in a block over its documents, and the best `limit` are kept. A document without rare terms of a query that is not
  among them is behind `limit` others with any rare terms added, since every term adds to a score; so nothing is lost.
* Rare terms: every document that has one is scored for each set that has it, all terms counted.

A query's best are then among these two lists; a document in both has its full score in the second, which is the larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.5, 0.75
#: Postings that are held at once by a task, pairs of set and document that are scored at once; scores that may be equal when rounded.
BLOCK, PAIRS, SLACK = 4_000_000, 500_000, 1e-6

Batches = Iterator[pa.RecordBatch]


def _spread(starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all items of the lists `which`, of which each begins at its start, and the row of `which` that each belongs to."""
    counts = starts[which + 1] - starts[which]
    rows = np.repeat(np.arange(len(which)), counts)
    return rows, np.arange(len(rows)) + np.repeat(starts[which] - (np.cumsum(counts) - counts), counts)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def count_batches(batches: Batches) -> Batches:
    """(__key, t: tokens) to (__key, length, terms, tfs): each term of a row once with its count; rows without tokens are left out."""
    for batch in batches:
        keys, lists = batch.columns
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        width = max(1, len(coded.dictionary))
        cells, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(), return_counts=True)
        ends = pa.array(_starts(np.bincount(cells // width, minlength=len(sizes))).astype(np.int32))
        terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(cells % width)))
        out = pa.RecordBatch.from_arrays([keys, pa.array(sizes), terms, pa.ListArray.from_arrays(ends, pa.array(tfs.astype(np.int32)))], ["__key", "length", "terms", "tfs"])
        yield out.filter(pa.array(sizes > 0))


class TermSets:
    """Term sets (set_id, terms) as arrays, sent to every task; terms are sorted in each set and occur once."""

    def __init__(self, sets: pa.Table, first: int):
        """first: subsets get the ids -1 - first and less."""
        lists = sets["terms"].combine_chunks()
        coded = lists.flatten().dictionary_encode()
        self.terms, self.first = coded.dictionary, first
        self.set_ids = sets["set_id"].to_numpy()
        self.items = coded.indices.to_numpy().astype(np.int64)
        self.starts = _starts(pc.list_value_length(lists).to_numpy(zero_copy_only=False))

    def document_counts(self) -> Callable[[Batches], Batches]:
        """Step from (terms) to (id, df), partial counts."""
        terms = self.terms

        def run(batches: Batches) -> Batches:
            df = np.zeros(len(terms) + 1, np.int64)  # the last is for all other terms
            for batch in batches:
                df += np.bincount(pc.index_in(batch.column(0).flatten(), value_set=terms).fill_null(len(terms)).to_numpy(), minlength=len(df))
            ids = np.flatnonzero(df[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(df[ids])], ["id", "df"])

        return run

    def weigh(self, ids: np.ndarray, df: np.ndarray, documents: int, mean: float, rare: int, limit: int) -> pa.Table:
        """Takes the statistics in; (__set, set_id): the sets of each subset without rare terms."""
        count = np.zeros(len(self.terms), np.int64)
        count[ids] = df
        self.mean, self.limit = mean, max(1, limit)
        self.idf = np.log(1 + (documents - count + 0.5) / (count + 0.5))
        self.rare = count <= rare
        of = np.repeat(np.arange(len(self.set_ids)), np.diff(self.starts))
        scarce = self.rare[self.items]
        order = np.argsort(self.items[scarce], kind="stable")
        self.having = of[scarce][order]  # the sets with each rare term
        self.having_starts = _starts(np.bincount(self.items[scarce], minlength=len(self.terms)))
        subsets: dict[tuple[int, ...], int] = {}
        pairs = []
        for k, set_id in enumerate(self.set_ids.tolist()):
            own = self.items[self.starts[k] : self.starts[k + 1]]
            if common := tuple(own[~self.rare[own]].tolist()):
                pairs.append((-1 - self.first - subsets.setdefault(common, len(subsets)), set_id))
        self.subsets = list(subsets)
        return pa.table({"__set": pa.array([p[0] for p in pairs], pa.int64()), "set_id": pa.array([p[1] for p in pairs], pa.int64())})

    def best(self) -> Callable[[Batches], Batches]:
        """Step from (__key, length, terms, tfs) to (__set, __key, score): the best of each subset (below 0) and of the documents with rare terms of each set."""

        def run(batches: Batches) -> Batches:
            held: list[tuple] = []
            for batch in batches:
                held.append(self._read(batch))
                if sum(len(x[2]) for x in held) >= BLOCK:
                    yield from self._block(held)
                    held = []
            if held:
                yield from self._block(held)

        return run

    def _read(self, batch: pa.RecordBatch) -> tuple:
        """Keys and lengths of all rows; row, term and count of the postings of the sets' terms."""
        keys, length, lists, counts = batch.columns
        ids = pc.index_in(lists.flatten(), value_set=self.terms).fill_null(-1).to_numpy()
        at = np.flatnonzero(ids >= 0)
        rows = np.repeat(np.arange(len(keys)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        return keys, length.to_numpy(), rows[at], ids[at].astype(np.int64), counts.flatten().to_numpy()[at]

    def _block(self, held: list[tuple]) -> Batches:
        keys = pa.concat_arrays([x[0] for x in held])
        before = _starts([len(x[0]) for x in held])
        length, ids, tf = (np.concatenate([x[i] for x in held]) for i in (1, 3, 4))
        doc = np.concatenate([x[2] + b for x, b in zip(held, before)])
        held.clear()
        n = len(keys)
        order = pc.array_sort_indices(keys, order="ascending", null_placement="at_start")
        place = np.empty(n, np.int64)
        place[order.to_numpy()] = np.arange(n)  # documents are numbered by key, which decides ties
        part = self.idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / self.mean))
        at = ids * n + place[doc]
        sort = np.argsort(at)
        at, part = at[sort], part[sort]
        found = [*self._of_subsets(n, at, part), *self._of_rare(n, at, part)]
        keys = keys.take(order)
        if found:
            ids, docs, scores = (np.concatenate(x) for x in zip(*found))
            for k in range(0, len(ids), 100_000):
                end = k + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(ids[k:end]), keys.take(pa.array(docs[k:end])), pa.array(scores[k:end])], ["__set", "__key", "score"])

    def _of_subsets(self, n: int, at: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
        doc, limit = at % n, self.limit
        bounds = np.searchsorted(at, np.arange(len(self.terms) + 1) * n).tolist()
        floors: dict[int, float] = {}
        total = np.zeros(n)
        for k, terms in enumerate(self.subsets):
            spans = [(t, slice(bounds[t], bounds[t + 1])) for t in terms if bounds[t] < bounds[t + 1]]
            for t, s in spans:
                if t not in floors:
                    size = s.stop - s.start
                    floors[t] = np.partition(part[s], size - limit)[size - limit] if size >= limit else 0.0
            if not spans:
                continue
            least = max(0.0, max(floors[t] for t, _ in spans) - SLACK)  # so many have more by one term alone
            if len(spans) == 1:
                docs, scores = doc[spans[0][1]], part[spans[0][1]]
                keep = scores > least
                docs, scores = docs[keep], scores[keep]
            else:
                total.fill(0)
                for _, s in spans:
                    total[doc[s]] += part[s]
                docs = np.flatnonzero(total > least)
                scores = total[docs]
            if (size := len(docs)) > limit:
                keep = scores > np.partition(scores, size - limit)[size - limit] - SLACK
                docs, scores = docs[keep], scores[keep]
                order = np.lexsort((docs, -np.round(scores, 6)))[:limit]
                docs, scores = docs[order], scores[order]
            yield np.full(len(docs), -1 - self.first - k), docs, scores

    def _of_rare(self, n: int, at: np.ndarray, part: np.ndarray) -> Iterator[tuple]:
        own = at[self.rare[at // n]]
        sizes = np.diff(self.having_starts)[own // n]
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1
        for some in np.split(own, cuts):
            if not len(some):
                continue
            rows, places = _spread(self.having_starts, some // n)
            pairs = np.unique(self.having[places] * n + (some % n)[rows])
            which, docs = pairs // n, pairs % n
            rows, places = _spread(self.starts, which)
            wanted = self.items[places] * n + docs[rows]
            spots = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
            scores = np.bincount(rows, np.where(at[spots] == wanted, part[spots], 0.0), len(pairs))
            order = np.lexsort((docs, -np.round(scores, 6), which))
            which, docs, scores = which[order], docs[order], scores[order]
            firsts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            rank = np.arange(len(which)) - np.repeat(firsts, np.diff(np.append(firsts, len(which))))
            keep = rank < self.limit
            yield self.set_ids[which[keep]], docs[keep], scores[keep]
