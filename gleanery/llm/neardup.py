"""Problem 5: near-duplicate records with small edits.

Method: minhash with tensored banding. Two small collections of sub-bands are computed; each table key combines one sub-band of either, so
t x t keys come from 2 t sub-bands' minhashes. Two bodies that share a key are candidates, and every candidate pair is verified by
its exact similarity. Bodies with equal shingles are one class: only its representative is compared, and members are joined in at the end.

The table is built lazily: bodies are first put together by their first sub-bands. One that is alone there has no partner under any key that
begins with it; in small buckets the second sub-bands are compared pair by pair; only the rows of large buckets are multiplied into full keys. So
the candidates are those of all t x t keys, while few of the keys are ever written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.boilerplate import corpus, label
from gleanery.llm.residue import residue_pages
from gleanery.session import cut, discard

#: Sub-bands of each of the two collections, and minhashes of each sub-band.
SUB_BANDS, ROWS = 16, 2
SIMILARITY, WIDTH, MIN_WORDS = 0.5, 3, 40
#: Bodies with one first sub-band up to which they are compared pair by pair.
SMALL_BUCKET = 8
#: Candidates whose equal minhashes lie so many standard deviations below the threshold are not verified (None: all are).
DEVIATIONS = 4.0

SIGNED = "same bigint, words int, sketch array<smallint>, bands array<bigint>"
SIGNED_COLUMNS = [c.split()[0] for c in SIGNED.split(", ")]
#: Words that are signed in one go.
GROUP_WORDS = 30_000
_WORD = re.compile(r"\w+")
#: Of Latin-1: letters in lower case, all that is in no word as a space.
_LATIN_WORDS = bytes(ord(chr(i).lower()) if _WORD.match(chr(i)) else 32 for i in range(256))
#: Frequent marks outside Latin-1, none of which is in a word.
_MARKS = "’“”–—‘…"
_MASK = (1 << 64) - 1


def _latin_words(text: str) -> list[str]:
    return text.encode("latin-1").translate(_LATIN_WORDS).decode("latin-1").split()


def words_of(text: str) -> list[str]:
    """The words of a text in lower case, in order; Latin-1 is taken apart without the pattern."""
    plain = text
    for mark in _MARKS:
        if mark in plain:
            plain = plain.replace(mark, " ")
    try:
        return _latin_words(plain)
    except UnicodeEncodeError:
        words = []
    for line, whole in zip(plain.split("\n"), text.split("\n")):
        try:
            words += _latin_words(line)
        except UnicodeEncodeError:
            words += _WORD.findall(whole.lower())
    return words


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """Hashes of words, made on demand."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Signer:
    """Shingles, sketch and sub-bands of a text."""

    def __init__(self, width: int = WIDTH, sub_bands: int = SUB_BANDS, rows: int = ROWS, seed: int = 11):
        self.width, self.sub_bands, self.rows = width, sub_bands, rows
        n = 2 * sub_bands * rows
        self.multiply, self.add = _constants(n, seed), _constants(n, seed + 1)
        self.place = _constants(2 * sub_bands, seed + 2)
        self.words = _Words()

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > 500_000:  # memory bound of the cache only
            known.clear()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        """Hashes of the runs of `width` words in order."""
        n = max(1, len(ids) - self.width + 1)
        with np.errstate(over="ignore"):
            mixed = np.zeros(n, np.uint64)
            for k in range(min(self.width, len(ids))):
                mixed = _mix(mixed * np.uint64(3) + ids[k : k + n] + np.uint64(k))
        return mixed

    def shingles(self, words: list[str]) -> np.ndarray:
        """Sorted distinct hashes of runs of `width` words; a text with fewer words is one shingle."""
        runs = np.sort(self._runs(self._ids(words)))
        return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]

    def sign(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts as lists of words: hash of the shingle set, sketch and sub-bands, a row for each. All texts go through each hash function together."""
        sizes = [len(words) for words in texts]
        runs = self._runs(self._ids([w for words in texts for w in words]))
        parts, at = [], 0
        for words, size in zip(texts, sizes):
            if size < self.width:
                part = self.shingles(words)
            else:
                part = runs[at : at + size - self.width + 1]
                part.sort()
            parts.append(part)
            at += size
        x = np.concatenate(parts)
        starts = np.cumsum([0, *map(len, parts[:-1])])
        distinct = np.concatenate([[True], x[1:] != x[:-1]])
        distinct[starts] = True
        counts = np.add.reduceat(distinct.astype(np.int64), starts)
        x, starts = x[distinct], np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            same = np.add.reduceat(_mix(x), starts) ^ counts.astype(np.uint64) ^ np.uint64(1 << 63)
            low = np.empty((len(self.multiply), len(texts)), np.uint64)
            hashed = np.empty_like(x)
            for j, (m, c) in enumerate(zip(self.multiply, self.add)):  # shingles are mixed already
                np.multiply(x, m, out=hashed)
                np.add(hashed, c, out=hashed)
                np.minimum.reduceat(hashed, starts, out=low[j])
            bands = np.zeros((2 * self.sub_bands, len(texts)), np.uint64)
            for row in range(self.rows):
                bands = _mix(bands ^ low[row :: self.rows])
            bands = _mix(bands * self.place[:, None])
        return same.view(np.int64), (low >> np.uint64(24)).astype(np.uint16).view(np.int16).T, np.ascontiguousarray(bands.T).view(np.int64)


def _lists(parts, kind):
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, kind)))


class Signing:
    """Columns SIGNED of a list of texts; null where a text has fewer than min_words words."""

    schema = SIGNED

    def __init__(self, width: int = WIDTH, min_words: int = MIN_WORDS, sub_bands: int = SUB_BANDS, rows: int = ROWS):
        self.min_words, self.signer = min_words, Signer(width, sub_bands, rows)

    def __call__(self, texts: list[str | None]) -> list:
        import pyarrow as pa

        signer, n = self.signer, len(texts)
        sizes, same = np.zeros(n, np.int32), np.zeros(n, np.int64)
        sketches, bands = np.zeros((n, len(signer.multiply)), np.int16), np.zeros((n, len(signer.place)), np.int64)
        at, group, waiting = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text or "")
            if len(words) >= self.min_words:
                sizes[i] = len(words)
                at.append(i)
                group.append(words)
                waiting += len(words)
            if group and (waiting >= GROUP_WORDS or i == n - 1):
                same[at], sketches[at], bands[at] = signer.sign(group)
                at, group, waiting = [], [], 0
        none = np.ones(n, bool)
        none[sizes > 0] = False
        if self.min_words <= 0:
            none[:] = False

        def lists(rows):
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * rows.shape[1])
            return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()), mask=pa.array(none))

        return [pa.array(same, mask=none), pa.array(sizes, mask=none), lists(sketches), lists(bands)]


class _BodySigning(Signing):
    """The text of a body given as its lines, and its columns SIGNED."""

    schema = "text string, " + SIGNED

    def __call__(self, bodies: list[list[str]]) -> list:
        import pyarrow as pa

        texts = ["\n".join(lines) for lines in bodies]
        return [pa.array(texts, pa.string()), *super().__call__(texts)]


def _sign_batches(signing: Signing):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), *signing(part.column(1).to_pylist())], ["rec_id", "same", "words", "sketch", "bands"])

    return run


def _whole(shingles: np.ndarray) -> int:
    """One number for a set of shingles."""
    with np.errstate(over="ignore"):
        return int(_mix(shingles).sum(dtype=np.uint64) ^ np.uint64(len(shingles))) - (1 << 63)


def _shingle_batches(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        signer = Signer(width)
        for batch in batches:
            found = [signer.shingles(words_of(t or "")) for t in batch.column(1).to_pylist()]
            same = pa.array([_whole(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, _lists([x.view(np.int64) for x in found], np.int64)], ["class_id", "same", "shingles"])

    return run


def sign(texts: DataFrame, record: str, text: str, width: int = WIDTH, min_words: int = MIN_WORDS, sub_bands: int = SUB_BANDS, rows: int = ROWS) -> DataFrame:
    """rec_id, same (hash of the shingle set), words, sketch and sub-bands of each text with min_words words or more (null: none)."""
    return texts.select(F.col(record).cast("bigint").alias("rec_id"), F.col(text).alias("text")).mapInArrow(_sign_batches(Signing(width, min_words, sub_bands, rows)), "rec_id bigint, " + SIGNED).where("same is not null")


def candidates(heads: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Distinct (class_a, class_b), class_a < class_b, of heads (class_id, bands) that share a key: a first and a second sub-band.

    The size of a bucket only decides how its pairs are found. Second sub-bands are compared by 27 bits and their place, so that a few pairs
    more may come out, never fewer.
    """
    half = (F.size("bands") / 2).cast("int")
    first, second = F.slice("bands", F.lit(1), half), F.slice("bands", half + 1, half)
    ones = heads.select("class_id", F.explode(first).alias("key"))
    sizes = ones.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = ones.join(sizes, "key")
    marks = F.transform(second, lambda b, i: (F.pmod(b, F.lit(1 << 27)) + i.cast("bigint") * (1 << 27)).cast("bigint"))
    buckets = cut(shared.join(heads.select("class_id", marks.alias("marks")), "class_id").select("class_id", "key", "n", "marks"), "buckets")

    def pairs(rows: DataFrame, on: str, *also) -> DataFrame:
        x, y = rows.alias("x"), rows.alias("y")
        met = x.join(y, (F.col(f"x.{on}") == F.col(f"y.{on}")) & (F.col("x.class_id") < F.col("y.class_id")))
        for condition in also:
            met = met.where(condition)
        return met.select(F.col("x.class_id").alias("class_a"), F.col("y.class_id").alias("class_b"))

    few = pairs(buckets.where(F.col("n") <= small_bucket), "key", F.arrays_overlap("x.marks", "y.marks"))
    full = buckets.where(F.col("n") > small_bucket).select("class_id", "key", F.explode("marks").alias("mark")).select("class_id", F.xxhash64("key", "mark").alias("whole"))
    return few.unionByName(pairs(full, "whole")).distinct()


def class_pairs(signed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, small_bucket: int = SMALL_BUCKET, deviations: float | None = DEVIATIONS, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links): (rec_id, class_id) for every signed record, and (class_a, class_b, similarity) for classes at or above similarity.

    signed: see sign, one row for each rec_id, or several of which kept (rec_id, same) names one; texts (rec_id, text): what was signed, other
    texts of a rec_id do no harm. class_id is the smallest rec_id with the same shingle set. A candidate must share a table key; its exact similarity decides. Keys of a hot group meet
    only between different shingle sets, as equal ones are one class.
    """
    kept = signed.select("rec_id", "same").distinct() if kept is None else kept
    members = cut(kept.join(kept.groupBy("same").agg(F.min("rec_id").alias("class_id")), "same").select("rec_id", "class_id", "same"), "members")
    first = members.where("rec_id = class_id").select("class_id", F.col("same").alias("__same")).distinct()
    heads = signed.join(first, signed.rec_id == F.col("class_id")).where("same = __same").select(signed.rec_id.alias("class_id"), "same", "sketch", "bands")
    heads = cut(heads.dropDuplicates(["class_id", "same"]), "heads")  # a class has one same, and by both the join has put the rows together already
    pairs = candidates(heads, small_bucket)
    if deviations is not None:  # sketches first: pairs far below the threshold never meet their shingles
        sa, sb = heads.select(F.col("class_id").alias("class_a"), F.col("sketch").alias("sketch_a")), heads.select(F.col("class_id").alias("class_b"), F.col("sketch").alias("sketch_b"))
        alike, n = F.size(F.array_remove(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), False)), F.size("sketch_a")
        least = n * similarity - deviations * F.sqrt(n * similarity * (1 - similarity))
        pairs = pairs.join(sa, "class_a").join(sb, "class_b").where(alike >= F.floor(least)).select("class_a", "class_b")
    pairs = cut(pairs, "candidates")
    needed = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).distinct().join(heads.select("class_id", "same"), "class_id")
    needed = cut(needed, "needed")
    shingles = texts.join(needed, texts.rec_id == needed.class_id, "left_semi").select("rec_id", "text").mapInArrow(_shingle_batches(width), "class_id bigint, same bigint, shingles array<bigint>")
    shingles = cut(shingles.join(needed, ["class_id", "same"], "left_semi").dropDuplicates(["class_id"]), "shingles")
    a, b = shingles.select(F.col("class_id").alias("class_a"), F.col("shingles").alias("shingles_a")), shingles.select(F.col("class_id").alias("class_b"), F.col("shingles").alias("shingles_b"))
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    exact = pairs.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", (both / (F.size("shingles_a") + F.size("shingles_b") - both)).alias("similarity"))
    return members.select("rec_id", "class_id"), exact.where(F.col("similarity") >= similarity)


def page_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """class_pairs over the main bodies of raw_pages without the pages that p3_found lists. Of several crawls of a page_id the one with the longest body counts."""
    pages, _, found = corpus(spark, sf_dir, texts=False)
    labelled = cut(label(pages, found, then=_BodySigning()), "labelled-pages")
    discard(pages)
    bad = cut(residue_pages(labelled), "residue")
    signed = labelled.where("same is not null").select("rec_id", *SIGNED_COLUMNS)
    kept = signed.select("rec_id", "same", "words").join(bad, F.col("rec_id") == F.col("page_id"), "left_anti")
    kept = cut(kept.groupBy("rec_id").agg(F.max(F.struct("words", "same")).alias("x")).select("rec_id", "x.same"), "kept")
    return class_pairs(signed, labelled.select("rec_id", "text"), kept=kept)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages whose bodies share half of their sets of three words or more; equal bodies count."""
    members, links = page_classes(spark, sf_dir)
    a, b = members.alias("a"), members.alias("b")
    equal = a.join(b, (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a.rec_id") < F.col("b.rec_id"))).select(F.col("a.rec_id").alias("page_id_a"), F.col("b.rec_id").alias("page_id_b"))
    near = links.join(a, F.col("class_a") == F.col("a.class_id")).join(b, F.col("class_b") == F.col("b.class_id")).where(F.col("a.rec_id") != F.col("b.rec_id"))
    near = near.select(F.least("a.rec_id", "b.rec_id").alias("page_id_a"), F.greatest("a.rec_id", "b.rec_id").alias("page_id_b"))
    return equal.unionByName(near).distinct()


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page: its class and the number of other classes linked to it."""
    members, links = page_classes(spark, sf_dir)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select(F.col("rec_id").alias("page_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
