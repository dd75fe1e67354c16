"""Passages of held-out items inside a corpus, by winnowed fingerprints that are extended to whole stretches.

Both sides are cut into words; each window of `window` successive k-grams keeps its smallest hash, so that any shared
run of k + window - 1 words shares a kept hash whatever surrounds it. Fingerprints of documents are joined with those of
the items; pairs with enough of them are extended word by word, and one stretch that covers enough of the item is a
case. The items go to the tasks whole while their size is within a limit: each document then is read once, where it
lies, and nothing of it is shuffled. Larger sets of items are joined by their fingerprints as tables.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortloom.functions.common import exact

K, WINDOW = 4, 4
#: Characters of all items up to which the items are sent to the tasks.
ITEMS_LIMIT = 32_000_000

# Escapes of notebook cells and of terminals.
ESCAPE = re.compile(r"(?:\x1b|\\+u001[bB]|\\+x1[bB])\[[0-9;]*[A-Za-z]|\\+u([0-9a-fA-F]{4})|\\+[nrtbf]")
WORD = re.compile(r"[^\W_]+")
_LAST = np.uint64((1 << 20) - 1)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def _unescape(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else " "


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, escapes undone."""
    if not text:
        return []
    if "\\" in text or "\x1b" in text:
        text = ESCAPE.sub(_unescape, text)
    return WORD.findall(text.lower())


class _Hashes(dict):
    """A 64-bit hash of each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def hash_words(words: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-grams of hashed words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = (g ^ h[j : j + n]) * _SEED
        g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window, the last of equals; of all if there are fewer than a window."""
    if len(g) == 0:
        return np.zeros(0, np.int64)
    if len(g) <= window:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    n = len(g) - window + 1
    least, at = g[:n].copy(), np.arange(n)
    for j in range(1, window):
        smaller = g[j : j + n] <= least
        at[smaller] = np.flatnonzero(smaller) + j
        np.minimum(least, g[j : j + n], out=least)
    # From window to window the place never goes back.
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def least_words(share: float, error_rate: float, k: int = K, window: int = WINDOW) -> int:
    """From so many words on, winnowing can't miss a stretch of that share of an item: see needed_hits."""
    slope = share * (1 - error_rate * (k + window - 1))
    return int((k + window - 2) / slope) + 1 if slope > 0 else 2**31 - 1


def hits_due(n: int, share: float, rate: float, k: int = K, window: int = WINDOW) -> int:
    """Fingerprints, at least one, that any stretch of `share` of an item's n words shares at that rate of errors.

    A stretch of L words with e errors is e + 1 runs of L - e words. Each run hides at most k + window - 2 words, and
    the rest of it holds a fingerprint in each `window` words; with e = rate * L the bound grows with L. Hits count
    by their places in the item.
    """
    free = n * (share * (1 - rate * (k + window - 1))) - (k + window - 2)
    return max(1, int(np.ceil(free / window - 1e-9)))


def needed_hits(n: Column, share: float, rate: float, k: int = K, window: int = WINDOW) -> Column:
    """hits_due of a column."""
    free = n * (share * (1 - rate * (k + window - 1))) - (k + window - 2)
    return F.greatest(F.lit(1), F.ceil(free / window - 1e-9))


def fingerprints(df: DataFrame, key: str, text: str, k: int = K, window: int = WINDOW, all_below: int = 0) -> DataFrame:
    """(key, n_words, prints: array of (hash, pos)) of each text that has any. Texts of fewer than `all_below` words keep the hashes of all their k-grams."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                keep, counts, hashes, places = [], [], [], []
                part = b.slice(at, 1000)
                for i, t in enumerate(part.column(1).to_pylist()):
                    words = words_of(t)
                    g = grams(hash_words(words), k)
                    pos = winnow(g, 1 if len(words) < all_below else window)
                    if len(pos):
                        keep.append(i)
                        counts.append(len(words))
                        hashes.append(g[pos])
                        places.append(pos)
                if not keep:
                    continue
                offsets = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
                prints = pa.StructArray.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))], ["hash", "pos"])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), prints)], ["key", "n_words", "prints"])

    return df.select(key, text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"key {kind}, n_words int, prints array<struct<hash: bigint, pos: int>>")


def due_words(n: int, share: float) -> int:
    """The fewest words that are `share` of n."""
    return max(1, int(np.ceil(share * n - 1e-9)))


def _greedy(doc: Sequence[str], item: Sequence[str], rate: float) -> int:
    """Words of the item in a stretch that the document repeats at that rate of errors: a sound stretch, though not always the longest.

    Blocks of equal words are chained; what the rate leaves is spent on wrong words at the ends.
    """
    blocks = [b for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size]
    best = 0
    for p in range(len(blocks)):
        errors = 0
        for q in range(p, len(blocks)):
            if q > p:
                a, b = blocks[q - 1], blocks[q]
                errors += max(b.a - a.a - a.size, b.b - a.b - a.size)
            span = blocks[q].a + blocks[q].size - blocks[p].a
            if errors <= rate * span + 1e-9:
                best = max(best, min(len(item), span + int((rate * span - errors + 1e-9) / (1 - rate))))
    return best


def _exact(doc: np.ndarray, item: np.ndarray, rate: float, due: int) -> int:
    """The longest stretch of at least `due` words of the item within edit distance rate * length of a part of the document, or 0.

    Edit distances of the item's words from each possible start to each end, against parts of the document that begin
    anywhere, one row of the item at a time.
    """
    n, m = len(item), len(doc)
    starts = n - due + 1
    cost = np.full((starts, m + 1), 1 << 20, np.int32)
    run = np.arange(m + 1, dtype=np.int32)
    best = 0
    for i in range(n):
        live = min(i + 1, starts)
        if i < starts:
            cost[i] = 0
        rows = cost[:live]
        new = rows + 1  # the item's word is dropped
        np.minimum(new[:, 1:], rows[:, :-1] + (doc != item[i]), out=new[:, 1:])  # kept or changed
        new = np.minimum.accumulate(new - run, axis=1) + run  # words added
        cost[:live] = new
        lengths = i + 1 - np.arange(live)
        good = (lengths >= due) & (new.min(axis=1) <= rate * lengths + 1e-9)
        if good.any():
            best = max(best, int(lengths[good].max()))
    return best


def stretch(doc: Sequence[str], item: Sequence[str], rate: float, share: float) -> int:
    """A stretch of the item, of `share` of its words or more, that the document repeats in order with at most that rate of errors; 0 where there is none.

    Errors are words changed, added or dropped, at the ends of the stretch, too. Whether there is one is decided
    exactly: where chained blocks don't show it and there are enough common words, by all edit distances.
    """
    due = due_words(len(item), share)
    common = Counter(doc) & Counter(item)
    if common.total() < (1 - rate) * due - 1e-9:
        return 0
    got = _greedy(doc, item, rate)
    if got >= due:
        return got
    number = {w: k for k, w in enumerate(dict.fromkeys([*item, *doc]))}
    return _exact(np.array([number[w] for w in doc]), np.array([number[w] for w in item]), rate, due)


def longest_stretch(doc_words: list[str], doc_grams: np.ndarray, item_words: list[str], rate: float, share: float, k: int = K, own: np.ndarray | None = None) -> int:
    """The stretch (see there) around any place of the document that shares a k-gram with the item.

    Places are read as one region where they lie no further apart than a stretch of this item allows: each wrong word
    spoils k successive k-grams at most, and there are `rate` times the item's words at most. A region has as many
    such places as the shortest stretch has correct k-grams, or is left out.
    """
    own = np.unique(grams(hash_words(item_words), k)) if own is None else own
    if not len(own) or not len(doc_grams):
        return 0
    n = len(item_words)
    at = np.flatnonzero(own[np.minimum(np.searchsorted(own, doc_grams), len(own) - 1)] == doc_grams)
    length = due_words(n, share)
    due = max(1, length - int(rate * length + 1e-9) * k - (k - 1))
    if len(at) < due:
        return 0
    best = 0
    wrong = int(rate * n + 1e-9)
    reach = k * wrong + k
    for places in np.split(at, np.flatnonzero(np.diff(at) > reach) + 1):
        if len(places) < due:
            continue
        lo, hi = max(0, int(places[0]) - reach), int(places[-1]) + k + reach
        # A long region (a passage that is repeated) is read in parts that overlap by more than the longest stretch.
        step, overlap = 2 * n + 2 * reach, n + wrong + 1
        for start in range(lo, max(lo + 1, min(hi, len(doc_words)) - overlap), step):
            best = max(best, stretch(doc_words[start : min(hi, start + step + overlap)], item_words, rate, share))
            if best == n:
                return best
    return best


class Items:
    """The items' words and fingerprints, to be held against one document after another."""

    def __init__(self, texts: Iterable[str], share: float, rate: float, k: int, window: int):
        self.share, self.rate, self.k, self.window = share, rate, k, window
        self.words = [words_of(t) for t in texts]
        least = least_words(share, rate, k, window)
        self.grams = [np.unique(g) for g in (grams(hash_words(w), k) for w in self.words)]
        self.needed = [0] * len(self.words)
        parts: dict[bool, list[tuple[np.ndarray, int]]] = {True: [], False: []}
        for i, w in enumerate(self.words):
            short = len(w) < least
            g = grams(hash_words(w), k)
            parts[short].append((g if short else g[winnow(g, window)], i))
            self.needed[i] = hits_due(len(w), share, rate, k, 1 if short else window)
        self.tables = []
        for short, own in parts.items():
            h = np.concatenate([x for x, _ in own]) if own else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            likely = np.zeros(1 << 20, bool)  # by the last bits, a cheap pass before the search
            likely[h & _LAST] = True
            self.tables.append((1 if short else window, likely, h[order], np.repeat([i for _, i in own], [len(x) for x, _ in own]).astype(np.int64)[order] if own else np.zeros(0, np.int64)))

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """(item, stretch) of the items that leaked into a text."""
        words = words_of(text)
        g = grams(hash_words(words), self.k)
        out = []
        for window, likely, hashes, item in self.tables:
            if not len(hashes) or not len(g):
                continue
            own = g[winnow(g, window)]
            own = np.unique(own[likely[own & _LAST]])
            low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
            hit = high > low
            if not hit.any():
                continue
            found = Counter(x for a, b in zip(low[hit], high[hit]) for x in item[a:b].tolist())
            for i, hits in found.items():
                if hits >= self.needed[i]:
                    got = longest_stretch(words, g, self.words[i], self.rate, self.share, self.k, self.grams[i])
                    if got:
                        out.append((i, got))
        return sorted(out)


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", share: float = 0.5, error_rate: float = 0.1, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_key, item_key, stretch, n_words): each document that holds a stretch of at least `share` of an item's words.

    Candidate pairs share as many fingerprints as a stretch of that share and rate must (hits_due). Winnowing
    leaves too few for that in short items (up to 40 words by default); these, and documents for them, keep all
    k-grams. Candidates are extended in the document's own words, and decided exactly (see stretch). Defined results:
    null and empty texts hold and leak nothing; a stretch without k unchanged words in a row can't be found (by default:
    none of items shorter than k words, and in items shorter than 2k - 1 words not every half); repeated rows count
    once, an item_id with several texts counts where any of them leaks; tables may be empty.
    Items of up to ITEMS_LIMIT characters in all go to the tasks; larger sets are joined by fingerprints, with the same
    results. Documents of one pair aren't gathered: a row holds one document.
    """
    documents, items = exact(documents, [doc_key, text]), exact(items, [item_key, text])
    kinds = dict(documents.dtypes)[doc_key], dict(items.dtypes)[item_key]
    schema = f"`{doc_key}` {kinds[0]}, `{item_key}` {kinds[1]}, stretch int, n_words int"
    there = items.filter(F.col(item_key).isNotNull() & F.col(text).isNotNull()).distinct()
    total = there.agg(F.sum(F.length(text)).alias("n")).collect()[0].n or 0
    if total <= ITEMS_LIMIT:
        out = _held(documents, there.select(F.col(item_key).alias("k"), F.col(text).alias("t")).collect(), schema, doc_key, text, share, error_rate, k, window)
    else:
        out = _joined(documents, there, schema, doc_key, item_key, text, share, error_rate, k, window)
    return out.groupBy(doc_key, item_key).agg(F.max("stretch").alias("stretch"), F.max("n_words").alias("n_words"))


_READY: dict[str, Items] = {}


def _rows(schema_key: pa.DataType, docs: pa.Array, found: list[tuple[int, object, int, int]]) -> pa.RecordBatch:
    """Rows (document, item, stretch, n_words) of found ones that name their document by its place."""
    place, item, size, total = (list(x) for x in zip(*found)) if found else ([], [], [], [])
    return pa.RecordBatch.from_arrays([docs.take(pa.array(place, pa.int64())), pa.array(item, schema_key), pa.array(size, pa.int32()), pa.array(total, pa.int32())], ["d", "i", "stretch", "n_words"])


def _held(documents: DataFrame, items: list, schema: str, doc_key: str, text: str, share: float, rate: float, k: int, window: int) -> DataFrame:
    """Each document held against all items, in one pass."""
    spark = documents.sparkSession
    pairs = sorted(((r.k, r.t) for r in items), key=lambda x: (str(x[0]), x[1]))
    content = pickle.dumps((pairs, share, rate, k, window))
    name, shared = hashlib.sha1(content).hexdigest(), spark.sparkContext.broadcast(pairs)
    item_type = pa.array([x for x, _ in pairs] or [None]).type if not pairs else _arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [x for x, _ in shared.value]
        if name not in _READY:
            _READY.clear()
            _READY[name] = Items([t for _, t in shared.value], share, rate, k, window)
        own = _READY[name]
        for b in batches:
            found = [(i, keys[j], got, len(own.words[j])) for i, t in enumerate(b.column(1)) for j, got in own.leaks(t.as_py())]
            yield _rows(item_type, b.column(0), found)

    return documents.select(doc_key, text).filter(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, schema)


def _arrow_of(schema: str) -> pa.DataType:
    """The Arrow type of the second column of a schema text."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(schema).fields[1].dataType)


def _joined(documents: DataFrame, items: DataFrame, schema: str, doc_key: str, item_key: str, text: str, share: float, rate: float, k: int, window: int) -> DataFrame:
    """Fingerprints joined as tables, then the texts of the candidates extended."""
    least = least_words(share, rate, k, window)
    # An item is a key and a text, as a key may have several.
    own = items.select(F.struct(F.col(item_key).alias("k"), F.col(text).alias("t")).alias("_item"), text)
    known = fingerprints(own.select(F.xxhash64("_item").alias("_id"), text), "_id", text, k, window, all_below=least)
    known = known.select(F.col("key").alias("_id"), F.col("n_words").alias("_n"), F.explode("prints").alias("p")).select("_id", "_n", F.col("p.hash").alias("hash"), F.col("p.pos").alias("_pos"))
    short = F.col("_n") < least
    found = []
    for part, w in ((known.filter(short), 1), (known.filter(~short), window)):
        prints = fingerprints(documents, doc_key, text, k, w).select(F.col("key").alias("_doc"), F.explode(F.array_distinct("prints.hash")).alias("hash"))
        hits = prints.join(part, "hash").groupBy("_doc", "_id").agg(F.count_distinct("_pos").alias("_hits"), F.max("_n").alias("_n"))
        found.append(hits.filter(F.col("_hits") >= needed_hits(F.col("_n"), share, rate, k, w)).select("_doc", "_id"))
    texts = items.select(F.xxhash64(F.struct(F.col(item_key).alias("k"), F.col(text).alias("t"))).alias("_iid"), F.col(item_key).alias("_key"), F.col(text).alias("_item_text"))
    wanted = found[0].union(found[1]).join(texts, F.col("_id") == F.col("_iid")).groupBy("_doc").agg(F.collect_list(F.struct("_key", "_item_text")).alias("_items"))
    rows = documents.select(F.col(doc_key).alias("_id"), F.col(text).alias("_text")).join(wanted, F.col("_id") == F.col("_doc")).select("_doc", "_text", "_items")
    item_type = _arrow_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i in range(b.num_rows):
                words = words_of(b.column(1)[i].as_py())
                g = grams(hash_words(words), k)
                for x in b.column(2)[i].as_py():
                    own = words_of(x["_item_text"])
                    if got := longest_stretch(words, g, own, rate, share, k):
                        found.append((i, x["_key"], got, len(own)))
            yield _rows(item_type, b.column(0), found)

    return rows.mapInArrow(run, schema)
