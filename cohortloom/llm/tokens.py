"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

The frequent words of the corpus, counted over all of it, are compiled with their id lists into a minimal acyclic
transducer whose states share suffixes: the number of words passed over on the way through it is a word's place in
sorted order, and so gives its ids. Its ways are lists of edges by state, a few megabytes that go out in one broadcast;
each executor keeps one copy as a file that all its workers map into memory. A task cuts a text into words, numbers
each new word once, sends the new words of a batch through the transducer together, and merges the words that it
doesn't hold by the vocabulary's ranks, exactly as the tokenizer does. Texts are cut in two steps, into chunks (no word
reaches over a blank but one that begins with it) and each new chunk into words, as most chunks occur again and again.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortloom.functions.common import exact, fresh, sealed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The vocabulary's way to part words. White space is spelled out, as modules differ on it.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
# The same with all that isn't white space taken together: words never cross the ends of these chunks.
CHUNKS = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Words, and chunks, a worker remembers, or counts, before it starts over.
REMEMBERED = 400_000
#: A frequent word is at least one in so many of the corpus's words (so there are no more than that), and of no more characters than this.
ONE_IN, LONGEST = 200_000, 48


_CHUNKS = re.compile(CHUNKS).findall
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in content.splitlines() if line.strip())}


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """The words of a vocabulary file and their ids."""
    with open(path, "rb") as fh:
        return parse_ranks(fh.read())


def _cutter() -> Callable[[str], list[str]]:
    """Cuts a text into words; together they are the text."""
    import regex

    plain, other = re.compile(ASCII_WORDS).findall, regex.compile(WORDS).findall
    return lambda t: plain(t) if t.isascii() else other(t)


class Lexicon:
    """A minimal acyclic transducer from byte strings to lists of ids.

    Edges are sorted by state * 256 + byte (`keys`), each with the state it leads to and the number of words passed over
    by taking it; all tables are one array of 32-bit numbers behind six sizes, so that a file of it can be mapped.
    """

    def __init__(self, flat: np.ndarray):
        n_edges, n_states, n_words, n_ids, self.longest = (int(x) for x in flat[:5])
        parts, at = [], 6
        for size in (n_edges, n_edges, n_edges, n_states, n_words + 1, n_ids):
            parts.append(flat[at : at + size])
            at += size
        self.flat = flat
        self.keys, self.targets, self.passed, self.final, self.first, self.ids = parts

    @classmethod
    def build(cls, words: dict[bytes, Sequence[int]]) -> Lexicon:
        """From words in any order. States that accept the same endings are one state."""
        ordered = sorted(words)
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []  # (parent, byte, child) of the word put in last

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (final[child], tuple(edges[child].items()))
                same = register.setdefault(key, child)
                if same != child:
                    edges[parent][byte] = same

        before = b""
        for word in ordered:
            common = len(os.path.commonprefix((before, word)))
            settle(common)
            state = path[-1][2] if path else 0
            for byte in word[common:]:
                edges.append({})
                final.append(False)
                child = len(edges) - 1
                edges[state][byte] = child
                path.append((state, byte, child))
                state = child
            final[state] = True
            before = word
        settle(0)
        # Only what is reached keeps a number. A state is settled after all that it leads to, so `below` comes in that order.
        number, order = {0: 0}, [0]
        for s in order:
            for child in edges[s].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            left = [c for c in edges[s].values() if c not in below]
            if left:
                stack += left
            else:
                below[s] = final[s] + sum(below[c] for c in edges[s].values())
                stack.pop()
        if len(order) >= 1 << 23:
            raise ValueError("the lexicon has too many states for 32-bit keys")
        keys, targets, passed = [], [], []
        for s in order:
            so_far = int(final[s])
            for byte in sorted(edges[s]):
                child = edges[s][byte]
                keys.append(number[s] << 8 | byte)
                targets.append(number[child])
                passed.append(so_far)
                so_far += below[child]
        lengths = [len(words[w]) for w in ordered]
        ids = [x for w in ordered for x in words[w]]
        sizes = [len(keys), len(order), len(ordered), len(ids), max(map(len, ordered), default=0), 0]
        return cls(np.concatenate([np.array(x, np.int32) for x in (sizes, keys, targets, passed, [final[s] for s in order], np.cumsum([0, *lengths]), ids)]))

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word among the sorted words, or -1. All words walk together, a byte at a time."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        buffer = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(words) else lengths
        state, passed = np.zeros(len(live), np.int32), np.zeros(len(live), np.int32)
        at = 0
        while len(live):
            done = lengths[live] == at
            if done.any():
                hit = done & (self.final[state] != 0)
                out[live[hit]] = passed[hit]
                live, state, passed = live[~done], state[~done], passed[~done]
                if not len(live):
                    break
            key = (state << 8) | buffer[start[live] + at]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[edge] == key
            live, edge = live[go], edge[go]
            state, passed = self.targets[edge], passed[go] + self.passed[edge]
            at += 1
        return out

    def ids_of(self, place: int) -> np.ndarray:
        return self.ids[self.first[place] : self.first[place + 1]]


class _Numbers(dict):
    """Gives each new text the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all slices one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Lists:
    """Lists of ids by number, one after another in one array."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.lengths, self.starts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def new(self) -> list[str]:
        return list(islice(self.numbers, len(self.lengths), None))

    def put(self, numbers: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> None:
        """The lists of some of the new numbers, one after another."""
        more = len(self.numbers) - len(self.lengths)
        if more:
            self.lengths, self.starts = (np.concatenate((x, np.zeros(more, np.int64))) for x in (self.lengths, self.starts))
        self.lengths[numbers], self.starts[numbers] = lengths, np.cumsum(lengths) - lengths + len(self.flat)
        self.flat = np.concatenate((self.flat, flat))

    def get(self, code: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of groups of numbers, the first sizes[0] of which are the first group."""
        lengths = self.lengths[code]
        offsets = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)]
        return offsets, self.flat[_gathered(self.starts[code], lengths)]


class Encoder:
    """Ids of texts; remembers the chunks and words it has met."""

    def __init__(self, lexicon: Lexicon, merge: Callable[[bytes], Sequence[int]]):
        self.lexicon, self.merge, self.cut = lexicon, merge, _cutter()
        self.chunks, self.words = _Lists(), _Lists()

    def _learn_chunks(self) -> None:
        """Cuts all new chunks of a kind at once, parted by line breaks, which no word of theirs holds."""
        known, new = len(self.chunks.lengths), self.chunks.new()
        kinds: dict[object, list[int]] = {None: [], True: [], False: []}
        for k, c in enumerate(new):
            kinds[None if c[-1] in BLANKS else c.isascii()].append(k)
        number = self.words.numbers.__getitem__
        for kind, own in kinds.items():
            if not own:
                continue
            texts = [new[k] for k in own]
            if kind is None:  # white space is one word
                code, sizes = np.fromiter(map(number, texts), np.int64, len(texts)), np.ones(len(texts), np.int64)
            else:
                words = self.cut("\n".join(texts))
                code = np.fromiter(map(number, words), np.int64, len(words))
                parting = code == number("\n")
                sizes = np.diff(np.flatnonzero(np.concatenate(([True], parting, [True])))) - 1
                code = code[~parting]
            self._learn_words()
            offsets, ids = self.words.get(code, sizes)
            self.chunks.put(np.array(own) + known, np.diff(offsets), ids)

    def _learn_words(self) -> None:
        words = [w.encode("utf-8", "surrogatepass") for w in self.words.new()]
        place = self.lexicon.places(words)
        first = self.lexicon.first.astype(np.int64)
        held = place >= 0
        lengths = np.where(held, first[place + held] - first[place], 0) if len(words) else np.zeros(0, np.int64)
        merged = {int(k): self.merge(words[k]) for k in np.flatnonzero(~held)}
        for k, ids in merged.items():
            lengths[k] = len(ids)
        at = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.int32)
        flat[_gathered(at[held], lengths[held])] = self.lexicon.ids[_gathered(first[place[held]], lengths[held])]
        for k, ids in merged.items():
            flat[at[k] : at[k] + len(ids)] = ids
        self.words.put(np.arange(len(words)) + len(self.words.lengths), lengths, flat)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, one after another. Null and empty texts have none."""
        if len(self.chunks.numbers) > REMEMBERED:
            self.chunks = _Lists()
        if len(self.words.numbers) > REMEMBERED:
            self.words = _Lists()
        number, codes, sizes = self.chunks.numbers.__getitem__, [], []
        for t in texts:
            before = len(codes)
            codes += map(number, _CHUNKS(t or ""))
            sizes.append(len(codes) - before)
        self._learn_chunks()
        return self.chunks.get(np.array(codes, np.int64), sizes)


def merger(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """Merges a word's bytes by rank, exactly; words of any length."""
    import tiktoken

    core = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return core.encode_single_piece


def word_counts(df: DataFrame, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(word, n): how often each word of at most `longest` characters occurs in all texts; n of the null word is that of all words, long ones too.

    A task adds up its own words first; what it sends on are its different words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, chunks = _cutter(), Counter()

        def out() -> pa.RecordBatch:
            counts: Counter = Counter()
            for kind in (True, False):
                often: dict[int, list[str]] = {}
                for c, n in chunks.items():
                    if c.isascii() == kind and c[-1] not in BLANKS:
                        often.setdefault(n, []).append(c)
                for n, texts in often.items():
                    for w, k in Counter(cut("\n".join(texts))).items():
                        counts[w] += k * n if w != "\n" else 0
            for c, n in chunks.items():
                if c[-1] in BLANKS:
                    counts[c] += n
            own = [w for w in counts if len(w) <= longest]
            return pa.RecordBatch.from_arrays([pa.array([*own, None], pa.string()), pa.array([*(counts[w] for w in own), counts.total()], pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0):
                chunks.update(_CHUNKS(t.as_py() or ""))
                if len(chunks) > REMEMBERED:
                    yield out()
                    chunks.clear()
        yield out()

    return exact(df, [text]).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text: str = "text", one_in: int = ONE_IN, longest: int = LONGEST) -> list[str]:
    """The words that are at least one in `one_in` of all words of all texts, sorted; so no more than `one_in` come to the driver."""
    counts = sealed(word_counts(df, text, longest))  # else the filter for the total would go below the counts, and both would count
    total = counts.filter("word is null").agg(F.sum("n").alias("total"))  # one row
    often = counts.filter("word is not null").crossJoin(F.broadcast(total)).filter(F.col("n") * one_in >= F.col("total"))
    return sorted(r.word for r in often.select("word").collect())


_READY: dict[str, Encoder] = {}


def _mapped(name: str, content: bytes) -> np.ndarray:
    """An array that all workers of an executor share: a file in the executor's own folder, mapped into memory."""
    from pyspark import SparkFiles

    path = os.path.join(SparkFiles.getRootDirectory(), name)
    if not os.path.exists(path):
        own = f"{path}.{os.getpid()}"
        with open(own, "wb") as fh:
            fh.write(content)
        os.replace(own, path)
    return np.memmap(path, np.int32, "r")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, out: str = "ids", one_in: int = ONE_IN) -> DataFrame:
    """(key, ids): every text as its list of token ids, without special tokens; texts aren't shuffled, only word counts are.

    Texts that look like special tokens are ordinary text. Defined results: null and empty texts give the empty list;
    texts of any length are encoded whole; null keys and repeated rows stay as they are; other columns aren't read.
    `vocabulary` is read by the driver only. The frequent words are counted when this is called; which they are (see
    frequent_words) changes nothing but the speed.
    """
    df = exact(df, [key, text])
    with open(vocabulary, "rb") as fh:
        ranks_file = fh.read()
    merge = merger(parse_ranks(ranks_file))
    words = [w.encode() for w in frequent_words(df, text, one_in)]
    content = Lexicon.build({w: merge(w) for w in words}).flat.tobytes()
    name = "lexicon-" + hashlib.sha1(content + ranks_file).hexdigest()[:16]
    shared = df.sparkSession.sparkContext.broadcast((content, ranks_file))
    out = fresh([key], out)
    key_type = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _READY:
            _READY.clear()
            _READY[name] = Encoder(Lexicon(_mapped(name, shared.value[0])), merger(parse_ranks(shared.value[1])))
        encoder = _READY[name]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                offsets, ids = encoder.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, out])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, `{out}` array<int>")
