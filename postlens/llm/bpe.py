"""Byte-level BPE encoding and decoding by a two-tier lookup.

Texts are split into pre-tokens by the vocabulary's pattern.  First tier: the
distinct pre-tokens of a batch are looked up in a minimal perfect hash of the
vocabulary (as many slots as entries, one probe, then the bytes are compared).
Second tier: a pre-token that is no entry is a doubly linked list of its
bytes, and a heap of its adjacent pairs yields the pair of lowest rank, the
leftmost of equal ones, until no pair is an entry.  Both tiers together give
what the tiktoken library gives for the same ranks and pattern.

The hash is built once and broadcast; it is as large as the vocabulary, which
is a parameter and not data.  Rows are encoded where they lie: no shuffle.
"""

from __future__ import annotations

import base64
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import by_value, replace_columns

by_value(__name__)

#: Entries of the largest vocabulary that is broadcast (about 20 bytes an entry).
MOST_ENTRIES = 4_000_000
#: Characters that are split and looked up at a time; a longer text is a batch of its own.
BATCH_CHARS = 1 << 21
#: Second-tier results that a task remembers; when full they are forgotten, and computed anew when met again.
REMEMBERED = 400_000
MIX, STEP = 0x9E3779B97F4A7C15, 0x100000001B3


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a rank file (base64 token and rank a line)."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, so not every text can be encoded")
    if len(ranks) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary of {len(ranks)} entries is more than {MOST_ENTRIES}")
    if len(set(ranks.values())) < len(ranks):
        raise ValueError("two entries of the vocabulary have the same rank")
    return ranks


# First tier: minimal perfect hash
def _scramble(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    h = (h ^ np.uint64(MIX) * np.asarray(seed, np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def hash_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings that lie in one buffer, a position of all strings at a time."""
    h = np.full(len(starts), 0xCBF29CE484222325, np.uint64) ^ lengths.astype(np.uint64)
    order = np.argsort(-lengths, kind="stable")
    longer = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    for at, n in enumerate(longer):
        who = order[:n]
        h[who] = (h[who] ^ data[starts[who] + at]) * np.uint64(STEP)
    return h


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: bucket, seed of the bucket, place, rank of the place.

    Buckets are placed by size, largest first.  In each round all open buckets
    of a size try the next seed; one is placed if its keys meet free places
    that no earlier one claims.  There are a quarter more places than keys;
    the rank of a taken place among those taken is the key's slot.
    """

    def __init__(self, keys: list[bytes]):
        self.size, self.longest = len(keys), max(map(len, keys), default=0)
        self.places = max(1, self.size + self.size // 4)
        lengths = np.array([len(k) for k in keys], np.int64)
        data = np.frombuffer(b"".join(keys) + b"\0", np.uint8)
        h = hash_bytes(data, np.cumsum(lengths) - lengths, lengths)
        if len(np.unique(h)) < len(h):
            raise ValueError("two entries have the same 64-bit hash")
        self.buckets = max(1, self.size // 4)
        self.seed = np.zeros(self.buckets, np.uint64)
        bucket = (_scramble(h, 0) % np.uint64(self.buckets)).astype(np.int64)
        key_in, counts = np.full(self.places, -1, np.int64), np.bincount(bucket, minlength=self.buckets)
        for n in np.unique(counts[counts > 0])[::-1]:
            open_keys, seed = np.flatnonzero(counts[bucket] == n), 0
            while len(open_keys):
                seed += 1
                at, order = self._place(h[open_keys], seed), np.arange(len(open_keys))
                claim = np.full(self.places, len(open_keys), np.int64)
                np.minimum.at(claim, at, order)
                lost = np.zeros(self.buckets, bool)
                lost[bucket[open_keys[(key_in[at] >= 0) | (claim[at] != order)]]] = True
                won = ~lost[bucket[open_keys]]
                key_in[at[won]] = open_keys[won]
                self.seed[bucket[open_keys[won]]] = seed
                open_keys = open_keys[~won]
        taken = key_in >= 0
        self.slot = np.maximum(np.cumsum(taken) - 1, 0)
        self.keys_at = key_in[taken]                         # slot -> key

    def _place(self, h: np.ndarray, seed) -> np.ndarray:
        return (_scramble(h, seed) % np.uint64(self.places)).astype(np.int64)

    def lookup(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The one slot where each string is if it is a key at all; the caller compares."""
        h = hash_bytes(data, starts, lengths)
        return self.slot[self._place(h, self.seed[(_scramble(h, 0) % np.uint64(self.buckets)).astype(np.int64)])]


class Vocabulary:
    """Entries in the order of their slots, with their ids; what a task needs to encode and decode."""

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        at = self.hash.keys_at
        self.entries = pa.array([keys[i] for i in at], pa.large_binary())
        self.ids = np.array([ranks[keys[i]] for i in at], np.int64)
        by_id = np.argsort(self.ids)
        self.sorted_ids, self.entries_by_id = self.ids[by_id], self.entries.take(pa.array(by_id))

    def ranks(self) -> dict[bytes, int]:
        return dict(zip(self.entries.to_pylist(), self.ids.tolist()))

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, found) of binary ``words``."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)
        offsets = offsets[words.offset:words.offset + n + 1].astype(np.int64)
        lengths = np.diff(offsets)
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        maybe = np.flatnonzero((lengths <= self.hash.longest) & (lengths > 0))
        slots = self.hash.lookup(data, offsets[:-1][maybe], lengths[maybe])
        same = pc.equal(self.entries.take(pa.array(slots)), words.take(pa.array(maybe)).cast(pa.large_binary()))
        hit = same.to_numpy(zero_copy_only=False)
        ids, found = np.zeros(n, np.int64), np.zeros(n, bool)
        ids[maybe[hit]], found[maybe[hit]] = self.ids[slots[hit]], True
        return ids, found

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes that ``ids`` stand for; an id that is no entry's raises."""
        at = np.minimum(np.searchsorted(self.sorted_ids, ids), len(self.sorted_ids) - 1)
        if (self.sorted_ids[at] != ids).any():
            raise ValueError(f"id {int(ids[self.sorted_ids[at] != ids][0])} is not in the vocabulary")
        got = self.entries_by_id.take(pa.array(at))
        return (got.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[:int(pc.sum(pc.binary_length(got)).as_py() or 0)]


# Second tier: heap over linked bytes
def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word that is no entry: pairs merge by rank, leftmost first."""
    n, get = len(word), ranks.get
    end = list(range(1, n + 1))              # where the part that begins at i ends and the next one begins
    before = list(range(-1, n))              # where the part before the one at i begins
    pair = [get(word[i:i + 2], -1) for i in range(n - 1)] + [-1]     # rank of the part at i with the next one
    wide = n.bit_length()
    mask = (1 << wide) - 1
    heap = [r << wide | i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        i = top & mask
        if pair[i] != top >> wide:
            continue                         # a part of this pair has been merged since
        m = end[i]
        e = end[i] = end[m]
        before[e] = i
        pair[m] = -1
        pair[i] = r = get(word[i:end[e]], -1) if e < n else -1
        if r >= 0:
            heapq.heappush(heap, r << wide | i)
        if i:
            b = before[i]
            pair[b] = r = get(word[b:e], -1)
            if r >= 0:
                heapq.heappush(heap, r << wide | b)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class Merged(dict):
    """word -> number of its result; the results of all words lie one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.ids, self.ends = ranks, array("i"), array("q", [0])

    def __missing__(self, word: bytes) -> int:
        self.ids.extend(merge(word, self.ranks))
        self.ends.append(len(self.ids))
        self[word] = k = len(self.ends) - 2
        return k


# Pre-tokens
LETTER, DIGIT, SPACE, OTHER, END = range(5)


def character_classes() -> np.ndarray:
    """Class of every code point, and of the end mark that follows each text."""
    import regex

    table = np.full(0x110001, OTHER, np.uint8)
    table[0x110000] = END
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]):ord(m[0][-1]) + 1] = kind      # a run never spans the gap of the surrogates
    return table


def split_points(texts: list[str], classes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes of all texts, byte offsets where pre-tokens begin and the end, how many begin before each text's end).

    The rule of the common pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
    ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` on arrays: runs of a class,
    where the last white space before a run stands alone or, if it is a
    blank, joins it, and where a lone apostrophe takes the letters of a
    contraction.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1                                    # places of the end marks
    points = np.full(int(lengths.sum()) + len(texts), 0x110000, np.uint32)
    real = np.ones(len(points), bool)
    real[ends] = False
    points[real] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    kind = classes[points]
    begins = np.ones(len(points), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= kind == END
    # White space before a run: its last character begins a pre-token of its own ...
    last = np.zeros(len(points), bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END)
    begins |= last
    # ... which a blank shares with the run that follows.
    joined = np.flatnonzero(last & (points == 0x20)) + 1
    begins[joined] = False
    # Contractions: an apostrophe that is a run of one and begins a pre-token.
    at = np.flatnonzero((points == 0x27) & begins)
    at = at[(kind[np.minimum(at + 1, len(points) - 1)] == LETTER)]
    if len(at):
        c1 = points[at + 1]
        c2 = points[np.minimum(at + 2, len(points) - 1)]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        took = at[one | two]
        after = took + 2 + two[one | two]
        begins[took + 1] = False
        begins[after[kind[after] == LETTER]] = True
    size = real.astype(np.int64)
    for above in (0x7F, 0x7FF, 0xFFFF):
        size += real & (points > above)
    offset = np.cumsum(size) - size
    begins &= real
    starts = np.append(offset[begins], size.sum())
    return "".join(texts).encode(), starts, np.cumsum(begins)[ends]


def split_by_pattern(texts: list[str], pattern) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The same for any pattern whose matches cover the text, by the regex library."""
    words, until = [], []
    for t in texts:
        found = [m.group().encode() for m in pattern.finditer(t)]
        words += found
        until.append(len(words))
    lengths = np.array([len(w) for w in words], np.int64)
    return b"".join(words), np.append(0, np.cumsum(lengths)), np.array(until, np.int64)


class Encoder:
    """Texts to ids in one task: both tiers, with second-tier results remembered up to a bound."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray | None, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.classes, self.remembered = vocabulary, classes, remembered
        self.ranks = vocabulary.ranks()
        self.merged = Merged(self.ranks)
        if classes is None:
            import regex

            self.pattern = regex.compile(pattern)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids up to each text's end)."""
        if self.classes is not None:
            data, starts, until = split_points(texts, self.classes)
        else:
            data, starts, until = split_by_pattern(texts, self.pattern)
        n = len(starts) - 1
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)])
        distinct = words.dictionary_encode()
        ids, found = self.vocabulary.find(distinct.dictionary)
        counts = np.ones(len(ids), np.int64)
        missed = np.flatnonzero(~found)
        if len(self.merged) > self.remembered:
            self.merged = Merged(self.ranks)
        words = distinct.dictionary.take(pa.array(missed)).to_pylist()
        result = np.fromiter(map(self.merged.__getitem__, words), np.int64, len(words))
        ends = np.frombuffer(self.merged.ends, np.int64).copy()
        counts[missed] = ends[result + 1] - ends[result]
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        flat[first[found]] = ids[found]
        if len(missed):
            each = counts[missed]
            inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            flat[np.repeat(first[missed], each) + inside] = np.array(self.merged.ids, np.int64)[np.repeat(ends[result], each) + inside]
        which = distinct.indices.to_numpy()
        each = counts[which]
        upto = np.cumsum(each)
        out = flat[np.repeat(first[which] - (upto - each), each) + np.arange(int(each.sum()))]
        return out, np.append(0, upto)[until]


def _batches_of_texts(column: pa.Array, at_once: int):
    """(first row, texts) of bounded size; a text of more than that is alone."""
    first, texts, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if texts and size + len(t) > at_once:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def _common_pattern(pattern: str) -> bool:
    return pattern == r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _schema(fields, *added: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + list(added))


def encode(docs: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None,
           keep_text: bool = True, batch_chars: int = BATCH_CHARS, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` + ``n_tokens`` long and ``ids`` binary, little-endian unsigned 32-bit numbers, of whole texts.

    Without ``keep_text`` the text itself is left out.

    Every match of ``pattern`` is encoded by itself; special tokens are
    ordinary text.  A null text is an empty one (no ids).  Every row is kept,
    repeated rows too; columns named ``n_tokens`` or ``ids`` are replaced, all
    others stay.  An empty table gives an empty result.
    """
    pattern = pattern or default_pattern()
    sc = docs.sparkSession.sparkContext
    classes = character_classes() if _common_pattern(pattern) else None
    shared = sc.broadcast((Vocabulary(load_ranks(ranks_path or default_ranks())), classes))
    docs = replace_columns(docs, ["n_tokens", "ids"])
    column = [n.lower() for n in docs.columns].index(text.lower())
    kept = [i for i in range(len(docs.columns)) if keep_text or i != column]
    names = [docs.columns[i] for i in kept]
    schema = _schema([docs.schema[i] for i in kept], "n_tokens long", "ids binary")

    def run(batches):
        encoder = Encoder(*shared.value, pattern, remembered)
        for b in batches:
            for first, texts in _batches_of_texts(b.column(column), batch_chars):
                ids, until = encoder.encode(texts)
                until = np.append(0, until)
                raw = pa.Array.from_buffers(pa.large_binary(), len(texts), [
                    None, pa.py_buffer(until * 4), pa.py_buffer(ids.astype("<u4"))])
                rows = b.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in kept), pa.array(np.diff(until)), raw.cast(pa.binary())],
                                                 [*names, "n_tokens", "ids"])

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", ranks_path: str | None = None) -> DataFrame:
    """``df`` + ``decoded`` binary: the bytes that the ids stand for (null: no bytes).

    An id that is not in the vocabulary, or bytes that are no whole ids, fail the job.
    """
    sc = df.sparkSession.sparkContext
    shared = sc.broadcast(Vocabulary(load_ranks(ranks_path or default_ranks())))
    df = replace_columns(df, ["decoded"])
    schema, names = _schema(df.schema, "decoded binary"), df.columns
    column = [n.lower() for n in names].index(ids.lower())

    def run(batches):
        vocabulary = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                out = [vocabulary.bytes_of(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else b"" for x in rows.column(column)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*names, "decoded"])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """+ ``ids_sha256`` and ``decoded_sha256``: lower-case hex."""
    return df.withColumns({"ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2(decoded, 256)})
