"""Language-model scores from a hashed maximum-entropy model whose features grow with the corpus.

The probability of a token is that of its class given the last two words, times that of the word given its
class and the last two words. Classes: CLASSES bins of the frequent words (the head), by the square root of
their counts, and one for all other words. Features, all of them seen in training texts:

- class: a bias, the class of the last word, the word before the last (the skip feature, a hashed table of
  SKIP_ROWS rows), the last word, and the last two words;
- word inside its class: its unigram share, the last word, and the last two words. Here the softmax is
  sparse: a class's normaliser is 1 plus what the seen words add to their shares, so it is exact although no
  row is as wide as the vocabulary. Words outside the head are known by a 32-bit hash.

Word counts are exact. Texts are encoded once and stored as chunks of ids, about CHUNK_TOKENS each. The skip
rows and those of the last word's class are common to all: in each of ``rounds`` rounds every chunk sends
their gradient, which is summed as a tree by blocks of rows. Then events (word before the last, last word, word, document) go to the bucket of
their last word, packed by chunk. The number of buckets follows the number of training tokens, never the
cluster. A bucket owns the features of its words, fits them by preconditioned gradient steps and scores its
events in the same pass, so these features are as many as the corpus asks and are never broadcast. A last
word with many events is dealt to several buckets by the word before it, and pairs of two such words by
chunk as well. Larger CHUNK_TOKENS and BUCKET_TOKENS make fewer and longer packets, for more memory a task.

Defined cases: a null text counts as empty and is scored as its end; without training texts every token
is of one unknown kind and scores 0; repeated rows and null ids are scored row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoreel.llm.common import fold, stored, text_or_empty

END = b"\n"  # no word holds white space
FOLDS, HELD = 5, 1
HEAD = 100_000  # words that workers know by heart, of at most HEAD_BYTES bytes; others go by their hash
HEAD_BYTES = 64
CLASSES = 64
WIDTH = CLASSES + 1
SKIP_ROWS, SKIP_DIRECT = 8192, 7168
BLOCK = 512
ROWS = SKIP_ROWS + BLOCK  # the last block has a row for each class of the last word, and one for the start
ROUNDS = 2
BUCKET_TOKENS = 1_000_000
CHUNK_TOKENS, CHUNK_DOCS = 2_000_000, 1 << 16
SLICE = 1 << 17  # events that are hashed at once
CONTEXTS = 4096  # contexts whose class probabilities are held at once
FAN_IN = 64  # gradients that are summed in one group
RIDGE = {"last": 2.0, "both": 0.2, "word": 0.3, "word_both": 0.1, "common": 20.0}
PLAN = "lbb"  # how a bucket fits its class features; see Bucket.classes
LOW = -30.0
START = np.uint32(0xFFFFFFFF)

#: A row for each text, or a row for each chunk (n tokens, as ids; of its texts the size, whether it is held out, and a hash of the id).
PARTS = "doc_id long, held_out boolean, chunk long, place int, n_tokens long, n_known long, base double, tail array<struct<word: binary, n: long>>, n long, texts long, sizes binary, ids binary, salts binary"
EVENTS = "bucket int, chunk long, n long, events binary"


def tokens(text: bytes) -> list[bytes]:
    """Words of UTF-8 text (ASCII lower-casing, ASCII white space), then the end."""
    return [*text.lower().split(), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``texts`` (text binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: Counter[bytes] = Counter()
        for batch in batches:
            for x in batch.column(0):
                seen.update(tokens(x.as_py()))
                if len(seen) > 200_000:
                    yield out()
                    seen.clear()
        yield out()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


@dataclass
class Head:
    """The frequent words, most frequent first but for the end, with their counts, and the corpus totals."""

    ids: dict[bytes, int]
    counts: np.ndarray
    total: int
    kinds: int

    def __post_init__(self) -> None:
        n = len(self.counts)
        weight = np.cumsum(np.sqrt(self.counts))
        #: Class of each word of the head; the last entry is that of all others.
        self.cls = np.append(np.minimum((weight - np.sqrt(self.counts)) / max(weight[-1], 1) * CLASSES, CLASSES - 1).astype(np.int64) if n else [], CLASSES).astype(np.int64)
        mass = np.bincount(self.cls[:n], self.counts + 0.5, WIDTH).astype(np.float64)
        mass[CLASSES] = self.total - self.counts.sum() + 0.5 * (self.kinds - n) + 0.5
        with np.errstate(divide="ignore"):
            self.bias = np.maximum(np.log(mass / mass.sum()), LOW).astype(np.float32)
        #: Share of each word in its class; any other word is one of their number, or the unknown kind.
        self.share = np.append((self.counts + 0.5) / mass[self.cls[:n]], 1 / (self.kinds - n + 1))

    def plain(self) -> tuple:
        """The same without this class, which workers may not be able to import."""
        return self.ids, self.counts, self.total, self.kinds

    @property
    def buckets(self) -> int:
        return max(1, -(-self.total // BUCKET_TOKENS))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Ids of all tokens, each text's number of tokens, and each text's words outside the head."""
        flat: list[bytes] = []
        sizes = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(flat)
            flat += tokens(text)
            sizes[i] = len(flat) - before
        found = np.fromiter(map(self.ids.get, flat, repeat(-1)), np.int64, len(flat))
        ids = found.astype(np.uint32)
        outside = np.flatnonzero(found < 0)
        words = [flat[i] for i in outside.tolist()]
        n = len(self.counts)
        hashes = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))
        ids[outside] = (n + hashes % np.uint64(0xFFFFFFFF - n)).astype(np.uint32)
        ends = np.searchsorted(outside, np.cumsum(sizes))
        return ids, sizes, [words[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def bucket_of(self, w1: np.ndarray, w2: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
        """The bucket of each event. Words of more than a quarter of a bucket are dealt out by the word before, pairs of such words by ``salt``, a number of their text."""
        n = len(self.counts)
        parts = np.maximum(1, -(-4 * np.append(self.counts, 0) // BUCKET_TOKENS)).astype(np.uint64)
        parts = np.append(parts, parts[0])  # as many starts as ends
        out, salts = np.empty(len(w1), np.uint32), np.broadcast_to(np.asarray(salt, np.uint64), len(w1))
        for at in range(0, len(w1), SLICE):
            here = slice(at, at + SLICE)
            k1, k2 = (parts[np.where(w[here] == START, n + 1, np.minimum(w[here], n))] for w in (w1, w2))
            both = np.minimum(k1, k2)
            own = np.where(both > 1, _mixed(salts[here].copy()) % both, np.uint64(0))
            sub = _mixed(w2[here].astype(np.uint64) + (own << np.uint64(32))) % k1
            out[here] = _mixed(w1[here].astype(np.uint64) + (sub << np.uint64(32))) % np.uint64(self.buckets)
        return out


def skip_rows(w2: np.ndarray) -> np.ndarray:
    """The row of each word before the last."""
    hashed = SKIP_DIRECT + _mixed(w2.astype(np.uint64)) % np.uint64(SKIP_ROWS - SKIP_DIRECT)
    return np.where(w2 < SKIP_DIRECT, w2, hashed).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte by byte, compressed."""
    planes = np.ascontiguousarray(np.stack(columns).astype("<u4")).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1)
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def _unpacked(payload: bytes, n: int, columns: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(payload, 4 * n * columns, asbytes=True), np.uint8).reshape(columns, 4, n)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, n)


def _fields(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    names = [x.split(maxsplit=1) for x in schema.replace("<struct<word: binary, n: long>>", "").split(", ")]
    return pa.schema([pa.field(name, kinds.get(kind, tail)) for name, kind in names])


def _rows(schema: str, size: int, **columns) -> pa.RecordBatch:
    """A batch of ``schema`` in which the columns that are not given are null."""
    kinds = _fields(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)


def encoded(rows: DataFrame, known) -> DataFrame:
    """PARTS of ``rows`` (doc_id, held_out, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(*known.value)
        base = np.log10(np.append(head.counts + 0.5, 1.0))  # words outside the head are added by the join
        floor = np.log10(head.total + 0.5 * (head.kinds + 1))
        chunk, held, n, texts = TaskContext.get().partitionId() << 32, [], 0, 0

        def whole() -> pa.RecordBatch:
            ids, sizes, salts = (np.concatenate(x) for x in zip(*held, strict=True))
            return _rows(PARTS, 1, chunk=[chunk], n=[len(ids)], texts=[len(sizes)], sizes=[_packed(sizes)], ids=[_packed(ids)], salts=[_packed(salts)])

        for arrow in batches:
            at, lengths = 0, pc.binary_length(arrow.column(2)).to_pylist()
            while at < arrow.num_rows:
                end, size = at, 0
                while end < arrow.num_rows and end - at < 256 and (end == at or size < 1 << 20):
                    size += lengths[end]
                    end += 1
                part = arrow.slice(at, end - at)
                at = end
                if n >= CHUNK_TOKENS or texts + part.num_rows > CHUNK_DOCS:
                    yield whole()
                    chunk, held, n, texts = chunk + 1, [], 0, 0
                ids, sizes, tails = head.encode(part.column(2).to_pylist())
                starts = np.cumsum(sizes) - sizes
                inside = np.minimum(ids, len(head.counts))
                found = [Counter(t) for t in tails]
                words = pa.array([k for t in found for k in t], pa.binary())
                times = pa.array([c for t in found for c in t.values()], pa.int64())
                ends = np.r_[0, np.cumsum([len(t) for t in found])].astype(np.int32)
                yield _rows(
                    PARTS,
                    part.num_rows,
                    doc_id=part.column(0),
                    held_out=part.column(1),
                    chunk=np.full(part.num_rows, chunk),
                    place=np.arange(texts, texts + part.num_rows),
                    n_tokens=sizes,
                    n_known=np.add.reduceat((inside < len(head.counts)).astype(np.int64), starts),
                    base=np.add.reduceat(base[inside], starts) - floor * sizes,
                    tail=pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([words, times], ["word", "n"])),
                )
                flags = part.column(1).to_numpy(zero_copy_only=False)
                # How pairs are dealt must not depend on where texts happen to be read, so it follows their ids; without one, the text.
                salts = [xxhash.xxh32_intdigest(t if i is None else b"%d" % i) for i, t in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)]
                held.append((ids, sizes.astype(np.uint32) | flags.astype(np.uint32) << np.uint32(31), np.array(salts, np.uint32)))
                n += len(ids)
                texts += part.num_rows
        if held:
            yield whole()

    return rows.mapInArrow(run, PARTS)


def _events(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, last word, word before it, and text (with its held-out bit) of each token of a chunk."""
    x, sizes = _unpacked(row["ids"], row["n"], 1)[0], _unpacked(row["sizes"], row["texts"], 1)[0]
    text = np.arange(len(sizes), dtype=np.uint32) | sizes & np.uint32(1 << 31)
    sizes = (sizes & np.uint32((1 << 31) - 1)).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    w1, w2 = np.r_[START, x[:-1]], np.r_[START, START, x[:-2]][: len(x)]
    w1[first] = w2[first] = START
    w2[first[sizes > 1] + 1] = START
    return x, w1, w2, np.repeat(text, sizes)


def dealt(chunks: DataFrame, known) -> DataFrame:
    """EVENTS: for each chunk and bucket, the events packed by last word and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = Head(*known.value)
        for batch in batches:
            for row in _each(batch):
                x, w1, w2, text = _events(row)
                bucket = head.bucket_of(w1, w2, _unpacked(row["salts"], row["texts"], 1)[0][text & np.uint32((1 << 31) - 1)])
                order = np.lexsort((w1, bucket)) if head.buckets > 1 << 16 else np.argsort(bucket.astype(np.uint64) << np.uint64(48) | w1.astype(np.uint64) << np.uint64(16) | text & np.uint32(0xFFFF))
                x, w1, w2, text, bucket = x[order], w1[order], w2[order], text[order], bucket[order]
                del order
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                ends = np.r_[cuts[1:], len(bucket)]
                packets = []
                for a, b in zip(cuts, ends, strict=True):
                    columns = np.stack([x[a:b], w1[a:b], w2[a:b], text[a:b]])
                    columns[1, 1:] -= columns[1, :-1].copy()  # differences are small, and wrap around
                    columns[3, 1:] -= columns[3, :-1].copy()
                    packets.append(_packed(*columns))
                yield _rows(EVENTS, len(cuts), bucket=bucket[cuts], chunk=np.full(len(cuts), row["chunk"]), n=ends - cuts, events=packets)

    return chunks.mapInArrow(run, EVENTS)


def in_order(x: np.ndarray, w1: np.ndarray, w2: np.ndarray, head: int) -> np.ndarray:
    """The order by last word, word before it, word."""
    ids = [w1, w2, x]
    low = [np.minimum(i, head) for i in ids]
    kinds = np.unique(np.concatenate([i[i >= head] for i in ids]))
    if head + len(kinds) >= 1 << 21:
        return np.lexsort((x, w2, w1))
    for i, r in zip(ids, low, strict=True):
        far = i >= head
        r[far] = head + np.searchsorted(kinds, i[far])
    a, b, c = (r.astype(np.uint64) for r in low)
    return np.argsort(a << np.uint64(42) | b << np.uint64(21) | c)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0) if len(starts) else x[:0]


def sparse_softmax(base: np.ndarray, n: np.ndarray, starts: np.ndarray, ridge: float, steps: int = 8) -> np.ndarray:
    """Log probabilities inside each segment, p = base * exp(w) / z, with a weight for each entry of n > 0.

    ``base`` sums to at most 1 in a segment; what is missing stands for entries that are not listed, which
    have no weight. Steps descend along the gradient of the log-likelihood with a quadratic penalty, divided
    by a bound of its curvature.
    """
    segment = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(np.r_[starts, len(base)]))
    log_z = np.zeros(len(starts), np.float32)
    seen = np.flatnonzero(n > 0).astype(np.int32)
    weight = np.zeros(len(base), np.float32)
    if len(seen):
        q, k, own = base[seen], n[seen], segment[seen]
        begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        inner = np.cumsum(np.r_[True, own[1:] != own[:-1]], dtype=np.int32) - 1
        total = _sums(k, begin)[inner]
        own = own[begin]
        w = np.clip(np.log(k / (total + 1) / q), 0, k / ridge)
        for step in range(steps + 1):
            v = q * np.exp(w)
            z = np.maximum(1 + _sums(v - q, begin), 1e-12)
            if step == steps:
                break
            v *= total / z[inner]
            w -= np.clip((v - k + ridge * w) / (v + ridge), -2, 2)
        weight[seen] = w
        log_z[own] = np.log(z)
    return np.log(base) + weight - log_z[segment]


def class_rows(head: Head, w1: np.ndarray) -> np.ndarray:
    """The row of each last word's class."""
    return SKIP_ROWS + np.where(w1 == START, WIDTH, head.cls[np.minimum(w1, len(head.counts))])


class Bucket:
    """The events of one bucket, in order, and the features it owns."""

    def __init__(self, head: Head, x: np.ndarray, w1: np.ndarray, w2: np.ndarray, train: np.ndarray):
        self.head, self.x = head, x
        self.cls = head.cls.astype(np.int16)[np.minimum(x, len(head.counts))]
        new1 = np.r_[True, w1[1:] != w1[:-1]]
        new2 = new1 | np.r_[True, w2[1:] != w2[:-1]]
        self.new_pair = new2 | np.r_[True, self.cls[1:] != self.cls[:-1]]  # a class after two words
        self.new_word = new2 | np.r_[True, x[1:] != x[:-1]]  # a word after two words
        self.last = np.cumsum(new1, dtype=np.int32) - 1
        self.train = train.astype(np.float32)
        first = np.flatnonzero(new2)
        self.n = _sums(self.train, first)
        self.owner = self.last[first]
        self.skip = skip_rows(w2[first]).astype(np.int32)
        self.class_row = class_rows(head, w1[new1])
        pairs = np.flatnonzero(self.new_pair)
        self.pair_n = _sums(self.train, pairs)
        self.pair_of = (np.cumsum(new2, dtype=np.int32) - 1)[pairs]
        self.pair_cls = self.cls[pairs]

    def _groups(self) -> Iterator[tuple[int, int]]:
        """Contexts of whole last words, CONTEXTS of them or one word's."""
        begins = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]])
        cuts = begins[np.r_[True, begins[1:] // CONTEXTS != begins[:-1] // CONTEXTS]]
        yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.owner)], strict=True)

    def classes(self, table: np.ndarray, plan: str) -> np.ndarray:
        """Log probability of each (context, class) that occurs.

        ``table``: the common rows. ``plan``: what is fitted in turn, "l" the rows of last words, "b" the
        weights of two words and a class.
        """
        out = np.zeros(len(self.pair_n), np.float32)
        for begin, end in self._groups():
            low = self.owner[begin]
            owners = int(self.owner[end - 1] - low) + 1
            a, b = np.searchsorted(self.pair_of, [begin, end])
            pair_of, pair_cls, pair_n = self.pair_of[a:b], self.pair_cls[a:b], self.pair_n[a:b]
            flat = (self.owner[pair_of] - low) * WIDTH + pair_cls
            wanted = np.bincount(flat, pair_n, owners * WIDTH).reshape(owners, WIDTH).astype(np.float32)
            seen = np.maximum(wanted.sum(axis=1, keepdims=True), 1)
            prior = table[self.class_row[low : low + owners]] + self.head.bias
            last, both = prior.copy(), np.zeros(b - a, np.float32)
            for step in plan + ".":
                expected = np.zeros((owners, WIDTH), np.float32)
                for at in range(begin, end, CONTEXTS):
                    until = min(end, at + CONTEXTS)
                    i, j = np.searchsorted(pair_of, [at, until])
                    own = self.owner[at:until] - low
                    z = table[self.skip[at:until]]
                    z += last[own]
                    where = (pair_of[i:j] - at, pair_cls[i:j])
                    z[where] += both[i:j]
                    z -= z.max(axis=1, keepdims=True)
                    chosen = z[where]
                    p = np.exp(z, out=z)
                    total = p.sum(axis=1)
                    if step == "l":
                        p *= (self.n[at:until] / total)[:, None]
                        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                        expected[own[heads]] += _sums(p, heads)
                    elif step == "b":
                        got, hit, m = p[where] / total[where[0]], pair_n[i:j], self.n[at:until][where[0]]
                        move = (m * got - hit + RIDGE["both"] * both[i:j]) / (m * got * (1 - got) + RIDGE["both"])
                        both[i:j] -= np.where(hit > 0, np.clip(move, -3, 3), 0)
                    else:
                        out[a + i : a + j] = chosen - np.log(total[where[0]])
                if step == "l":
                    move = (expected - wanted + RIDGE["last"] * (last - prior)) / (expected * (1 - expected / seen) + RIDGE["last"])
                    last -= np.clip(move, -3, 3)
        return out

    def words(self) -> np.ndarray:
        """Log probability of each (context, word) that occurs, given its class."""
        at = np.flatnonzero(self.new_word)
        n = _sums(self.train, at)
        keys, back = np.unique(self.last[at].astype(np.uint64) << np.uint64(32) | self.x[at], return_inverse=True)
        back, part = back.astype(np.int32), self.new_pair[at]
        del at
        inside = np.minimum(keys & np.uint64(0xFFFFFFFF), np.uint64(len(self.head.counts))).astype(np.int32)
        keys = (keys >> np.uint64(32)) * np.uint64(WIDTH) + self.head.cls[inside].astype(np.uint64)
        starts, share = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), self.head.share.astype(np.float32)[inside]
        del keys, inside
        after_last = sparse_softmax(share, np.bincount(back, n).astype(np.float32), starts, RIDGE["word"])
        return sparse_softmax(np.exp(after_last)[back], n, np.flatnonzero(part), RIDGE["word_both"])

    def log_probabilities(self, table: np.ndarray, plan: str = PLAN) -> np.ndarray:
        """Natural logarithm of each event's probability."""
        return self.classes(table, plan)[np.cumsum(self.new_pair) - 1] + self.words()[np.cumsum(self.new_word) - 1]


def common_gradient(head: Head, table: np.ndarray, x: np.ndarray, w1: np.ndarray, w2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the common rows: expected minus actual classes over training events, and how often each row occurs."""
    key = np.empty(len(x), np.int64)
    for at in range(0, len(x), SLICE):
        here = slice(at, at + SLICE)
        key[here] = (skip_rows(w2[here]) * BLOCK + class_rows(head, w1[here]) - SKIP_ROWS) * WIDTH + head.cls[np.minimum(x[here], len(head.counts))]
    key, times = np.unique(key, return_counts=True)
    context, cls = np.divmod(key, WIDTH)
    new = np.r_[True, context[1:] != context[:-1]]
    of, first = np.cumsum(new) - 1, np.flatnonzero(new)
    skip, last = np.divmod(context[first], BLOCK)
    n = _sums(times.astype(np.float32), first)
    gradient = np.zeros((ROWS, WIDTH), np.float32)
    for at in range(0, len(first), CONTEXTS):
        part = slice(at, at + CONTEXTS)
        i, j = np.searchsorted(of, [at, at + CONTEXTS])
        z = table[skip[part]]
        z += (table[SKIP_ROWS:] + head.bias)[last[part]]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z, out=z)
        p *= (n[part] / p.sum(axis=1))[:, None]
        p[of[i:j] - at, cls[i:j]] -= times[i:j]
        for rows in (skip[part], SKIP_ROWS + last[part]):
            order = np.argsort(rows, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
            gradient[rows[order][heads]] += _sums(p[order], heads)
    return gradient, np.bincount(np.r_[skip, SKIP_ROWS + last], np.r_[n, n], ROWS).astype(np.float32)


def _stepped(table: np.ndarray, bias: np.ndarray, gradient: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The common rows after one step along the summed gradient, divided by an estimate of its curvature."""
    p = np.exp(bias)
    # Two rows meet in each event; half a step of each keeps their sum from going too far.
    move = (gradient + RIDGE["common"] * table) / (2 * n[:, None] * p * (1 - p) + RIDGE["common"])
    return table - np.clip(move, -1, 1).astype(np.float32)


def train(chunks: DataFrame, head: Head, known, rounds: int = ROUNDS) -> np.ndarray:
    """The common rows after ``rounds`` steps, each along the gradient over all chunks."""
    spark = chunks.sparkSession
    table = np.zeros((ROWS, WIDTH), np.float32)
    schema = "shard long, block int, n binary, gradient binary"
    shards = chunks.count()
    for _ in range(rounds):
        common = spark.sparkContext.broadcast(table)

        def work(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            own = Head(*known.value)
            for batch in batches:
                for row in _each(batch):
                    x, w1, w2, text = _events(row)
                    mine = np.flatnonzero(text >> np.uint32(31) == 0)
                    if not len(mine):
                        continue
                    g, n = common_gradient(own, common.value, x[mine], w1[mine], w2[mine])
                    blocks = [b for b in range(ROWS // BLOCK) if n[b * BLOCK : (b + 1) * BLOCK].any()]
                    mean = (g / np.maximum(n, 1)[:, None]).astype(np.float16).reshape(-1, BLOCK, WIDTH)
                    times = n.reshape(-1, BLOCK)
                    yield _rows(schema, len(blocks), shard=[row["chunk"]] * len(blocks), block=blocks, n=[times[b].tobytes() for b in blocks], gradient=[mean[b].tobytes() for b in blocks])

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total, times = np.zeros((BLOCK, WIDTH)), np.zeros(BLOCK)
            for n, gradient in zip(pdf["n"], pdf["gradient"], strict=True):
                n = np.frombuffer(n, np.float32).astype(np.float64)
                total += n[:, None] * np.frombuffer(gradient, np.float16).reshape(BLOCK, WIDTH)
                times += n
            mean = total / np.maximum(times, 1)[:, None]
            return pd.DataFrame({"shard": [key[1]], "block": [key[0]], "n": [times.astype(np.float32).tobytes()], "gradient": [mean.astype(np.float16).tobytes()]})

        sent, left = chunks.mapInArrow(work, schema), shards
        while left > 1:  # at most about FAN_IN shards meet in a group, whatever the corpus
            left = -(-left // FAN_IN)
            sent = sent.groupBy("block", F.pmod(F.xxhash64("shard"), F.lit(left)).alias("shard")).applyInPandas(merge, schema)
        gradient, n = np.zeros_like(table), np.zeros(ROWS, np.float32)
        for r in sent.collect():  # all blocks together are the size of the table
            part = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            n[part] = np.frombuffer(r["n"], np.float32)
            gradient[part] = n[part][:, None] * np.frombuffer(r["gradient"], np.float16).reshape(BLOCK, WIDTH)
        table = _stepped(table, head.bias, gradient, n)
        common.unpersist()
    return table


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def scored(events: DataFrame, known, table: np.ndarray, buckets: int) -> DataFrame:
    """(chunk, place, model): the log10 probability of each text."""
    common = events.sparkSession.sparkContext.broadcast(table)
    schema = "chunk long, places binary, sums binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Head(*known.value)
        for _, packets in groupby((row for batch in batches for row in _each(batch)), lambda row: row["bucket"]):
            chunks, parts = [], []
            for row in packets:
                columns = np.vstack([_unpacked(row["events"], row["n"], 4), np.full((1, row["n"]), len(chunks), np.uint32)])
                np.cumsum(columns[1], out=columns[1], dtype=np.uint32)
                np.cumsum(columns[3], out=columns[3], dtype=np.uint32)
                parts.append(columns)
                chunks.append(row["chunk"])
            x, w1, w2, text, number = np.concatenate(parts, axis=1)
            del parts
            order = in_order(x, w1, w2, len(own.counts))
            key = (number.astype(np.uint64) << np.uint64(32) | text)[order]
            x, w1, w2 = x[order], w1[order], w2[order]
            del order, text, number
            found = Bucket(own, x, w1, w2, key >> np.uint64(31) & np.uint64(1) == 0).log_probabilities(common.value)
            del x, w1, w2
            key &= ~np.uint64(1 << 31)
            order = np.argsort(key)
            key, found = key[order], found[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sums, key = (np.add.reduceat(found, first, dtype=np.float64) / np.log(10)).astype(np.float32), key[first]
            owner, place = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFF)).astype("<u2")
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            split = lambda v: [p.tobytes() for p in np.split(v, cuts[1:])]
            yield _rows(schema, len(cuts), chunk=[chunks[i] for i in owner[cuts]], places=split(place), sums=split(sums))

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        places, sums = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in (("places", "<u2"), ("sums", np.float32)))
        total = np.bincount(places, sums)
        here = np.unique(places)
        return pd.DataFrame({"chunk": key[0], "place": here.astype(np.int32), "model": total[here]})

    # A chunk has at most CHUNK_DOCS texts and about CHUNK_TOKENS tokens, which bounds its group.
    ordered = events.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return ordered.mapInArrow(work, schema).groupBy("chunk").applyInPandas(add, "chunk long, place int, model double")


def _head(counts: DataFrame, total: int, kinds: int) -> Head:
    """The end, then the words above the least frequency that at most HEAD words reach, most frequent first.

    Frequencies are compared by bins, 64 an octave, so the search for the least one collects a few thousand
    numbers, and each of the chosen words is sent once. A tie that would exceed HEAD stays outside whole.
    """
    bins = F.floor(F.log2("c") * 64)
    fits = counts.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(END)))
    least, size = float("inf"), 0
    for r in fits.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("b").desc()).collect():
        size += r["n"]
        if size >= HEAD:
            break
        least = r["b"]
    chosen = fits.where(bins >= F.lit(least)).unionAll(counts.where(F.col("word") == F.lit(END))).toArrow()
    words, c = chosen.column("word").to_pylist(), chosen.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (words[i] != END, -c[i], words[i]))
    return Head({words[i]: n for n, i in enumerate(order)}, c[order].astype(np.int64), total, kinds)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(id_col, FOLDS) == HELD).alias("held_out"), text_or_empty(text_col).cast("binary").alias("text"))
    counts = stored(word_counts(rows.where(~F.col("held_out")).select("text")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head = _head(counts, totals["n"], totals["v"])
    known = spark.sparkContext.broadcast(head.plain())
    parts = stored(encoded(rows, known), "lm-ids")
    texts = parts.where(F.col("ids").isNull()).select("doc_id", "held_out", "chunk", "place", "n_tokens", "n_known", "base", "tail")
    chunks = parts.where(F.col("ids").isNotNull()).select("chunk", "n", "texts", "sizes", "ids", "salts")
    if head.total:
        table = train(chunks, head, known, rounds)
        model = stored(scored(dealt(chunks, known), known, table, head.buckets), "lm-scores")
    else:
        model = texts.select("chunk", "place", F.lit(0.0).alias("model"))
    key = ["chunk", "place"]
    c = F.coalesce("c", F.lit(0))
    tail = texts.select(*key, F.inline("tail")).join(counts, "word", "left")
    found = tail.groupBy(*key).agg(F.sum(F.log10(c + 0.5) * F.col("n")).alias("gain"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"))
    return texts.drop("tail").join(model, key).join(found, key, "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        F.col("model").alias("score"),
    )
