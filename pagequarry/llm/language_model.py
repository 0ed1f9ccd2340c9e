"""Scoring by a probabilistic suffix tree over words.

Tokens are a text's words (A-Z in lower case) and one end. The root of the tree is the add-one unigram distribution over all
training tokens. Every context of one to ``depth`` words that training texts hold ``LEAST_COUNT`` times or more is a candidate,
and every word is a symbol. A candidate is retained as a state if its next-symbol distribution diverges from that of its
longest retained suffix: the log-likelihood ratio over all its continuations must reach ``LEAST_GAIN`` nats. A state's
distribution is its counts smoothed by ``SMOOTH`` counts of its suffix's distribution, so every state's probabilities sum to
one. A token is scored by the state of the longest suffix of the words before it.

The tree grows level by level and is never held in one place. Texts are tokenised once, into blocks of about ``BLOCK_TOKENS``
tokens (a text is never split) with a dictionary of their words. For each level a block asks, packed by bucket, for the
continuations of those of its contexts that are frequent enough; whatever isn't has no longer context either. Buckets of large levels
take turns, so that only a part of what is asked lies on disk at once, blocks go from level to level in lots, and shuffles go when their table
is written. A bucket adds up
what all blocks sent for a context, tests it, and answers every block with the counts and the verdicts. A block sends each
distinct continuation once with its count, so repeated passages cost one entry a block. A context of ``hot`` occurrences or more
is dealt out by continuation; its sums come together in an aggregation, and the verdicts of these contexts are broadcast (there
are at most 1 / ``HOT_SHARE`` of them, 16 bytes each). So no task reads more of a context than its share, and what is gathered
follows the input. Words and contexts are told by 64-bit hashes, continuations of a context by 40 bits of theirs.

Defined results: null and empty texts are one end token. Without training texts every token is unknown and has probability 1.
A row whose ``teaches`` is null teaches nothing. Rows that repeat an id, and equal texts, teach and are scored each by itself.
A text of any length is one piece of a block. Other columns pass through, whatever their names; the text doesn't, and columns
named like the made ones are replaced.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, fold, mix, nested, release, rows_of, shuffles_removed, unnested

#: Words of the longest context, and how often a context must be seen.
DEPTH = 5
LEAST_COUNT = 4
LEAST_GAIN = 25.0
SMOOTH = 5.0
#: Tokens that a map task holds at once, and asked continuations for which there is one bucket.
BLOCK_TOKENS = 2_000_000
BUCKET_ENTRIES = 1_500_000
#: Turns in which the buckets of a level are asked, so that only this share of what is asked lies on disk at once. A level that concerns
#: less than ``TURNS_FROM`` of the first one's tokens asks all buckets in one turn.
TURNS, TURNS_FROM = 3, 0.25
#: Lots of blocks, one table each: a level is written lot by lot, and the level before it goes likewise.
LOTS = 4
#: A context is hot from this count, and from this share of all training tokens.
HOT_LEAST, HOT_SHARE = 1_000_000, 1e-6
#: Values whose bytes are turned at once.
_PIECE = 8_192
_END = b"\n"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOLD = np.uint64(~0xFFFFFF & (1 << 64) - 1)

MADE = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])
#: What blocks and buckets send one another. A block's state has no bucket.
_MAIL = "block long, bucket long, payload binary, tokens long, kinds long"
_MAIL_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("payload", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in byte planes, compressed together."""
    return zstandard.compress(pickle.dumps([(a.dtype.str, _planes(a)) for a in map(np.ascontiguousarray, arrays)]), 1)


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes: the first of all values, the second of all, and so on. Turned in pieces that stay in the processor's cache."""
    if a.itemsize == 1 or not len(a):
        return a.tobytes()
    rows = a.view(np.uint8).reshape(len(a), -1)
    out = np.empty(rows.shape[::-1], np.uint8)
    for i in range(0, len(a), _PIECE):
        out[:, i : i + _PIECE] = rows[i : i + _PIECE].T
    return out.tobytes()


def _unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, planes in pickle.loads(zstandard.decompress(data)):
        bytes_of = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
        if kind == "<u4":  # shifts are quicker than a turn of so few bytes
            values = bytes_of[3].astype(np.uint32)
            for plane in bytes_of[2::-1]:
                values <<= np.uint32(8)
                values |= plane
            out.append(values)
        else:
            out.append(np.ascontiguousarray(bytes_of.T).view(kind).ravel())
    return out


def _small(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return n.astype(np.uint32 if not len(n) or n.max() < 1 << 32 else np.uint64)


def _mail(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bucket, payload, tokens, kinds) as small batches."""
    for i in range(0, len(rows), 64):
        columns = zip(zip(*rows[i : i + 64], strict=True), _MAIL_ARROW.types, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], schema=_MAIL_ARROW)


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Groups arrive whole and one after the other."""
    now, held = None, []
    for batch in batches:
        for row in rows_of(batch):
            if row[key] != now and held:
                yield held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield held


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of keys, by their 24 highest bits, which are what entries are sorted by."""
    return (keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


def _slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of keys whose 24 highest bits ascend."""
    bucket = _buckets(keys, buckets)
    cuts = [*np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))).tolist(), len(keys)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[i]), slice(i, j)


def _firsts(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def _total(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, its sum, which distinct key each entry has)"""
    order = np.argsort(keys)
    first = _firsts(keys[order])
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return order[first], np.bincount(which, n, len(first)).astype(np.int64) if len(keys) else n, which


# --- blocks ----------------------------------------------------------------------------------------------------------


class _Block:
    """A block's tokens and what is known of them: arrays over its tokens, one after the other, text after text.

    Up to level one all tokens are kept and the levels are gone up again from the counts that came; from level two on a block is
    narrowed to the tokens that longer contexts still concern, as they are, and sums over the others.
    """

    def __init__(self, payload: bytes, total: int, kinds: int):
        self.parts, self._asked = pickle.loads(payload), None
        arrays = [x for part in self.parts for x in _unpack(part)]
        self.narrow = len(arrays) == 12
        if self.narrow:
            own, ids, self.key, self.n, self.p, going, self.text, self.sizes, self.known, self.root, self.done, self.teaching = arrays
            self.h, self.n, self.p = own[ids], self.n.astype(np.int64), self.p.astype(np.float64)
            self.place = np.where(going, 1 << 30, 0)
        else:
            own, at, ranks, self.sizes, self.teaching, totals = arrays[:6]
            ids = at[ranks]
            self.h, self.count = own[ids], totals[ids].astype(np.int64)
            self.text = np.repeat(np.arange(len(self.sizes), dtype=np.uint32), self.sizes)
            self.place = np.arange(len(ids), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
            self.p = (self.count + 1.0) / (total + kinds + 1)
            self.size, self.done = total + kinds + 1, np.zeros(len(self.sizes))
            self.n, self.key = self.count, self.h
            for found, verdicts in zip(arrays[6::2], arrays[7::2], strict=True):
                self.step(found, np.unpackbits(verdicts, count=len(found)).astype(bool))

    def _by_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, values, len(self.sizes))

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """(known tokens, score of the root) of each text"""
        if self.narrow:
            return self.known, self.root
        return self._by_text((self.count > 0).astype(np.float64)).astype(np.int64), self._by_text(np.log10((self.count + 1.0) / self.size))

    def scores(self) -> np.ndarray:
        return self.done + self._by_text(np.log10(self.p))

    def narrowed(self) -> bytes:
        """The payload of a block of which only what concerns the next level is left."""
        at = self.candidates()
        going, before = np.zeros(len(self.h), bool), np.zeros(len(self.h), bool)
        going[at], before[at - 1] = True, True
        done = self.done + self._by_text(np.where(going, 0.0, np.log10(self.p)))
        kept = np.flatnonzero(going | before)
        own, ids = np.unique(self.h[kept], return_inverse=True)
        key, n = (np.where(before[kept], x[kept], x.dtype.type(0)) for x in (self.key, self.n))
        p = np.where(going[kept], self.p[kept], 1.0).astype(np.float32)
        return pickle.dumps([_pack(own, ids.astype(np.uint32), key, _small(n), p, going[kept], self.text[kept], self.sizes, *self.base(), done), _pack(self.teaching)])

    def step(self, found: np.ndarray, state: np.ndarray) -> None:
        """One level further: counts of the asked continuations, and whether their contexts are states."""
        at, n_context, gram, _ = self._asked or self.asked()
        n = found.astype(np.int64)
        self.p[at[state]] = (n[state] + SMOOTH * self.p[at[state]]) / (n_context[state] + SMOOTH)
        self.n, self.key = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), np.uint64)
        self.n[at], self.key[at] = n, gram
        self.place, self._asked = self.place - 1, None

    def candidates(self) -> np.ndarray:
        """Tokens whose context is a candidate of the next level."""
        if not len(self.n):
            return np.empty(0, np.int64)
        going = self.n[:-1] >= LEAST_COUNT
        going &= self.place[1:] >= 1
        return np.flatnonzero(going) + 1

    def asked(self) -> tuple[np.ndarray, ...]:
        """(candidates, counts of their contexts, keys of the continuations, keys of the contexts)"""
        at = self.candidates()
        context = self.key[at - 1]
        self._asked = at, self.n[at - 1], mix(context * _STEP + self.h[at]), context
        return self._asked

    def _asked_in(self, hot: int, buckets: int, turn: int, turns: int) -> tuple[np.ndarray, ...]:
        """``asked`` for the buckets of one turn; other candidates' continuations aren't hashed."""
        at = self.candidates()
        context, n_context = self.key[at - 1], self.n[at - 1]
        mine, is_hot = _buckets(context, buckets) % np.uint64(turns) == turn, n_context >= hot
        some = np.flatnonzero(mine | is_hot)
        at, context, n_context, is_hot = at[some], context[some], n_context[some], is_hot[some]
        gram = mix(context * _STEP + self.h[at])
        if is_hot.any():
            mine = _buckets(np.where(is_hot, gram, context), buckets) % np.uint64(turns) == turn
            at, context, n_context, gram = at[mine], context[mine], n_context[mine], gram[mine]
        return at, n_context, gram, context

    def entries(self, hot: int, buckets: int = 0, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, ...]:
        """(candidates, which of them in the order of sending, entry of each of these; by entry: a candidate, route, context, its count, key)

        With several ``turns``, only the candidates of the ``buckets`` whose turn it is, in the same order.
        """
        at, n_context, gram, context = self.asked() if turns == 1 else self._asked_in(hot, buckets, turn, turns)
        # one sort brings equal continuations together, by bucket and nearly by context; the places lie in the low bits, so that
        # the order is the same on any machine. A continuation between whose places another one falls is sent twice.
        bits = max(21, len(self.h).bit_length())
        is_hot = n_context >= hot
        route = np.where(is_hot, gram, context) if is_hot.any() else context
        low = np.uint64(64 - 24)
        keys = (route >> low << low) | (gram >> np.uint64(24 + bits) << np.uint64(bits)) | np.arange(len(at), dtype=np.uint64)
        keys.sort()
        order = (keys & np.uint64((1 << bits) - 1)).astype(np.uint32)
        new = np.ones(len(order), bool)
        ordered = gram[order]
        new[1:] = ordered[1:] != ordered[:-1]
        entry = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
        some = order[new]
        return at, order, entry, some, route[some], context[some], n_context[some], ordered[new]


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, each text's number of words): Arrow splits at the six bytes that ``words`` splits at."""
    lists = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0)  # white space at an edge leaves an empty piece
    ends = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return flat.filter(there), np.diff(ends)


def _payload(held: list[pa.Array], sizes: list[int], teach: list[bool]) -> bytes:
    """A block of texts from their words and numbers of words; an end follows each text."""
    coded = pa.chunked_array([*held, pa.array([_END], pa.binary()).cast(held[0].type)]).dictionary_encode()
    known = coded.chunk(0).dictionary.cast(pa.large_binary() if pa.types.is_large_string(held[0].type) else pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    order = np.argsort(hashes)
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    sizes = np.array(sizes, np.int64) + 1
    tokens = np.empty(sizes.sum(), np.uint32)
    words_at = np.ones(len(tokens), bool)
    words_at[np.cumsum(sizes) - 1] = False
    numbers = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    tokens[words_at], tokens[~words_at] = numbers[:-1], numbers[-1]
    # tokens are told by the ranks of their words, whose high bytes are mostly zero
    by_rank = np.argsort(-np.bincount(tokens, minlength=len(order)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[by_rank] = np.arange(len(order), dtype=np.uint32)
    return _pack(hashes[order], number[by_rank], rank[tokens], sizes, np.array(teach, bool))


def _tokenise(names: list[str]):
    """Rows of texts with the block and the place that they have there, and a row with the payload of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes, teach, tokens = [], [], [], 0
        block, own_type = TaskContext.get().partitionId() << 32, None

        def flush() -> pa.RecordBatch:
            row = [pa.nulls(1, own_type), pa.array([block], pa.int64()), pa.array([None], pa.int64()), pa.array([_payload(held, sizes, teach)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=names)

        for b in batches:
            own_type, blocks, places, done, first = b.column(2).type, [], [], [], 0
            found, counts = _tokens(b.column(0))
            ends = np.cumsum(counts).tolist()
            for n, end, t in zip(counts.tolist(), ends, b.column(1).to_pylist(), strict=True):
                blocks.append(block)
                places.append(len(sizes))
                sizes.append(n)
                teach.append(bool(t))
                tokens += n + 1
                if tokens >= BLOCK_TOKENS:
                    held.append(found.slice(first, end - first))
                    done.append(flush())
                    held, sizes, teach, tokens, block, first = [], [], [], 0, block + 1, end
            if sizes:
                held.append(found.slice(first))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(blocks, pa.int64()), pa.array(places, pa.int64()), pa.nulls(len(b), pa.binary())], names=names)
            yield from done
        if sizes:
            yield flush()
        held, sizes = [], []
        release()

    return run


def _word_mail(buckets: int):
    """A block's words and how often its training texts hold them, by the words' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in rows_of(batch):
                own, at, ranks, sizes, teaches = _unpack(payload)
                n = _small(np.bincount(at[ranks[np.repeat(teaches, sizes)]], minlength=len(own)))
                yield from _mail([(number, bucket, _pack(own[part], n[part]), None, None) for bucket, part in _slices(own, buckets)])
        release()

    return run


def _word_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers for blocks, and one row of sums for each bucket."""
    for held in _groups(batches, 1):
        sent = [_unpack(r[2]) for r in held]
        at, total, which = _total(np.concatenate([s[0] for s in sent]), np.concatenate([s[1] for s in sent]))
        parts = np.split(total[which], np.cumsum([len(s[0]) for s in sent])[:-1])
        yield from _mail([(r[0], r[1], _pack(_small(x)), None, None) for r, x in zip(held, parts, strict=True)])
        yield from _mail([(None, held[0][1], None, int(total.sum()), int((total > 0).sum()))])
    release()


def _ask(level: int, total: int, kinds: int, buckets: int, hot: int, turn: int, turns: int):
    """The continuations of a block's candidate contexts, by bucket, for the buckets whose turn it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in rows_of(batch):
                block = _Block(payload, total, kinds)
                at, order, entry, some, route, context, n_context, gram = block.entries(hot, buckets, turn, turns)
                taught = block.teaching[block.text][at][order].astype(np.uint32)  # entries stand one after the other
                n = _small(np.add.reduceat(taught, _firsts(entry)) if len(entry) else taught)
                # the root's probabilities go as counts, which take less room
                p = _small(block.count[at[some]]) if level == 1 else block.p[at[some]].astype(np.float32)
                is_hot = n_context >= hot
                block = at = order = entry = taught = None
                out = []
                for bucket, part in _slices(route, buckets):
                    first = _firsts(context[part])
                    runs = np.diff(np.append(first, part.stop - part.start)).astype(np.uint32)
                    out.append((number, bucket, _pack(context[part][first], runs, is_hot[part][first], gram[part] & _TOLD, n[part], p[part]), None, None))
                yield from _mail(out)
        release()

    return run


def _bucket(held: list[tuple], size: float) -> list[tuple]:
    """Counts and verdicts for each block that asked, and a row without block with a bucket's sums of hot contexts."""
    sent = [_unpack(r[2]) for r in held]
    context, is_hot = (np.concatenate([np.repeat(s[i], s[1]) for s in sent]) for i in (0, 2))
    gram, n, p = (np.concatenate([s[i] for s in sent]) for i in (3, 4, 5))
    some, total, which = _total(mix(context * _STEP + gram), n)
    of, _, owner = _total(context[some], np.ones(len(some)))
    p = (p[some] + 1.0) / size if p.dtype.kind == "u" else p[some].astype(np.float64)
    gain = np.bincount(owner, total * np.log(np.maximum(total, 1) / p), len(of))
    n_context = np.bincount(owner, total, len(of))
    verdict = np.round(gain - n_context * np.log(np.maximum(n_context, 1)), 6) >= LEAST_GAIN
    counts, verdicts = total[which], verdict[owner][which]
    cuts = np.cumsum([len(s[3]) for s in sent])[:-1]
    out = [(r[0], r[1], _pack(_small(c), np.packbits(v)), None, None) for r, c, v in zip(held, np.split(counts, cuts), np.split(verdicts, cuts), strict=True)]
    parts = np.flatnonzero(is_hot[some][of])
    if len(parts):
        out.append((None, held[0][1], _pack(context[some][of][parts], n_context[parts], gain[parts]), None, None))
    return out


def _answer(total: int, kinds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 1):
            yield from _mail(_bucket(held, total + kinds + 1.0))
            held = None
        release()

    return run


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for (payload,) in rows_of(batch):
            context, n, gain = _unpack(payload)
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(gain)], names=["context", "n", "gain"])


def _hear(total: int, kinds: int, hot: int, states):
    """A block with the answers of one level, or of the words where ``states`` is None, and how many candidates follow."""

    def run(of: pa.Table, answers: pa.Table) -> pa.Table:
        number, payload = of.column("block")[0].as_py(), of.column("payload")[0].as_py()
        heard = sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        heard = [_unpack(x) for _, x in heard]
        if states is None:
            payload = pickle.dumps([payload, _pack(_small(np.concatenate([a[0] for a in heard])))])
            block = _Block(payload, total, kinds)
        else:
            block = _Block(payload, total, kinds)
            _, order, entry, _, _, context, n_context, _ = block.entries(hot)
            counts, verdicts = np.empty(0, np.uint32), np.empty(0, bool)
            if heard:
                counts = np.concatenate([a[0].astype(np.int64) for a in heard])
                verdicts = np.concatenate([np.unpackbits(a[1], count=len(a[0])) for a in heard]).astype(bool)
            at = np.flatnonzero(n_context >= hot)
            verdicts[at] = np.isin(context[at], states.value)
            found, state = np.empty(len(order), counts.dtype), np.empty(len(order), bool)
            found[order], state[order] = counts[entry], verdicts[entry]
            found = _small(found)
            first = not block.narrow and len(block.parts) == 2
            block.step(found, state)
            payload = pickle.dumps([*block.parts, _pack(found, np.packbits(state))]) if first else block.narrowed()
        row = ([number], [payload], [len(block.candidates())])
        return pa.table([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["block", "payload", "tokens"])

    return run


def _scores(total: int, kinds: int):
    """(block, place, ...) of every text of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in rows_of(batch):
                block = _Block(payload, total, kinds)
                columns = (np.full(len(block.sizes), number), np.arange(len(block.sizes)), block.sizes, *block.base(), block.scores())
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["block", "place", "n_tokens", "n_known", "base_score", "score"])
        release()

    return run


def score_texts(docs: DataFrame, teaches: Column, depth: int = DEPTH) -> DataFrame:
    """``docs`` (text, ...) without text, with n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where ``teaches`` holds; all rows are scored. Scores are sums of log10 probabilities:
    base_score of the root's, score of the tree's.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "language-model")
    own, kept = nested(docs, [*MADE.names, "text"])
    names = ["own", "block", "place", "payload"]
    rows = docs.select(F.col("text"), F.coalesce(teaches, F.lit(False)).alias("teaches"), own.alias("own"))
    made = T.StructType([T.StructField("own", rows.schema["own"].dataType), T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("payload", T.BinaryType())])
    lot = F.pmod(F.xxhash64("block"), F.lit(LOTS)).cast("int")
    whole = scratch.save(rows.mapInArrow(_tokenise(names), made).withColumn("lot", lot), "texts", "lot")
    texts = scratch.save(whole.where("payload IS NULL").select("own", "block", "place"), "rows")
    blocks = whole.where("payload IS NOT NULL").select("block", "payload", "lot")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = blocks.count()
    by_block = -(-max(partitions, n_blocks) // LOTS)
    tables: dict[str, str] = {}

    def exchanged(mail: DataFrame, buckets: int, answer, name: str) -> DataFrame:
        return scratch.save(mail.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(answer, _MAIL), name)

    def bucketed(rows: DataFrame, name: str) -> DataFrame:
        """Blocks in a bucketed table, so that they stay where they are and only answers move."""
        tables[name] = f"language_model_{uuid.uuid4().hex}"
        with shuffles_removed(spark):
            rows.write.bucketBy(by_block, "block").option("compression", "zstd").option("path", f"{scratch.base}/{name}").saveAsTable(tables[name])
        return spark.table(tables[name])

    def done(name: str) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {tables.pop(name)}")
        scratch.drop(name)

    def heard(states: list[DataFrame], answers: DataFrame, hear, before: str, name: str) -> list[DataFrame]:
        """The next level of each lot; the lot's table of the level before goes."""
        out = []
        for i, mine in enumerate(states):
            sent = answers.where("block IS NOT NULL").where(lot == i).select("block", "bucket", "payload").repartition(by_block, "block")
            both = mine.select("block", "payload").groupby("block").cogroup(sent.groupby("block"))
            out.append(bucketed(both.applyInArrow(hear, "block long, payload binary, tokens long"), f"{name}-{i}"))
            done(f"{before}-{i}")
        return out

    buckets = max(16, partitions, n_blocks)
    answers = exchanged(blocks.select("block", "payload").mapInArrow(_word_mail(buckets), _MAIL), buckets, _word_totals, "words")
    total, kinds = answers.where("block IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    hot = int(max(HOT_LEAST, HOT_SHARE * total))
    lots = []
    for i in range(LOTS):
        lots.append(bucketed(blocks.where(F.col("lot") == i).select("block", "payload"), f"blocks-{i}"))
        scratch.drop(f"texts/lot={i}")
    scratch.drop("texts")
    lots = heard(lots, answers, _hear(total, kinds, hot, None), "blocks", "level-0")
    scratch.drop("words")
    level, now, first_open = 0, reduce(DataFrame.union, lots), 0
    while level < depth and (open_tokens := now.agg(F.sum("tokens")).first()[0]):
        level += 1
        buckets, first_open = max(16, partitions, open_tokens // BUCKET_ENTRIES), first_open or open_tokens
        turns = TURNS if open_tokens >= TURNS_FROM * first_open else 1
        answers = []
        for turn in range(turns):
            mail = now.select("block", "payload").mapInArrow(_ask(level, total, kinds, buckets, hot, turn, turns), _MAIL)
            answers.append(exchanged(mail, max(partitions, buckets // turns), _answer(total, kinds), f"answers-{level}-{turn}"))
        answers = reduce(DataFrame.union, answers)
        sums = answers.where("block IS NULL").select("payload").mapInArrow(_hot_sums, "context long, n long, gain double").groupBy("context").agg(F.sum("n").alias("n"), F.sum("gain").alias("gain"))
        passed = F.round(F.col("gain") - F.col("n") * F.log(F.greatest("n", F.lit(1))), 6) >= LEAST_GAIN
        states = sums.where(passed).select("context").toArrow().column(0).to_numpy()  # at most 1 / HOT_SHARE
        sent = spark.sparkContext.broadcast(np.sort(states.view(np.uint64)))
        lots = heard(lots, answers, _hear(total, kinds, hot, sent), f"level-{level - 1}", f"level-{level}")
        now = reduce(DataFrame.union, lots)
        for turn in range(turns):
            scratch.drop(f"answers-{level}-{turn}")
    scores = now.select("block", "payload").mapInArrow(_scores(total, kinds), "block long, place long, n_tokens long, n_known long, base_score double, score double")
    scores = scratch.save(scores, "scores")
    for i in range(LOTS):
        done(f"level-{level}-{i}")
    found = texts.join(scores, ["block", "place"])
    return found.select(*unnested(kept), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def teaching(parts: int = 7, left_out: int = 2) -> Column:
    return fold("doc_id", parts) != left_out
