"""Toxicity: a linear-chain conditional random field tags toxic spans, and their marginals
make document scores.

Training. A bounded sample of labelled documents (``SAMPLE`` of them, the first in the order
of a hash of their id) gives, for each feature of a token - the lower-cased word and
its beginnings of 3 to 6 bytes, as 64-bit hashes - the number of toxic and of clean documents
that have it. Features of at least ``SUPPORT`` toxic documents, and of a larger share of these
than of clean ones, are counted once more by the different words before them, ``BURST`` of a
document at most and those of a copied passage once. A feature whose counts are beyond chance
and that is e^2 times as frequent in toxic documents marks tokens: tokens of toxic documents
with such a feature are labelled 1, all others 0. Beyond chance are those that a likelihood
ratio test of all of them passes with a share of ``FALSE`` false discoveries, so the bar follows
the labels and the number of features tested. Sentences with labelled tokens, sentences of clean
documents that have such a feature all the same, and others, one in ``ONE_IN`` of these and
``SENTENCES`` of each kind at most, in pieces of at most ``PIECE`` tokens, train the field:
weights of features, of the two states' transitions and of the start, by gradients from
forward-backward marginals. One task does this on an executor, as these four parameters of
``fit`` bound the tokens; the driver gets the weights and the tested features alone, 1,469 of
them at sf0.1, each in ``SUPPORT`` documents of the sample or more.

Scoring. Each whole text is cut into sentences at line ends and full stops, however long they
are; forward-backward gives each token's marginal probability of being toxic. Each marginal is
weighed by itself, so that the small ones of a long text's many plain words don't add up: the sum of
their squares is how many tokens two independent taggings of the document are expected to call
toxic alike. A document's score is a logistic function of that number, of the number of tokens
and of their ratio, fitted on the sample's documents, so that one such word in a long text weighs
less than many in a short one. Spans of tokens of at least one half are the offending offsets. Tasks get
the weights of features that training sentences have, a bounded number of them.

Labels that are null, or of documents that do not exist, are ignored; without labelled
documents of both kinds every score is 0. Null text counts as empty, and an empty text has the
score that the logistic function gives to no tokens (0.055 at sf0.01). A document labelled twice is
toxic if any label says so. Repeated rows are scored each; empty tables give no rows; other columns
are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.words import BASES, CHUNK, mix, powers, seeded, text_column
from motefield.storage import forget, materialize

#: Documents and sentences (with and without labelled tokens) that training sees at most.
SAMPLE, SENTENCES = 16_000, 8_000
#: Of the sentences without such tokens, which are many, training sees one in so many, drawn by
#: a hash; sentences of more than so many tokens it sees in pieces.
ONE_IN, PIECE = 16, 256
#: Toxic documents that a feature must have, and different words before it that one document
#: can count for.
SUPPORT, BURST = 4, 3
#: The share of features that mark tokens by chance.
FALSE = 0.001
#: Emission of a token none of whose features is known: one feature alone does not make a
#: token toxic, several that agree do.
PRIOR = -6.0
#: The feature that words too short for a beginning have; its weight is 0.
NONE = np.uint64(0)
PREFIXES = (3, 4, 5, 6)
#: Steps of one pass of forward-backward; longer chains are blocks that exchange messages.
BLOCK = 256
THRESHOLD = 0.3


def _lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes lower-cased in A-Z and in the accented Latin letters of one table."""
    upper = (data >= 65) & (data <= 90)
    if len(data):
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + (upper * 32).astype(np.uint8)


class Tokens:
    """Tokens of some texts: byte places, text, sentence bounds and hashed features; sentences
    of more than ``piece`` tokens are cut where it is given."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, piece: int | None = None):
        data = _lower(data)
        inside = ((data >= 97) & (data <= 122)) | (data >= 128)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1] | edge[1:-1]
            end[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        self.base = bounds[self.doc] if len(self.doc) else self.doc
        n = len(self.start)
        stops = np.cumsum((data == 10) | (data == 46))
        sentence = stops[self.start] if n else np.zeros(0, dtype=np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (sentence[1:] != sentence[:-1]) | (self.doc[1:] != self.doc[:-1])
        if piece is not None:
            first = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            new |= place % piece == 0
        self.first = np.flatnonzero(new)
        self.length = np.diff(np.append(self.first, n))
        up, down = powers(BASES[0], len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        size = self.end - self.start
        columns = []
        for k, salt in ((None, 40), *((k, 40 + k) for k in PREFIXES)):
            stop = self.end if k is None else np.minimum(self.start + k, self.end)
            h = mix((total[stop] - total[self.start]) * down[self.start] ^ seeded(salt))
            columns.append(h | np.uint64(1) if k is None else np.where(size >= k, h | np.uint64(1), NONE))
        self.features = np.stack(columns, axis=1) if n else np.zeros((0, 1 + len(PREFIXES)), dtype=np.uint64)


class Lookup:
    """A sorted set of features; a small table of their low bits turns most others away."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.seen = np.zeros(1 << self.BITS, dtype=bool)
        self.seen[self.slot(keys)] = True

    def slot(self, features: np.ndarray) -> np.ndarray:
        return (features >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat places of features that are in the set, their places in the set)."""
        flat = features.ravel()
        at = np.flatnonzero(self.seen[self.slot(flat)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        spot = np.minimum(np.searchsorted(self.keys, flat[at]), len(self.keys) - 1)
        same = self.keys[spot] == flat[at]
        return at[same], spot[same]

    def any(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features), dtype=bool)
        out[self.find(features)[0] // features.shape[1]] = True
        return out


def token_chunks(texts: pa.Array, piece: int | None = None) -> Iterator[tuple[slice, Tokens]]:
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * texts.offset).astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        yield slice(low, high), Tokens(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], piece)
        low = high


class Field:
    """A linear-chain field of two states; state 0 has no emission of its own."""

    def __init__(self, lookup: Lookup, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.lookup, self.weights, self.moves, self.begin = lookup, weights, moves, begin
        self.link: np.ndarray | None = None

    def _forward(self, emission: np.ndarray, first: np.ndarray, active: np.ndarray, enter: np.ndarray, f: np.ndarray) -> None:
        """Log sums over all ways up to each token; ``enter``: those up to the step into a chain's
        first token. Chains are in falling order of length, ``active`` of them have a step."""
        m = self.moves
        for t, n in enumerate(active):
            at = first[:n] + t
            if not t:
                f[0, at], f[1, at] = enter[0], enter[1] + emission[at]
            else:
                p, q = f[0, at - 1], f[1, at - 1]
                f[0, at] = np.logaddexp(p + m[0, 0], q + m[1, 0])
                f[1, at] = np.logaddexp(p + m[0, 1], q + m[1, 1]) + emission[at]

    def _backward(self, emission: np.ndarray, first: np.ndarray, active: np.ndarray, last: np.ndarray, leave: np.ndarray, b: np.ndarray) -> None:
        """Log sums over all ways behind each token; ``leave``: those behind a chain's last."""
        m = self.moves
        b[:, last] = leave
        for t in range(len(active) - 2, -1, -1):
            at = first[: active[t + 1]] + t
            p, q = b[0, at + 1], b[1, at + 1] + emission[at + 1]
            b[0, at] = np.logaddexp(m[0, 0] + p, m[0, 1] + q)
            b[1, at] = np.logaddexp(m[1, 0] + p, m[1, 1] + q)

    def _messages(self, emission: np.ndarray, first: np.ndarray, active: np.ndarray, last: np.ndarray, number: np.ndarray, place: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What enters and leaves each block of chains that are cut into blocks. A block's ways
        from either state before it to either state at its end are a 2 x 2 matrix; messages go
        along these, one step a block. ``number``: a block's place in its chain, ``place``: where
        the block stands that is its chain's first, counted in the chains' own order."""
        m, blocks = self.moves, len(first)
        enter, leave = np.repeat(self.begin[:, None], blocks, axis=1), np.zeros((2, blocks))
        if not number.any():
            return enter, leave
        ways = np.empty((2, 2, blocks))
        for i in (0, 1):
            self._forward(emission, first, active, np.where(number == 0, self.begin[:, None], m[i][:, None]), f)
            ways[i] = f[:, last]
        spot = np.empty(blocks, dtype=np.int64)  # of a block, by its place
        spot[place + number] = np.arange(blocks)
        done = ways[0].copy()  # of first blocks; the others follow
        by_number = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[by_number], np.arange(number.max() + 2))
        for k in range(1, len(bounds) - 1):
            own = by_number[bounds[k] : bounds[k + 1]]
            p, q = done[:, spot[place[own] + k - 1]]
            enter[:, own] = np.logaddexp(p + m[0][:, None], q + m[1][:, None])
            done[:, own] = np.logaddexp(p + ways[0][:, own], q + ways[1][:, own])
        for k in range(len(bounds) - 2, 0, -1):
            own = by_number[bounds[k] : bounds[k + 1]]
            leave[:, spot[place[own] + k - 1]] = np.logaddexp(ways[:, 0, own] + leave[0, own], ways[:, 1, own] + leave[1, own])
        return enter, leave

    def marginals(self, emission: np.ndarray, first: np.ndarray, length: np.ndarray, moves: bool = False):
        """P(state 1) of each token; with ``moves`` also expected transitions and log Z. The work
        is linear in the tokens, whatever the length of a chain."""
        n, m = len(emission), self.moves
        parts = -(-length // BLOCK)
        before = np.repeat(np.cumsum(parts) - parts, parts)
        number = np.arange(len(before)) - before
        start = np.repeat(first, parts) + number * BLOCK
        size = np.minimum(np.repeat(length, parts) - number * BLOCK, BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, number, before = start[order], size[order], number[order], before[order]
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        f, b = np.zeros((2, n)), np.zeros((2, n))
        last = start + size - 1
        enter, leave = self._messages(emission, start, active, last, number, before, f)
        self._forward(emission, start, active, enter, f)
        self._backward(emission, start, active, last, leave, b)
        whole = np.logaddexp(f[0] + b[0], f[1] + b[1])
        p1 = np.exp(f[1] + b[1] - whole)
        if not moves:
            return p1
        expected, inner = np.zeros((2, 2)), np.ones(n, dtype=bool)
        inner[first] = False
        at = np.flatnonzero(inner)
        for x in (0, 1):
            for y in (0, 1):
                expected[x, y] = np.exp(f[x, at - 1] + m[x, y] + b[y, at] + y * emission[at] - whole[at]).sum()
        return p1, expected, whole[first].sum()

    def score(self, tokens: Tokens) -> np.ndarray:
        n, width = tokens.features.shape
        at, spot = self.lookup.find(tokens.features)
        emission = PRIOR + np.bincount(at // width, weights=self.weights[spot], minlength=n)
        return self.marginals(emission, tokens.first, tokens.length)

    @staticmethod
    def hits(p: np.ndarray, tokens: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that two taggings are expected to call toxic alike, and tokens, of ``n`` texts."""
        return np.bincount(tokens.doc, weights=p * p, minlength=n), np.bincount(tokens.doc, minlength=n)

    def documents(self, p: np.ndarray, tokens: Tokens, n: int) -> np.ndarray:
        """Scores of ``n`` texts from the marginals of their tokens."""
        return 1 / (1 + np.exp(-evidence(*self.hits(p, tokens, n)) @ self.link))


def train(tokens: Tokens, labels: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 0.02) -> Field:
    """Maximum a posteriori weights by Adam steps on the exact gradient."""
    used, inverse = np.unique(tokens.features, return_inverse=True)
    inverse = inverse.reshape(tokens.features.shape)
    w = np.zeros(len(used) + 6)
    speed, size = np.zeros_like(w), np.zeros_like(w)
    y = labels.astype(float)
    inner = np.ones(len(y), dtype=bool)
    inner[tokens.first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    begun = np.bincount(labels[tokens.first], minlength=2).astype(float)
    k = len(used)
    for r in range(1, rounds + 1):
        field = Field(Lookup(used[:0]), w[:0], w[k : k + 4].reshape(2, 2), w[k + 4 :])
        emission = PRIOR + w[:k][inverse].sum(axis=1)
        p, expected, _ = field.marginals(emission, tokens.first, tokens.length, moves=True)
        slope = np.zeros_like(w)
        slope[:k] = np.bincount(inverse.ravel(), weights=np.repeat(y - p, inverse.shape[1]), minlength=k)
        slope[k : k + 4] = (seen - expected).ravel()
        start = p[tokens.first].sum()
        slope[k + 4 :] = begun - np.array([len(tokens.first) - start, start])
        slope -= decay * w
        slope[:k][used == NONE] = 0
        speed = 0.9 * speed + 0.1 * slope
        size = 0.99 * size + 0.01 * slope**2
        w += rate * (speed / (1 - 0.9**r)) / (np.sqrt(size / (1 - 0.99**r)) + 1e-8)
    return Field(Lookup(used), w[:k].copy(), w[k : k + 4].reshape(2, 2), w[k + 4 :])


def held_out(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; not so for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of each kind that have a feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, tokens in token_chunks(text_column(batch, 1)):
                width = tokens.features.shape[1]
                feature, doc = tokens.features.ravel(), np.repeat(tokens.doc, width)
                order = np.lexsort((doc, feature))
                feature, doc = feature[order], doc[order]
                new = np.ones(len(feature), dtype=bool)
                new[1:] = (feature[1:] != feature[:-1]) | (doc[1:] != doc[:-1])
                new &= feature != NONE
                feature, bad = feature[new], toxic[rows][doc[new]]
                first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1])) if len(feature) else np.zeros(0, dtype=np.int64)
                if len(first):
                    n, hits = np.diff(np.append(first, len(feature))), np.add.reduceat(bad, first)
                    yield pa.RecordBatch.from_arrays([pa.array(feature[first].view(np.int64)), pa.array(hits.astype(np.int64)), pa.array((n - hits).astype(np.int64))], ["feature", "toxic", "clean"])

    return sample.select("toxic", "text").mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def contexts(sample: DataFrame, marks: Lookup) -> DataFrame:
    """(feature, toxic, clean): different words before a feature, in documents of each kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for rows, tokens in token_chunks(text_column(batch, 1)):
                before = np.zeros(len(tokens.doc), dtype=np.uint64)
                before[1:] = np.where(tokens.doc[1:] == tokens.doc[:-1], tokens.features[:-1, 0], NONE)
                at, _ = marks.find(tokens.features)
                token = at // tokens.features.shape[1]
                columns = [tokens.features.ravel()[at].view(np.int64), before[token].view(np.int64), toxic[rows][tokens.doc[token]].astype(np.int64), ids[rows][tokens.doc[token]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["feature", "before", "bad", "doc"])

    seen = sample.select("toxic", "text", "doc").mapInArrow(run, "feature long, before long, bad long, doc long").groupBy("feature", "before", "bad").agg(F.min("doc").alias("doc"))
    told = seen.groupBy("feature", "doc", "bad").agg(F.least(F.count("*"), F.lit(BURST)).alias("n"))
    return told.groupBy("feature").agg(F.sum(F.col("n") * F.col("bad")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("clean"))


def _ratio(toxic: int, clean: int) -> Column:
    return ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))


def _lookup(kept: DataFrame) -> Lookup:
    return Lookup(np.sort(np.array([r.feature for r in kept.select("feature").collect()], dtype=np.int64).view(np.uint64)))


def leaning(counts: DataFrame, toxic: int, clean: int) -> Lookup:
    """Features of enough toxic documents that clean ones have less often; the sample bounds
    their number."""
    return _lookup(counts.where((F.col("toxic") >= SUPPORT) & (_ratio(toxic, clean) > float(np.e))))


def telling(counts: DataFrame, toxic: int, clean: int) -> Lookup:
    """Features that toxic documents have beyond chance: of likelihood ratio tests of all features,
    those that the step-up rule of Benjamini and Hochberg passes at ``FALSE``."""
    share = toxic / (toxic + clean)
    n = F.col("toxic") + F.col("clean")
    part = lambda x, s: F.when(x > 0, x * F.log(x / (n * s))).otherwise(0.0)
    gain = part(F.col("toxic"), share) + part(F.col("clean"), 1 - share)
    rows = counts.select("feature", (_ratio(toxic, clean) > float(np.exp(2))).alias("often"), F.greatest(gain, F.lit(0.0)).alias("gain")).collect()
    # twice the gain is chi-squared with one degree of freedom
    tail = np.array([math.erfc(math.sqrt(r.gain)) for r in rows])
    passed = np.sort(tail) <= FALSE * np.arange(1, len(tail) + 1) / max(len(tail), 1)
    bar = np.sort(tail)[np.flatnonzero(passed)[-1]] if passed.any() else -1.0
    return Lookup(np.sort(np.array([r.feature for r, p in zip(rows, tail) if r.often and p <= bar], dtype=np.int64).view(np.uint64)))


def sentences(sample: DataFrame, marks: Lookup, one_in: int = ONE_IN, piece: int = PIECE) -> DataFrame:
    """(kind, toxic, order, text) of sentences, long ones in pieces: kind 2 holds labelled tokens, kind 1 tokens of
    clean documents that look like them, kind 0 neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, column = batch.column(0).to_numpy(zero_copy_only=False), text_column(batch, 1)
            for rows, tokens in token_chunks(column, piece):
                if not len(tokens.first):
                    continue
                doc = tokens.doc[tokens.first]
                bad = toxic[rows][doc]
                hit = np.add.reduceat(marks.any(tokens.features), tokens.first) > 0
                kind = np.where(hit, 1 + bad, 0)
                order = mix(tokens.features[tokens.first, 0] + tokens.length.astype(np.uint64) + seeded(7))
                use = np.flatnonzero(hit | (order % np.uint64(one_in) == 0))
                raw = [x.as_py().encode() for x in column.slice(rows.start, rows.stop - rows.start)]
                last = tokens.first + tokens.length - 1
                text = [raw[doc[i]][tokens.start[tokens.first[i]] - tokens.base[tokens.first[i]] : tokens.end[last[i]] - tokens.base[last[i]]].decode(errors="replace") for i in use]
                columns = [pa.array(kind[use].astype(np.int32)), pa.array(bad[use].astype(np.int32)), pa.array(order[use].view(np.int64)), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "toxic", "order", "text"])

    return sample.select("toxic", "text").mapInArrow(run, "kind int, toxic int, order long, text string")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = SENTENCES, one_in: int = ONE_IN, piece: int = PIECE) -> Field | None:
    """The field trained on labelled rows that are not held out; None without both kinds. It
    sees ``sample`` documents and ``most`` sentences of each kind at most, of those without
    marked tokens one in ``one_in``, and sentences in pieces of ``piece`` tokens."""
    told = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # a number of rows that the limit bounds, 12 bytes each
    chosen = F.broadcast(told.orderBy(F.xxhash64("doc"), "doc").limit(sample))
    pairs = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "doc")
    rows = materialize(pairs.select("toxic", "text", "doc"), "labelled")
    size = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = int(size[0]), int(size[1] - size[0])
    if not toxic or not clean:
        return None
    marks = telling(contexts(rows, leaning(feature_counts(rows), toxic, clean)), toxic, clean)
    held = materialize(sentences(rows, marks, one_in, piece), "sentences")
    kinds = [held.where(F.col("kind") == kind).orderBy("order", "text").limit(most) for kind in (2, 1, 0)]
    told = trained(kinds[0].union(kinds[1]).union(kinds[2]), marks).first()
    field = None
    if told is not None:
        weights, rest = np.frombuffer(told.weights), np.frombuffer(told.rest)
        field = Field(Lookup(np.frombuffer(told.features, dtype=np.uint64)), weights, rest[:4].reshape(2, 2), rest[4:])
        field.link = np.frombuffer(linked(rows, field).first().link)
    forget(rows)
    forget(held)
    return field


def linked(sample: DataFrame, field: Field) -> DataFrame:
    """(link): weights of a document's evidence, by Newton steps on the sample's labels: the
    evidence is counted by all tasks, and one fits a few numbers of each document."""
    model = sample.sparkSession.sparkContext.broadcast(field)  # as in score_documents
    names = ["toxic", "hits", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, tokens in token_chunks(text_column(batch, 1)):
                hits, n = model.value.hits(model.value.score(tokens), tokens, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([pa.array(toxic[rows].astype(float)), pa.array(hits), pa.array(n.astype(float))], names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([(c, pa.float64()) for c in names])).sort_by([(c, "ascending") for c in names])
        y, hits, n = (rows.column(c).to_numpy() for c in names)
        yield pa.RecordBatch.from_arrays([pa.array([logistic(evidence(hits, n), y).tobytes()], pa.binary())], ["link"])

    seen = sample.select("toxic", "text").mapInArrow(count, "toxic double, hits double, n double")
    return seen.coalesce(1).mapInArrow(solve, "link binary")


def evidence(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a document's score is a function of, given its expected toxic tokens and its tokens."""
    return np.stack((np.ones(len(n)), np.log1p(hits), np.log1p(n) / 8, np.log1p(50 * hits / (n + 25))), axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step / max(1.0, float(np.abs(step).max()) / 2)
    return w


def trained(some: DataFrame, marks: Lookup) -> DataFrame:
    """(features, weights, rest) of the field trained on ``some`` sentences, 3 x ``SENTENCES``
    of them at most, in one task; no row for no sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("kind", pa.int32()), ("toxic", pa.int32()), ("order", pa.int64()), ("text", pa.string())]))
        if not rows.num_rows:
            return
        rows = rows.sort_by([("kind", "descending"), ("order", "ascending"), ("text", "ascending")])
        column = rows.column("text").combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1).astype(np.int64)
        tokens = Tokens(np.frombuffer(column.buffers()[2], dtype=np.uint8), offsets)
        label = marks.any(tokens.features) & (rows.column("toxic").to_numpy()[tokens.doc] == 1)
        field = train(tokens, label.astype(np.int64))
        rest = np.concatenate((field.moves.ravel(), field.begin))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (field.lookup.keys, field.weights, rest)], ["features", "weights", "rest"])

    return some.coalesce(1).mapInArrow(run, "features binary, weights binary, rest binary")


SCORES = "score double, predicted int, n_tokens long, spans array<struct<start:int,end:int>>"


def score_documents(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``score``, ``predicted``, ``n_tokens`` and ``spans``, the offending offsets as
    bytes of the UTF-8 text, neighbours joined."""
    kind = docs.schema[key].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(field)  # no more weights than SENTENCES have features
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for rows, tokens in token_chunks(text_column(batch, 1)):
                n = rows.stop - rows.start
                p = known.score(tokens) if known is not None else np.zeros(len(tokens.start))
                score = known.documents(p, tokens, n) if known is not None else np.zeros(n)
                spans: list[list[dict]] = [[] for _ in range(n)]
                last = -2
                for i in np.flatnonzero(p >= 0.5):
                    d, a, b = int(tokens.doc[i]), int(tokens.start[i] - tokens.base[i]), int(tokens.end[i] - tokens.base[i])
                    if i == last + 1 and spans[d]:
                        spans[d][-1]["end"] = b
                    else:
                        spans[d].append({"start": a, "end": b})
                    last = i
                columns = [batch.column(0).slice(rows.start, n), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(np.bincount(tokens.doc, minlength=n)), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(columns, [key, "score", "predicted", "n_tokens", "spans"])

    return docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, f"`{key}` {kind}, {SCORES}")


def clean_documents(docs: DataFrame, field: Field | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; no shuffle."""
    model, at = docs.sparkSession.sparkContext.broadcast(field), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            column = text_column(batch, at)
            filled = pa.compute.fill_null(column, "")
            for rows, tokens in token_chunks(filled) if known is not None else ():
                keep[rows] = known.documents(known.score(tokens), tokens, rows.stop - rows.start) < threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
