"""A gated recurrent language model in numpy, trained and applied in Spark tasks.

Counts of all training words come from one aggregation over shards of documents, and go back
to the shards that hold the words. The words most frequent are modelled one by one in classes by
frequency; the others are modelled by the class of their ending, and within it by their counts.
The output is thus a class, then a word in it. Training is truncated backpropagation on runs
of windows, each run of every training document in one of ROUNDS rounds; in a round, each partition trains
from the same parameters, and the results are averaged. Scoring carries the state through all windows of a document.

A word's identity is a 64-bit hash of its bytes. Within an ending's class, a training word has its count and one, and
any other word the mass of one, so that nothing is learnt from held-out texts.

Cases: null and empty texts are an end alone; a null doc_id is a training document; repeated rows
count each and are scored each; without training documents, all counts are 0; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, streamed
from .textblock import Words, pieces

SHARD_BYTES = 12 << 20
#: State and embedding, words modelled one by one (classes of equal size), classes of endings.
STATE = 16
LISTED, CLASSES, TAILS = 1024, 32, 32
PER = LISTED // CLASSES
#: Tokens of a window; windows of a training run; rounds that the runs are dealt to; sequences in a step.
WINDOW, RUN, ROUNDS, BATCH = 32, 2, 3, 256
RATE = 0.2

_SHARD = "shard string, ids binary, nulls binary, held binary, sizes binary, words binary, tails binary, tokens binary, counts binary"


def _shards(batches):
    """Of each shard: its documents, its distinct words (ascending) with tails and training counts, and its tokens as numbers of these."""
    for whole in batches:
        for b in pieces(whole, "text", SHARD_BYTES):
            w = Words(b.column(2))
            words, first, tokens = np.unique(w.hashes(), return_index=True, return_inverse=True)
            last = w.starts[first] + w.lens[first] - 1
            ending = w.data[last].astype(np.int64) * 31 + np.where(w.lens[first] > 1, w.data[np.maximum(last - 1, 0)], 0) * 7
            held = pc.fill_null(b.column(1), False).to_numpy(zero_copy_only=False)
            sizes = np.diff(w.first)
            counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words))
            none = np.asarray(b.column(0).is_null())
            columns = [b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), none.astype(np.uint8), held.astype(np.uint8), sizes.astype("<i4"), words, (ending % TAILS).astype(np.uint8), tokens.astype("<u4"), counts.astype("<u4")]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], [x.split()[0] for x in _SHARD.split(", ")])


def _counts(batches):
    for b in batches:
        for shard, words, tails, counts in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            word = np.frombuffer(words, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(word), pa.string()).dictionary_encode().cast(pa.string()), pa.array(word), pa.array(np.frombuffer(tails, np.uint8).astype(np.int32)), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))],
                ["shard", "word", "tail", "n"],
            )


class Model:
    """Parameters as one flat vector. Token 0 is the end; then listed words; then the tails."""

    SHAPES = {"E": (LISTED + TAILS, STATE), "Wx": (STATE, 3 * STATE), "U": (STATE, 3 * STATE), "b": (3 * STATE,), "Wc": (STATE, CLASSES + TAILS), "bc": (CLASSES + TAILS,), "Ww": (CLASSES, STATE, PER), "bw": (CLASSES, PER)}

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        at = 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, listed: np.ndarray, tails: np.ndarray) -> Model:
        """Small weights; output biases at the logarithms of the counts, so that it starts as a unigram model."""
        m = cls(np.random.default_rng(5).normal(0, 0.1, cls.size()).astype(np.float32))
        words = listed.reshape(CLASSES, PER)
        m.b[:] = 0
        m.bw[:] = np.log(words)
        m.bc[:] = np.log(np.concatenate([words.sum(1), tails]))
        return m

    def step(self, x: np.ndarray, h: np.ndarray):
        a = h @ self.U
        z = _sigmoid(x[:, :STATE] + a[:, :STATE])
        r = _sigmoid(x[:, STATE : 2 * STATE] + a[:, STATE : 2 * STATE])
        c = np.tanh(x[:, 2 * STATE :] + r * a[:, 2 * STATE :])
        return c + z * (h - c), z, r, c, a[:, 2 * STATE :]

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target's class, and of the word in it if listed."""
        logits = h @ self.Wc + self.bc
        kind = np.where(target < LISTED, target // PER, target - LISTED + CLASSES)
        out = logits[np.arange(len(h)), kind] - _log_sum(logits)
        for k, rows in _by_class(kind):
            inner = h[rows] @ self.Ww[k] + self.bw[k]
            out[rows] += inner[np.arange(len(rows)), target[rows] % PER] - _log_sum(inner)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1)[:, None])
    return x / x.sum(1)[:, None]


def _by_class(kind: np.ndarray):
    """Rows of each class of listed words."""
    order = np.argsort(kind.astype(np.uint8), kind="stable")
    edge = np.searchsorted(kind[order], np.arange(CLASSES + 1))
    for k in range(CLASSES):
        if edge[k + 1] > edge[k]:
            yield k, order[edge[k] : edge[k + 1]]


def gradient(m: Model, given: np.ndarray, target: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean loss over one window (rows: sequences), and the state after it. No gradient goes to the state before it."""
    g = Model(np.zeros_like(m.flat))
    rows, steps = given.shape
    whole = mask.all()
    #: Steps first, so that each step's rows lie together.
    ids = given.T.ravel()
    x = (m.E @ m.Wx + m.b)[ids].reshape(steps, rows, 3 * STATE)
    kept, states = [], np.empty((steps, rows, STATE), np.float32)
    for t in range(steps):
        new, *parts = m.step(x[t], h)
        if not whole:
            new = np.where(mask[:, t, None], new, h)
        kept.append((h, *parts))
        states[t] = h = new
    live = mask.T.ravel()
    hs, goal = states.reshape(-1, STATE), target.T.ravel()
    if not whole:
        hs, goal = hs[live], goal[live]
    scale = np.float32(1 / max(len(goal), 1))
    kind = np.where(goal < LISTED, goal // PER, goal - LISTED + CLASSES)
    d = _softmax(hs @ m.Wc + m.bc)
    d[np.arange(len(d)), kind] -= 1
    d *= scale
    g.Wc[:] = hs.T @ d
    g.bc[:] = d.sum(0)
    dh = d @ m.Wc.T
    for k, at in _by_class(kind):
        d = _softmax(hs[at] @ m.Ww[k] + m.bw[k])
        d[np.arange(len(d)), goal[at] % PER] -= 1
        d *= scale
        g.Ww[k] = hs[at].T @ d
        g.bw[k] = d.sum(0)
        dh[at] += d @ m.Ww[k].T
    from_out = np.zeros((steps * rows, STATE), np.float32)
    from_out[live] = dh
    from_out = from_out.reshape(steps, rows, STATE)
    dx = np.empty((steps, rows, 3 * STATE), np.float32)
    back = np.zeros((rows, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, c, an = kept[t]
        dn = from_out[t] + back
        if not whole:
            on = mask[:, t, None]
            dn *= on
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (before - c) * z * (1 - z)
        dr = dc * an * r * (1 - r)
        out = dx[t]
        out[:, :STATE], out[:, STATE : 2 * STATE], out[:, 2 * STATE :] = dz, dr, dc * r
        g.U += before.T @ out
        through = dn * z + out @ m.U.T
        back = through if whole else np.where(on, through, back)
        out[:, 2 * STATE :] = dc
    flat_x = dx.reshape(-1, 3 * STATE)
    g.b[:] = flat_x.sum(0)
    g.Wx[:] = m.E[ids].T @ flat_x
    de = flat_x @ m.Wx.T
    order = np.argsort(ids, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) > 0]))
    g.E[ids[order][edge]] = np.add.reduceat(de[order], edge)
    return g.flat, h


class _Coder:
    """From a shard's words to the model's tokens."""

    def __init__(self, listed: np.ndarray):
        order = np.argsort(listed)
        self.sorted, self.number = listed[order], order + 1

    def codes(self, words: np.ndarray, tails: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return LISTED + tails.astype(np.int64)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.number[at], LISTED + tails.astype(np.int64))


def _train(listed: np.ndarray, start: np.ndarray, turn: int):
    def run(batches):
        m = Model(start.copy())
        speed = np.full_like(start, 1e-6)
        coder, seen = _Coder(listed), 0
        for b in batches:
            for row in b.to_pylist():
                codes = coder.codes(np.frombuffer(row["words"], np.int64), np.frombuffer(row["tails"], np.uint8))
                seen += _train_shard(m, speed, codes[np.frombuffer(row["tokens"], "<u4")], np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["held"], np.uint8), turn)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start), dtype=np.int32)), pa.array(m.flat.astype(np.float64) * seen), pa.array(np.full(len(start), seen, np.int64))], ["k", "v", "w"])

    return run


def _train_shard(m: Model, speed: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, held: np.ndarray, turn: int) -> int:
    """One pass over the runs dealt to this turn, of the documents that are not held out; the turns together have each run once."""
    span = WINDOW * RUN
    first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    per = np.where(held == 0, -(-(sizes + 1) // span), 0)
    doc = np.repeat(np.arange(len(sizes)), per)
    at = (np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)) * span
    drawn = np.random.default_rng(100).permutation(len(doc)) % ROUNDS == turn
    doc, at = doc[drawn], at[drawn]
    order = np.random.default_rng(200 + turn).permutation(len(doc))
    total = 0
    for cut in range(0, len(order), BATCH):
        mine = order[cut : cut + BATCH]
        h = np.zeros((len(mine), STATE), np.float32)
        for k in range(RUN):
            place = at[mine, None] + k * WINDOW + np.arange(WINDOW)
            size = sizes[doc[mine], None]
            base = first[doc[mine], None]
            take = lambda p, base=base, size=size: np.where((p >= 0) & (p < size), tokens[np.clip(base + p, 0, max(len(tokens) - 1, 0))] if len(tokens) else 0, 0)
            mask = place <= size
            if not mask.any():
                break
            g, h = gradient(m, take(place - 1), take(place), mask, h)
            speed += g * g
            m.flat -= RATE * g / np.sqrt(speed)
            total += int(mask.sum())
    return total


def _score(listed: np.ndarray, model: np.ndarray, tail_sums: np.ndarray, total: int, kinds: int, end_count: int):
    def run(key, batches):
        m, coder = Model(model), _Coder(listed)
        table = pa.Table.from_batches(batches)
        head = table.filter(pc.equal(table["kind"], 0)).to_pylist()[0]
        told = table.filter(pc.equal(table["kind"], 1))
        words, tails = np.frombuffer(head["words"], np.int64), np.frombuffer(head["tails"], np.uint8)
        #: Only counts other than 1 are sent.
        counts = np.ones(len(words), np.int64)
        at = np.searchsorted(words.view(np.uint64), told["word"].to_numpy().view(np.uint64))
        counts[at] = told["c"].to_numpy()
        tokens, sizes = np.frombuffer(head["tokens"], "<u4"), np.frombuffer(head["sizes"], "<i4")
        first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        n = len(sizes)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
        norm = np.log10(total + kinds + 1)
        base = sums(np.log10(counts + 1.0)[tokens]) + np.log10(end_count + 1.0) - (sizes + 1) * norm
        known = sums((counts > 0)[tokens]) + (end_count > 0)
        codes = coder.codes(words, tails)
        inner = np.where(codes >= LISTED, np.log10((counts + 1.0) / (tail_sums[tails] + 1.0)), 0.0)
        score = sums(inner[tokens]) + _model_scores(m, codes[tokens], sizes, first) / np.log(10)
        ids = pa.array(np.frombuffer(head["ids"], "<i8"), mask=np.frombuffer(head["nulls"], np.uint8).astype(bool))
        columns = [ids, pa.array(np.frombuffer(head["held"], np.uint8).astype(bool)), pa.array((sizes + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _model_scores(m: Model, codes: np.ndarray, sizes: np.ndarray, first: np.ndarray, rows: int = 256, window: int = 64) -> np.ndarray:
    """Natural logarithm for each document, windows in turn with the state carried on; documents of like size together."""
    out = np.zeros(len(sizes))
    inputs = m.E @ m.Wx + m.b
    codes = np.append(codes, 0)
    by_size = np.argsort(-sizes, kind="stable")
    for cut in range(0, len(by_size), rows):
        docs = by_size[cut : cut + rows]
        h = np.zeros((len(docs), STATE), np.float32)
        for at in range(0, int(sizes[docs[0]]) + 1, window):
            alive = int(np.searchsorted(-sizes[docs], -at, side="right"))
            docs, h = docs[:alive], h[:alive]
            place = at + np.arange(min(window, int(sizes[docs[0]]) + 1 - at))
            size, base = sizes[docs, None], first[docs, None]
            goal = np.where(place < size, codes[np.minimum(base + place, len(codes) - 1)], 0)
            given = np.concatenate([np.where(at > 0, codes[np.minimum(base + at - 1, len(codes) - 1)], 0), goal[:, :-1]], 1)
            mask = place <= size
            states = np.empty((len(place), len(docs), STATE), np.float32)
            for t in range(len(place)):
                h = m.step(inputs[given[:, t]], h)[0]
                states[t] = h
            live = mask.T.ravel()
            logs = np.zeros(mask.size)
            logs[live] = m.log_probs(states.reshape(-1, STATE)[live], goal.T.ravel()[live])
            out[docs] += logs.reshape(len(place), len(docs)).sum(0)
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """A row for each of docs (doc_id, text): see SCORES. Held out: crc32 of the doc_id as text, mod 7, is 2."""
    spark = docs.sparkSession
    #: Tasks fill the cores; more threads of numpy's in each would only wait for one another. For Python workers started from here on.
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held"), "text")
    shards = staged(rows.mapInArrow(_shards, _SHARD), "lm-shards", "zstd")
    placed = shards.select("shard", "words", "tails", "counts").mapInArrow(_counts, "shard string, word bigint, tail int, n bigint")
    words = staged(placed.groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("c")), "lm-counts")
    total, kinds = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = rows.filter(~F.col("held")).count()
    total, kinds = total + ends, kinds + (ends > 0)
    #: LISTED - 1 words at most come to the driver, and TAILS sums.
    top = words.filter("c > 0").orderBy(F.desc("c"), "word").limit(LISTED - 1).select("word", "c", "tail").collect()
    listed = np.array([r["word"] for r in top], np.int64)
    tail_sums = np.zeros(TAILS)
    for r in words.filter("c > 0").groupBy("tail").agg(F.sum(F.col("c") + 1).alias("s")).collect():
        tail_sums[r["tail"]] = r["s"]
    for r in top:
        tail_sums[r["tail"]] -= r["c"] + 1
    sizes = np.ones(LISTED)
    sizes[0] += ends
    sizes[1 : len(top) + 1] += [r["c"] for r in top]
    model = Model.start(sizes, tail_sums + 1).flat
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)
        part = shards.select("words", "tails", "tokens", "sizes", "held").mapInArrow(_trainer(listed, sent, turn), "k int, v double, w bigint")
        #: One value for each parameter.
        mean = part.groupBy("k").agg((F.sum("v") / F.sum("w")).alias("v")).collect()
        if mean:
            model = np.empty(len(mean), np.float32)
            model[[r["k"] for r in mean]] = [r["v"] for r in mean]
    counted = placed.select("shard", "word").join(words.filter("c <> 1").select("word", "c"), "word")
    both = shards.select("shard", F.lit(0).alias("kind"), "ids", "nulls", "held", "sizes", "words", "tails", "tokens").unionByName(counted.select("shard", F.lit(1).alias("kind"), "word", "c"), allowMissingColumns=True)
    return streamed(both, ["shard"], ["kind"], _score(listed, model, tail_sums, total, kinds, ends), SCORES)


def _trainer(listed: np.ndarray, sent, turn: int):
    def run(batches):
        yield from _train(listed, sent.value, turn)(batches)

    return run
