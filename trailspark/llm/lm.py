"""Language-model scoring with a gated recurrent network.

Counts: every word of every training text is counted by Spark.  The most frequent words
(at most ``HEAD_WORDS``) go to the tasks as a dictionary; the rarer words of a text leave the
task and meet their exact counts in a shuffle join, so the vocabulary may grow without bound.

Network: a GRU over the ``LM_WORDS`` most frequent words, an unknown word and the end, with a softmax
factored into word classes.  It is trained by truncated backpropagation in numpy on all training
texts: tasks grow in number with the tokens, each trains on its part from the common
parameters, and the parameters are averaged by a tree of tasks after each round.  An unknown word is charged its share of the smoothed counts of
all unlisted words, so the model is a distribution over the same tokens as the unigram base.

Scoring: texts are laid end to end on lanes that run side by side; the state starts at zero with each
text and is carried over windows, so a whole text of any length is scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import map_texts, materialize, text_bytes

HEAD_WORDS = 400_000
LM_WORDS = 2_000
HIDDEN = 24
# Share of the training texts that the network learns from: all of them.
SHARE = 1.0
# Tokens that one task trains on from the common parameters, and parameter sets that one task averages.
PART_TOKENS = 1_600_000
FAN_IN = 64
# Lanes of a small part; a larger one has a lane for each LANE_TOKENS tokens, up to MOST_LANES, so that a step is dear only once.
TRAIN_LANES, TRAIN_WINDOW = 32, 24
MOST_LANES, LANE_TOKENS = 128, 12_500
# Learning rates of the rounds; each round reads all the texts.
RATES = (0.02,)
# A longer text is learned from in stretches on several lanes, so that no window holds one text alone.
STRETCH = 512
LANES, WINDOW = 256, 64
# Tokens that one task holds at once.
BUFFER_TOKENS = 3_000_000
SMOOTH = 0.1
END, UNK = 0, 1


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one text after another, and how many each has; [A-Z] is lower-cased, words are runs of anything
    but space and \\t\\n\\v\\f\\r, and a null text has none."""
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words = pieces.flatten().view(pa.binary())
    real = pc.not_equal(pc.binary_length(words), 0)  # a piece before the first space or after the last is empty
    row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False))
    return words.filter(real), np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def places(words: pa.Array | pa.ChunkedArray, known: pa.Array) -> np.ndarray:
    """Place of each word among the ``known`` ones, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False)


def with_ends(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts of ``n`` words with the end after each text, and the places after these ends."""
    ends = np.cumsum(n + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, ids.dtype)
    word = np.ones(len(out), bool)
    word[ends - 1] = False
    out[word] = ids
    return out, ends


# ---------------------------------------------------------------- network

def classes(n: int) -> np.ndarray:
    """First ids of the word classes for ``n`` tokens, and ``n``: class ``j`` holds the ids from ``4 * j * j`` on, so the frequent
    tokens, which come first, share their class with few others."""
    return np.append(4 * np.arange(math.isqrt(max(n - 1, 0) // 4) + 1) ** 2, n)


def class_of(ids: np.ndarray) -> np.ndarray:
    return (np.sqrt(ids) / 2).astype(np.int16)


def new_params(freq: np.ndarray, hidden: int = HIDDEN, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters that start as the unigram model; token ids are ordered so that neighbours share a class."""
    rng = np.random.default_rng(seed)
    n = len(freq)
    first = classes(n)
    p = (freq + 0.5) / (freq.sum() + 0.5 * n)
    mass = np.add.reduceat(p, first[:-1])
    f = np.float32
    return {"x": rng.normal(0, 0.1, (n + 1, 3 * hidden)).astype(f),  # the last row starts a text
            "u": rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(f), "b": np.zeros(3 * hidden, f),
            "wc": rng.normal(0, 0.05, (hidden, len(mass))).astype(f), "bc": np.log(mass).astype(f),
            "ww": rng.normal(0, 0.05, (n, hidden)).astype(f), "bw": np.log(p / np.repeat(mass, np.diff(first))).astype(f)}


def gru_states(p, h, tokens, start, tape=None):
    """States after every step of all lanes, as (step, unit, lane); a lane that starts a text forgets its state.

    The last axis is that of the lanes, so gates are whole blocks.  ``tape`` gets what backpropagation needs.
    """
    steps, (lanes, hidden) = len(tokens), h.shape
    # the gates' sums are negated for 1 / (1 + exp(-x))
    sign = np.repeat(np.array([-1, -1, 1], p["u"].dtype), hidden)
    u, x = np.ascontiguousarray((p["u"] * sign).T), (p["x"] + p["b"]) * sign
    begins = tokens == start
    some = begins.any(axis=1).tolist()
    dtype = x.dtype
    states = np.empty((steps, hidden, lanes), dtype)
    if tape is not None and tape.get("sums", x).shape != (steps, 3 * hidden, lanes):
        tape["sums"] = np.empty((steps, 3 * hidden, lanes), dtype)
        tape["prev"], tape["n"] = np.empty_like(states), np.empty_like(states)
        tape["zr"], tape["gn"] = tape["sums"][:, :2 * hidden], tape["sums"][:, 2 * hidden:]
    # one step's numbers only, which stay in the cache
    row, g = np.empty((lanes, 3 * hidden), dtype), np.empty((3 * hidden, lanes), dtype)
    a = row.T
    h, n, d = np.array(h.T, dtype, order="C"), np.empty((hidden, lanes), dtype), np.empty((hidden, lanes), dtype)
    with np.errstate(over="ignore"):  # a gate whose exponential is infinite is zero
        for t in range(steps):
            if some[t]:
                h = h * ~begins[t]
            if tape is not None:
                tape["prev"][t], g, n = h, tape["sums"][t], tape["n"][t]
            np.take(x, tokens[t], axis=0, out=row, mode="clip")
            np.matmul(u, h, out=g)
            zr = g[:2 * hidden]
            zr += a[:2 * hidden]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(g[2 * hidden:], zr[hidden:], out=n)
            n += a[2 * hidden:]
            np.tanh(n, out=n)
            np.subtract(h, n, out=d)
            d *= zr[:hidden]
            h = np.add(n, d, out=states[t])
    return states


def gru_step(p, h, tokens, start):
    """One step of all lanes: their new states, and None."""
    return gru_states(p, h, tokens[None], start)[0].T, None


def token_log(p, h, target, grads=None):
    """Natural logarithms of the targets' probabilities; with ``grads`` also the gradient of -sum by h."""
    first = classes(len(p["bw"]))
    cls = class_of(target)
    order = np.argsort(cls, kind="stable")  # tokens of a class lie side by side
    cls, target, rows = cls[order], target[order], np.arange(len(order))
    units = h.shape[1]
    # the last column of ones meets the biases, so one product does for both
    hs = np.ones((len(order), units + 1), p["wc"].dtype)
    hs[:, :units] = np.take(h, order, axis=0, mode="clip")
    hs = hs.T
    wc, ww = np.vstack([p["wc"], p["bc"]]).T, np.column_stack([p["ww"], p["bw"]])
    size = [(np.abs(w) @ np.append(np.ones(units, w.dtype), 0), w[:, -1]) for w in (wc, ww)]
    far = any((b + x).max() > 80 or (b - x).max() < -80 for x, b in size)  # states lie in (-1, 1), so else nothing overflows

    def softmax(w, x, at, total):
        """Sums of the softmax of lines ``w`` at the places ``at``, and the gradient of -sum by them; ``total`` gets the divisors."""
        e = w @ x
        if far:
            e -= e.max(axis=0)
        line = rows[:len(at)]
        log = e[at, line]
        np.exp(e, out=e)
        np.add.reduce(e, axis=0, out=total)
        if grads is not None:
            e *= 1 / total
            e[at, line] -= 1
        return log, e

    totals = np.ones((2, len(order)), hs.dtype)
    log, d = softmax(wc, hs, cls, totals[0])
    dh = None
    if grads is not None:
        g = d @ hs.T
        grads["wc"] += g[:, :-1].T
        grads["bc"] += g[:, -1]
        dh = d.T @ p["wc"].T
    bounds = np.searchsorted(cls, np.arange(len(first))).tolist()
    starts = first.tolist()
    place = target - first[cls]
    for j in range(len(first) - 1):
        i, k, lo, hi = bounds[j], bounds[j + 1], starts[j], starts[j + 1]
        if i == k or hi - lo == 1:  # the only token of a class
            continue
        x, w = hs[:, i:k], ww[lo:hi]
        inner, d = softmax(w, x, place[i:k], totals[1, i:k])
        log[i:k] += inner
        if grads is not None:
            g = d @ x.T
            grads["ww"][lo:hi] += g[:, :-1]
            grads["bw"][lo:hi] += g[:, -1]
            dh[i:k] += d.T @ w[:, :-1]
    log -= np.log(totals).sum(axis=0)
    out = np.empty_like(log)
    out[order] = log
    if dh is not None:
        back = np.empty_like(order)
        back[order] = rows
        dh = np.take(dh, back, axis=0, mode="clip")
    return out, dh


def _flat(states: np.ndarray) -> np.ndarray:
    """States of a window, (step, unit, lane), as (place, unit)."""
    return np.ascontiguousarray(states.transpose(0, 2, 1)).reshape(-1, states.shape[1])


def sums_by_token(rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens, and the sum of the rows of each."""
    by = np.argsort(tokens, kind="stable")
    rows, tokens = np.take(rows, by, axis=0, mode="clip"), tokens[by]
    at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    n = np.diff(np.append(at, len(tokens)))
    sums = np.take(rows, at, axis=0, mode="clip")
    # the second rows of all tokens, their third rows and so on; a frequent token's rows at once
    for k in range(1, min(FEW, int(n.max()))):
        some = np.flatnonzero((n > k) & (n <= FEW))
        sums[some] += rows[at[some] + k]
    for i in np.flatnonzero(n > FEW).tolist():
        np.add.reduce(rows[at[i]:at[i] + n[i]], axis=0, out=sums[i])
    return tokens[at], sums


def lay_out(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts on lanes of about equal length: the longest first, each on the shortest lane."""
    import heapq

    heap = [(0, i) for i in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for t in np.argsort(-lengths, kind="stable").tolist():
        total, i = heapq.heappop(heap)
        out[i].append(t)
        heapq.heappush(heap, (total + int(lengths[t]), i))
    return sorted(out, key=lambda lane: -int(lengths[lane].sum()))


def lanes_of(texts: list[np.ndarray], lanes: int, start: int):
    """Flat inputs and targets lane by lane, offsets and lengths of lanes (longest first), texts in flat order."""
    lengths = np.array([len(t) for t in texts])
    layout = lay_out(lengths, lanes)
    order = [t for lane in layout for t in lane]
    target = np.concatenate([texts[t] for t in order])
    first = np.cumsum(lengths[order]) - lengths[order]
    inputs = np.empty_like(target)
    inputs[1:] = target[:-1]
    inputs[first] = start
    size = np.array([int(lengths[lane].sum()) for lane in layout])
    return inputs, target, np.cumsum(size) - size, size, order, first


def score_texts(p: dict[str, np.ndarray], texts: list[np.ndarray], lanes: int = LANES, window: int = WINDOW) -> np.ndarray:
    """Log likelihood (natural) of each whole text, given as token ids that end with END."""
    if not texts:
        return np.zeros(0)
    start = len(p["x"]) - 1
    inputs, target, offset, size, order, first = lanes_of(texts, lanes, start)
    logs = np.empty(len(target))
    h = np.zeros((len(size), p["u"].shape[0]), np.float32)
    for t0 in range(0, int(size[0]), window):
        live = int(np.searchsorted(-size, -t0))  # lanes longer than t0
        h = h[:live]
        steps = min(window, int(size[0]) - t0)
        place = offset[:live] + t0 + np.arange(steps)[:, None]
        inside = (t0 + np.arange(steps))[:, None] < size[:live]
        if inside.all():
            states = gru_states(p, h, inputs[place], start)
            at, flat = place.ravel(), _flat(states)
        else:
            states = gru_states(p, h, inputs[np.where(inside, place, offset[:live])], start)
            at, flat = place[inside], _flat(states)[inside.ravel()]
        h = states[-1].T
        logs[at] = token_log(p, flat, target[at])[0]
    out = np.empty(len(texts))
    out[order] = np.add.reduceat(logs, first)
    return out


# Numbers that one step of Adam works on at once.
BLOCK = 1 << 15
# Rows of a token in a window; a token with more has them added at once.
FEW = 12


class Trainer:
    """Adam on truncated windows; the state is carried from window to window.  All parameters lie in one array."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.tape = {}  # its arrays serve all windows of one shape
        self.flat = np.concatenate([v.ravel() for v in p.values()])
        self.moments, self.grads = np.zeros((2, self.flat.size), self.flat.dtype), np.zeros_like(self.flat)
        ends = np.cumsum([v.size for v in p.values()])
        views = [{k: x[e - v.size:e].reshape(v.shape) for e, (k, v) in zip(ends, p.items(), strict=True)}
                 for x in (self.flat, *self.moments, self.grads)]
        self.p, self.m, self.v, self.g = views

    def window(self, h, tokens, target, start, inside=None):
        """One step on a window; ``inside`` marks the places before the lanes' ends (default: all)."""
        p, g, hidden = self.p, self.g, h.shape[1]
        inside = np.ones(target.shape, bool) if inside is None else inside
        self.grads[:] = 0
        tape = self.tape
        states = gru_states(p, h, tokens, start, tape)
        steps, _, lanes = states.shape
        if inside.all():
            dout = token_log(p, _flat(states), target.ravel(), g)[1]
        else:
            dout = np.zeros((steps * lanes, hidden), states.dtype)
            dout[inside.ravel()] = token_log(p, _flat(states)[inside.ravel()], target[inside], g)[1]
        dout = np.ascontiguousarray(dout.reshape(steps, lanes, hidden).transpose(0, 2, 1))
        z, r, n = tape["zr"][:, :hidden], tape["zr"][:, hidden:], tape["n"]
        rest, by_r, by_n = 1 - z, 1 - r, n * n
        np.subtract(1, by_n, out=by_n)
        by_n *= rest
        by_r *= r
        by_r *= tape["gn"]
        by_z = tape["prev"] - n
        by_z *= rest
        by_z *= z
        begins = tokens == start
        some = begins.any(axis=1).tolist()
        dh = np.zeros((hidden, lanes), states.dtype)
        by_new = np.empty((steps, hidden, lanes), states.dtype)
        dg = np.empty((steps, 3 * hidden, lanes), states.dtype)  # by the sums of the state's part
        for t in range(steps - 1, -1, -1):
            dh += dout[t]
            now, dn = dg[t], by_new[t]
            np.multiply(dh, by_n[t], out=dn)
            np.multiply(dh, by_z[t], out=now[:hidden])
            np.multiply(dn, by_r[t], out=now[hidden:2 * hidden])
            np.multiply(dn, r[t], out=now[2 * hidden:])
            dh *= z[t]
            dh += p["u"] @ now
            if some[t]:
                dh *= ~begins[t]
        g["u"] += np.matmul(tape["prev"], dg.transpose(0, 2, 1)).sum(axis=0)
        da = np.empty((steps, lanes, 3 * hidden), states.dtype)
        da[..., :2 * hidden], da[..., 2 * hidden:] = dg[:, :2 * hidden].transpose(0, 2, 1), by_new.transpose(0, 2, 1)
        token, sums = sums_by_token(da.reshape(-1, 3 * hidden), tokens.ravel().astype(np.int16 if start < 1 << 15 else np.int64))
        g["x"][token] = sums
        g["b"] += sums.sum(axis=0)
        self._adam(1 / int(inside.sum()))
        return states[-1].T

    def _adam(self, scale: float) -> None:
        """One step along the gradient times ``scale``, cut to length one."""
        norm = math.sqrt(float(self.grads @ self.grads)) * scale
        scale *= min(1.0, 1.0 / (norm + 1e-9))
        self.step += 1
        # the moments are sums of which Adam takes a tenth and a hundredth
        root = 0.1 / math.sqrt(1 - 0.99 ** self.step)
        rate = 0.1 * self.rate / (1 - 0.9 ** self.step) / root
        for i in range(0, self.flat.size, BLOCK):
            x, m, v = self.grads[i:i + BLOCK], self.moments[0, i:i + BLOCK], self.moments[1, i:i + BLOCK]
            x *= scale
            m *= 0.9
            m += x
            x *= x
            v *= 0.99
            v += x
            np.sqrt(v, out=x)
            x += 1e-6 / root
            np.divide(m, x, out=x)
            x *= rate
            self.flat[i:i + BLOCK] -= x

    def texts(self, texts: list[np.ndarray], lanes: int = TRAIN_LANES, window: int = TRAIN_WINDOW) -> None:
        start = len(self.p["x"]) - 1
        stretches = [t[i:i + STRETCH] for t in texts for i in range(0, len(t), STRETCH)]
        inputs, target, offset, size, _, _ = lanes_of(stretches, lanes, start)
        h = np.zeros((len(size), self.p["u"].shape[0]), np.float32)
        for t0 in range(0, int(size[0]), window):
            steps = min(window, int(size[0]) - t0)
            live = int(np.searchsorted(-size, -t0))  # lanes longer than t0
            inside = (t0 + np.arange(steps))[:, None] < size[:live]
            place = np.where(inside, offset[:live] + t0 + np.arange(steps)[:, None], offset[:live])
            h = self.window(h[:live], inputs[place], target[place], start, inside)


# ---------------------------------------------------------------- Spark side

@dataclass
class Counts:
    table: DataFrame  # word, c of all training texts
    n_tokens: int
    n_types: int
    n_texts: int
    head_min: int  # words of at least this count are in ``head``
    head: dict[bytes, int]


def count_words(train: DataFrame, text: str = "text", head_words: int = HEAD_WORDS) -> Counts:
    """Counts of all words of all training texts; the end of a text is a token of its own."""
    def run(batches):
        held, n = [], 0

        def flush():
            found = pc.value_counts(pa.chunked_array(held, pa.binary()))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "c"])

        for b in batches:
            held.append(words_in(b.column(0))[0])
            n += len(held[-1])
            if n >= BUFFER_TOKENS:
                yield flush()
                n = 0
        yield flush()

    n_texts = train.count()
    table = materialize(map_texts(train.select(text_bytes(text)), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    level = F.floor(8 * F.log2("c"))  # levels of counts, a few hundred
    rows = table.groupBy(level.alias("l")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least")).orderBy(F.desc("l")).collect()
    total, least = 0, None
    for r in rows:
        total += r["n"]
        if total > head_words:
            break
        least = r["least"]
    head_min = least if least is not None else 1 << 62
    head = {bytes(r["word"]): r["c"] for r in table.where(F.col("c") >= head_min).toLocalIterator()}  # at most head_words
    return Counts(table, sum(r["c"] for r in rows) + n_texts, sum(r["n"] for r in rows) + (n_texts > 0), n_texts, head_min, head)


@dataclass
class Model:
    params: dict[str, np.ndarray]
    ids: dict[bytes, int]  # words of the network
    unlisted: float  # smoothed counts of all words that are not listed, unseen ones included
    learned: int = 0  # tokens that the network learned from in the last round


def vocabulary(counts: Counts, size: int = LM_WORDS) -> tuple[dict[bytes, int], np.ndarray, float]:
    top = sorted(counts.head.items(), key=lambda x: (-x[1], x[0]))[:size]
    freq = np.array([counts.n_texts, counts.n_tokens - counts.n_texts - sum(c for _, c in top), *[c for _, c in top]], float)
    smoothed = counts.n_tokens + SMOOTH * (counts.n_types + 1)
    return {w: i + 2 for i, (w, _) in enumerate(top)}, freq, smoothed - sum(c + SMOOTH for _, c in top) - (counts.n_texts + SMOOTH)


def fit(train: DataFrame, counts: Counts, doc_id: str = "doc_id", text: str = "text", share: float = SHARE,
        rates: tuple[float, ...] = RATES) -> Model:
    """Train the network on all texts: rounds of truncated backpropagation in tasks of about ``PART_TOKENS``
    tokens, then the mean of their parameters.

    With a ``share`` below one, texts are drawn by id and text, so rows without an id are drawn for themselves.
    """
    ids, freq, unlisted = vocabulary(counts)
    params = new_params(freq)
    spark = train.sparkSession
    known = spark.sparkContext.broadcast(pa.array(list(ids), pa.binary()))

    def encode(batches):
        for b in batches:
            words, n = words_in(b.column(0))
            at = places(words, known.value)
            out, ends = with_ends(np.where(at < 0, UNK, at + 2).astype(np.int32), n)
            rows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int32)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([rows], names=["ids"])

    u = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("lm")),
               F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = materialize(map_texts((train.where(u < share) if share < 1 else train).select(text_bytes(text)), encode, "ids binary"))
    tokens = sample.agg(F.sum(F.length("ids") / 4)).first()[0] or 0
    parts = max(1, math.ceil(tokens / PART_TOKENS))
    names, learned = sorted(params), 0
    for rate in rates:
        now = spark.sparkContext.broadcast(params)

        def learn(batches, now=now, rate=rate):
            trainer, held, n, total = Trainer({k: v.copy() for k, v in now.value.items()}, rate), [], 0, 0
            for b in batches:
                for x in b.column(0).to_pylist():
                    held.append(np.frombuffer(x, np.int32).astype(np.int64))
                    n += len(held[-1])
                if n >= BUFFER_TOKENS:
                    trainer.texts(held, _lanes(n))
                    total, held, n = total + n, [], 0
            if held:
                trainer.texts(held, _lanes(n))
                total += n
            if total:
                yield _sums(total, np.concatenate([trainer.p[k].ravel() for k in names]).astype(np.float64) * total)

        sums = map_texts(sample.repartition(parts), learn, "n long, p binary")
        left = parts
        while left > 1:  # a tree of tasks adds up the parameters, so the driver gets one row
            left = -(-left // FAN_IN)
            sums = map_texts(materialize(sums).repartition(left), _add, "n long, p binary")
        got = sums.collect()
        if not got:
            break
        learned = got[0]["n"]
        mean = (np.frombuffer(bytes(got[0]["p"]), np.float64) / learned).astype(np.float32)
        at = 0
        for k in names:
            size = params[k].size
            params[k] = mean[at:at + size].reshape(params[k].shape)
            at += size
    return Model(params, ids, unlisted, learned)


def _lanes(tokens: int) -> int:
    return min(MOST_LANES, max(TRAIN_LANES, tokens // LANE_TOKENS))


def _sums(n: int, p: np.ndarray) -> pa.RecordBatch:
    """Tokens learned from, and parameters times tokens."""
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([p.tobytes()], pa.binary())], names=["n", "p"])


def _add(batches):
    total, p = 0, None
    for b in batches:
        for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(x, np.float64)
            total, p = total + n, x if p is None else p + x
    if p is not None:
        yield _sums(total, p)


def score(docs: DataFrame, counts: Counts, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row of ``docs``.

    Scores are log10 probabilities of whole texts.  A null text is an empty one (its end is its only
    token); repeated rows are scored each; an empty table gives an empty result.
    Without any training token every score is that of the smoothed counts alone.
    """
    sc = docs.sparkSession.sparkContext
    # words of the network by their ids, then the other words of the dictionary
    ordered = [*model.ids, *(counts.head.keys() - model.ids.keys())]
    log_c = np.append(np.log10(np.array([counts.head[w] for w in ordered], float) + SMOOTH), 0)  # the last for any other word
    shared = sc.broadcast((pa.array(ordered, pa.binary()), log_c, model.params, len(model.ids)))
    n_all = counts.n_tokens + SMOOTH * (counts.n_types + 1)
    trained, end_count = counts.n_tokens > 0, counts.n_texts
    log_all, log_unlisted = math.log10(n_all), math.log10(max(model.unlisted, 1e-300))

    def run(batches):
        known, log_c, params, listed = shared.value
        part, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        tokens = 0

        def flush():
            nonlocal serial
            n, names_of = np.concatenate([h[2] for h in held]), pa.concat_arrays([h[0] for h in held])
            words = pa.chunked_array([h[1] for h in held], pa.binary())
            held.clear()
            row = np.repeat(np.arange(len(n), dtype=np.int32), n)
            at = places(words, known)  # the known words begin with those of the network
            add = lambda rows, x=None: np.bincount(rows, x, len(n))
            log, unlisted, far = log_c[at], (at < 0) | (at >= listed), at < 0
            base = add(row, log) - log_all * (n + 1) + math.log10(end_count + SMOOTH)
            extra = add(row[unlisted], log[unlisted]) - log_unlisted * add(row[unlisted])
            del log
            # the other words, once for each text
            rare, rows = words.filter(pa.array(far)).combine_chunks().dictionary_encode(), row[far].astype(np.int64)
            del words, row, far
            kinds = max(1, len(rare.dictionary))
            key, times = np.unique(rows * kinds + rare.indices.to_numpy(), return_counts=True)
            text, kind = np.divmod(key, kinds)
            first = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
            if trained:
                ids, ends = with_ends(np.where(unlisted, np.int32(UNK), at + np.int32(2)), n)
                del at, unlisted  # what scoring does not need is not held while it runs
                extra += score_texts(params, np.split(ids, ends[:-1])) / math.log(10)
            out = pa.RecordBatch.from_arrays(
                [pa.array((part << 33) + serial + np.arange(len(n))), names_of, pa.array(n + 1), pa.array(n - add(rows) + (end_count > 0)),
                 pa.array(base), pa.array(extra), pa.ListArray.from_arrays(first, rare.dictionary.take(pa.array(kind))),
                 pa.ListArray.from_arrays(first, pa.array(times.astype(np.int32)))], names=names)
            serial += len(n)
            return out

        for b in batches:
            held.append((b.column(0), *words_in(b.column(1))))
            tokens += len(held[-1][1]) + b.num_rows
            if tokens >= BUFFER_TOKENS:
                yield flush()
                tokens = 0
        if tokens:
            yield flush()

    names = ["uid", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare", "rare_n"]
    src = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("t"))
    schema = src.select(F.lit(0).cast("long").alias("uid"), "doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
                        F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.lit(None).cast("array<binary>").alias("rare"),
                        F.lit(None).cast("array<int>").alias("rare_n")).schema
    first = materialize(map_texts(src, run, schema))
    # words outside the dictionary: exact counts by a join, all of them unlisted in the network
    rare = first.select("uid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    tail = counts.table.where(F.col("c") < counts.head_min)
    c = F.coalesce("c", F.lit(0))
    gained = rare.join(tail, "word", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"), F.sum(F.col("n") * F.log10(c + F.lit(SMOOTH))).alias("logs"))
    out = first.drop("rare", "rare_n").join(gained, "uid", "left")
    model_score = F.col("score") + F.coalesce("logs", F.lit(0.0))
    base = F.col("base_score") + F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
                      base.alias("base_score"), (model_score if trained else base).alias("score"))
