"""Toxicity by a bidirectional GRU with attention pooling over word and
character inputs, trained in numpy.

A word (a run of anything but ASCII blanks, A-Z lower-cased; runs of more than
``WORD_CHARS`` characters count as several words) enters as the sum of two
projections: of a learned vector of its hash bucket, and of the last states of
a bidirectional GRU over its characters.  A bidirectional GRU reads windows of
``WINDOW`` words that start every ``STRIDE`` words and together cover the whole
text; attention pools each window's states into one logit.  A text's score is
that of its most toxic window, so one insult in a long text is not diluted.
A text without words is read as one empty word.

Training uses at most ``SAMPLE`` labelled rows of either class, the smallest by a
hash of their text, of at most ``TRAIN_WORDS`` words each.  A row's label says
nothing about which window is toxic: the first round learns from random windows
of the rows, every later one scores all windows and learns from the highest of
each row, so also from the clean windows that look most toxic, until hardly a row is
on the wrong side.  Only the text is an input.  Null texts
are empty; null labels and labels of unknown ids are not trained on.  Without
labelled rows of both classes the untrained network's scores are those of its
bias, the share of toxic rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .exact_dedup import normalise
from .neural import Adam, gru, gru_back, gru_states, half_gates, init, sigmoid, sum_by

#: Rows with crc32(id) mod FOLDS equal to HELD_OUT give no labels.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
WINDOW, STRIDE = 64, 48
WORD_CHARS = 32
BUCKETS, WORD_DIM, CHAR_DIM, CHAR_STATE, STATE = 4096, 8, 8, 12, 8
CHARS = 512
SAMPLE, TRAIN_WORDS = {1: 1500, 0: 4000}, 1500
ROUNDS, STEPS, RATE = 8, 70, 0.015
#: Training ends when, after a round, so small a share of the sampled rows is on the wrong side of the threshold.
DONE = 0.002
#: Windows of toxic and clean rows in a step.
TOXIC, CLEAN = 16, 32
SEED = 11


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def words_of(text: str | None) -> list[bytes]:
    out = normalise(text).split()
    if any(len(w) > WORD_CHARS for w in out):
        whole, out = out, []
        for w in whole:
            s = w.decode("utf-8", "replace")
            out += [s[k:k + WORD_CHARS].encode("utf-8", "surrogatepass") for k in range(0, len(s), WORD_CHARS)]
    return out or [b""]


def windows_of(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows of texts laid end to end."""
    text, first, size, at = [], [], [], 0
    for k, n in enumerate(counts):
        number = 1 if n <= WINDOW else 1 - (-(n - WINDOW) // STRIDE)
        start = np.arange(number) * STRIDE
        text.append(np.full(number, k))
        first.append(at + start)
        size.append(np.minimum(WINDOW, n - start))
        at += n
    return np.concatenate(text), np.concatenate(first), np.concatenate(size)


class Network:
    """The network's parameters, its scores and its gradients."""

    def __init__(self, seed: int = SEED, prior: float = 0.1):
        rng = np.random.default_rng(seed)
        p = {"words": init(rng, BUCKETS, WORD_DIM) * np.float32(BUCKETS ** 0.5 * 0.1),
             "chars": init(rng, CHARS, CHAR_DIM) * np.float32(CHARS ** 0.5 * 0.3)}
        for d in "fb":
            p |= {f"cw{d}": init(rng, CHAR_DIM, 3 * CHAR_STATE), f"cu{d}": init(rng, CHAR_STATE, 3 * CHAR_STATE),
                  f"cb{d}": np.zeros(3 * CHAR_STATE, np.float32), f"cc{d}": np.zeros(CHAR_STATE, np.float32),
                  f"ww{d}": init(rng, WORD_DIM + 2 * CHAR_STATE, 3 * STATE), f"wu{d}": init(rng, STATE, 3 * STATE),
                  f"wb{d}": np.zeros(3 * STATE, np.float32), f"wc{d}": np.zeros(STATE, np.float32)}
        p |= {"att": init(rng, 2 * STATE, STATE), "attb": np.zeros(STATE, np.float32), "attv": init(rng, STATE),
              "out": init(rng, 2 * STATE), "outb": np.array([np.log(prior / (1 - prior))], np.float32)}
        self.p = p

    # words: bucket and characters, padded to the longest
    @staticmethod
    def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        buckets = np.array([zlib.crc32(w.strip(b".,;:!?\"'()[]|*%&$-")) % BUCKETS for w in words], np.int64)
        text = [w.decode("utf-8", "replace") for w in words]
        lengths = np.array([len(s) for s in text], np.int64)
        longest = max(int(lengths.max()), 1)
        points = np.frombuffer("".join(s.ljust(longest, "\0") for s in text).encode("utf-32-le"), np.uint32)
        return buckets, (points.reshape(len(words), longest).T % CHARS).astype(np.int64), lengths

    def char_states(self, chars: np.ndarray, lengths: np.ndarray):
        """Last states of both directions, and by blocks of like lengths what gradients need."""
        p = self.p
        out, saved = np.empty((len(lengths), 2 * CHAR_STATE), p["chars"].dtype), []
        tables = {d: p["chars"] @ p[f"cw{d}"] + p[f"cb{d}"] for d in "fb"}
        order = np.argsort(lengths, kind="stable")
        for at in np.array_split(order, 1 + len(order) // 512):
            steps = max(int(lengths[at].max()), 1)
            mask = (np.arange(steps)[:, None] < lengths[at]).astype(np.float32)
            for k, d in enumerate("fb"):
                way = slice(None) if d == "f" else slice(None, None, -1)
                read, m = chars[:steps, at][way], mask[way]
                states, kept = gru(tables[d][read], m, p[f"cu{d}"], p[f"cc{d}"], True)
                out[at, k * CHAR_STATE:(k + 1) * CHAR_STATE] = states[-1]
                saved.append((k, d, at, kept, m, read))
        return out, saved

    def project(self, words: list[bytes]) -> np.ndarray:
        """Per word what the window GRUs read: forward, then backward."""
        p = self.p
        tables = {d: half_gates(p["chars"] @ p[f"cw{d}"] + p[f"cb{d}"]) for d in "fb"}
        both = half_gates(np.stack([p["wwf"], p["wwb"]])), half_gates(np.stack([p["wbf"], p["wbb"]]))
        out = np.empty((len(words), 6 * STATE), np.float32)
        by_length = np.argsort([len(w) for w in words], kind="stable")
        for lo in range(0, len(words), 1024):
            at = by_length[lo:lo + 1024]
            buckets, chars, lengths = self.spell([words[i] for i in at])
            mask = (np.arange(len(chars))[:, None] < lengths).astype(np.float32)
            x = [p["words"][buckets]]
            for d in "fb":
                order = slice(None) if d == "f" else slice(None, None, -1)
                states = np.empty((len(chars), CHAR_STATE, len(at)), np.float32)
                gru_states(tables[d], chars[order], mask[order], half_gates(p[f"cu{d}"]), p[f"cc{d}"], states)
                x.append(states[-1].T)
            x = np.concatenate(x, 1)
            out[at] = np.concatenate([x @ both[0][k] + both[1][k] for k in range(2)], 1)
        return out

    def pool(self, proj: dict[str, np.ndarray], mask: np.ndarray):
        """Logits of windows, and what their gradients need."""
        p, parts, saved = self.p, [], {}
        for d in "fb":
            m = mask if d == "f" else mask[::-1]
            states, steps = gru(proj[d] if d == "f" else proj[d][::-1], m, p[f"wu{d}"], p[f"wc{d}"], True)
            saved[d] = steps, m
            parts.append(states if d == "f" else states[::-1])
        h = np.concatenate(parts, 2)
        hidden = np.tanh(h @ p["att"] + p["attb"])
        e = np.where(mask > 0, hidden @ p["attv"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        value = h @ p["out"]
        return (a * value).sum(0) + p["outb"][0], (h, hidden, a, value, saved)

    def logits(self, ids: np.ndarray, table: np.ndarray, first: np.ndarray, size: np.ndarray, block: int = 512) -> np.ndarray:
        """Logits of the windows (first, size) over word ids; ``table`` projects the ids."""
        p = self.p
        out = np.empty(len(first), np.float32)
        tables = [np.ascontiguousarray(table[:, k * 3 * STATE:(k + 1) * 3 * STATE]) for k in range(2)]
        u = [half_gates(p["wuf"]), half_gates(p["wub"])]
        att, v = np.ascontiguousarray(p["att"].T), np.stack([p["attv"]])
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), block):
            at = order[lo:lo + block]
            steps = int(size[at[-1]])
            grid = np.arange(steps)[:, None]
            inside = grid < size[at]
            word = ids[np.where(inside, first[at] + grid, first[at])]
            mask = None if inside.all() else inside.astype(np.float32)
            h = np.empty((2, steps, STATE, len(at)), np.float32)
            gru_states(tables[0], word, mask, u[0], p["wcf"], h[0])
            gru_states(tables[1], word[::-1], None if mask is None else mask[::-1], u[1], p["wcb"], h[1])
            h = np.concatenate([h[0], h[1, ::-1]], 1)
            hidden = np.matmul(att, h)
            hidden += p["attb"][:, None]
            e = np.matmul(v, np.tanh(hidden, out=hidden))[:, 0]
            if mask is not None:
                e[~inside] = -1e9
            a = np.exp(e - e.max(0))
            out[at] = (a * np.matmul(p["out"], h)).sum(0) / a.sum(0) + p["outb"][0]
        return out

    def learn(self, windows: list[list[bytes]], labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients over single windows."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for win in windows for w in win))}
        buckets, chars, lengths = self.spell(list(vocabulary))
        spelled, saved_chars = self.char_states(chars, lengths)
        x = np.concatenate([p["words"][buckets], spelled], 1)
        steps = max(map(len, windows))
        ids, mask = np.zeros((steps, len(windows)), np.int64), np.zeros((steps, len(windows)), np.float32)
        for k, win in enumerate(windows):
            ids[:len(win), k] = [vocabulary[w] for w in win]
            mask[:len(win), k] = 1
        logit, (h, hidden, a, value, saved) = self.pool({d: (x @ p[f"ww{d}"] + p[f"wb{d}"])[ids] for d in "fb"}, mask)
        prob = sigmoid(logit)
        loss = -float((weights * np.where(labels == 1, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))).sum() / weights.sum())
        dl = ((prob - labels) * weights / weights.sum()).astype(np.float32)
        g["outb"][0] = dl.sum()
        dvalue = a * dl
        da = value * dl
        de = a * (da - (a * da).sum(0))
        g["out"] = np.tensordot(dvalue, h, ([0, 1], [0, 1])).astype(np.float32)
        g["attv"] = np.tensordot(de, hidden, ([0, 1], [0, 1])).astype(np.float32)
        dpre = de[..., None] * p["attv"] * (1 - hidden * hidden)
        g["att"] = np.tensordot(h, dpre, ([0, 1], [0, 1])).astype(np.float32)
        g["attb"] = dpre.sum((0, 1))
        dh = dvalue[..., None] * p["out"] + dpre @ p["att"].T
        dx = np.zeros_like(x)
        for d in "fb":
            part = dh[..., :STATE] if d == "f" else dh[::-1, :, STATE:]
            states, m = saved[d]
            dproj, g[f"wu{d}"], g[f"wc{d}"] = gru_back(part, states, m, p[f"wu{d}"])
            if d == "b":
                dproj = dproj[::-1]
            dproj = dproj * mask[..., None]
            dtable = sum_by(len(vocabulary), ids, dproj)
            g[f"ww{d}"] = x.T @ dtable
            g[f"wb{d}"] = dtable.sum(0)
            dx += dtable @ p[f"ww{d}"].T
        g["words"] += sum_by(BUCKETS, buckets, dx[:, :WORD_DIM])
        dtables = {d: np.zeros((CHARS, 3 * CHAR_STATE), np.float32) for d in "fb"}
        for k, d, at, kept, m, read in saved_chars:
            last = np.zeros((len(read), len(at), CHAR_STATE), np.float32)
            last[-1] = dx[at, WORD_DIM + k * CHAR_STATE:WORD_DIM + (k + 1) * CHAR_STATE]
            dproj, du, dc = gru_back(last, kept, m, p[f"cu{d}"])
            g[f"cu{d}"] += du
            g[f"cc{d}"] += dc
            dtables[d] += sum_by(CHARS, read, dproj)
        for d, dtable in dtables.items():
            g[f"cw{d}"] = p["chars"].T @ dtable
            g[f"cb{d}"] = dtable.sum(0)
            g["chars"] += dtable @ p[f"cw{d}"].T
        return loss, g


def fit(rows: list[tuple[str | None, int]], rounds: int = ROUNDS, steps: int = STEPS, seed: int = SEED) -> Network:
    """Train on (text, label) rows."""
    docs = [words_of(t) for t, _ in rows]
    labels = np.array([y for _, y in rows], np.int64)
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    net = Network(seed, min(max(float(labels.mean()) if len(labels) else 0.1, 0.01), 0.99))
    if not len(toxic) or not len(clean):
        net.p["out"][:] = 0
        return net
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for doc in docs for w in doc))}
    ids = np.array([vocabulary[w] for doc in docs for w in doc], np.int64)
    words = list(vocabulary)
    text, first, size = windows_of([len(d) for d in docs])
    of = np.searchsorted(text, np.arange(len(docs) + 1))  # each row's windows
    rng, adam = np.random.default_rng(seed), Adam(net.p, RATE, rounds * steps)
    best = None
    for k in range(rounds):
        if k:
            logit = net.logits(ids, net.project(words), first, size)
            best = np.array([lo + logit[lo:hi].argmax() for lo, hi in zip(of, of[1:])])
            if k > 2 and np.mean((sigmoid(logit[best]) >= THRESHOLD) != labels) <= DONE:
                break
        for _ in range(steps):
            bad, good = rng.choice(toxic, TOXIC), rng.choice(clean, CLEAN)
            any_of = lambda d: rng.integers(of[d], of[d + 1])
            take = (np.r_[any_of(bad), any_of(good)] if best is None else
                    np.r_[best[bad], best[good[:CLEAN * 3 // 4]], any_of(good[CLEAN * 3 // 4:])])
            y = np.r_[np.ones(TOXIC), np.zeros(CLEAN)]
            _, grads = net.learn([[words[i] for i in ids[first[w]:first[w] + size[w]]] for w in take], y, np.ones(len(y)))
            adam.step(grads)
    return net


class Scorer:
    """Scores of whole texts, with words' projections remembered between batches."""

    LIMIT = 200_000

    def __init__(self, net: Network):
        self.net, self.known, self.rows = net, {}, np.empty((self.LIMIT, 6 * STATE), np.float32)

    def _table(self, words: list[bytes]) -> np.ndarray:
        fresh = [w for w in words if w not in self.known]
        table = np.empty((len(words), 6 * STATE), np.float32)
        made = self.net.project(fresh) if fresh else table[:0]
        if len(self.known) + len(fresh) <= self.LIMIT:
            at = len(self.known)
            self.rows[at:at + len(fresh)] = made
            self.known.update(zip(fresh, range(at, at + len(fresh))))
            return self.rows[[self.known[w] for w in words]]
        new = dict(zip(fresh, range(len(fresh))))
        for i, w in enumerate(words):
            table[i] = made[new[w]] if w in new else self.rows[self.known[w]]
        self.known = {}
        return table

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(t) for t in texts]
        # ids in order of appearance: rare words then lie side by side in the table
        vocabulary = dict.fromkeys(w for doc in docs for w in doc)
        table = self._table(list(vocabulary))
        vocabulary.update(zip(vocabulary, range(len(vocabulary))))
        get = vocabulary.__getitem__
        ids = np.array([i for doc in docs for i in map(get, doc)], np.int64)
        text, first, size = windows_of([len(d) for d in docs])
        best = np.full(len(docs), -np.inf, np.float32)
        np.maximum.at(best, text, self.net.logits(ids, table, first, size))
        return sigmoid(best).astype(float)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    doc_id, key = F.col(f"`{id_col}`").cast("long"), F.col(f"`{id_col}`").cast("long")
    learn = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % FOLDS != HELD_OUT
    known = (labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
                   .filter(F.col("y").isin(0, 1) & learn).groupBy("id").agg(F.max("y").alias("y")))
    rows = (docs.select(doc_id.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
                .filter(F.col("text").isNotNull() & (F.length("text") <= TRAIN_WORDS * 8))
                .withColumn("h", F.xxhash64("text")))
    # ids and hashes are joined first: only the sample's texts travel
    order = rows.select("id", "h").join(known, "id")
    sample = None
    for y in (0, 1):
        part = order.filter(F.col("y") == y).orderBy("h", "id").limit(SAMPLE[y])
        sample = part if sample is None else sample.union(part)
    picked = {(r["id"], r["h"]): r["y"] for r in sample.collect()}  # at most SAMPLE of each
    if not picked:
        return fit([])
    wanted = docs.sparkSession.createDataFrame([(i, h, y) for (i, h), y in picked.items()], "id long, h long, y int")
    texts = rows.join(F.broadcast(wanted), ["id", "h"]).select("id", "h", "text", "y").distinct().collect()
    texts.sort(key=lambda r: (r["h"], r["id"]))
    return fit([(r["text"], r["y"]) for r in texts if len(words_of(r["text"])) <= TRAIN_WORDS])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score."""
    bound_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches):
        model = Network()
        model.p = weights.value
        scorer = Scorer(model)
        for b in batches:
            ids = b.column(0)
            yield pa.RecordBatch.from_pydict({
                "id": ids, "held_out": pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_()),
                "score": pa.array(scorer(b.column(1).to_pylist()) if len(ids) else [], pa.float64())})
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(
        run, "id long, held_out boolean, score double")


def keep_clean(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(net.p)
    at = docs.columns.index(text_col)

    def run(batches):
        model = Network()
        model.p = weights.value
        scorer = Scorer(model)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(scorer(b.column(at).to_pylist()) < threshold))
    return docs.mapInArrow(run, docs.schema)
