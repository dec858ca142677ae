"""Personal data: patterns, and a character-level bidirectional LSTM with CRF
transitions that adds what the patterns miss.

The base finds emails, IP addresses, card and phone numbers by pattern and
check (see :func:`base_spans`).  Its spans in a bounded sample of texts are the
labels from which the network is trained, in numpy: characters enter as learned
vectors, a bidirectional LSTM reads them, a CRF scores tag sequences (none, or
one of the four kinds).  To find spans, every text is read in windows of
``WINDOW`` characters that start every ``STRIDE``; each window is decoded by
Viterbi, where two windows overlap each decides the half that lies further from
its edge, and spans are then read off the whole text's tags, so a span across a
border is one span.  A decoded span is added if it overlaps no base span and has
the ``SHAPE`` of its kind.

Windows whose emissions cannot beat the empty tagging by any path (a bound over
all transitions) are decoded without the search, and windows that can have no part
in an added span (see :func:`tag_texts`) are not decoded, with the same result.

Null texts count as empty and have no spans.  Repeated rows give repeated rows.
Without any labelled span the network adds nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .neural import Adam, init, sigmoid

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 320, 256
#: What a decoded span must look like at least: an at sign; four groups of digits; 13 digits; 9 digits.
SHAPE = {"email": r".@.", "ip": r"[0-9]+(\D{1,3}[0-9]+){3}", "card": r"([0-9]\D{0,2}){13}", "phone": r"([0-9]\D{0,3}){9}"}
#: Texts sampled for training (those with digits or at signs, and any), windows of each, and their size.
SAMPLE, SAMPLE_ANY, PER_TEXT, TRAIN_WINDOW = 1500, 300, 6, 96
STATE, CHAR_DIM, CLASSES, TAGS = 8, 8, 131, len(KINDS) + 1
STEPS, BATCH, RATE = 350, 48, 0.015
SEED = 5

# ---------------------------------------------------------------- base patterns
# Linear forms of the contract's patterns: possessive repeats, and no second start within a run of digits.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LEFT = re.compile(r"[A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, searched for around at signs only."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LEFT.match(text, start - 1):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base, by start, then kind; ends are exclusive."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)
                if all(len(x) <= 3 and int(x or "0") <= 255 for x in (y.lstrip("0") for y in m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text)
                    if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def classes_of(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, other letters, blanks, and the rest."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = points.astype(np.uint8)
    for k in np.flatnonzero(points > 127) if not text.isascii() else ():
        c = chr(points[k])
        out[k] = 128 if c.isalpha() else 129 if c.isspace() else 130
    return out


# -------------------------------------------------------------------- network
# LSTM gates i, f, o and candidate g: c' = f c + i g, h' = o tanh(c')

def lstm(proj: np.ndarray, u: np.ndarray):
    """States over time, and what the gradients need."""
    steps, batch, width = proj.shape
    n = width // 4
    h = c = np.zeros((batch, n), np.float32)
    out, saved = np.empty((steps, batch, n), np.float32), []
    for t in range(steps):
        pre = proj[t] + h @ u
        gates, g = sigmoid(pre[:, :3 * n]), np.tanh(pre[:, 3 * n:])
        new = gates[:, n:2 * n] * c + gates[:, :n] * g
        squash = np.tanh(new)
        saved.append((h, c, gates, g, squash))
        h, c = gates[:, 2 * n:] * squash, new
        out[t] = h
    return out, saved


def lstm_back(grad: np.ndarray, saved: list, u: np.ndarray):
    steps, batch, n = grad.shape
    dproj, du = np.empty((steps, batch, 4 * n), np.float32), np.zeros_like(u)
    dh = dc = np.zeros((batch, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, gates, g, squash = saved[t]
        i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
        dh = dh + grad[t]
        dnew = dc + dh * o * (1 - squash * squash)
        d = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dh * squash * o * (1 - o),
                            dnew * i * (1 - g * g)], 1)
        dproj[t] = d
        du += h.T @ d
        dh, dc = d @ u.T, dnew * f
    return dproj, du


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(emit: np.ndarray, tags: np.ndarray, trans: np.ndarray):
    """Mean negative log likelihood of the tag sequences, and gradients (emissions, transitions)."""
    steps, batch, k = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, steps):
        alpha[t] = emit[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
    log_z = _lse(alpha[-1], 1)
    demit = np.exp(alpha + beta - log_z[:, None])
    pair = np.exp(alpha[:-1, :, :, None] + trans + (emit[1:] + beta[1:])[:, :, None, :] - log_z[:, None, None])
    dtrans = pair.sum((0, 1))
    rows = np.arange(batch)
    gold = np.zeros(batch)
    for t in range(steps):
        gold += emit[t, rows, tags[t]]
        demit[t, rows, tags[t]] -= 1
        if t:
            gold += trans[tags[t - 1], tags[t]]
            np.add.at(dtrans, (tags[t - 1], tags[t]), -1)
    return float((log_z - gold).mean()), (demit / batch).astype(np.float32), (dtrans / batch).astype(np.float32)


class Tagger:
    """Parameters of the network, its gradients, and decoding."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        p = {"chars": init(rng, CLASSES, CHAR_DIM) * np.float32(CLASSES ** 0.5 * 0.3)}
        for d in "fb":
            bias = np.zeros(4 * STATE, np.float32)
            bias[STATE:2 * STATE] = 1
            p |= {f"w{d}": init(rng, CHAR_DIM, 4 * STATE), f"u{d}": init(rng, STATE, 4 * STATE), f"b{d}": bias}
        p |= {"out": init(rng, 2 * STATE, TAGS), "outb": np.zeros(TAGS, np.float32),
              "trans": np.zeros((TAGS, TAGS), np.float32)}
        self.p = p

    def learn(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients over windows of classes ``x[t, b]`` with their tags."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        ways = {"f": slice(None), "b": slice(None, None, -1)}
        parts, saved = [], {}
        for d, way in ways.items():
            table = p["chars"] @ p[f"w{d}"] + p[f"b{d}"]
            states, saved[d] = lstm(table[x[way]], p[f"u{d}"])
            parts.append(states[way])
        h = np.concatenate(parts, 2)
        loss, demit, g["trans"] = crf_loss(h @ p["out"] + p["outb"], tags, p["trans"])
        g["out"], g["outb"] = np.tensordot(h, demit, ([0, 1], [0, 1])), demit.sum((0, 1))
        dh = demit @ p["out"].T
        for k, (d, way) in enumerate(ways.items()):
            dproj, g[f"u{d}"] = lstm_back(dh[way][:, :, k * STATE:(k + 1) * STATE], saved[d], p[f"u{d}"])
            dtable = np.zeros((CLASSES, 4 * STATE), np.float32)
            np.add.at(dtable, x[way], dproj)
            g[f"w{d}"], g[f"b{d}"] = p["chars"].T @ dtable, dtable.sum(0)
            g["chars"] += dtable @ p[f"w{d}"].T
        return loss, g

    def _stacked(self):
        """Both directions as one recurrence: tables [gate, unit, class] of each and the joint matrix.

        Rows come gate by gate (i, f, o, g), the forward units first in each; the
        first three gates are halved, as sigmoid(x) is (tanh(x / 2) + 1) / 2.
        """
        p, n = self.p, STATE
        scale = np.repeat(np.array([0.5, 1], np.float32), [3 * n, n])
        joint, tables = np.zeros((4, 2, n, 2, n), np.float32), []
        for k, d in enumerate("fb"):
            tables.append(np.ascontiguousarray(((p["chars"] @ p[f"w{d}"] + p[f"b{d}"]) * scale).T))
            joint[:, k, :, k] = (p[f"u{d}"] * scale).T.reshape(4, n, n)
        return tables, joint.reshape(8 * n, 2 * n)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores ``e[t, tag, b]`` of windows ``x[t, b]``; feature-major, without gradients.

        Step t reads character t for the forward and steps - 1 - t for the backward direction.
        """
        p, n, half = self.p, STATE, np.float32(0.5)
        steps, batch = x.shape
        at = x.astype(np.intp)
        (ahead, back), joint = self._stacked()
        out = np.empty((steps, TAGS, batch), np.float32)
        out[:] = p["outb"][:, None]
        rec, one, read = (np.empty((k * n, batch), np.float32) for k in (8, 4, 8))
        both, four = read.reshape(4, 2, n, batch), one.reshape(4, n, batch)
        h, c = np.zeros((2 * n, batch), np.float32), np.zeros((2 * n, batch), np.float32)
        gates, g = rec[:6 * n], rec[6 * n:]
        w = [np.ascontiguousarray(p["out"][k * n:(k + 1) * n].T) for k in (0, 1)]
        for t in range(steps):
            np.matmul(joint, h, out=rec)
            np.take(ahead, at[t], axis=1, out=one, mode="clip")
            both[:, 0] = four
            np.take(back, at[steps - 1 - t], axis=1, out=one, mode="clip")
            both[:, 1] = four
            rec += read
            np.tanh(rec, out=rec)
            gates *= half
            gates += half
            c *= gates[2 * n:4 * n]
            g *= gates[:2 * n]
            c += g
            np.tanh(c, out=h)
            h *= gates[4 * n:]
            out[t] += w[0] @ h[:n]
            out[steps - 1 - t] += w[1] @ h[n:]
        return out

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags ``[t, b]`` of windows."""
        e, trans = self.emissions(x), self.p["trans"]
        tags = np.zeros(x.shape, np.uint8)
        # a path that leaves "none" gains at most this per step it is away, and once more on its way back
        slack = max(0.0, float((trans - trans[0, 0]).max()))
        rival = (e[:, 1:] - e[:, :1]).max((0, 1)) + 2 * slack
        for_search = np.flatnonzero(rival > 0)
        if len(for_search):
            tags[:, for_search] = viterbi(e[:, :, for_search], trans)
        return tags


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    steps, k, batch = e.shape
    back, score = np.empty((steps, k, batch), np.uint8), e[0]
    for t in range(1, steps):
        paths = score[:, None, :] + trans[:, :, None]
        back[t] = paths.argmax(0)
        score = paths.max(0) + e[t]
    tags, rows = np.empty((steps, batch), np.uint8), np.arange(batch)
    tags[-1] = score.argmax(0)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = back[t, tags[t], rows]
    return tags


def tag_texts(tagger: Tagger, texts: list[str], block: int = 512) -> list[np.ndarray]:
    """Tags of every character: overlapping windows, decoded and reconciled.

    Windows that can have no part in a span with a ``SHAPE`` are left at "none":
    every shape has a digit or an at sign, so windows that decide none of these
    are decoded only where a tag other than "none" reaches their border.
    """
    flat = np.concatenate([classes_of(t) for t in texts]) if texts else np.empty(0, np.uint8)
    lengths = np.array([len(t) for t in texts], int)
    ends = np.cumsum(lengths)
    doc, first = [], []
    for k, t in enumerate(texts):
        starts = np.arange(0, max(1, len(t) - (WINDOW - STRIDE)), STRIDE) if t else np.empty(0, np.int64)
        doc.append(np.full(len(starts), k))
        first.append(starts)
    doc, first = np.concatenate(doc or [[]]).astype(int), np.concatenate(first or [[]]).astype(int)
    begin, size = ends[doc] - lengths[doc] + first, np.minimum(WINDOW, lengths[doc] - first)
    order, edge = np.argsort(size, kind="stable"), (WINDOW - STRIDE) // 2
    low, high = np.where(first > 0, edge, 0), np.where(first + size < lengths[doc], size - edge, size)  # what a window decides
    steps = np.empty_like(size)
    for lo in range(0, len(order), block):
        steps[order[lo:lo + block]] = size[order[lo:lo + block]].max()
    hints = np.r_[0, np.cumsum((flat == ord("@")) | (flat >= ord("0")) & (flat <= ord("9")))]
    out, seen = np.zeros(len(flat), np.uint8), np.zeros(len(doc), bool)
    todo = np.flatnonzero(hints[begin + high] > hints[begin + low])
    while len(todo):
        seen[todo] = True
        reached = []
        for n in np.unique(steps[todo]):
            alike = todo[steps[todo] == n]
            for at in (alike[lo:lo + block] for lo in range(0, len(alike), block)):
                grid = np.arange(n)[:, None]
                inside = grid < size[at]
                # behind a text's end the window reads blanks
                x = np.where(inside, flat[np.where(inside, begin[at] + grid, 0)], 32)
                tags = tagger.decode(x)
                for j in np.flatnonzero(tags.any(0)):
                    k, mine = at[j], tags[low[at[j]]:high[at[j]], j]
                    out[begin[k] + low[k]:begin[k] + high[k]] = mine
                    reached += [k - 1] * bool(low[k] and mine[0]) + [k + 1] * bool(high[k] < size[k] and mine[-1])
        todo = np.array(sorted(k for k in set(reached) if not seen[k]), int)
    return np.split(out, ends[:-1]) if texts else []


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the tags that the base doesn't touch."""
    if not tags.any():
        return []
    cut = np.flatnonzero(np.diff(np.r_[0, tags, 0].astype(int)))
    taken, out = [(a, b) for a, b, _ in base], []
    for a, b in zip(cut, cut[1:]):
        if not tags[a]:
            continue
        piece = text[a:b]
        start, end = int(a) + len(piece) - len(piece.lstrip()), int(b) - (len(piece) - len(piece.rstrip()))
        kind = KINDS[tags[a] - 1]
        if re.search(SHAPE[kind], piece) and not any(s < end and start < e for s, e in taken):
            out.append((start, end, kind))
    return out


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


# ------------------------------------------------------------------- training

def fit(windows: list[tuple[str, list[tuple[int, int, str]]]], steps: int = STEPS, batch: int = BATCH,
        seed: int = SEED) -> Tagger:
    """Train on (text, labelled spans) windows of at most ``TRAIN_WINDOW`` characters."""
    tagger = Tagger(seed)
    marked = [k for k, (_, spans) in enumerate(windows) if spans]
    if not marked:
        tagger.p["outb"][0] = 1e3
        return tagger
    x = np.full((TRAIN_WINDOW, len(windows)), 32, np.uint8)
    tags = np.zeros((TRAIN_WINDOW, len(windows)), np.int64)
    for k, (text, spans) in enumerate(windows):
        x[:len(text), k] = classes_of(text)
        for a, b, kind in spans:
            tags[a:b, k] = KINDS.index(kind) + 1
    plain = [k for k in range(len(windows)) if k not in set(marked)] or marked
    rng, adam = np.random.default_rng(seed), Adam(tagger.p, RATE, steps)
    for _ in range(steps):
        take = np.r_[rng.choice(marked, batch * 2 // 3), rng.choice(plain, batch // 3)]
        _, grads = tagger.learn(x[:, take], tags[:, take])
        adam.step(grads)
    return tagger


def _train_windows(batches):
    """Windows of sampled texts: around base spans, around other digits, and anywhere."""
    for b in batches:
        keys, texts, spans = [], [], []
        for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rng = np.random.default_rng(h & 0xFFFFFFFF)
            found = base_spans(text)
            digits = [m.start() for m in re.finditer(r"[0-9]{3,}", text)]
            centres = [(s + e) // 2 for s, e, _ in found][:PER_TEXT // 2]
            centres += [int(d) for d in rng.choice(digits, 2)] if digits else []
            centres += rng.integers(0, max(len(text), 1), PER_TEXT - len(centres)).tolist()
            for c in centres:
                lo = max(0, min(int(c) - int(rng.integers(20, TRAIN_WINDOW - 20)), max(0, len(text) - TRAIN_WINDOW)))
                hi = min(len(text), lo + TRAIN_WINDOW)
                inside = [(max(s, lo) - lo, min(e, hi) - lo, k) for s, e, k in found if s < hi and e > lo]
                keys.append(h)
                texts.append(text[lo:hi])
                spans.append(as_text(inside))
        yield pa.RecordBatch.from_pydict({"h": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string()),
                                          "spans": pa.array(spans, pa.string())})


def train(docs: DataFrame, text_col: str = "text") -> Tagger:
    """Fit on the base's spans in a bounded sample of the texts, the smallest by hash."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).filter("text <> ''").withColumn("h", F.xxhash64("text"))
    hinted = rows.filter(F.col("text").rlike("[0-9]{3}|@")).select("h").distinct().orderBy("h").limit(SAMPLE)
    anyhow = rows.select("h").distinct().orderBy("h").limit(SAMPLE_ANY)
    picked = sorted({r["h"] for r in hinted.union(anyhow).collect()})
    if not picked:
        return fit([])
    wanted = docs.sparkSession.createDataFrame([(h,) for h in picked], "h long")
    windows = (rows.join(F.broadcast(wanted), "h").select("h", "text").mapInArrow(_train_windows, "h long, text string, spans string")
                   .distinct().collect())  # at most PER_TEXT small windows of each sampled text
    windows.sort(key=tuple)
    return fit([(r["text"], [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r["spans"].split(",") if s)])
                for r in windows])


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base's kinds, base_sha256, spans."""
    bound_batches(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(tagger.p)

    def run(batches):
        model = Tagger()
        model.p = weights.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [s + added_spans(t, g, s) for t, g, s in zip(texts, tag_texts(model, texts), base)]
            counts = [[sum(s[2] == k for s in spans) for spans in base] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(as_text(s).encode()).hexdigest() for s in base], pa.string()),
                 pa.array([as_text(s) for s in every], pa.string())],
                names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(
        run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
