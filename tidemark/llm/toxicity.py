"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of itself, if it is known, beside the mean
embedding of its character n-grams. Two gated recurrent layers read a window
of words from both ends, attention pools their states, and a logistic unit
gives the window's probability. All overlapping windows of a text are scored;
the text's score is that of its highest window.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import whole_text

#: Words of a window and words from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Sizes: states of a direction, word and character embeddings, buckets of n-grams (3 and 4 letters).
STATES, WORD_DIMS, CHAR_DIMS, BUCKETS = 12, 12, 16, 1 << 14
#: Bound of the training sample: labelled documents of each class, with all their windows.
SAMPLE_DOCS = 1500
#: Occurrences in the sample from which a word has an embedding of its own; training steps and windows of a step.
KNOWN_FROM, STEPS, BATCH = 5, 300, 144
#: Words whose projections a worker keeps, and windows scored at a time.
CACHE_WORDS, SCORE_WINDOWS = 250_000, 1024


def _starts(n: int) -> list[int]:
    """Starts of the windows of a text of n words: every ``STRIDE``, the last one ending with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words and the number of each word's; letters only, in lower case, bounded by blanks.

    A word is padded so that it has one n-gram of each length at least.
    """
    plain = ["".join(filter(str.isalpha, w)).lower() for w in words]
    joined = np.frombuffer("".join([f" {w}  " for w in plain]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 3 for w in plain], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    out, owner = [], []
    for n in (3, 4):
        if len(joined) < n:
            continue
        inside = word[: len(word) - n + 1] == word[n - 1 :]
        h = np.full(int(inside.sum()), np.uint64(n), np.uint64)
        for k in range(n):
            h = (h ^ joined[k : len(joined) - n + 1 + k][inside]) * np.uint64(0x100000001B3)
        out.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64) % BUCKETS)
        owner.append(word[: len(word) - n + 1][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order], np.bincount(owner, minlength=len(words))


def _scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``values`` by ``index``, in an array of ``rows`` rows."""
    out = np.zeros((rows, values.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """The parameters and the forward and backward passes. Arrays are float32; axis 0 of recurrent ones is the direction."""

    def __init__(self, known: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.known = {w: i + 1 for i, w in enumerate(known)}  # 0 is the unknown word
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        inputs = WORD_DIMS + CHAR_DIMS
        self.p = {
            "words": draw(len(known) + 1, WORD_DIMS, scale=0.1), "chars": draw(BUCKETS, CHAR_DIMS, scale=0.3),
            "w": draw(inputs, 6 * STATES, scale=inputs**-0.5), "b": np.zeros(6 * STATES, np.float32), "u": draw(2, STATES, 3 * STATES, scale=STATES**-0.5),
            "attend": draw(2 * STATES, scale=0.3), "out": draw(2 * STATES, scale=0.3), "bias": np.zeros(1, np.float32),
        }

    def inputs(self, numbers: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input vectors of words: numbers of known ones, and the n-gram buckets of all, ``sizes`` each."""
        first = np.cumsum(sizes) - sizes
        chars = np.add.reduceat(self.p["chars"][grams], first, axis=0) / sizes[:, None].astype(np.float32)
        return np.concatenate([self.p["words"][numbers], chars], axis=1)

    def forward(self, x: np.ndarray, at: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict | None]:
        """Logits of windows: ``x`` holds the projected words, ``at`` (windows, words) their rows, ``lengths`` the windows' words."""
        n, steps = at.shape
        place = np.arange(steps)
        back = np.clip(lengths[:, None] - 1 - place, 0, None)
        mirrored = np.take_along_axis(at, back, axis=1)
        h = np.zeros((2, n, STATES), np.float32)
        states = np.empty((steps, 2, n, STATES), np.float32)
        tape = []
        short = int(lengths.min()) < steps
        s = STATES
        for t in range(steps):
            xt = np.stack([x[at[:, t], : 3 * s], x[mirrored[:, t], 3 * s :]])
            a = h @ self.p["u"]
            gates = _sigmoid(xt[:, :, : 2 * s] + a[:, :, : 2 * s])
            z, r, au = gates[:, :, :s], gates[:, :, s:], a[:, :, 2 * s :]
            new = np.tanh(xt[:, :, 2 * s :] + r * au)
            nxt = new + z * (h - new)
            live = None
            if short:
                live = (t < lengths)[None, :, None]
                nxt = np.where(live, nxt, h)
            if keep:
                tape.append((h, z, r, au, new, live))
            h = nxt
            states[t] = h
        ahead = states[:, 0]
        behind = np.take_along_axis(states[:, 1], back.T[:, :, None], axis=0)
        both = np.concatenate([ahead, behind], axis=2)  # words, windows, states
        score = both @ self.p["attend"]
        score = np.where(place[:, None] < lengths[None, :], score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tns->ns", weight, both)
        logits = pooled @ self.p["out"] + self.p["bias"][0]
        return logits, {"tape": tape, "back": back, "mirrored": mirrored, "both": both, "weight": weight, "pooled": pooled} if keep else None

    def backward(self, x: np.ndarray, at: np.ndarray, c: dict, dlogits: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters above the projections, and of the projections."""
        s, (n, steps) = STATES, at.shape
        g = {"out": c["pooled"].T @ dlogits, "bias": np.array([dlogits.sum()], np.float32)}
        dpooled = dlogits[:, None] * self.p["out"]
        dweight = np.einsum("tns,ns->tn", c["both"], dpooled)
        dscore = c["weight"] * (dweight - (c["weight"] * dweight).sum(axis=0))
        dboth = c["weight"][:, :, None] * dpooled + dscore[:, :, None] * self.p["attend"]
        g["attend"] = np.einsum("tn,tns->s", dscore, c["both"])
        dstates = np.empty((steps, 2, n, s), np.float32)
        dstates[:, 0] = dboth[:, :, :s]
        # Mirroring a window is its own inverse; words past its end have no part in the pooling.
        dstates[:, 1] = np.where(np.arange(steps)[:, None, None] <= c["back"][:, 0][None, :, None], np.take_along_axis(dboth[:, :, s:], c["back"].T[:, :, None], axis=0), 0)
        every, du, dh = np.empty((steps, 2, n, 3 * s), np.float32), np.zeros_like(self.p["u"]), np.zeros((2, n, s), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, au, new, live = c["tape"][t]
            dh = dh + dstates[t]
            passed = 0
            if live is not None:
                passed, dh = np.where(live, 0, dh), np.where(live, dh, 0)
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * au * r * (1 - r)
            da = np.concatenate([dz, dr, dnew * r], axis=2)
            every[t] = np.concatenate([dz, dr, dnew], axis=2)
            du += h.transpose(0, 2, 1) @ da
            dh = dh * z + da @ self.p["u"].transpose(0, 2, 1) + passed
        g["u"] = du
        ahead = _scatter(at.T.reshape(-1), every[:, 0].reshape(-1, 3 * s), len(x))
        behind = _scatter(c["mirrored"].T.reshape(-1), every[:, 1].reshape(-1, 3 * s), len(x))
        return g, np.concatenate([ahead, behind], axis=1)


class _Words:
    """The distinct words of a sample with their n-gram buckets."""

    def __init__(self, words: list[str]):
        self.grams, self.sizes = gram_buckets(words)
        self.first = np.cumsum(self.sizes) - self.sizes

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.grams[np.repeat(self.first[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))], sizes


def train(windows: list[list[str]], bags: list[int], labels: list[int], *, odds: float = 0.5, seed: int = 7) -> Network | None:
    """A network fitted to windows of words; those of one bag are of one document and share its label.

    A toxic document need not be toxic in every window: after a first sixth
    of the steps only its highest window counts. A third of a batch are such
    windows, a third are clean windows that score highest, a third any clean
    ones. As such batches hold more toxic ones than the corpus, whose ``odds``
    of a toxic label are given, the bias is set back by the logarithm of the
    ratio. Adam, a fixed number of steps and a fixed seed. None without both
    labels.
    """
    bags_, y = np.array(bags), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    seen = Counter(w for x in windows for w in set(x))
    words = sorted(seen)
    number = {w: i for i, w in enumerate(words)}
    net = Network([w for w in words if seen[w] >= KNOWN_FROM], seed)
    own = np.array([net.known.get(w, 0) for w in words], np.int64)
    table, rng = _Words(words), np.random.default_rng(seed)
    lengths = np.array([len(x) for x in windows])
    ids = np.zeros((len(windows), WINDOW), np.int64)
    for k, x in enumerate(windows):
        ids[k, : len(x)] = [number[w] for w in x]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}

    def project(rows: np.ndarray, drop: bool) -> tuple[np.ndarray, np.ndarray, tuple]:
        used, at = np.unique(rows, return_inverse=True)
        mine = own[used].copy()
        if drop:
            mine[rng.random(len(mine)) < 0.3] = 0  # so that characters must tell as well
        grams, sizes = table.of(used)
        raw = net.inputs(mine, grams, sizes)
        return raw @ net.p["w"] + net.p["b"], at.reshape(rows.shape), (raw, mine, grams, sizes)

    clean, toxic = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    def logits_of(rows: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(rows), SCORE_WINDOWS):
            part = rows[k : k + SCORE_WINDOWS]
            x, at, _ = project(ids[part], False)
            out.append(net.forward(x, at, lengths[part])[0])
        return np.concatenate(out)

    every = {label: np.flatnonzero(y == label) for label in (0, 1)}
    hard = clean
    for step in range(1, STEPS + 1):
        if step > 1 and step % (STEPS // 6) == 1:
            logits = logits_of(every[1])  # the highest window of each toxic document
            order = np.lexsort((-logits, bags_[every[1]]))
            toxic = every[1][order[np.concatenate([[True], np.diff(bags_[every[1]][order]) != 0])]]
            hard = every[0][np.argsort(-logits_of(every[0]))[: max(BATCH, len(every[0]) // 20)]]  # and the highest of all clean ones
        third = BATCH // 3
        pick = np.concatenate([rng.choice(clean, BATCH - 2 * third), rng.choice(hard, third), rng.choice(toxic, third)])
        x, at, (raw, mine, grams, sizes) = project(ids[pick], True)
        logits, cache = net.forward(x, at, lengths[pick], keep=True)
        dlogits = ((_sigmoid(logits) - y[pick]) / len(pick)).astype(np.float32)
        g, dx = net.backward(x, at, cache, dlogits)
        g["w"], g["b"] = raw.T @ dx, dx.sum(axis=0)
        draw = dx @ net.p["w"].T
        g["words"] = _scatter(mine, draw[:, :WORD_DIMS], len(net.p["words"]))
        g["chars"] = _scatter(grams, np.repeat(draw[:, WORD_DIMS:] / sizes[:, None], sizes, axis=0), BUCKETS)
        rate = 0.01 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, v in net.p.items():
            m, q = moments[k]
            m += 0.1 * (g[k] - m)
            q += 0.001 * (g[k] * g[k] - q)
            v -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8) + (1e-3 * v if k in ("words", "chars", "out") else 0))
    net.p["bias"] -= np.float32(max(0.0, np.log(0.5 / odds)))
    return net


class Scorer:
    """A network in a worker: words are projected once and kept."""

    def __init__(self, net: Network):
        self.net = net
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 6 * STATES), np.float32)

    def _learn(self, words: list[str]) -> None:
        grams, sizes = gram_buckets(words)
        mine = np.array([self.net.known.get(w, 0) for w in words], np.int64)
        new = self.net.inputs(mine, grams, sizes) @ self.net.p["w"] + self.net.p["b"]
        used = len(self.rows)
        if used + len(new) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), used + len(new), 4096), 6 * STATES), np.float32)
            grown[:used] = self.table[:used]
            self.table = grown
        self.table[used : used + len(new)] = new
        self.rows.update(zip(words, range(used, used + len(new)), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        """The highest window's probability of each text; 0 for a text without words."""
        if len(self.rows) > CACHE_WORDS:
            self.rows, self.table = {}, np.zeros((0, 6 * STATES), np.float32)
        out = np.zeros(len(texts))
        held, owner, held_n = [], [], 0
        split = [clean_words(t) for t in texts]
        if new := [w for w in dict.fromkeys(w for words in split for w in words) if w not in self.rows]:
            self._learn(new)
        for k, words in enumerate(split):
            if not words:
                continue
            rows = np.array([self.rows[w] for w in words], np.int64)
            for s in _starts(len(rows)):
                held.append(rows[s : s + WINDOW])
                owner.append(k)
                held_n += 1
                if held_n >= SCORE_WINDOWS:
                    self._score(held, owner, out)
                    held, owner, held_n = [], [], 0
        if held:
            self._score(held, owner, out)
        return np.clip(out, 0, 1).tolist()

    def _score(self, held: list[np.ndarray], owner: list[int], out: np.ndarray) -> None:
        lengths = np.array([len(x) for x in held])
        for part in (np.flatnonzero(lengths == WINDOW), np.flatnonzero(lengths < WINDOW)):  # whole windows need no masks
            if len(part):
                at = np.zeros((len(part), int(lengths[part].max())), np.int64)
                for row, k in enumerate(part):
                    at[row, : lengths[k]] = held[k]
                logits, _ = self.net.forward(self.table, at, lengths[part])
                np.maximum.at(out, np.array(owner)[part], _sigmoid(logits.astype(np.float64)))


def clean_words(text: str) -> list[str]:
    """Words of a text in lower case, by white space."""
    return text.lower().split()


def training_windows(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, float]:
    """Rows (id, label, number, words), and the odds of a toxic label: all windows of a bounded sample of labelled documents.

    Of each class some ``SAMPLE_DOCS`` documents are drawn by a hash of their
    id. The sampled ids are broadcast; that they are few is a matter of
    the bound. Of rows that share an id the least text is taken, so that a
    repeated id brings one document.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    n = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, SAMPLE_DOCS / max(1, n.get(1, 0))).otherwise(SAMPLE_DOCS / max(1, n.get(0, 0)))
    draw = F.pmod(F.xxhash64(F.lit("toxic-sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = F.broadcast(marked.where(draw < share))
    rows = docs.select(docs[id_col].alias("id"), whole_text(text_col).alias("text")).join(sample, "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"id": [], "label": [], "number": [], "words": []}
            for i, label, text in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "text")), strict=True):
                words = clean_words(text)
                starts = _starts(len(words)) if words else []
                for k, start in enumerate(starts):
                    out["id"].append(i)
                    out["label"].append(label)
                    out["number"].append(k)
                    out["words"].append(words[start : start + WINDOW])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], batch.schema.field("id").type), pa.array(out["label"], pa.int32()), pa.array(out["number"], pa.int32()), pa.array(out["words"], pa.list_(pa.string()))], names=list(out)
            )

    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, number int, words array<string>")
    return found, max(1, n.get(1, 0)) / max(1, n.get(0, 0))


def _fitted(windows: DataFrame, odds: float) -> Network | None:
    """The network of a bounded sample, trained in one task: there numpy keeps to the task's cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same: dict[str, str] = {}  # a word is held once
        rows = []
        for batch in batches:
            for i, number, label, words in zip(*(batch.column(c).to_pylist() for c in ("id", "number", "label", "words")), strict=True):
                rows.append((str(i), number, label, [same.setdefault(w, w) for w in words]))
        rows.sort()
        bag = {i: k for k, i in enumerate(dict.fromkeys(r[0] for r in rows))}
        net = train([r[3] for r in rows], [bag[r[0]] for r in rows], [r[2] for r in rows], odds=odds)
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(net)], pa.binary())})

    return pickle.loads(windows.repartition(1).mapInArrow(run, "net binary").head()["net"])


def score_documents(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: Column | None = None, threshold: float = 0.7
) -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of ``docs``; ``labels`` has the id and the label of the training rows.

    A text without words (null, empty, blank) scores 0; so does every text if
    the labels do not hold both classes. Repeated rows score alike. Labels
    that are null or neither 0 nor 1 are left out; of contrary labels of one
    id the higher counts. Texts are scored where they are read, whole.
    """
    windows, odds = training_windows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    net = _fitted(windows, odds)
    sent = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(docs[id_col].alias("id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), whole_text(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [x for k in range(0, len(texts), 200) for x in scorer.scores(texts[k : k + 200])] if scorer else [0.0] * len(texts)
            predicted = pa.array([int(x >= threshold) for x in scores], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), predicted], names=[id_col, "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
