"""Toxic annotation texts, found by a small convolutional classifier trained in numpy.

Words are hashed, embedded, convolved with filters of several widths, and each filter
keeps its maximum over the whole text; a linear layer makes the score.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches, drop_stage, stage
from .words import hashes, letters, text_chunks

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16  # of each width
PREFIXES = (4, 6)  # bytes; compounds share the embedding of their first bytes
CUT = 0.3  # score from which a text is called toxic


def word_ids(column: pa.Array):
    """For runs of texts: first row, words per text, and per word its hash buckets (whole, and by prefix)."""
    for row, offsets, data in text_chunks(column, 1 << 18):
        low, s, e, text = letters(data, offsets)
        ids = np.empty((len(s), 1 + len(PREFIXES)), np.int32)
        for k, n in enumerate((None, *PREFIXES)):
            h = hashes(low, s, e if n is None else np.minimum(e, s + n))
            ids[:, k] = (h + np.uint64(k * 0x1234567)) % np.uint64(BUCKETS - 1) + np.uint64(1)
        yield row, np.bincount(text, minlength=len(offsets) - 1), ids


def padded(counts: np.ndarray, ids: np.ndarray):
    """Texts end to end with gaps of bucket 0, so that no filter reaches the next text: ids, first and last start per text."""
    gap = max(WIDTHS) - 1
    size = np.maximum(counts, 1)
    start = np.concatenate([[0], np.cumsum(size + gap)])[:-1]
    out = np.zeros((int((size + gap).sum()), ids.shape[1]), ids.dtype)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(counts)])[:-1], counts) + np.arange(len(ids))
    out[at] = ids
    return out, start, start + size


class Model:
    """Weights: embeddings E, filters W, their offsets b, output weights v and c; ``shift`` moves the decision to CUT."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.E[0] = 0
        n = FILTERS * len(WIDTHS)
        # Filter f of width w looks at w words: W[f, j] is zero from j = w on.
        self.width = np.repeat(WIDTHS, FILTERS)
        self.W = rng.normal(0, 0.3, (n, max(WIDTHS), DIM)).astype(np.float32) * (np.arange(max(WIDTHS))[None, :, None] < self.width[:, None, None])
        self.b = np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.1, n).astype(np.float32)
        self.c = np.float32(-2)
        self.shift = 0.0

    def embed(self, ids):
        X = self.E[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            X = X + self.E[ids[:, k]]
        return X

    def responses(self, X):
        """Filter outputs at every start."""
        Z = X @ self.W[:, 0].T
        for j in range(1, max(WIDTHS)):
            use = self.width > j
            Z[:-j, use] += X[j:] @ self.W[use, j].T
        return Z

    def logits(self, ids, start, stop):
        """One number per text: every start inside it counts."""
        out = np.empty(len(start), np.float32)
        a = 0
        while a < len(start):  # bounded pieces keep the responses small
            b = max(a + 1, int(np.searchsorted(stop, start[a] + 30_000)))
            lo, hi = start[a], stop[b - 1] + max(WIDTHS) - 1
            if hi - lo <= 200_000:
                Z = self.responses(self.embed(ids[lo:hi]))
                edges = np.stack([start[a:b] - lo, stop[a:b] - lo], 1).ravel()
                pooled = np.maximum.reduceat(Z, edges, axis=0)[::2]
            else:  # one very long text: its maximum over slices
                pooled = np.full((1, len(self.b)), -np.inf, np.float32)
                for p in range(lo, stop[b - 1], 100_000):
                    q = min(p + 100_000, stop[b - 1])
                    Z = self.responses(self.embed(ids[p:q + max(WIDTHS) - 1]))[:q - p]
                    pooled = np.maximum(pooled, Z.max(axis=0))
            out[a:b] = np.maximum(pooled + self.b, 0) @ self.v + self.c
            a = b
        return out

    def score(self, logits):
        return 1 / (1 + np.exp(-np.clip(logits.astype(np.float64) + self.shift, -40, 40)))


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.08, seed: int = 5) -> Model:
    """Fit by AdaGrad on the logistic loss; ``texts`` holds each text's word ids."""
    rng = np.random.default_rng(seed)
    m = Model(seed)
    counts = np.array([len(t) for t in texts])
    ids, start, stop = padded(counts, np.concatenate(texts) if len(texts) else np.zeros((0, 1 + len(PREFIXES)), np.int32))
    # The first embedding dimension starts as each bucket's log ratio, the first filter looks at it.
    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for t, label in zip(texts, y):
        seen[int(label)][np.unique(t)] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    ratio = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    enough = (seen[0] + seen[1]) >= 3
    m.E[:, 0] = np.where(enough, np.clip(ratio, -3, 3), 0)
    m.E[0] = 0
    for f in np.flatnonzero(np.arange(len(m.b)) % FILTERS == 0):
        m.W[f] *= 0.1
        m.W[f, :m.width[f], 0] = 1
        m.v[f] = 0.3
    sq = {k: np.full_like(getattr(m, k), 1e-6, dtype=np.float32) for k in ("E", "W", "b", "v")}
    sq["c"] = np.float32(1e-6)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a:a + batch]
            P, best = np.empty((len(some), len(m.b)), np.float32), np.empty((len(some), len(m.b)), np.int64)
            for i, t in enumerate(some):
                X = m.embed(ids[start[t]:stop[t] + max(WIDTHS) - 1])
                Z = m.responses(X)[:stop[t] - start[t]]
                at = Z.argmax(axis=0)
                P[i], best[i] = Z[at, np.arange(Z.shape[1])], at + start[t]
            A = np.maximum(P + m.b, 0)
            g = (1 / (1 + np.exp(-np.clip(A @ m.v + m.c, -30, 30))) - y[some]) * weight[some] / len(some)
            D = (g[:, None] * m.v) * (P + m.b > 0)
            grad = {"v": A.T @ g, "c": g.sum(), "b": D.sum(axis=0), "W": np.zeros_like(m.W)}
            rows, vals = [], []
            for j in range(max(WIDTHS)):
                use = np.flatnonzero(m.width > j)
                word = ids[best[:, use] + j]
                d = D[:, use]
                grad["W"][use, j] = np.einsum("nf,nfd->fd", d, m.embed(word.reshape(-1, word.shape[2])).reshape(len(some), len(use), DIM))
                move = d[:, :, None] * m.W[use, j]
                active = np.flatnonzero(d.ravel())
                for k in range(word.shape[2]):
                    rows.append(word[:, :, k].ravel()[active])
                    vals.append(move.reshape(-1, DIM)[active])
            for k in ("v", "c", "b", "W"):
                G = grad[k] + 1e-4 * getattr(m, k)
                sq[k] = sq[k] + G**2
                setattr(m, k, (getattr(m, k) - rate * G / np.sqrt(sq[k])).astype(np.float32))
            r, v = np.concatenate(rows), np.concatenate(vals)
            if len(r):
                u, inv = np.unique(r, return_inverse=True)
                G = np.zeros((len(u), DIM), np.float32)
                np.add.at(G, inv, v)
                G[u == 0] = 0
                sq["E"][u] += G**2
                m.E[u] -= rate * G / np.sqrt(sq["E"][u])
    return m


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """Logit between two texts at which calling all above toxic gives the best F1; ties go to the widest gap."""
    if not y.sum() or y.all():
        return 0.0
    o = np.argsort(-logits, kind="stable")
    l, hit = logits[o], np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ok = np.append(l[:-1] > l[1:], True)
    top = np.flatnonzero(ok & (f1 >= f1[ok].max() - 1e-12))
    nxt = np.append(l[1:], l[-1] - 1)
    k = top[np.argmax((l - nxt)[top])]
    return float((l[k] + nxt[k]) / 2)


def fit_toxicity(annotations: DataFrame, labels: DataFrame, text: str = "name", toxic: str = "toxic", lang: str = "lang", id: str = "id",
                 fit_rows: int = 10_000, fit_words: int = 8_000_000, epochs: int = 8, seed: int = 5) -> tuple[Model, dict]:
    """Model and the thresholds of each language, from annotations that ``labels`` (``id, toxic``) call toxic, 0 or 1.

    Fitted on a bounded sample: of the ``fit_rows`` labels that come first in hash order of
    their ids, so few that they are sent to where the texts are, the first whose whole texts
    have ``fit_words`` words together (texts of over a hundredth of that come last).  Their word hashes, six bytes a word, are written to
    the shared folder and the model is trained in one task; the driver gets the model, some
    2 MB, and never a text.  One in five is held back for
    calibration: the score is shifted so that 0.3 is the cut with the best F1 there, and
    ``thresholds`` has the best cut per language (of at least 20 held-back texts of both
    kinds, else 0.3).  Rows with a null label are left out.  Without labels of both kinds
    every score is below 0.3.
    """
    L = labels.where(F.col(toxic).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(toxic).cast("int").alias("y"))
    L = L.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    T = annotations.select(F.col(id).alias("id"), F.col(text).alias("t"), F.coalesce(F.col(lang), F.lit("")).alias("lang"))
    rows = T.join(F.broadcast(L), "id")

    def hashed(it):
        schema = pa.schema([("id", pa.binary()), ("y", pa.int32()), ("lang", pa.string()), ("fold", pa.int64()), ("n", pa.int64()), ("w", pa.binary())])

        def out():
            for b in it:
                head = [b.column(i).to_pylist() for i in range(4)]
                for row, counts, ids in word_ids(b.column(4)):
                    at = np.concatenate([[0], np.cumsum(counts)])
                    for i in range(len(counts)):
                        yield (*(h[row + i] for h in head), int(counts[i]), ids[at[i]:at[i + 1]].astype(np.uint16).tobytes())
        yield from batches(schema, out())

    order = F.unhex(F.sha2(F.concat_ws(":", F.xxhash64("id"), F.sha2("t", 256)), 256))
    sample = stage(rows.select(order.alias("id"), "y", "lang", F.pmod(F.xxhash64("t", F.lit(3)), F.lit(5)).alias("fold"), "t").mapInArrow(
        hashed, "id binary, y int, lang string, fold bigint, n bigint, w binary"), "toxicity-sample")
    # At most fit_rows rows (more only where an id has several texts), without their words.
    upto = F.sum("n").over(W.orderBy(F.col("n") > fit_words // 100, "id", "y", "lang").rowsBetween(W.unboundedPreceding, W.currentRow))
    taken = sample.select("id", "y", "lang", "n").withColumn("upto", upto).where(F.col("upto") <= fit_words).select("id", "y", "lang").distinct()
    few = sample.join(F.broadcast(taken), ["id", "y", "lang"], "left_semi").select("y", "lang", "fold", "w")

    def fit(it):
        got: list = []
        for b in it:
            got += zip(*(b.column(i).to_pylist() for i in range(4)))
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(_fit(got, epochs, seed))], pa.binary())})

    made = few.coalesce(1).mapInArrow(fit, "model binary").collect()
    drop_stage(sample)
    return pickle.loads(made[0].model) if made else _fit([], epochs, seed)


def _fit(got: list, epochs: int, seed: int) -> tuple[Model, dict]:
    """Model and thresholds from rows of label, language, fold and word hashes."""
    # In one order whatever the tasks, as training goes by it.
    texts = [np.frombuffer(w, np.uint16).reshape(-1, 1 + len(PREFIXES)) for *_, w in got]
    at = sorted(range(len(got)), key=lambda i: (got[i][2], texts[i].astype("<i4").tobytes(), got[i][0]))
    texts = [texts[i] for i in at]
    y, langs = np.array([got[i][0] for i in at], np.int64), np.array([got[i][1] for i in at], object)
    back = np.array([got[i][2] for i in at], np.int64) == 0
    if len(np.unique(y[~back])) < 2:
        model = Model(seed)
        model.v[:], model.shift = 0, -4.0
        return model, {}
    fit = np.flatnonzero(~back)
    model = train([texts[i] for i in fit], y[fit], epochs, seed=seed)
    held = np.flatnonzero(back) if len(np.unique(y[back])) == 2 else fit
    ids, start, stop = padded(np.array([len(texts[i]) for i in held]), np.concatenate([texts[i] for i in held]))
    logits = model.logits(ids, start, stop)
    model.shift = float(np.log(CUT / (1 - CUT)) - best_cut(logits, y[held]))
    thresholds = {}
    for name in np.unique(langs[held]):
        own = langs[held] == name
        if min((y[held][own] == 1).sum(), (y[held][own] == 0).sum()) >= 20:
            thresholds[str(name)] = float(model.score(np.array([best_cut(logits[own], y[held][own])]))[0])
    return model, thresholds


def score_toxicity(annotations: DataFrame, model: Model, thresholds: dict | None = None, id: str = "id", text: str = "name",
                   lang: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``id, keep…, score, toxic``: how likely each annotation's text is toxic, from the whole text alone.

    toxic   1 where the score reaches the language's threshold; without ``lang`` or for
            other languages that is 0.3

    A null or empty text gets the score of no words.  Repeated rows and null ids keep their rows;
    an empty table gives an empty result; other columns are left out.  The model goes to
    the tasks as an object of fixed size.
    """
    keep = keep or []
    A = annotations.select(F.col(id).alias("k"), F.col(text).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
                           *([F.col(lang).alias("lang")] if lang else []))
    # The text itself, if it is to be kept, travels once.
    carried = {f"k{i}": "t" for i, c in enumerate(keep) if c == text}
    A = A.drop(*carried)
    others = [c for c in A.columns if c != "t"]
    sent = A.sparkSession.sparkContext.broadcast(model)  # some 2 MB, whatever the input
    kind = "".join(f"{c} {t}, " for c, t in [*A.select(*others).dtypes, *((c, "string") for c in carried)])
    sources = {**{c: c for c in others}, **carried}

    def run(it):
        m = sent.value
        for b in it:
            out = np.empty(b.num_rows)
            for row, counts, ids in word_ids(b.column(b.schema.get_field_index("t"))):
                out[row:row + len(counts)] = m.score(m.logits(*padded(counts, ids)))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in sources.values()], pa.array(out)], [*sources, "score"])

    S = A.mapInArrow(run, kind + "score double")
    cut = F.lit(CUT)
    if lang and thresholds:
        cut = F.coalesce(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[F.col("lang")], cut)
    return S.select(F.col("k").alias(id), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= cut).cast("int").alias("toxic"))
