"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fit (labels are read here only): a sample of at most ``MAX_FIT_ROWS`` labelled
texts, the smallest hashes of doc_id; toxic ones may take half of it, or what the
others leave, so rare ones are kept.  Repeated texts count once, also where one
id comes with many.  Terms are all
words and the first four characters of longer words.  Weights are (1 + ln tf) *
idf * strength, length 1.  The strength of a term grows with the G-squared
statistic of its excess among toxic rows, up to 1 at the bound 2 ln(terms) +
``MARGIN``, and is never below ``NEUTRAL``: the filler of long texts is weighed
down, not left out, and a text without any toxic term still has neighbours.
Three quarters of the sample are the examples of the index, one quarter
calibrates; both classes count there by their share of all labelled rows.

Search: the index keeps postings by example.  All postings of the text's terms
are added up; only blocks of ``BLOCK`` examples whose largest cosine reaches that
of the k-th best block are sorted, so the k nearest are exact; equal cosines go
to the smaller example number.  The vote weighs each neighbour's
label by 1 / (1 - cosine + ``SOFTEN``) and adds ``PRIOR`` votes at the sample's
toxic share; a logistic curve fitted on the calibration rows turns the vote
into the score.

An empty, null or term-free text has no neighbour and takes the share of toxic
calibration rows without terms.  With no labelled rows every score is 0.
``labels``, ``lang``, ``source`` and ``doc_id`` are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter, defaultdict
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bounded_batches, rows_where, utf8, written

MAX_FIT_ROWS = 20_000
NEIGHBOURS = 15
MARGIN = 4
BLOCK = 64
SOFTEN = 0.02
PRIOR = 1.0
NEUTRAL = 0.05         # least strength of a term
LEAST_DENSE = 32       # and in more than so many
DENSE = 24             # a term in more than one of so many examples is a column of a matrix
TOGETHER = 256         # texts searched with one matrix product
EVIDENCE = 3
KNOWN_WORDS = 300_000  # words whose terms a worker remembers
MODEL_PART_BYTES = 8 << 20

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32
                    for c in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def word_counts(text: bytes) -> Counter:
    return Counter(words_of(text))


def _stem(word: bytes) -> bytes | None:
    """A term for the first four characters of a longer word (marked by ``^``)."""
    if word.isascii():
        return b"^" + word[:4] if len(word) > 4 else None
    w = word.decode("utf-8", "replace")
    return b"^" + w[:4].encode() if len(w) > 4 else None


def _term_hashes(terms) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(t, digest_size=8).digest() for t in terms]), "<i8")


def hashed(words: Counter, known: dict[bytes, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the terms of counted words, and their counts."""
    adds = list(map(known.get, words))
    if None in adds:
        if len(known) >= KNOWN_WORDS:
            known.clear()
        for i, w in enumerate(words):
            if adds[i] is None:
                adds[i] = known[w] = tuple(_term_hashes(t for t in (w, _stem(w)) if t).tolist())
    n = np.repeat(np.fromiter(words.values(), np.int64, len(adds)), np.fromiter(map(len, adds), np.int64, len(adds)))
    h, inverse = np.unique(np.fromiter(chain.from_iterable(adds), np.int64, len(n)), return_inverse=True)
    return h, np.bincount(inverse, n, len(h)).astype(np.int32)


def strengths(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Strength of terms in a of n1 toxic and b of n0 other rows."""
    if not n1 or not n0:
        return np.ones(len(a))
    n, r, g = n1 + n0, a + b, np.zeros(len(a))
    for seen, expected in ((a, r * n1 / n), (b, r * n0 / n),
                           (n1 - a, (n - r) * n1 / n), (n0 - b, (n - r) * n0 / n)):
        some = seen > 0
        g[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    least = 2 * math.log(max(len(a), 2)) + MARGIN
    more = a * n0 > b * n1
    return np.where(more, np.clip(g / least, 0, 1) ** 2 * _purity(a, b, n1, n0), 0) * (1 - NEUTRAL) + NEUTRAL


def _purity(a, b, n1: int, n0: int):
    """Toxic share of the rows with a term, were both classes of one size; one row of each added."""
    x, y = (a + 1) / (n1 + 2), (b + 1) / (n0 + 2)
    return np.maximum(2 * x / (x + y) - 1, 0)


class BlockMaxIndex:
    """Exact k nearest examples by cosine; block maxima pick the blocks to sort."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list):
        terms = sorted({t for v in vectors for t in v})
        self._build(np.array([i for i, v in enumerate(vectors) for _ in v], dtype=np.int32),
                    np.searchsorted(terms, [t for v in vectors for t in v]) if terms else
                    np.zeros(0, np.int64),
                    np.array([w for v in vectors for w in v.values()], dtype=float),
                    len(terms), labels, ids)
        self.names = {t: k for k, t in enumerate(terms)}

    @classmethod
    def of(cls, example, term, weight, n_terms: int, labels, ids) -> BlockMaxIndex:
        self = cls.__new__(cls)
        self._build(example, term, weight, n_terms, labels, ids)
        return self

    def _build(self, example, term, weight, n_terms: int, labels, ids) -> None:
        """Postings of each term by example number."""
        self.labels, self.ids = np.array(labels, dtype=float), np.array(ids)
        by = np.argsort(term, kind="stable")
        self.at, self.weight = example[by], weight[by]
        self.cuts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms))))

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines), best first; only examples that share a term."""
        mine = [(self.names[t], w) for t, w in query.items() if t in self.names]
        return self.search(np.array([t for t, _ in mine], dtype=np.int64),
                           np.array([w for _, w in mine], dtype=float), k)

    def search(self, terms: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search_all([(terms, w)], k)[0]

    def _matrix(self) -> None:
        """Weights of the terms that many examples hold, by example, made where it is used first."""
        n = np.diff(self.cuts)
        common = np.flatnonzero(n > max(len(self.labels) // DENSE, LEAST_DENSE))
        self.row_of = np.full(len(n), -1, np.int32)
        self.row_of[common] = np.arange(len(common))
        self.dense = np.zeros((-(-len(self.labels) // BLOCK) * BLOCK, len(common)), self.weight.dtype)
        self.flag = np.zeros(len(self.dense), bool)
        for k, t in enumerate(common):
            s = slice(self.cuts[t], self.cuts[t + 1])
            self.dense[self.at[s], k] = self.weight[s]

    def __getstate__(self):
        """Weights travel, and are used after it, in single precision: two thirds of the bytes."""
        kept = {k: v for k, v in self.__dict__.items() if k not in ("dense", "row_of", "flag", "pairs")}
        return kept | {"at": np.ascontiguousarray(self.at), "weight": self.weight.astype(np.float32)}

    def __setstate__(self, state: dict) -> None:
        """Example and weight of a posting lie side by side, so that a term's are read as one piece."""
        self.__dict__.update(state)
        pairs = np.empty((len(self.at), 2), np.int32)
        pairs[:, 0], pairs[:, 1] = self.at, self.weight.view(np.int32)
        self.at, self.weight = pairs[:, 0], pairs.view(np.float32)[:, 1]
        self.pairs = memoryview(pairs.view(np.int64).ravel())

    def _postings(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples and weights of the terms whose postings are from ``low`` to ``high``."""
        lists = map(slice, low.tolist(), high.tolist())
        if not hasattr(self, "pairs"):
            spot = np.concatenate([np.zeros(0, np.int64), *(np.arange(s.start, s.stop) for s in lists)])
            return self.at[spot], self.weight[spot]
        got = b"".join(map(self.pairs.__getitem__, lists))
        return np.frombuffer(got, np.int32)[::2].astype(np.intp), np.frombuffer(got, np.float32)[1::2]

    def search_all(self, queries: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if not hasattr(self, "dense"):
            self._matrix()
        out = []
        some = TOGETHER if self.weight.dtype == np.float32 else TOGETHER // 4       # while the model is made
        for first in range(0, len(queries), some):
            part = queries[first:first + some]
            q = np.zeros((len(part), self.dense.shape[1]))
            for j, (terms, w) in enumerate(part):
                row = self.row_of[terms]
                q[j, row[row >= 0]] = w[row >= 0]
            scores = q.astype(self.dense.dtype) @ self.dense.T
            out += [self._best(*x, k) for x in zip(scores, q, *zip(*part))]
        return out

    def _best(self, score: np.ndarray, q: np.ndarray, terms: np.ndarray, w: np.ndarray, k: int):
        """The k best; ``score`` holds the sums over the common terms, weighed by ``q``, in the weights' precision.

        All products are positive, so a sum is off by less than a single rounding of itself per
        term: all that come so close to the k-th best are computed again in full.
        """
        rare = np.flatnonzero(self.row_of[terms] < 0)
        low, high = self.cuts[terms[rare]], self.cuts[terms[rare] + 1]
        at, weight = self._postings(low, high)
        adds = np.repeat(w[rare].astype(score.dtype), high - low)
        adds *= weight
        np.add.at(score, at, adds)
        blocks = len(score) // BLOCK
        by_block = score.reshape(blocks, BLOCK)
        top = by_block.max(axis=1)
        # k blocks reach the k-th largest maximum, so no other block holds one of the k best
        least = float(np.partition(top, blocks - k)[blocks - k]) if blocks > k else 0.0
        near = 1 - (len(terms) + 8) * float(np.finfo(np.float32).eps)
        some = np.flatnonzero(top >= least * near)
        b, c = np.nonzero((by_block[some] > 0) & (by_block[some] >= least * near))
        hit = some[b] * BLOCK + c
        if len(hit) > k:                              # the k-th best of all, not only of the blocks' best
            kth = float(np.partition(score[hit], len(hit) - k)[len(hit) - k])
            hit = hit[score[hit] >= kth * near]
        exact = self.dense[hit] @ q
        self.flag[hit] = True
        mine = np.flatnonzero(self.flag.take(at))
        self.flag[hit] = False
        np.add.at(exact, np.searchsorted(hit, at[mine]),
                  w[rare[np.searchsorted(np.cumsum(high - low), mine, "right")]] * weight[mine])
        best = np.lexsort((hit, -np.round(exact, 12)))[:k]
        return hit[best], exact[best]


class Model:
    """Term hashes with weights, the example index and the calibration curve."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, share: float, index: BlockMaxIndex):
        self.hashes, self.weight, self.share, self.index = hashes, weight, share, index
        self.curve, self.bare = (0.0, 1.0), share
        self.known: dict[bytes, int] = {}
        self.stems: dict[bytes, int] = {}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the terms with these hashes, -1 where there is none."""
        out = np.full(len(h), -1)
        if len(self.hashes):
            by = np.argsort(h)                       # neighbours are looked for in the same places
            at = np.minimum(np.searchsorted(self.hashes, h[by]), len(self.hashes) - 1)
            out[by] = np.where(self.hashes[at] == h[by], at, -1)
        return out

    def _learn(self, words: list[bytes]) -> list[int]:
        """The terms of new words, kept for the next texts: the word's number + 1 and, 32 bits higher, its stem's."""
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
            self.stems.clear()
        own = [_stem(w) for w in words]
        new = list({t for t in own if t and t not in self.stems})
        at = (self.numbers(_term_hashes(chain(words, new))) + 1).tolist()
        self.stems.update(zip(new, at[len(words):]))
        both = [k | self.stems[t] << 32 if t else k for k, t in zip(at, own)]
        self.known.update(zip(words, both))
        return both

    def terms(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted numbers of the model's terms in each text, and their counts; a word is looked up once for all."""
        number = defaultdict(count().__next__)
        found = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in map(words_of, texts)]
        words = list(number)
        both = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(both < 0)
        if len(new):
            both[new] = self._learn([words[i] for i in new.tolist()])
        own, stem, out = both & 0xFFFFFFFF, both >> 32, []
        for w in found:
            t = np.concatenate((own[w], stem[w]))
            out.append(np.unique(t[t > 0] - 1, return_counts=True))
        return out

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of counted terms, length 1."""
        w = (1 + np.log(n)) * self.weight[at]
        return at, w / max(math.sqrt(float(w @ w)), 1e-300)

    def votes(self, counted: list[tuple]) -> list[tuple[float | None, list]]:
        """Distance-weighted toxic share of the neighbours of each text's terms, and the first of them."""
        found = self.index.search_all([self.vector(at, n) for at, n in counted], NEIGHBOURS)
        return [self._vote(i, cos) for i, cos in found]

    def _vote(self, i: np.ndarray, cos: np.ndarray) -> tuple[float | None, list]:
        if not len(i):
            return None, []
        w = 1 / (1 - np.minimum(cos, 1) + SOFTEN)
        y = self.index.labels[i]
        vote = (w @ y + PRIOR * self.share) / (w.sum() + PRIOR)
        near = [f"{self.index.ids[j]}:{int(self.index.labels[j])}:{c:.4f}"
                for j, c in zip(i[:EVIDENCE], cos)]
        return float(vote), near

    def calibrate(self, rows: list[tuple], times: tuple[float, float]) -> None:
        """Logistic curve on the log-odds of the vote (two parameters, Newton steps).

        ``times`` is how often a row of each label counts.
        """
        voted = [(v, y) for (v, _), (_, _, y) in zip(self.votes([r[:2] for r in rows]), rows)]
        none = [y for v, y in voted if v is None]
        self.bare = (sum(none) + self.share) / (len(none) + 1)
        x = np.array([_logit(v) for v, _ in voted if v is not None])
        y = np.array([y for v, y in voted if v is not None], dtype=float)
        if not len(x):
            return
        c = np.array(times)[y.astype(int)]
        design = np.stack((np.ones_like(x), x))
        ridge = np.diag([0.5, 0.5])
        start = np.array([0.0, 1.0])
        p = start.copy()
        for _ in range(50):
            z = 1 / (1 + np.exp(-np.clip(p @ design, -30, 30)))
            step = np.linalg.solve((design * (c * z * (1 - z))) @ design.T + ridge,
                                   design @ (c * (y - z)) - ridge @ (p - start))
            p = p + step
            if np.abs(step).max() < 1e-9:
                break
        self.curve = (float(p[0]), float(max(p[1], 0.05)))

    def scores(self, texts: list[bytes]) -> list[tuple[float, list]]:
        out = []
        for first in range(0, len(texts), TOGETHER):
            out += [(self.bare if v is None else self._curved(v), near)
                    for v, near in self.votes(self.terms(texts[first:first + TOGETHER]))]
        return out

    def _curved(self, vote: float) -> float:
        z = self.curve[0] + self.curve[1] * _logit(vote)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Packed:
    """A model as the bytes that its task made: the driver only passes them on, workers load the model itself."""

    def __init__(self, made: bytes):
        self.made = made

    def __reduce__(self):
        return pickle.loads, (self.made,)

    def model(self) -> Model:
        if "unpacked" not in self.__dict__:
            self.unpacked = pickle.loads(self.made)
        return self.unpacked

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("made", "unpacked"):
            raise AttributeError(name)
        return getattr(self.model(), name)


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def _sample(docs, labels, doc_id, text, label, fit_on, max_rows) -> tuple[DataFrame, list[int]]:
    """The fit rows (text, label, id) and all labelled ids by label, others first.

    The labelled ids sent out are at most ``max_rows``; their texts are bounded by ``_bounded``.
    """
    y = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & fit_on)
               .groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("__y"))
               .select(F.col(doc_id).alias("__id"), (F.col("__y") != 0).cast("int").alias("__y")))
    there = {r["__y"]: r["count"] for r in y.groupBy("__y").count().collect()}
    there = [there.get(0, 0), there.get(1, 0)]
    toxic = min(there[1], max(max_rows // 2, max_rows - there[0]))
    chosen = [r for k, n in ((0, max_rows - toxic), (1, toxic)) for r in
              y.where(F.col("__y") == k).orderBy(F.xxhash64("__id"), "__id").limit(n).collect()]
    spark = docs.sparkSession
    sent = spark.createDataFrame(pa.table(
        {"__id": pa.array([r[0] for r in chosen], pa.int64()),
         "__y": pa.array([r[1] for r in chosen], pa.int32())}))
    rows = (docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text"))
                .join(F.broadcast(sent), "__id"))
    return rows, there


def _bounded(rows: DataFrame, there: list[int], max_rows: int) -> DataFrame:
    """One row per distinct text of ``rows``, at most ``max_rows`` of them.

    An id may come with many texts and a text with many ids: texts are chosen
    by their hash and smallest id before any of them moves.
    """
    keyed = rows.withColumn("__h", F.xxhash64(F.coalesce("__text", F.lit(""))))
    keys = written(keyed.groupBy("__h").agg(F.max("__y").alias("__y"), F.min("__id").alias("__id")),
                   "toxicity-keys")
    n = {r["__y"]: r["count"] for r in keys.groupBy("__y").count().collect()}
    if sum(n.values()) > max_rows:
        toxic = min(n.get(1, 0), max(max_rows // 2, max_rows - n.get(0, 0)))
        first = [keys.where(F.col("__y") == k).orderBy(F.xxhash64("__id"), "__id", "__h").limit(m)
                 for k, m in ((0, max_rows - toxic), (1, toxic))]
        keys = written(first[0].unionByName(first[1]), "toxicity-keys")
    chosen = F.broadcast(keys.select("__h", F.col("__id").alias("__least"), F.col("__y").alias("__any")))
    return (keyed.join(chosen, "__h").groupBy("__h")
                 .agg(F.min_by("__text", "__id").alias("__text"), F.max("__any").alias("__y"),
                      F.min("__least").alias("__id")))


def fit(docs: DataFrame, labels: DataFrame, fit_on, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", max_rows: int = MAX_FIT_ROWS) -> Model | Packed:
    """Learn from labelled rows that meet ``fit_on`` (a condition on ``labels``).

    Terms are counted where the texts are; one task builds the index of the
    bounded sample, and the driver only passes its bytes on.
    """
    bounded_batches(docs.sparkSession)
    rows, there = _sample(docs, labels, doc_id, text, label, fit_on, max_rows)
    rows = _bounded(rows, there, max_rows)

    def count(batches):
        known: dict[bytes, tuple] = {}
        for batch in batches:
            got = [hashed(word_counts(t), known) for t in utf8(batch.column("__text"))]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("__id"), "y": batch.column("__y"),
                "h": pa.array([h.tobytes() for h, _ in got], pa.binary()),
                "n": pa.array([n.tobytes() for _, n in got], pa.binary())})

    def build(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("id", "y", "h", "n")))
        rows.sort(key=lambda r: r[0])
        ids, y, h, n = zip(*rows) if rows else ((), (), (), ())
        made = pickle.dumps(learnt(list(ids), list(y), [np.frombuffer(x, np.int64) for x in h],
                                   [np.frombuffer(x, np.int32) for x in n], there))
        for at in range(0, len(made), MODEL_PART_BYTES):
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([made[at:at + MODEL_PART_BYTES]], pa.binary())})

    counted = written(rows.select("__id", "__y", "__text")
                          .mapInArrow(count, "id long, y int, h binary, n binary"), "toxicity-sample")
    # the bounded sample in one task, whose output keeps its order
    made = bytearray()
    for r in counted.coalesce(1).mapInArrow(build, "bytes binary").toLocalIterator():
        made += r["bytes"]
    return Packed(bytes(made)) if made else learnt([], [], [], [], there)


def learnt(ids: list[int], y: list[int], h: list, n: list, there: list[int]) -> Model:
    """The model of rows given by term hashes and counts; ``there`` as from ``_sample``."""
    label = np.array(y, dtype=np.int64)
    hashes = np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64)
    number = [np.searchsorted(hashes, x).astype(np.int32) for x in h]
    a, b = np.zeros(len(hashes)), np.zeros(len(hashes))
    for t, v in zip(number, y):
        (a if v else b)[t] += 1
    n1, n0 = int(label.sum()), int(len(label) - label.sum())
    weight = (np.log((1 + n1 + n0) / (1 + a + b)) + 1) * strengths(a, b, n1, n0)
    kept = np.flatnonzero(np.arange(len(ids)) % 4)
    size = [len(h[k]) for k in kept]
    term, w = np.empty(sum(size), np.int32), np.empty(sum(size))
    at = 0
    for k, m in zip(kept, size):
        v = (1 + np.log(n[k])) * weight[number[k]]
        term[at:at + m], w[at:at + m] = number[k], v / max(math.sqrt(float(v @ v)), 1e-300)
        at += m
    del number
    index = BlockMaxIndex.of(np.repeat(np.arange(len(kept), dtype=np.int32), size), term, w,
                             len(hashes), label[kept], np.array(ids, dtype=np.int64)[kept])
    del term, w
    model = Model(hashes, weight, there[1] / sum(there) if sum(there) else 0.0, index)
    times = tuple(all_rows / max(m, 1) for all_rows, m in zip(there, (n0, n1)))
    model.calibrate([(np.searchsorted(hashes, h[k]), n[k], y[k]) for k in range(0, len(ids), 4)], times)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus score, predicted and evidence (id:label:cosine of the nearest)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts):
        got = sent.value.scores(texts)
        return [[s for s, _ in got], [int(s >= 0.5) for s, _ in got], [e for _, e in got]]

    return append_columns(docs, keep, text, [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StringType()))], rows)


def remove(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that the model does not predict to be toxic."""
    return rows_where(docs, text, lambda df, keep, t: score(df, model, keep, t), "predicted = 0")
