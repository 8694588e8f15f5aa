"""A quality classifier by co-training on two views of a document.

The text view sees which words, word beginnings and marks occur, and measures of the text (shares of kinds of bytes,
lengths, repetition). The metadata view sees the columns beside the text alone: source, language, both together, and the
size that the page was recorded with. Texts are read once for fitting: what the views see of each goes to a scratch table, of its
words those that tell anything in the labelled documents. For either target (quality, toxic) both views start from labelled documents. In
each round they judge all other documents, in one distributed pass; the surest of what one calls with confidence
becomes pseudo-labels for the other. In the end each view is calibrated on labelled documents that neither was trained
on, and the calibrated views are combined there by a logistic regression.

Fitting runs on the driver, on at most ``LABELLED`` labelled documents, those whose hashed doc_id is least, and at most a
tenth of ``POOL`` pseudo-labels of a class, view and round, which are chosen from all documents. Of several rows of a labelled
doc_id that of the least hash stands for it. Documents that are alike in all that the views see count once as pseudo-labels.
All documents are scored, whole, without a shuffle.

A document is kept if it is likely of quality (0.5 or more) and not likely toxic (less than 0.5). Null texts are
empty; null sources, languages and sizes, or columns that are not there, are a value of their own. Labels that are
null are not used; of several labels for a document the worst counts. A target whose labels are all alike gets their
smoothed share for every document, one without labels 0.5 for quality and 0 for toxic.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, partitions, prepare, table

LABELLED, POOL, ROUNDS, CONFIDENT = 8_000, 2_000, 3, 0.02
#: Doubts that agree in so many digits are ties, which go by key.
DOUBT_DIGITS = 9
TARGETS = ("quality", "toxic")
VIEWS = ("text", "meta")
TOKEN = re.compile(r"\w+|[^\w\s]+")
BEGINNINGS = (4, 5, 6)
#: Features of a view in the model: at least so many documents, so many standard errors in the text view, and at most so many.
LEAST_DOCS, LEAST_Z, MOST_FEATURES = 5, 4.0, 4_000
#: Standard errors that a word feature needs in the labelled documents to be looked at at all.
SCREEN_Z = 2.0
#: Bits of a hash by which its features are counted apart.
RANGE_BITS = 4
#: Stretches between white space that a worker remembers, and the longest of them.
CACHED_CHUNKS, CACHED_LENGTH = 500_000, 40


# What the views see.


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


def token_features(token: str) -> list[int]:
    """Hashes of what the text view sees in a token."""
    return [_hashed(token), *(_hashed(f"{n}^{token[:n]}") for n in BEGINNINGS if len(token) > n)]


class Chunks:
    """What ``of`` gives for the tokens between white space, remembered: tokens do not reach across it."""

    def __init__(self, of: Callable[[str], list[int]]) -> None:
        self.of, self.seen = of, {}

    def __call__(self, text: str) -> set[int]:
        seen, chunks = self.seen, list(set(text.lower().split()))
        if len(seen) + len(chunks) > CACHED_CHUNKS:
            seen.clear()
        own = list(map(seen.get, chunks))
        if None in own:
            for i, c in enumerate(chunks):
                if own[i] is None:
                    own[i] = [f for token in TOKEN.findall(c) for f in self.of(token)]
                    if len(c) <= CACHED_LENGTH:
                        seen[c] = own[i]
        found: set[int] = set()
        found.update(*filter(None, own))
        return found


def _kinds() -> np.ndarray:
    """Which bytes are capitals, digits, ends of sentences, other marks, and white space."""
    kinds = [range(65, 91), range(48, 58), b".,;:?'\"-", [b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:?'\"-"], [32, *range(9, 14)]]
    out = np.zeros((256, len(kinds)))
    for i, k in enumerate(kinds):
        out[list(k), i] = 1
    return out


_KINDS = _kinds()
MEASURES = len(_KINDS[0]) + 6


def measures(text: str) -> np.ndarray:
    """Shares of kinds of bytes, lengths and repetition of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    n, words, lines = max(len(raw), 1), raw.split(), raw.count(b"\n") + 1
    m = max(len(words), 1)
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / n
    again = sum(map(eq, words, words[1:])) / m
    return np.array([*np.sqrt(shares), np.log1p(len(raw)), np.log1p(lines), np.log1p(len(raw) / lines), len(set(words)) / m, again, len(raw) / m / 10])


def meta_features(source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    """Hashes of what the metadata view sees: source, language, both, and the size up to a factor of 2."""
    named = lambda kind, x: kind if x is None else f"{kind}={x}"
    s, g = named("source", source), named("lang", lang)
    return np.unique(np.array([_hashed(x) for x in (s, g, f"{s}\n{g}", named("size", None if size is None else max(size, 0).bit_length()))], np.uint32))


class Rows(NamedTuple):
    """Documents as the views see them."""

    words: list[np.ndarray]
    dense: np.ndarray
    meta: list[np.ndarray]

    def pick(self, at: np.ndarray) -> Rows:
        return Rows([self.words[i] for i in at], self.dense[at], [self.meta[i] for i in at])

    def plus(self, other: Rows) -> Rows:
        return Rows(self.words + other.words, np.concatenate((self.dense, other.dense)), self.meta + other.meta)


class Extractor:
    """What the views see of documents: word features as their numbers in a vocabulary, or without one as hashes."""

    def __init__(self, vocabulary: np.ndarray | None = None) -> None:
        of = token_features
        if vocabulary is not None:
            numbers = {f: i for i, f in enumerate(vocabulary.tolist())}
            of = lambda token: [numbers[f] for f in token_features(token) if f in numbers]
        self.chunks, self.pages = Chunks(of), {}

    def _page(self, source: str | None, lang: str | None, size: int | None) -> np.ndarray:
        key = (source, lang, None if size is None else max(size, 0).bit_length())
        if key not in self.pages:
            if len(self.pages) >= CACHED_CHUNKS:
                self.pages.clear()
            self.pages[key] = meta_features(source, lang, size)
        return self.pages[key]

    def __call__(self, text: list[str], source: list[str | None], lang: list[str | None], size: list[int | None]) -> Rows:
        words = [np.sort(np.fromiter(found, np.uint32, len(found))) for found in map(self.chunks, text)]
        dense = np.stack([measures(t) for t in text]) if text else np.zeros((0, MEASURES))
        return Rows(words, dense, [self._page(*x) for x in zip(source, lang, size, strict=True)])


def _deviations(words: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct features: (feature, documents, standard errors from the share of ones), and each occurrence's feature."""
    names, at = np.unique(np.concatenate([np.zeros(0, np.uint32), *words]), return_inverse=True)
    row = np.repeat(np.arange(len(y)), [len(f) for f in words])
    n, ones = np.bincount(at, minlength=len(names)), np.bincount(at, weights=y[row], minlength=len(names))
    share = y.mean()
    return names, n, np.abs(ones - n * share) / np.sqrt(n * share * (1 - share) + 1e-9), at


def _least(documents: int) -> int:
    return min(LEAST_DOCS, 1 + documents // 100)


def vocabulary(words: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """The features (hashes) that are frequent enough and tell anything of one of the targets; labels may be NaN.

    Occurrences are sorted a range of hashes at a time: all at once they would take a quarter of a GB of the driver."""
    out = [np.zeros(0, np.uint32)]
    for part in range(1 << RANGE_BITS):
        own = [w[w >> (32 - RANGE_BITS) == part] for w in words]
        for y in labels:
            told = np.flatnonzero(~np.isnan(y))
            if len(told):
                names, n, z, _ = _deviations([own[i] for i in told], y[told])
                out.append(names[(n >= _least(len(told))) & (z >= SCREEN_Z)])
    return np.unique(np.concatenate(out))


def numbered(rows: Rows, known: np.ndarray) -> Rows:
    """Rows whose word features are hashes, as the vocabulary ``known`` numbers them."""
    return rows._replace(words=[np.flatnonzero(np.isin(known, w, assume_unique=True)).astype(np.uint32) for w in rows.words])


# The learners. Rows are documents; y is 0 or 1.


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression with a ridge (not on column 0), by Newton's steps."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step * min(1, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return w


def _sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the values of each row, added up in their order and apart from all other rows': a document's sum is the same
    to the last bit whatever batch it comes in."""
    return np.bincount(row, values, rows)


def _dots(dense: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Row by row as well, which a matrix product does not promise."""
    out = np.zeros(len(dense))
    for k, w in enumerate(weights):
        out += dense[:, k] * w
    return out


class View:
    """Logistic regression over the features of one view that occur often enough, and over measures if it has any."""

    def __init__(self, name: str) -> None:
        self.name = name

    def _seen(self, rows: Rows) -> tuple[list[np.ndarray], np.ndarray]:
        return (rows.words, rows.dense) if self.name == "text" else (rows.meta, np.zeros((len(rows.meta), 0)))

    def fit(self, rows: Rows, y: np.ndarray) -> View:
        features, dense = self._seen(rows)
        names, n, z, at = _deviations(features, y)
        row, share = np.repeat(np.arange(len(y)), [len(f) for f in features]), y.mean()
        chosen = np.flatnonzero((n >= _least(len(y))) & (z >= (LEAST_Z if self.name == "text" else 0)))
        chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[:MOST_FEATURES]])
        self.names = names[chosen]
        place = np.full(len(names), -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[at] >= 0
        row, at = row[keep], place[at[keep]]
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        d = np.clip((dense - self.mean) / self.scale, -8, 8)
        self.w, self.v, self.bias = np.zeros(len(chosen)), np.zeros(d.shape[1]), float(_logit(np.array([share]))[0])
        seen, seen_v, seen_bias, ridge = np.full(len(chosen), 1e-8), np.full(d.shape[1], 1e-8), 1e-8, 2e-4
        for _ in range(300):  # Adagrad on all rows at once
            g = _sigmoid(_sums(self.w[at], row, len(y)) + d @ self.v + self.bias) - y
            gw, gv, gb = np.bincount(at, g[row], len(chosen)) / len(y) + ridge * self.w, d.T @ g / len(y) + ridge * self.v, g.mean()
            seen += gw**2
            seen_v += gv**2
            seen_bias += gb**2
            self.w -= 0.3 * gw / np.sqrt(seen)
            self.v -= 0.3 * gv / np.sqrt(seen_v)
            self.bias -= 0.3 * gb / np.sqrt(seen_bias)
        return self

    def margin(self, rows: Rows) -> np.ndarray:
        features, dense = self._seen(rows)
        out = _dots(np.clip((dense - self.mean) / self.scale, -8, 8), self.v) + self.bias
        if len(self.names):
            f = np.concatenate([np.zeros(0, np.uint32), *features])
            at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
            row = np.repeat(np.arange(len(features)), [len(x) for x in features])
            out += _sums(np.where(self.names[at] == f, self.w[at], 0.0), row, len(features))
        return out


class Target:
    """Both views of one target, calibrated and combined."""

    def __init__(self, default: float) -> None:
        self.constant: float | None = default
        self.rounds: list[tuple[int, int]] = []  # pseudo-labels that either view has had

    def start(self, rows: Rows, y: np.ndarray) -> None:
        if not len(y):
            return
        self.constant = (y.sum() + 1) / (len(y) + 2)
        apart = np.arange(len(y)) % 3 == 2  # labelled documents for calibration only
        if min(y[~apart].sum(), (1 - y[~apart]).sum(), y[apart].sum(), (1 - y[apart]).sum()) < 2:
            return
        self.constant = None
        self.own, self.apart = (rows.pick(np.flatnonzero(x)) for x in (~apart, apart))
        self.y, self.y_apart = y[~apart], y[apart]
        self.given: list[dict[int, tuple[float, Rows]]] = [{}, {}]  # document: label and features; for either view

    def train(self) -> None:
        """Both views, on labels and on the pseudo-labels given to them."""
        self.views, self.scales = [], []
        for k, name in enumerate(VIEWS):
            rows, y = self.own, self.y
            if self.given[k]:
                labels, more = zip(*self.given[k].values(), strict=True)
                more = Rows([r.words[0] for r in more], np.concatenate([r.dense for r in more]), [r.meta[0] for r in more])
                rows, y = rows.plus(more), np.concatenate((y, labels))
            view = View(name).fit(rows, y)
            m = view.margin(self.apart)
            self.views.append(view)
            self.scales.append(logistic(np.stack((np.ones(len(m)), m), axis=1), self.y_apart, 0.1))

    def learn(self, found: list[dict[int, tuple[float, Rows]]]) -> None:
        """Takes what each view calls with confidence as pseudo-labels of the other."""
        for k in (0, 1):
            self.given[1 - k].update(found[k])
        self.rounds.append((len(self.given[0]), len(self.given[1])))

    def combine(self) -> None:
        self.both = logistic(self._calibrated([v.margin(self.apart) for v in self.views]), self.y_apart, 0.01)
        del self.own, self.apart, self.y, self.y_apart, self.given  # the model is what is sent to the executors

    def _calibrated(self, margins: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.ones(len(margins[0])), *(s[0] + s[1] * m for s, m in zip(self.scales, margins, strict=True))], axis=1)

    def each(self, margins: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated probabilities by text and by metadata."""
        x = self._calibrated(margins)
        return [_sigmoid(x[:, 1]), _sigmoid(x[:, 2])]

    def judged(self, margins: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities by text, by metadata, by both."""
        if self.constant is not None:
            return [np.full(len(margins[0]), self.constant)] * 3
        return [*self.each(margins), _sigmoid(self._calibrated(margins) @ self.both)]


class Targets(dict):
    """Target by name, the vocabulary that their text views share, and the table of what the views see of all documents
    that were there when they were fitted (None if there was nothing to learn)."""

    known: np.ndarray = np.zeros(0, np.uint32)
    table: DataFrame | None = None


def scored(targets: dict[str, Target], rows: Rows) -> tuple[dict[str, list[np.ndarray]], np.ndarray]:
    """Probabilities by target (by text, by metadata, by both), and which documents are kept."""
    nothing = [np.zeros(len(rows.meta))] * 2
    found = {n: t.judged(nothing if t.constant is not None else [v.margin(rows) for v in t.views]) for n, t in targets.items()}
    return found, (found["quality"][2] >= 0.5) & (found["toxic"][2] < 0.5)


# The tables.

_SEEN = ("text", "source", "lang", "size")


def _columns(docs: DataFrame) -> list[Column]:
    null = F.lit(None)
    of = lambda name, kind: (F.col(name) if name in docs.columns else null).cast(kind)
    return [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), of("source", "string").alias("source"), of("lang", "string").alias("lang"), of("n_chars", "long").alias("size")]


def _lists(batch: pa.RecordBatch) -> list[list]:
    return [batch.column(c).to_pylist() for c in _SEEN]


_FEATURES = ("words", "dense", "meta")


def extracted(frame: DataFrame, known: np.ndarray | None, *kept: str) -> DataFrame:
    """The kept columns and what the views see (words, dense, meta) of documents with text, source, lang and size."""
    model = frame.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = Extractor(model.value)
        for b in batches:
            rows = extract(*_lists(b))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in rows)], [*kept, *_FEATURES])

    kinds = dict(frame.dtypes)
    return frame.select(*kept, *_SEEN).mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in kept) + "words binary, dense binary, meta binary")


def _rows(found: pa.Table | pa.RecordBatch) -> Rows:
    words, dense, meta = (found.column(c).to_pylist() for c in _FEATURES)
    return Rows([np.frombuffer(x, np.uint32) for x in words], np.frombuffer(b"".join(dense)).reshape(-1, MEASURES), [np.frombuffer(x, np.uint32) for x in meta])


def confident(others: DataFrame, targets: dict[str, Target], most: int) -> dict[str, list[dict[int, float]]]:
    """Of all documents (key, words, dense, meta), for each target and view the surest calls of either label, ``most`` of
    each at most, that the other view has not been given yet: {key: label}.

    A task keeps its surest calls only; what all tasks keep holds the surest of all."""
    model = {n: (t.views, t.scales, [set(g) for g in t.given]) for n, t in targets.items()}
    model = others.sparkSession.sparkContext.broadcast(model)
    judge = Target.each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int, int], dict[int, float]] = {}
        surest = lambda calls: dict(sorted(calls.items(), key=lambda x: (x[1], x[0]))[:most])
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("key").to_numpy()
            rows = _rows(b)
            for n, (views, scales, given) in model.value.items():
                t = Target(0.0)
                t.scales = scales
                for k, p in enumerate(judge(t, [v.margin(rows) for v in views])):
                    for label, doubt in ((1, np.round(1 - p, DOUBT_DIGITS)), (0, np.round(p, DOUBT_DIGITS))):
                        own = best.setdefault((n, k, label), {})
                        for i in np.flatnonzero(doubt < CONFIDENT).tolist():
                            if (key := int(keys[i])) not in given[1 - k]:
                                own[key] = float(doubt[i])
                        if len(own) > 4 * most:
                            best[n, k, label] = surest(own)
        rows = [(n, k, label, key, doubt) for (n, k, label), own in best.items() for key, doubt in surest(own).items()]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["target", "view", "label", "key", "doubt"])

    found = others.mapInArrow(run, "target string, view int, label int, key long, doubt double")
    found = found.groupBy("target", "view", "label", "key").agg(F.min("doubt").alias("doubt")).withColumn("part", F.pmod("key", F.lit(64)))
    for group in (["target", "view", "label", "part"], ["target", "view", "label"]):  # of each part, then of all
        nth = F.row_number().over(Window.partitionBy(*group).orderBy("doubt", "key"))
        found = found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    out: dict[str, list[dict[int, float]]] = {n: [{}, {}] for n in targets}
    for r in sorted(found.collect(), key=lambda r: (r.target, r.view, -r.label, r.key)):  # bounded by ``most``
        out[r.target][r.view][r.key] = float(r.label)
    return out


def fitted(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> Targets:
    """The targets, learnt from a bounded sample; labels has doc_id, quality and toxic."""
    prepare(docs.sparkSession)
    d = docs.select(*_columns(docs)).withColumn("key", F.xxhash64(*_SEEN))
    each = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    own = cut(each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "quality-labels")
    one = d.join(F.broadcast(own), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min_by(F.struct(*_SEEN), "key").alias("d"))
    one = one.select("doc_id", "quality", "toxic", "d.*").repartition(partitions(docs.sparkSession))
    found = extracted(one, None, "doc_id", "quality", "toxic").toArrow()  # bounded by labelled
    known = list(zip(*(found.column(c).to_pylist() for c in ("doc_id", "quality", "toxic")), range(found.num_rows), strict=True))
    known.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    rows = _rows(found).pick(np.array([r[3] for r in known], np.int64))
    del found
    labels_of = [np.array([np.nan if r[i] is None else float(r[i] > 0) for r in known]) for i in (1, 2)]
    targets = Targets({n: Target(default) for n, default in zip(TARGETS, (0.5, 0.0), strict=True)})
    targets.known = vocabulary(rows.words, labels_of)
    rows = numbered(rows, targets.known)
    for n, y in zip(TARGETS, labels_of, strict=True):
        told = np.flatnonzero(~np.isnan(y))
        targets[n].start(rows.pick(told), y[told])
    learning = {n: t for n, t in targets.items() if t.constant is None}
    if learning:
        targets.table = cut(extracted(d, targets.known, "doc_id", "key"), "quality-features")
        others = targets.table.join(F.broadcast(own.select("doc_id")), "doc_id", "left_anti")
        exchange(others, learning, max(1, pool // 10) if pool else 0)
    return targets


def exchange(others: DataFrame, targets: dict[str, Target], most: int, pick: Callable = confident) -> None:
    """The rounds of co-training: views are trained, call the other documents, and are given each other's surest calls."""
    for _ in range(ROUNDS if most and targets else 0):
        for t in targets.values():
            t.train()
        calls = pick(others, targets, most)
        keys = sorted({key for n in calls for found in calls[n] for key in found})
        seen = {}
        if keys:
            wanted = others.sparkSession.createDataFrame([(k,) for k in keys], "key long")
            found = others.join(F.broadcast(wanted), "key").groupBy("key").agg(F.first(F.struct(*_FEATURES)).alias("d")).select("key", "d.*").toArrow()
            rows = _rows(found)
            seen = {k: rows.pick(np.array([i])) for i, k in enumerate(found.column("key").to_pylist())}
        for n, t in targets.items():
            t.learn([{key: (label, seen[key]) for key, label in calls[n][k].items()} for k in (0, 1)])
    for t in targets.values():
        t.train()
        t.combine()


_NAMES = [f"{v}_{n}" for n in TARGETS for v in ("text", "meta", "p")]


def _results(targets: dict[str, Target], rows: Rows) -> list[pa.Array]:
    found, keep = scored(targets, rows)
    return [*(pa.array(x) for n in TARGETS for x in found[n]), pa.array(keep)]


def judged(docs: DataFrame, targets: Targets, carried: tuple[str, ...] = ()) -> DataFrame:
    """Adds to every row, beside doc_id: p_quality and p_toxic (both views), text_* and meta_* (each view), and keep.

    ``carried`` names columns of ``docs`` that are passed on; one named like a result is passed on as carried_<name>."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((dict(targets), targets.known))
    frame = docs.select(*_columns(docs), *(F.col(c).alias(f"_{i}") for i, c in enumerate(carried)))
    extra = [f"_{i}" for i in range(len(carried))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, known = model.value
        extract = Extractor(known)
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_results(targets, extract(*_lists(b))), *(b.column(c) for c in extra)], ["doc_id", *_NAMES, "keep", *extra])

    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = "doc_id long, " + ", ".join(f"{n} double" for n in _NAMES) + ", keep boolean" + "".join(f", {c} {kinds[c]}" for c in extra)
    new = {e: f"carried_{c}" if c in (*_NAMES, "keep") else c for e, c in zip(extra, carried, strict=True) if c != "doc_id"}
    out = frame.mapInArrow(run, schema)
    return out.select("doc_id", *_NAMES, "keep", *(F.col(e).alias(c) for e, c in new.items()))


def judged_here(targets: Targets) -> DataFrame:
    """``judged`` for the rows that the targets were fitted on, from what was extracted then."""
    model = targets.table.sparkSession.sparkContext.broadcast(dict(targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_results(model.value, _rows(b))], ["doc_id", *_NAMES, "keep"])

    return targets.table.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in _NAMES) + ", keep boolean")


def kept(docs: DataFrame, targets: Targets) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names."""
    prepare(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((dict(targets), targets.known))
    frame = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)), *_columns(docs))
    extra = [f"_{i}" for i in range(len(docs.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        targets, known = model.value
        extract = Extractor(known)
        for b in batches:
            if b.num_rows:
                yield b.select(extra).filter(pa.array(scored(targets, extract(*_lists(b)))[1]))

    out = frame.mapInArrow(run, frame.select(*extra).schema)
    return out.select(*(F.col(e).alias(c) for e, c in zip(extra, docs.columns, strict=True)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    targets = fitted(docs, table(spark, sf_dir, "labels"))
    return judged(docs, targets) if targets.table is None else judged_here(targets)
