"""Toxicity by a gapped-subsequence kernel machine with Nystroem landmarks.

Units are the blank-separated strings of a text and what neighbours give when joined, whatever
white space or lone punctuation parts them and without punctuation at their ends: two strings
of JOINED characters together, any that follow each other in a run of strings of at most SHORT
characters if they have JOINED together, and whole runs of single characters or of such short
strings. An insult of over JOINED characters cut into longer pieces isn't joined.
A unit is a row of character classes between two end marks. Its features are all
subsequences of three characters within SPAN places, weighted DECAY for each place skipped, so
insults with gaps or inserted characters stay close to the plain ones. Landmarks are the units
that mark toxic documents most clearly and frequent ones of the others, joined ones left out;
after each fit the units of clean documents that score highest join the training set. The kernel between
landmarks gives the Nystroem map, and a support vector machine (squared hinge) is fitted on it.
As the kernel's features are explicit, the machine folds into one table of weights, so scoring
needs no landmark. A document scores by its most toxic unit, calibrated by a logistic curve.
Joined units, of which a text has many by chance, count less by an offset that keeps CALM of the
sampled clean documents below even odds.

Bounds of the training sample (the only rows that are sampled): SAMPLE documents of each label,
MARKERS toxic, PLAIN other units and HARD more of these a round. Training takes units of at
most WINDOW characters only. Every text is scored whole: longer units in overlapping windows.

Defined results
* Null, empty and wordless texts score like a text whose only unit is neutral.
* No toxic label: every score is 0; nothing but toxic labels: every score is 1.
* Repeated rows score alike; documents with contradicting labels count as toxic.
* Empty table: no row. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.common import process_store, written

SAMPLE = 4000
MARKERS, PLAIN = 400, 6000
LEAST_DOCS, LEAST_Z, LEAST_RATIO = 3, 6.0, 10.0
HARD, ROUNDS = 3000, 3
CLASSES = 40
SPAN, DECAY = 6, 0.6
STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
WINDOW, STRIDE = 48, 28
NEUTRAL = -4.0
CACHE = 800_000
SHORT, JOINED = 3, 12
CALM = 0.99
#: Fixed look-alikes: what a reader takes the character for.
LOOKS = str.maketrans("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ0134578@$", "aaaaaaceeeeiiiinoooooouuuuyyoieastbas")
INNER = re.compile(r"[^\w]+|_+")


ENDS = "\"'.,;:!?()[]{}*#%&|<>-_/\\~+="


@lru_cache(100_000)
def bare(piece: str) -> str:
    core = piece.strip(ENDS)
    return core if core.isascii() and core.isalpha() else INNER.sub("", core.translate(LOOKS))


def parts_of(text: str | None) -> tuple[set[str], set[str]]:
    """The text's own units (strings, spelled-out runs), and those joined from neighbours."""
    pieces = (text or "").lower().split()
    cores = [c for p in pieces if (c := p if p.isascii() and p.isalpha() else bare(p))]
    own = set(pieces)
    joined = {a + b for a, b in zip(cores, cores[1:]) if len(a) + len(b) <= JOINED}
    for single, run in groupby(cores, lambda c: len(c) == 1):
        if single and len(run := list(run)) > 2:
            own.add("".join(run))
    for short, run in groupby(cores, lambda c: len(c) <= SHORT):
        if not short or len(run := list(run)) < 3:
            continue
        joined.add("".join(run))
        for at, unit in enumerate(run):
            for core in run[at + 1 : at + JOINED]:
                unit += core
                if len(unit) > JOINED:
                    break
                joined.add(unit)
    return own, joined - own


def units_of(text: str | None) -> set[str]:
    own, joined = parts_of(text)
    return own | joined


def spellings(unit: str) -> list[str]:
    """The unit with and without what stands between its letters, in windows if long."""
    # No look-alike is or becomes a character of ENDS.
    core = unit.strip(ENDS)
    if len(core) <= STRIDE and core.isascii() and core.isalpha():
        return [core]
    core = core.translate(LOOKS)
    both = dict.fromkeys([core, INNER.sub("", core)])
    out = []
    for s in both:
        out += [s[a : a + WINDOW] for a in range(0, max(1, len(s) - WINDOW + STRIDE), STRIDE)]
    return out


def coded(strings: list[str]) -> np.ndarray:
    """Rows of classes: letters from 0, other letters and digits from 26, gaps -1, the end marks last."""
    width = max(map(len, strings), default=0) + 2
    out = np.full((len(strings), width + SPAN), -1, np.int32)
    if not len(strings):
        return out
    together = "".join([s.ljust(width) for s in strings]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(together, np.int32).reshape(len(strings), width)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    inside = np.arange(width)[None, :] < lengths[:, None]
    letter = (points >= 97) & (points <= 122)
    other = (points >= 128) | ((points >= 48) & (points <= 57))
    classes = np.where(letter, points - 97, np.where(other, 26 + points % (CLASSES - 28), -1))
    out[:, 1 : width + 1] = np.where(inside, classes, -1)
    out[:, 0] = CLASSES - 2
    out[np.arange(len(strings)), lengths + 1] = CLASSES - 1
    return out


def occurrences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each step pattern: index of the triple at every place, its validity, its weight."""
    reach = codes.shape[1] - SPAN + 1
    for j, k in STEPS:
        a, b, c = codes[:, :reach], codes[:, j : j + reach], codes[:, k : k + reach]
        yield (a * CLASSES + b) * CLASSES + c, (a >= 0) & (b >= 0) & (c >= 0), DECAY ** (k - 2)


def scale_of(codes: np.ndarray) -> np.ndarray:
    """What each unit's features are divided by: the root of its squared weights."""
    total = sum((ok.sum(axis=1) * w * w for _, ok, w in occurrences(codes)), np.zeros(len(codes)))
    return np.sqrt(np.maximum(total, 1.0))


def raw_sums(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights of all features of each unit, not yet divided by its scale."""
    total = np.zeros(len(codes))
    for index, ok, weight in occurrences(codes):
        total += weight * np.where(ok, weights[np.where(ok, index, 0)], 0.0).sum(axis=1, dtype=np.float64)
    return total


def features(codes: np.ndarray) -> np.ndarray:
    """The explicit features of a few units (dense; for training only)."""
    out = np.zeros((len(codes), CLASSES**3), np.float32)
    for index, ok, weight in occurrences(codes):
        rows, places = np.nonzero(ok)
        np.add.at(out, (rows, index[rows, places]), weight)
    return out / scale_of(codes)[:, None].astype(np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    offset: float = 0.0

    def units(self, strings: list[str]) -> np.ndarray:
        out = np.empty(len(strings))
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            codes = coded([strings[i] for i in part])
            out[part] = raw_sums(codes, self.weights) / scale_of(codes) + self.bias
        return out

    def margins(self, texts: list[str | None], known: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """The margins of the most toxic own and joined unit of each text; `known` remembers units."""
        sets = [parts_of(t) for t in texts]
        fresh = list(set().union(*(s for both in sets for s in both)) - known.keys())
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            forms = [spellings(u) for u in some]
            scores = self.units([s for f in forms for s in f])
            ends = np.cumsum([len(f) for f in forms])
            best = np.maximum.reduceat(scores, np.concatenate([[0], ends[:-1]]))
            known.update(zip(some, best.tolist()))
        most = lambda units, least: max(map(known.__getitem__, units), default=least)
        own = np.array([most(s, NEUTRAL) for s, _ in sets], np.float64)
        joined = np.array([most(s, -np.inf) for _, s in sets], np.float64)
        if len(known) > CACHE:
            known.clear()
        return own, joined

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -50, 50)))


def text_maxima(values: np.ndarray, texts: np.ndarray, out: np.ndarray) -> None:
    """Raise each text's entry of `out` to the largest of its values; `texts` is sorted."""
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
        out[texts[first]] = np.maximum(out[texts[first]], np.maximum.reduceat(values, first))


class Scorer:
    """Margins of whole texts, a batch at a time, in arrays of piece numbers.

    A joined unit of two pieces is never spelled out: its features are those inside the first
    piece with the mark before it, those inside the second with the mark after it (both known for
    each piece), and those across the border, which the five places on either side decide. Windows
    of runs of short pieces take running sums over the run and the features of the two marks.
    """

    SIDE = SPAN - 1

    def __init__(self, model: Model) -> None:
        self.model = model
        # One class more, of weight 0, stands for places outside.
        size = CLASSES + 1
        self.weights = np.zeros((size, size, size))
        self.weights[:CLASSES, :CLASSES, :CLASSES] = model.weights.reshape(CLASSES, CLASSES, CLASSES)
        self.flat = self.weights.ravel()
        lengths = np.arange(2 * JOINED + 3)
        squares = sum(DECAY ** (2 * (k - 2)) * np.maximum(0, lengths - k) for _, k in STEPS)
        self.scales = np.sqrt(np.maximum(squares, 1.0))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.cores: list[str] = []
        self.own, self.before, self.after = np.zeros(0), np.zeros(0), np.zeros(0)
        self.sizes = np.zeros(0, np.int64)
        self.heads, self.tails = (np.zeros((0, self.SIDE), np.int8) for _ in range(2))

    def best_forms(self, units: list[str]) -> np.ndarray:
        """The margin of each unit's best spelling."""
        forms = [spellings(u) for u in units]
        # A word with and without punctuation is one form.
        number: dict[str, int] = {}
        flat = [number.setdefault(s, len(number)) for f in forms for s in f]
        scores = self.model.units(list(number))[flat]
        ends = np.cumsum([len(f) for f in forms])
        return np.maximum.reduceat(scores, np.concatenate([[0], ends[:-1]]))

    def add(self, pieces: list[str]) -> None:
        cores = [p if p.isascii() and p.isalpha() else bare(p) for p in pieces]
        sizes = np.fromiter(map(len, cores), np.int64, len(cores))
        before, after = np.zeros(len(cores)), np.zeros(len(cores))
        heads, tails = (np.full((len(cores), self.SIDE), CLASSES, np.int8) for _ in range(2))
        # Longer pieces are never joined.
        short = np.flatnonzero((sizes > 0) & (sizes < JOINED))
        if len(short):
            codes = coded([cores[i] for i in short])
            n, width = sizes[short], codes.shape[1]
            place = np.arange(width)[None, :]
            before[short] = raw_sums(np.where(place <= n[:, None], codes, -1), self.model.weights)
            after[short] = raw_sums(np.where(place >= 1, codes, -1), self.model.weights)
            padded = np.where(codes >= 0, codes, CLASSES)
            for back in range(self.SIDE):
                # Up to and with the mark before the piece; from the piece's first place to the mark after it.
                at = n - back
                tails[short, self.SIDE - 1 - back] = np.where(at >= 0, padded[np.arange(len(short)), np.maximum(at, 0)], CLASSES)
                at = np.minimum(1 + back, width - 1)
                heads[short, back] = np.where(1 + back <= n + 1, padded[:, at], CLASSES)
        first = len(self.cores)
        self.numbers.update(zip(pieces, range(first, first + len(pieces))))
        self.cores += cores
        self.own = np.concatenate([self.own, self.best_forms(pieces)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.before, self.after = np.concatenate([self.before, before]), np.concatenate([self.after, after])
        self.heads, self.tails = np.concatenate([self.heads, heads]), np.concatenate([self.tails, tails])

    def weight(self, a, b, c) -> np.ndarray:
        size = CLASSES + 1
        return self.flat[(a * size + b) * size + c]

    def pair_margins(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        codes = np.concatenate([self.tails[one], self.heads[two]], axis=1).T.astype(np.int64)
        total = self.before[one] + self.after[two]
        for j, k in STEPS:
            for i in range(self.SIDE - k, self.SIDE):
                total += DECAY ** (k - 2) * self.weight(codes[i], codes[i + j], codes[i + k])
        return total / self.scales[self.sizes[one] + self.sizes[two] + 2] + self.model.bias

    def window_margins(self, letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Margins of the windows [start, end) of `letters`, in which SPAN outside places part the runs."""
        total, length = np.zeros(len(start)), end - start
        first, last = CLASSES - 2, CLASSES - 1
        padded = np.concatenate([letters, np.full(SPAN, CLASSES)])
        for k in range(2, SPAN):
            weight = DECAY ** (k - 2)
            here = np.arange(len(letters))
            inner = sum(self.weight(padded[here], padded[here + j], padded[here + k]) for j in range(1, k))
            sums = np.concatenate([[0.0], np.cumsum(inner)])
            total += weight * np.where(end - k > start, sums[np.maximum(end - k, 0)] - sums[start], 0.0)
            for j in range(1, k):
                opening = self.weight(first, padded[np.maximum(start - 1 + j, 0)], padded[start - 1 + k])
                closing = self.weight(padded[np.maximum(end - k, 0)], padded[np.maximum(end - k + j, 0)], last)
                both = self.weight(first, padded[np.maximum(start - 1 + j, 0)], last)
                total += weight * (np.where(k <= length, opening + closing, 0.0) + np.where(k == length + 1, both, 0.0))
        return total / self.scales[length + 2] + self.model.bias

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The margins of the most toxic own and joined unit of each text."""
        pieces, counts = [], []
        for text in texts:
            some = (text or "").lower().split()
            pieces += some
            counts.append(len(some))
        if len(self.cores) > CACHE:
            self.clear()
        if fresh := list(set(pieces) - self.numbers.keys()):
            for at in range(0, len(fresh), 50_000):
                self.add(fresh[at : at + 50_000])
        which = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        text = np.repeat(np.arange(len(texts)), counts)
        own, joined = np.full(len(texts), -np.inf), np.full(len(texts), -np.inf)
        text_maxima(self.own[which], text, own)
        own[np.array(counts) == 0] = NEUTRAL
        kept = self.sizes[which] > 0
        which, text = which[kept], text[kept]
        sizes = self.sizes[which]
        if len(which) > 1:
            near = (text[1:] == text[:-1]) & (sizes[1:] + sizes[:-1] <= JOINED)
            keys, place = np.unique(which[:-1][near] * len(self.cores) + which[1:][near], return_inverse=True)
            found = np.concatenate([self.pair_margins(*np.divmod(keys[a : a + 50_000], len(self.cores))) for a in range(0, len(keys), 50_000)] or [np.zeros(0)])
            text_maxima(found[place], text[:-1][near], joined)
        self.single_runs(which, text, sizes, own)
        self.short_runs(which, text, sizes, joined)
        return own, joined

    @staticmethod
    def runs(able: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place of the runs of at least three able pieces of one text."""
        if not len(able):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.concatenate([[True], (able[1:] != able[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(able))
        chosen = able[first] & (last - first > 2)
        return first[chosen], last[chosen]

    def spelled(self, which: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, out: np.ndarray) -> None:
        """Whole runs as units."""
        units: dict[str, int] = {}
        runs = [units.setdefault("".join([self.cores[i] for i in which[a:b].tolist()]), len(units)) for a, b in zip(first.tolist(), last.tolist())]
        if runs:
            text_maxima(self.best_forms(list(units))[runs], text[first], out)

    def single_runs(self, which: np.ndarray, text: np.ndarray, sizes: np.ndarray, own: np.ndarray) -> None:
        first, last = self.runs(sizes == 1, text)
        self.spelled(which, text, first, last, own)

    def short_runs(self, which: np.ndarray, text: np.ndarray, sizes: np.ndarray, joined: np.ndarray) -> None:
        first, last = self.runs(sizes <= SHORT, text)
        if not len(first):
            return
        total = np.concatenate([[0], np.cumsum(sizes)])
        # Runs of up to JOINED letters are among the windows.
        long = total[last] - total[first] > JOINED
        self.spelled(which, text, first[long], last[long], joined)
        pieces = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), last.tolist())])
        run = np.repeat(np.arange(len(first)), last - first)
        size, ends = sizes[pieces], np.cumsum(sizes[pieces])
        # Places of letters, with SPAN outside places after each run.
        start = ends - size + SPAN * run
        letters = np.full(int(ends[-1]) + SPAN * len(first), CLASSES, np.int64)
        codes = self.heads[which[pieces]]
        for i in range(SHORT):
            here = size > i
            letters[start[here] + i] = codes[here, i]
        begins, stops, texts = [], [], []
        for more in range(2, JOINED):
            if more >= len(pieces):
                break
            stop = start[more:] + size[more:]
            fits = (run[more:] == run[:-more]) & (stop - start[:-more] <= JOINED)
            if not fits.any():
                break
            begins.append(start[:-more][fits])
            stops.append(stop[fits])
            texts.append(text[pieces[:-more]][fits])
        if begins:
            texts = np.concatenate(texts)
            order = np.argsort(texts, kind="stable")
            found = self.window_margins(letters, np.concatenate(begins), np.concatenate(stops))
            text_maxima(found[order], texts[order], joined)


def fit_machine(texts: list[str], labels: np.ndarray, landmarks: list[str], cost: float = 10.0) -> tuple[np.ndarray, float]:
    """Weights over the explicit features, and bias, of the machine in the Nystroem space."""
    marks = features(coded(landmarks))
    gram = marks @ marks.T
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    parts = [features(coded(texts[a : a + 250])) @ marks.T for a in range(0, len(texts), 250)]
    z = np.column_stack([np.concatenate(parts) @ root, np.ones(len(texts))])
    weight = np.where(labels > 0, np.sqrt(len(labels) / max(1, (labels > 0).sum())), 1.0)
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w)) / cost
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        active = labels * (z @ w) < 1
        za, ca = z[active], weight[active]
        new = np.linalg.solve(za.T @ (za * ca[:, None]) + ridge, za.T @ (ca * labels[active]))
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return (root @ w[:-1]) @ marks, float(w[-1])


def fit_curve(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with the classes weighed to `share` toxic."""
    weight = np.where(labels, share / max(1, labels.sum()), (1 - share) / max(1, (~labels).sum()))
    w, x = np.array([1.0, 0.0]), np.column_stack([margins, np.ones(len(margins))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (weight * (p - labels)) + 1e-4 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
    return max(0.0, float(w[0])), float(w[1])


def held_out(doc_id: str, parts: int, part: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of at most `size` documents a label, chosen by a hash; label counts."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for k in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "_id")
    # At most two samples' ids are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).drop("_id")
    return written(rows, "toxicity-sample"), counts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model from the labelled rows (doc_id, toxic), or a constant score."""
    rows, counts = labelled_sample(docs, labels, sample)
    if not counts.get(1) or not counts.get(0):
        return 1.0 if counts.get(1) else 0.0

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = [u for u in parts_of(text)[0] if len(u) <= WINDOW]
                yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "toxic": pa.array([toxic] * len(units), pa.int32())})

    units = rows.select("text", F.col("toxic").cast("int")).mapInArrow(split, "unit string, toxic int")
    units = units.groupBy("unit").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good"))
    units = written(units, "toxicity-units")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad, good = F.col("bad") / max(1, sizes.get(1, 0)), F.col("good") / max(1, sizes.get(0, 0))
    mean = (F.col("bad") + F.col("good")) / max(1, sum(sizes.values()))
    spread = F.sqrt(mean * (1 - mean) * (1 / max(1, sizes.get(1, 0)) + 1 / max(1, sizes.get(0, 0))))
    scored = units.withColumn("z", F.when(spread > 0, (bad - good) / spread).otherwise(0.0))
    order = [F.desc("z"), "unit"]
    clear = (F.col("bad") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z) & (bad >= LEAST_RATIO * good)
    markers = [r.unit for r in scored.filter(clear).orderBy(*order).limit(MARKERS).collect()]
    markers = markers or [r.unit for r in scored.filter("bad > 0").orderBy(*order).limit(10).collect()]
    half = PLAIN // 2
    usual = scored.filter("good > 0 and z < 1").orderBy(F.desc("good"), "unit").limit(half)
    any_of = scored.filter("good > 0 and z < 1").orderBy(F.xxhash64("unit"), "unit").limit(half)
    plain = [r.unit for r in usual.select("unit").unionByName(any_of.select("unit")).distinct().orderBy("unit").collect()]
    if not markers:
        return 0.0
    first = lambda units: [spellings(u)[0] for u in units]
    landmarks = list(dict.fromkeys(first(markers[:128]) + first(plain[:128])))
    for turn in range(ROUNDS + 1):
        strings = first(markers) + first(plain)
        truth = np.array([1.0] * len(markers) + [-1.0] * len(plain))
        weights, bias = fit_machine(strings, truth, landmarks)
        rough = Model(weights.astype(np.float32), bias, 1.0, 0.0)
        if turn < ROUNDS:
            hard = unit_margins(scored.filter((F.col("good") > 0) & (bad < 2 * good)).select("unit"), rough)
            found = [r.unit for r in hard.orderBy(F.desc("margin"), "unit").limit(HARD).collect()]
            plain = list(dict.fromkeys(plain + found))
    seen = rough_margins(rows, rough).collect()
    margins, marks = np.array([r.margin for r in seen]), np.array([r.toxic == 1 for r in seen])
    slope, shift = fit_curve(margins, marks, counts[1] / (counts[0] + counts[1]))
    calm = np.array([r.joined for r in seen])[~marks]
    high = np.quantile(calm, CALM, method="higher") if len(calm) else -np.inf
    even = -shift / slope if slope > 0 else 0.0
    return Model(rough.weights, bias, slope, shift, max(0.0, float(high - even)))


def unit_margins(units: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = model.units([spellings(u)[0] for u in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margins)], ["unit", "margin"])

    return units.mapInArrow(run, "unit string, margin double")


def rough_margins(rows: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            own, joined = model.margins(batch.column(0).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(joined), batch.column(1)], ["margin", "joined", "toxic"])

    return rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "margin double, joined double, toxic int")


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score of every row."""
    if not isinstance(model, Model):
        return docs.select("doc_id", F.lit(float(model)).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    key = f"toxicity-{held._jbroadcast.id()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = process_store(key).setdefault("scorer", Scorer(held.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own, joined = scorer.margins(part.column(1).to_pylist())
                scores = held.value.probability(np.maximum(own, joined - held.value.offset))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
