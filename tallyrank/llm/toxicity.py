"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two short character windows by their common subsequences
of three characters within a span of six; each occurrence counts
``DECAY ** span``, so an insult keeps most of its similarity when characters
are inserted into it or left out of it.  Landmark windows give the Nyström
embedding, and a squared-hinge support vector machine is fitted in it on
windows of labelled sentences.  As the kernel is linear in its subsequence
features, landmarks and weights fold into one vector over hashed features: a
window is scored by a gather and a sum.

A sentence is read as letters with a mark at each blank.  Windows slide over
each word, and over each two neighbouring words that are short together, so an
insult that a blank cuts in two (id iot), or one of two words, is one string;
single letters in a row are joined (i d i o t), and what stands between letters
is passed over (i.d.i.o.t), digits that look like letters being read as these.

Labels belong to documents, so training is multiple-instance: the windows of
a clean document's sentences are negative, and of a toxic document's those are
positive that are witnesses, units seen in many different contexts of toxic
documents and hardly in clean ones; then those that the machine so trained
scores like them.  Variants with a letter put in or left out join the positives.

A document is judged over its whole text.  Its different units are a mixture: a
share of insults, whose margins are distributed as what toxic documents hold
more of, and the rest as in clean documents.  The score is a logistic function
of the log likelihood ratio at the best such share, so one unit that clean
documents never hold is enough, and of those they hold now and then it takes
several, close together.  Both distributions and the rule are fitted on documents
that the machine has not seen, by cross-validation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .common import bound_batches

#: Bounds of the labelled sample: documents of either kind, and about how many characters of one, in pieces from all over it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 4000, 20_000
PIECE_CHARS = 1000
THRESHOLD = 0.7

WIDTH = 9
SPAN = 6
DECAY = 0.75
DIM_LOG2 = 17
LANDMARKS = 320
ROUNDS = 2
FOLDS = 2
PENALTY = 5.0
#: Letters of two neighbouring words, together, with which they are also read as one.
LEAST_PAIR, PAIR_LETTERS = 4, 8
#: Standard errors by which a pair of words must be more frequent in toxic documents to be a witness.
PAIR_ERRORS = 8.0
#: Most witnesses, those whose variants are made, and negative units of a fit.
WITNESSES, VARIED, NEGATIVES = 1500, 150, 6000
SLICE_BYTES = 4 << 20
NO_WORDS = -4.0
#: Margins below the first are those of plain words; shares of insults that are tried.
STEPS = np.arange(-1, 5, 0.25)
SHARES = 0.0005 * 2.0 ** np.arange(10)
#: A clean document that is rejected counts as so many toxic ones that pass.
FALSE_ALARM = 2

# (j, k) offsets of the second and third character after the first, and the weight of each.
_OFFSETS = [(j, k) for j in range(1, SPAN) for k in range(j + 1, SPAN)]
_WEIGHTS = np.array([DECAY ** (k - 2) for _, k in _OFFSETS], np.float32)


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


# Signs that stand for a letter inside a word.
_LOOKS_LIKE = str.maketrans("0134578@$", "oieastbas")


def letters(token: str) -> str:
    """Lower-case letters of a token; with a letter in it, signs that look like letters count as these."""
    if token.isalpha():
        return token.lower()
    if any(map(str.isalpha, token)):
        token = token.translate(_LOOKS_LIKE)
    return "".join(filter(str.isalpha, token)).lower()


def windows_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0 to WIDTH, number of the token) of all windows; each token has a boundary mark before it."""
    points, owner = [], []
    by_length: dict[int, list[int]] = {}
    for k, t in enumerate(tokens):
        by_length.setdefault(len(t) + 1, []).append(k)
    for n, own in by_length.items():
        codes = np.frombuffer("".join("^" + tokens[k] for k in own).encode("utf-32-le"), np.uint32).reshape(-1, n)
        if n <= WIDTH:
            points.append(np.pad(codes, ((0, 0), (0, WIDTH - n))))
            owner.append(np.array(own))
        else:
            view = np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=1)
            points.append(view.reshape(-1, WIDTH))
            owner.append(np.repeat(np.array(own), view.shape[1]))
    if not points:
        return np.empty((0, WIDTH), np.uint32), np.empty(0, np.int64)
    return np.concatenate(points), np.concatenate(owner)


def subsequences(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature numbers, weights) of each window's three-character subsequences, weights of unit length."""
    index, weight = [], []
    p = points.astype(np.uint64)
    for (j, k), w in zip(_OFFSETS, _WEIGHTS):
        if k >= WIDTH:
            continue
        a, b, c = p[:, : WIDTH - k], p[:, j : WIDTH - k + j], p[:, k:]
        h = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xC2B2AE3D27D4EB4F) + c
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        index.append((h >> np.uint64(64 - DIM_LOG2)).astype(np.int32))
        weight.append(np.where(c > 0, w, np.float32(0)))
    index, weight = np.concatenate(index, axis=1), np.concatenate(weight, axis=1)
    norm = np.sqrt((weight * weight).sum(axis=1, keepdims=True))
    return index, weight / np.maximum(norm, 1e-6)


@dataclass
class Model:
    """Folded feature weights and intercept of the machine; the rule: likelihood ratios by margin of words and of pairs, slope and shift."""

    weights: np.ndarray
    bias: float
    ratios: np.ndarray | None = None
    slope: float = 1.0
    shift: float = -20.0

    def windows(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.float32)
        for at in range(0, len(points), 1 << 13):
            index, weight = subsequences(points[at : at + (1 << 13)])
            out[at : at + (1 << 13)] = (self.weights[index] * weight).sum(axis=1)
        return out + np.float32(self.bias)

    def tokens(self, tokens: list[str]) -> np.ndarray:
        best = np.full(len(tokens), NO_WORDS, np.float32)
        for at in range(0, len(tokens), 1 << 15):
            points, owner = windows_of(tokens[at : at + (1 << 15)])
            np.maximum.at(best, owner + at, self.windows(points))
        return best

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.shift, -40, 40)))


@dataclass
class Units:
    """Different units of some documents: the document of each, its margin, whether it is a pair; and the documents' numbers of different words."""

    doc: np.ndarray
    margin: np.ndarray
    pair: np.ndarray
    words: np.ndarray

    def near(self) -> np.ndarray:
        return np.flatnonzero(self.margin >= STEPS[0])

    def evidence(self, ratios: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of each document at its best share of insults; 0 where no share is better than none."""
        near = self.near()
        step = np.searchsorted(STEPS, self.margin[near], "right") - 1
        ratio, doc = ratios[self.pair[near].astype(np.int64), step], self.doc[near]
        rest = np.maximum(self.words - np.bincount(doc, minlength=len(self.words)), 0)
        best = np.zeros(len(self.words))
        for share in SHARES:
            np.maximum(best, np.bincount(doc, np.log(1 - share + share * ratio), len(self.words)) + rest * np.log(1 - share), out=best)
        return best


def likelihood_ratios(units: list[Units], toxic: list[np.ndarray]) -> np.ndarray:
    """(2, steps): how much likelier a margin of that step is in an insult than in a clean document's word, or pair of words.

    The insults' margins are what toxic documents have more of, word for word:
    steps at which they have less than twice as much count as noise.
    """
    found = np.zeros((2, 2, len(STEPS)))  # pairs or words, toxic or clean, step
    words = np.ones(2)
    for u, t in zip(units, toxic):
        near = u.near()
        step = np.searchsorted(STEPS, u.margin[near], "right") - 1
        for k, of in enumerate((t, ~t)):
            words[k] += u.words[of].sum()
            for pair in (0, 1):
                found[pair, k] += np.bincount(step[of[u.doc[near]] & (u.pair[near] == bool(pair))], minlength=len(STEPS))
    rate = found[0] / words[:, None]
    insult = np.where(rate[0] > 2 * rate[1], rate[0] - rate[1], 0)
    insult = np.maximum(insult / max(insult.sum(), 1e-9), 1e-4)
    clean = (found[:, 1] + 0.5) / words[1]
    return np.maximum.accumulate(insult / clean, axis=1)


def nothing_is_toxic() -> Model:
    return Model(np.zeros(1 << DIM_LOG2, np.float32), NO_WORDS)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (last: intercept) that minimise |w|^2/2 + sum cost * max(0, 1 - y f)^2, by Newton's method.

    The normal equations are summed over blocks of rows, so no copy of ``x`` is made.
    """
    m = x.shape[1] + 1
    w = np.zeros(m)
    ridge = np.eye(m)
    ridge[-1, -1] = 1e-3
    for _ in range(20):
        left, right = ridge.copy(), np.zeros(m)
        for at in range(0, len(x), 2048):
            part = np.hstack([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))]).astype(np.float64)
            yy = y[at : at + 2048]
            act = yy * (part @ w) < 1
            weighted = part[act] * cost[at : at + 2048][act, None]
            left += 2 * weighted.T @ part[act]
            right += 2 * weighted.T @ yy[act]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _fit(points: np.ndarray, y: np.ndarray, cost: np.ndarray, landmarks: np.ndarray) -> Model:
    """Nyström embedding on ``landmarks`` and the machine in it, folded to feature weights.

    Only features that a landmark has matter, so the arrays have a row for each of those.
    """
    index, weight = subsequences(landmarks)
    known, at = np.unique(index, return_inverse=True)
    base = np.zeros((len(landmarks), len(known) + 1), np.float32)  # the last column: features of no landmark
    np.add.at(base, (np.arange(len(landmarks))[:, None], at.reshape(index.shape)), weight)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    root = (vectors / np.sqrt(np.maximum(values, 1e-3))).astype(np.float32)
    project = base.T @ root  # features -> embedding
    of = np.full(1 << DIM_LOG2, len(known), np.int32)
    of[known] = np.arange(len(known))
    x = np.empty((len(points), project.shape[1]), np.float32)
    for start in range(0, len(points), 128):
        index, weight = subsequences(points[start : start + 128])
        x[start : start + 128] = np.matmul(weight[:, None, :], project[of[index]])[:, 0]
    w = _svm(x, y.astype(np.float64), cost)
    folded = np.zeros(1 << DIM_LOG2, np.float32)
    folded[known] = (project[:-1] @ w[:-1].astype(np.float32)).astype(np.float32)
    return Model(folded, float(w[-1]))


def _variants(word: str, alphabet: list[str], rng: np.random.Generator) -> list[str]:
    """The word with a foreign letter at each inner place, and with each letter but the first left out."""
    inserted = [word[:at] + alphabet[int(rng.integers(len(alphabet)))] + word[at:] for at in range(1, len(word))]
    return inserted + [word[:at] + word[at + 1 :] for at in range(1, len(word))]


class _Corpus:
    """The units of labelled documents: which documents hold which, and how often."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        number: dict[str, int] = {}
        docs, tokens, lefts = [], [], []
        for k, text in enumerate(texts):
            for sentence in sentences(text):
                got = [number.setdefault(u, len(number)) for u in units(sentence)]
                docs += [k] * len(got)
                tokens += got
                lefts += [-1, *got][: len(got)]
        self.toxic, self.names = np.asarray(toxic, bool), list(number)
        self.doc, self.token, self.left = np.array(docs, np.int64), np.array(tokens, np.int64), np.array(lefts, np.int64)

    def contexts(self, of: np.ndarray) -> np.ndarray:
        """For each unit in how many different contexts (unit before it) it stands in the chosen documents: copies of a text count once."""
        own = of[self.doc]
        pair = np.unique(self.token[own] * (len(self.names) + 1) + self.left[own] + 1)
        return np.bincount(pair // (len(self.names) + 1), minlength=len(self.names))

    def units(self, margin: np.ndarray, of: np.ndarray) -> Units:
        """Different units of the chosen documents, which are numbered anew."""
        own = of[self.doc]
        key = np.unique((np.cumsum(of) - 1)[self.doc[own]] * len(self.names) + self.token[own])
        doc, unit = key // len(self.names), key % len(self.names)
        pair = np.array(["^" in u for u in self.names])[unit]
        return Units(doc, margin[unit], pair, np.bincount(doc[~pair], minlength=int(of.sum())))


def _machine(corpus: _Corpus, of: np.ndarray, seed: int) -> Model:
    """The machine trained on the chosen documents, without a rule."""
    rng = np.random.default_rng(seed)
    toxic, clean = of & corpus.toxic, of & ~corpus.toxic
    n1, n0 = toxic.sum(), clean.sum()
    a, b = corpus.contexts(toxic), corpus.contexts(clean)
    if not n1 or not n0 or not a.any() or not b.any():
        return nothing_is_toxic()
    lift = ((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    z = (a / n1 - b / n0) / np.sqrt(np.maximum((a + b) / (n1 + n0), 1e-9) * (1 / n1 + 1 / n0))
    pair = np.array(["^" in u for u in corpus.names])
    single = ~pair & np.array([len(u) > 2 for u in corpus.names])
    # There are so many pairs of words that chance alone makes some stand out.
    beyond = np.where(pair, PAIR_ERRORS, 4.0)
    own = toxic[corpus.doc]
    for least in (8, 5, 3, 2, 1):
        chosen = (a >= least) & (lift >= 6) & (z > (beyond if least > 2 else np.where(pair, PAIR_ERRORS, 0)))
        explained = len(np.unique(corpus.doc[own][chosen[corpus.token[own]]])) == n1
        if explained or (chosen & single).sum() >= 3 or chosen.any() and least <= 2:
            break
    witness = np.flatnonzero(chosen) if chosen.any() else np.array([int(np.argmax(z))])
    present = np.flatnonzero(b)
    model, margin = None, np.zeros(len(corpus.names), np.float32)
    for _ in range(ROUNDS):
        if model is not None:
            grown = np.flatnonzero((a >= 2) & (lift >= 4) & (~pair | (z > PAIR_ERRORS)) & (margin > -0.2))
            witness = np.union1d(witness, grown)
        witness = witness[np.argsort(-a[witness], kind="stable")][:WITNESSES]
        alphabet = sorted({c for u in present[rng.permutation(len(present))[:2000]] for c in corpus.names[u] if c.isalpha()}) or ["x"]
        words = [corpus.names[u] for u in witness]
        support = np.sqrt(a[witness].astype(np.float64))
        varied, share = [], []
        for word, n in list(zip(words, support))[:VARIED]:
            if len(word) >= 4:
                forms = _variants(word, alphabet, rng)
                varied += forms
                share += [n / len(word)] * len(forms)
        positive, owner = windows_of(words + varied)
        importance = np.concatenate([support, share])[owner]
        importance /= np.bincount(owner)[owner]
        others = np.setdiff1d(present, witness)
        hard = others[np.argsort(-margin[others], kind="stable")[: NEGATIVES // 2]] if model is not None else others[:0]
        some = rng.choice(others, min(len(others), NEGATIVES), replace=False) if len(others) else others
        rows = np.unique(np.concatenate([hard, some])).astype(np.int64)
        negative, owner = windows_of([corpus.names[u] for u in rows])
        weight = np.minimum(b[rows], 4.0)[owner] / 2
        half = min(len(positive), LANDMARKS * 5 // 8)
        best = np.argsort(-importance, kind="stable")[: half // 2]
        rest = np.setdiff1d(np.arange(len(positive)), best)
        pick = np.concatenate([best, rng.choice(rest, min(len(rest), half - len(best)), replace=False)]).astype(np.int64)
        drawn = rng.choice(len(negative), min(len(negative), LANDMARKS - len(pick)), replace=False) if len(negative) else np.empty(0, np.int64)
        points = np.concatenate([positive, negative])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        model = _fit(points, y, np.concatenate([importance, weight]) * PENALTY, np.concatenate([positive[pick], negative[drawn]]))
        margin = model.tokens(corpus.names)
    return model


def _rule(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift that put THRESHOLD where errors weigh least, in the widest gap among the best.

    There it is nearer to the clean side: disguised insults, which the sample lacks, are weaker evidence than plain ones.
    """
    order = np.argsort(evidence, kind="stable")
    m, t = evidence[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(t)]) + FALSE_ALARM * ((~t).sum() - np.concatenate([[0], np.cumsum(~t)]))
    ends = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    gap = ends[1:] - ends[:-1]
    best = np.flatnonzero((errors == errors[gap > 1e-9].min()) & (gap > 1e-9))
    k = best[np.argmax(gap[best])]
    slope = 1.0
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * (ends[k] + 0.2 * (ends[k + 1] - ends[k])))


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Model:
    """Model of labelled documents, the same in whatever order they come. With only one kind of label nothing is toxic."""
    toxic = np.asarray(toxic, bool)
    order = sorted(range(len(texts)), key=lambda k: (texts[k], bool(toxic[k])))
    texts, toxic = [texts[k] for k in order], toxic[order]
    corpus = _Corpus(texts, toxic)
    if not toxic.any() or toxic.all() or not corpus.names:
        return nothing_is_toxic()
    everything = np.ones(len(texts), bool)
    model = _machine(corpus, everything, seed)
    # Copies follow each other in this order; blocks keep most of them in one fold.
    fold = (np.arange(len(texts)) // 8) % FOLDS
    seen, marks = [], []
    for k in range(FOLDS):
        part = _machine(corpus, fold != k, seed)
        seen.append(corpus.units(part.tokens(corpus.names), fold == k))
        marks.append(toxic[fold == k])
    model.ratios = likelihood_ratios(seen, marks)
    model.slope, model.shift = _rule(np.concatenate([u.evidence(model.ratios) for u in seen]), np.concatenate(marks))
    return model


_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> list[str]:
    return _SENTENCE.split(text)


def units(sentence: str) -> list[str]:
    """What windows are taken from: the letters of each word, of two short neighbours with a mark between, and of runs of single letters."""
    parts = [p for p in (letters(t) for t in sentence.split()) if p]
    out = list(parts)
    out += [f"{a}^{b}" for a, b in zip(parts, parts[1:]) if LEAST_PAIR <= len(a) + len(b) <= PAIR_LETTERS]
    run: list[str] = []
    for p in [*parts, ""]:
        if len(p) == 1:
            run.append(p)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def letters_of(tokens: pa.Array) -> pa.Array:
    """:func:`letters` of each token; one by one only where signs may stand for letters."""
    signs = pc.match_substring_regex(tokens, r"[0134578@$]")
    plain = pc.utf8_lower(pc.replace_substring_regex(tokens, r"[^\pL]+", ""))
    if not pc.any(signs).as_py():
        return plain
    return pc.replace_with_mask(plain, signs, pa.array([letters(t) for t in tokens.filter(signs).to_pylist()], pa.large_string()))


class _Words:
    """Distinct words of a slice as code points, one after the other."""

    def __init__(self, names: pa.Array):
        self.names = names.to_pylist()
        self.size = np.fromiter(map(len, self.names), np.int64, len(self.names))
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(self.names).encode("utf-32-le", "surrogatepass"), np.uint32)

    def rows(self, own: np.ndarray, n: int) -> np.ndarray:
        """Code points of words of one length, a row each."""
        return self.codes[self.start[own, None] + np.arange(n)]


class Scorer:
    """Evidence against whole texts."""

    def __init__(self, model: Model):
        self.model = model

    def _best(self, points: np.ndarray) -> np.ndarray:
        """Greatest margin of each row's windows; rows are marked code points of one length."""
        if points.shape[1] <= WIDTH:
            return self.model.windows(np.pad(points, ((0, 0), (0, WIDTH - points.shape[1]))))
        view = np.lib.stride_tricks.sliding_window_view(points, WIDTH, axis=1)
        return self.model.windows(view.reshape(-1, WIDTH)).reshape(len(points), -1).max(axis=1)

    def _of_words(self, words: _Words) -> np.ndarray:
        out = np.full(len(words.size), NO_WORDS, np.float32)
        for n in np.unique(words.size[words.size > 0]).tolist():
            own = np.flatnonzero(words.size == n)
            step = max(1, (1 << 17) // n)
            for at in range(0, len(own), step):
                some = own[at : at + step]
                out[some] = self._best(np.hstack([np.full((len(some), 1), ord("^"), np.uint32), words.rows(some, n)]))
        return out

    def _of_pairs(self, a: np.ndarray, b: np.ndarray, words: _Words) -> np.ndarray:
        """Margins of pairs of words, given by number."""
        out = np.full(len(a), NO_WORDS, np.float32)
        shape = words.size[a] * (PAIR_LETTERS + 1) + words.size[b]
        for kind in np.unique(shape).tolist():
            n, m = divmod(kind, PAIR_LETTERS + 1)
            own = np.flatnonzero(shape == kind)
            for at in range(0, len(own), 1 << 14):
                some = own[at : at + (1 << 14)]
                mark = np.full((len(some), 1), ord("^"), np.uint32)
                out[some] = self._best(np.hstack([mark, words.rows(a[some], n), mark, words.rows(b[some], m)]))
        return out

    def evidence(self, column: pa.Array) -> np.ndarray:
        """What :meth:`Model.probability` takes; 0 for a text without words."""
        split = pc.utf8_split_whitespace(pc.fill_null(column, "").cast(pa.large_string()))
        tokens = split.flatten()
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(tokens) or self.model.ratios is None:
            return np.zeros(len(counts))
        coded = tokens.dictionary_encode()
        # Spellings with the same letters are one word.
        spelt = letters_of(coded.dictionary).dictionary_encode()
        words = _Words(spelt.dictionary)
        margin, size, n = self._of_words(words), words.size, len(words.size)
        index = spelt.indices.to_numpy().astype(np.int64)[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(counts)), counts)
        filled = size[index] > 0  # what has no letter does not keep words apart
        index, doc = index[filled], doc[filled]
        word = pc.unique(pa.array(doc * n + index)).to_numpy()
        a, b = index[:-1], index[1:]
        both = size[a] + size[b]
        near = np.flatnonzero((doc[1:] == doc[:-1]) & (both >= LEAST_PAIR) & (both <= PAIR_LETTERS))
        pairs = pa.array(a[near] * n + b[near]).dictionary_encode()
        key, most = pairs.dictionary.to_numpy(), max(len(pairs.dictionary), 1)
        both = pc.unique(pa.array(doc[near] * most + pairs.indices.to_numpy())).to_numpy()
        docs = [word // n, both // most]
        margins = [margin[word % n], self._of_pairs(key // n, key % n, words)[both % most]]
        distinct = np.bincount(docs[0], minlength=len(counts))
        # Runs of three single letters and more, each joined to one unit.
        single = np.flatnonzero(size[index] == 1)
        if len(single) > 2:
            breaks = np.flatnonzero((np.diff(single) != 1) | (doc[single[1:]] != doc[single[:-1]])) + 1
            first = np.concatenate([[0], breaks])
            last = np.concatenate([breaks, [len(single)]])
            runs = np.flatnonzero(last - first >= 3)
            if len(runs):
                joined = ["".join(words.names[t] for t in index[single[first[k] : last[k]]]) for k in runs]
                margins[0] = np.concatenate([margins[0], self.model.tokens(joined)])
                docs[0] = np.concatenate([docs[0], doc[single[first[runs]]]])
        pair = np.arange(len(docs[0]) + len(docs[1])) >= len(docs[0])
        return Units(np.concatenate(docs), np.concatenate(margins), pair, distinct).evidence(self.model.ratios)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, most: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> list:
    """At most ``most[value]`` labelled rows (text, label) for each label value, of ids that are not held out, in the order of a hash of the id."""
    own = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("__id").isNotNull())
    own = own.filter(~held_out(F.col("__id"), modulus, remainder))
    order = [F.xxhash64("__id"), F.col("__id")]
    chosen = reduce(DataFrame.unionByName, [own.filter(F.col("label") == v).dropDuplicates(["__id"]).orderBy(*order).limit(n) for v, n in most.items()])
    # Of a long text every k-th piece is taken, over all of it.
    pieces = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"(?s)(.{{1,{PIECE_CHARS}}}(?=\s|$)|.{{1,{PIECE_CHARS}}})"), F.lit(1))
    step = F.ceil(F.size("pieces") * PIECE_CHARS / SAMPLE_CHARS)
    short = F.array_join(F.filter("pieces", lambda _, k: k % F.greatest(step, F.lit(1)) == 0), "\n")
    held = F.when(F.char_length("text") <= SAMPLE_CHARS, F.col("text")).otherwise(short)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # An id given both labels, or to several documents, may give more rows: the bound holds for these too.
    own = text.join(F.broadcast(chosen), "__id").filter("text is not null").withColumn("pieces", F.when(F.char_length("text") > SAMPLE_CHARS, pieces))
    return own.select("__id", held.alias("text"), "label").orderBy(*order, "label", "text").limit(sum(most.values())).select("text", "label").collect()


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model trained on the driver from a sample of at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents, none held out."""
    rows = sample_labelled(docs, labels, "toxic", 3, 1, {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}, id_col, text_col)
    return train([r["text"] for r in rows], np.array([r["label"] == 1 for r in rows], bool))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns toxic_score (0 to 1) and toxic, over whole texts.

    Null and empty texts have no words and no suspicion; equal texts score
    alike, however often they come; an empty table gives an empty one.
    """

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = [scorer.evidence(b.column(0)) for b in slices(iter([batch]), "text", SLICE_BYTES)]
            yield pa.array(model.probability(np.concatenate(parts)) if parts else [], pa.float64())

    bound_batches(docs.sparkSession)
    score = F.arrow_udf(work, "double")(F.col(text_col))
    return docs.withColumn("toxic_score", score).withColumn("toxic", F.col("toxic_score") >= THRESHOLD)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text scores as an empty one, a null id is held out, repeated rows
    each get their row, and an empty table gives an empty report.
    """
    model = train_on(docs, labels)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").cast("int").alias("predicted")
    )


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with their own columns.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty one.
    """
    model = train_on(docs, labels)
    return score_toxicity(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), model).filter("not toxic").select("row.*")
