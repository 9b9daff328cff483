"""Toxicity by a weighted finite-state pattern grammar.

Tokens become symbols (insulting word, intensifier, harmful verb, intent, target,
negation, reported speech, clause end, other) through a lexicon of fixed seeds
and of terms learned from labels. Small transducers are composed into one that
rewrites each insulting word or harmful verb by its place in the clause: an
insult (alone or intensified), a threat (a verb after an intent), what is aimed
at a target, negated, or reported. A document is scored by its matched clauses,
calibrated on labels.

Fitted on a bounded sample, the parameter ``per_class`` of ``fit``: so many
labelled rows of each class at most, whose whole texts are read.

Defined cases: null and empty texts match nothing and get the score of a text
without matches; texts of any length are read whole; labels with null fields
are left out; no labels, or one class, give the smoothed prior with the seed
lexicon; keys are of any type; ties in the sample are broken by key; repeated
rows get equal scores each; an empty table gives no row; other columns are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import bounded, fit_logistic, hash_words, shingle_hashes, sigmoid, slices, stored, tokens

#: Bounds of the sample of labelled rows that the model is fitted on.
SAMPLE_PER_CLASS = 6000
#: A learned term occurs in so many toxic texts of the sample at least, and so
#: many times as often (in logarithms) in toxic texts as in others.
MIN_SUPPORT, MIN_LOG_RATIO = 3, 3.0
#: A term's gain, in twice the log likelihood, is one of these at least beyond what
#: chance gives the best of all terms tried: the one whose lexicon, learned on the
#: other parts, has the least loss on the calibration's part, each half of it judged
#: by the other half's weights.
MIN_GAINS = (4.0, 0.0, -4.0, -8.0)
#: The sample is dealt over so many parts: one for the calibration, the others for the lexicon.
PARTS = 4
PREFIXES = (4, 5, 6, 7)

# Seed words of each symbol, in English, German, French and Spanish.
SEEDS = {
    "i": "idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting dummkopf idioten abschaum crétin imbécile ordure imbécil basura",
    "h": "kill hurt destroy beat shoot stab strangle töten umbringen verprügeln tuer frapper détruire matar golpear destruir",
    "t": "you your you're youre u he she they them him her this that those these everyone du ihr euch dich dein sie diese tu toi vous ton ils elle cette tú usted ustedes ellos ellas ese esa esta",
    "n": "not no never neither nor isn't aren't wasn't don't doesn't didn't won't without nicht kein keine keinen nie niemals ohne ne pas jamais aucun aucune sans nunca jamás ni sin",
    "m": "will gonna going shall must should i'll we'll werde werden sollte muss vais vas allons voy vas vamos",
    "a": "so such very utterly total totally complete completely absolute absolutely real really damn bloody fucking sehr total völlig verdammt très vraiment totalement sacré muy tan totalmente maldito",
    "r": "said says say wrote writes called calls claimed claims quoted quotes reported reportedly according alleged sagte sagt schrieb nannte laut angeblich zitierte dit disait écrit écrivait selon appelé cité dijo dice escribió llamó según citó",
}
SEED_WEIGHT = 3.0
SYMBOLS = "oithnrbma"  # other, insult, target, harm, negation, report, clause end, intent, intensifier
#: What a matched insult or threat has become, and its factor in a clause's score.
FACTORS = {"i": 1.0, "x": 1.2, "I": 1.5, "j": 0.3, "q": 0.3, "h": 0.1, "y": 0.5, "H": 1.5, "k": 0.2}
_PUNCT = "\"'`.,;:!?()[]{}<>*_~…«»„“”‚‘’¿¡-–—|"
_ENDS = ".,;:!?…|"


@dataclass
class Transducer:
    """States, their arcs (state, input) -> (output, next state); an input
    without an arc is copied and the state kept."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol), (symbol, state))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """Feeds the first one's output to the second; reachable states only."""
    out = Transducer(f"{first.start}|{second.start}")
    todo, seen = [(first.start, second.start)], set()
    while todo:
        a, b = pair = todo.pop()
        if pair in seen:
            continue
        seen.add(pair)
        for s in symbols:
            middle, na = first.step(a, s)
            result, nb = second.step(b, middle)
            out.arcs[f"{a}|{b}", s] = result, f"{na}|{nb}"
            todo.append((na, nb))
    return out


def within(trigger: str, reach: int, rewrite: dict[str, str], symbols: str, ends: str = "b") -> Transducer:
    """Rewrites symbols in the ``reach`` tokens after a trigger of the same clause."""
    out = Transducer("0")
    for left in range(reach + 1):
        for s in symbols:
            after = str(max(0, left - 1))
            if s == trigger:
                out.arcs[str(left), s] = s, str(reach)
            elif s in ends:
                out.arcs[str(left), s] = s, "0"
            else:
                out.arcs[str(left), s] = (rewrite.get(s, s) if left else s), after
    return out


def grammar() -> Transducer:
    insult = within("a", 2, {"i": "x"}, SYMBOLS)
    threat = within("m", 3, {"h": "y"}, SYMBOLS + "x")
    target = within("t", 4, {"i": "I", "x": "I", "h": "y", "y": "H"}, SYMBOLS + "xy")
    negation = within("n", 3, {"i": "j", "x": "j", "I": "j", "h": "k", "y": "k", "H": "k"}, SYMBOLS + "xyIH")
    reported = within("r", 8, {"i": "q", "x": "q", "I": "q", "j": "q", "h": "k", "y": "k", "H": "k"}, SYMBOLS + "xyIHjk")
    whole = insult
    for part in (threat, target, negation, reported):
        whole = compose(whole, part, SYMBOLS)
    return whole


def _compiled(machine: Transducer) -> tuple[int, list[list[tuple[str, int]]]]:
    names = sorted({s for s, _ in machine.arcs} | {machine.start})
    index = {n: i for i, n in enumerate(names)}
    return index[machine.start], [[(o, index[n]) for o, n in (machine.step(name, s) for s in SYMBOLS)] for name in names]


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]  # whole words; prefixes end with *
    beta: tuple[float, ...]


class _Lexicon:
    def __init__(self, terms: dict[str, float]):
        self.exact = {w: (s, SEED_WEIGHT if s in "ih" else 0.0) for s, words in SEEDS.items() for w in words.split()}
        self.exact.update({w: ("i", v) for w, v in terms.items() if not w.endswith("*")})
        self.prefixes = {w[:-1]: v for w, v in terms.items() if w.endswith("*")}
        self.heads = {w[:4] for w in (*self.exact, *self.prefixes)} | {w for w in self.exact if len(w) < 4}

    def classify(self, token: str) -> tuple[str, float]:
        word = token.strip(_PUNCT)
        if not word.isascii():
            word = word.lower()
        if word[:4] in self.heads:
            if word in self.exact:
                return self.exact[word]
            for size in reversed(PREFIXES):
                if len(word) > size and (v := self.prefixes.get(word[:size])) is not None:
                    return "i", v
        return "o", 0.0


def _terms(token: str) -> list[str]:
    word = token.strip(_PUNCT)
    if not word.isascii():
        word = word.lower()
    if len(word) < 3 or not any(c.isalpha() for c in word):
        return []
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class _Matcher:
    def __init__(self, terms: dict[str, float]):
        self.lexicon = _Lexicon(terms)
        self.start, self.table = _compiled(grammar())
        self.end = SYMBOLS.index("b")

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: logarithms of the summed weights of plain, aimed, negated
        and reported insults and of threats, and of the heaviest clause."""
        codes, offsets, words = tokens(texts)
        out = np.zeros((len(offsets) - 1, 6))
        found = [self.lexicon.classify(w) for w in words]
        kind = np.array([SYMBOLS.index(s) for s, _ in found], np.int64)
        weight = [v for _, v in found]
        ends = np.array([w[-1] in _ENDS for w in words], bool)
        loud = np.array([s in "ih" for s, _ in found], bool)
        at = np.flatnonzero(loud[codes]) if len(codes) else np.zeros(0, np.int64)
        column = {"i": 0, "x": 0, "I": 1, "j": 2, "q": 3, "h": 4, "y": 4, "H": 4, "k": 4}
        for d in np.unique(np.searchsorted(offsets, at, "right") - 1):
            own = codes[offsets[d] : offsets[d + 1]]
            state, clause, heaviest = self.start, 0.0, 0.0
            for code, k, end in zip(own.tolist(), kind[own].tolist(), ends[own].tolist(), strict=True):
                symbol, state = self.table[state][k]
                if symbol in FACTORS:
                    value = weight[code] * FACTORS[symbol]
                    out[d, column[symbol]] += value
                    clause += value
                    heaviest = max(heaviest, clause)
                if end:
                    state, clause = self.table[state][self.end][1], 0.0
            out[d, 5] = heaviest
        return np.log1p(out)


def _chosen(strong: list) -> dict[str, float]:
    """Terms and their weights; a prefix is kept where it reaches clearly more
    texts than any one term in it."""
    reach: dict[str, int] = {}
    for r in strong:
        for n in PREFIXES:
            if len(r["term"]) > n + r["term"].endswith("*"):
                head = r["term"][:n] + "*"
                reach[head] = max(reach.get(head, 0), r["toxic"])
    return {r["term"]: r["ratio"] for r in strong if r["toxic"] > 1.2 * reach.get(r["term"], 0)}


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The logistic loss of each half of the rows under the weights of the other."""
    half = np.arange(len(y)) % 2 == 0
    loss = 0.0
    for own in (half, ~half):
        beta = fit_logistic(x[~own], y[~own], w[~own], rising=True)
        v = x[own] @ beta[:-1] + beta[-1]
        loss += float((w[own] * (np.logaddexp(0, v) - y[own] * v)).sum())
    return loss


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most ``per_class`` labelled texts of each class (those with the
    smallest hash of their key): one part, with weights for the classes' shares
    of all labels, for the calibration, the other parts for the lexicon."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("_k"), (F.col(label) > 0).cast("int").alias("_y")).dropna()
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y in sorted(counts):
        picked += known.where(F.col("_y") == y).distinct().orderBy(F.xxhash64("_k", F.lit(29)), "_k").limit(per_class).collect()
    if not picked:
        return Model({}, (0.0, 0.0, 0.0, 0.0, 0.0, 2.0, -3.0))
    # At most 2 * per_class rows of a key and two integers.
    sample = spark.createDataFrame([(r["_k"], r["_y"], i % PARTS) for i, r in enumerate(picked)], f"_k {labels.schema[key].dataType.simpleString()}, _y int, _part int")
    rows = bounded(docs).select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(sample), "_k")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                codes, offsets, words = tokens(batch.column("text"))
                hashed = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
                least = [min(shingle_hashes(hashed[a:b], 5).tolist(), default=0) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("_y"), batch.column("text"), pa.array(np.array(least, np.uint64).view(np.int64))], ["_y", "text", "mark"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                codes, offsets, words = tokens(batch.column("text"))
                index: dict[str, int] = {}
                lists = [[index.setdefault(t, len(index)) for t in _terms(w)] for w in words]
                size = np.array([len(x) for x in lists], np.int64)
                flat = np.array([t for x in lists for t in x], np.int64)
                begin = np.r_[0, np.cumsum(size)]
                y = np.asarray(batch.column("_y").to_pylist())
                seen = np.zeros((2, len(index)), np.int64)
                for d in range(len(offsets) - 1):
                    own = np.unique(codes[offsets[d] : offsets[d + 1]])
                    if len(own):
                        took = np.unique(np.concatenate([flat[begin[c] : begin[c + 1]] for c in own]))
                        seen[y[d], took] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), pa.array(seen[1]), pa.array(seen[0])], ["term", "toxic", "clean"])

    # Copies of one text, exact or near, are one witness: most share the mark.
    witnesses = rows.where("_part > 0").select("_y", "text").mapInArrow(marked, "_y int, text string, mark long").dropDuplicates(["_y", "mark"])
    terms = witnesses.mapInArrow(counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    of = [sum(1 for i, r in enumerate(picked) if r["_y"] == y and i % PARTS) for y in (0, 1)]
    ratio = F.log((F.col("toxic") + 0.5) / (of[1] + 1)) - F.log((F.col("clean") + 0.5) / (of[0] + 1))
    share = of[1] / max(1, sum(of))
    gain = 2 * F.col("toxic") * F.log(F.col("toxic") / ((F.col("toxic") + F.col("clean")) * share)) if share else F.lit(0.0)
    common = terms.where(F.col("toxic") >= MIN_SUPPORT).withColumns({"ratio": ratio, "gain": gain})
    # The more terms there are to choose from, the more support each must have.
    common = stored(common, "toxic-terms")
    bar = 2 * math.log(max(2, common.count()))
    # Terms of the bounded sample only: each toxic text of it supports a few.
    strong = common.where((F.col("ratio") >= MIN_LOG_RATIO) & (F.col("gain") >= bar + min(MIN_GAINS))).orderBy("term").collect()
    lexicons = [_chosen([r for r in strong if r["gain"] >= bar + least]) for least in MIN_GAINS]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [_Matcher(terms) for terms in lexicons]
        for whole in batches:
            for batch in slices(whole):
                x = np.hstack([m.features(batch.column("text")) for m in matchers])
                yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_y"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["k", "y", "x"])

    key_type = labels.schema[key].dataType.simpleString()
    got = rows.where("_part = 0").mapInArrow(measured, f"k {key_type}, y int, x array<double>").collect()
    got.sort(key=lambda r: (r["y"], str(r["k"]), r["x"]))  # halves don't depend on tasks
    y = np.array([r["y"] for r in got], float)
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(lexicons), 6)
    per = {k: counts[k] / max(1, (y == k).sum()) for k in counts}
    w = np.array([per[int(v)] for v in y])
    w *= len(w) / max(w.sum(), 1e-9)
    best = min(range(len(lexicons)), key=lambda i: (_loss(x[:, i], y, w), i)) if len(got) else 0
    return Model(lexicons[best], tuple(fit_logistic(x[:, best], y, w, rising=True)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score (0 to 1, higher: toxic likelier) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, beta = _Matcher(model.terms), np.array(model.beta)
        for whole in batches:
            for batch in slices(whole):
                p = sigmoid(matcher.features(batch.column("text")) @ beta[:-1] + beta[-1])
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p)], [key, "score"])

    return bounded(docs).select(key, F.col(text).alias("text")).mapInArrow(scored, f"`{key}` {kind}, score double")
