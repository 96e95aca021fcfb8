"""Operator 10, toxicity by a weighted finite-state pattern grammar.

Four transducers over word classes are composed into one deterministic machine that reads a clause from left
to right: negation (an insult or threat within reach of a negator is marked), reported speech (what stands
inside quotation marks or after a reporting verb is marked), target (one who is spoken to or of, before or
after) and event (what is left becomes a scored event). A clause is worth the summed weights of its events,
not of its words; a document's score is the logistic of what its clauses are worth.

What is learned, from labelled rows only: which words and word stems insult (support in documents and in
different left neighbours, so that copies of one text cannot vote), and the weight of each event (logistic
regression around the grammar's own weights). Fitting uses a bounded sample of ``sample_rows`` labelled rows;
scoring is one narrow pass over all documents. The machine and lexicon are a few kilobytes.

Cases: null or empty text has no clause and gets the score of the bias alone; null labels are left out;
several labels of one document count once (the highest); without labelled rows the grammar's own weights
and lexicon are used; repeated rows give equal rows; very long texts and clauses are read whole.
"""
from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, filter_rows, flat, lean, runs, saved, ship, slices, text_column

# Word classes the grammar starts from (English, German, French, Spanish); the labels add insults and stems.
INSULTS = """idiot idiots stupid moron morons loser losers scum trash clown pathetic disgusting worthless imbecile
dumb dumbass bastard jerk pervert filth vermin retard freak ugly fool creep coward
idiotin dumm trottel arschloch abschaum dreck versager widerlich hurensohn schwein
idiote stupide connard salaud ordure imbécile crétin minable dégoûtant pourriture
idiota estúpido estúpida imbécil basura escoria inútil asqueroso cabrón gilipollas""".split()
THREATS = """kill murder strangle stab shoot punch beat destroy hurt töten umbringen erschießen schlagen vernichten
tuer frapper détruire égorger matar golpear destruir degollar""".split()
TARGETS = """you your yourself they them their these those everyone people women immigrants he she him her
dich dein deine euch ihr euer vous votre vos toi tien leur leurs usted ustedes vosotros ellos ellas""".split()
NEGATORS = "not no never neither nor isn aren wasn don doesn cannot nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás tampoco".split()
REPORTERS = "said says say wrote writes claimed claims called told quoted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
QUOTES = '"“”«»„'

#: Weight of an event before fitting: insult (I) or threat (T), with a target (+), negated (-), reported (~).
PRIOR = {"I": 2.5, "I+": 3.0, "I-": 1.0, "I+-": 1.2, "I~": 1.0, "I+~": 1.2, "I-~": 0.3, "I+-~": 0.4, "D": 0.3,
         "T": 0.2, "T+": 2.5, "T-": 0.0, "T+-": 0.5, "T~": 0.0, "T+~": 0.8, "T-~": 0.0, "T+-~": 0.2}
EVENTS = tuple(PRIOR)
PRIOR_BIAS, PRIOR_SPREAD = -1.5, 1.5

NEGATION_REACH, TARGET_REACH, AFTER_REACH = 3, 4, 3     # words
STEM_LENGTHS = (4, 5, 6)
MIN_BYTES = 4               # every insult and threat has this many bytes, which the scan's filter relies on
SCHEMA = "doc_id long, score double, predicted int, n_events long, n_clauses long, clause_worth double"

_TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}]")


@dataclass
class Transducer:
    """Deterministic, total on its alphabet: (state, symbol) -> (state, output)."""
    start: object
    step: Callable[[object, str], tuple[object, str]]
    alphabet: tuple[str, ...]

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other one reads what this one writes."""
        def step(state, symbol):
            a, mid = self.step(state[0], symbol)
            b, out = other.step(state[1], mid)
            return (a, b), out
        return Transducer((self.start, other.start), step, self.alphabet)

    def table(self) -> dict[int, dict[str, tuple[int, str]]]:
        """All reachable states, numbered, with their arcs."""
        number, todo, arcs = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            row = arcs[number[state]] = {}
            for symbol in self.alphabet:
                after, out = self.step(state, symbol)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                row[symbol] = (number[after], out)
        return arcs


def _negation(left: int, s: str) -> tuple[int, str]:
    if s == "N":
        return NEGATION_REACH, "o"
    return max(0, left - 1), s + "-" if left and s in "IT" else s


def _reported(state: tuple[bool, bool], s: str) -> tuple[tuple[bool, bool], str]:
    quoted, told = state
    if s == "Q":
        return (not quoted, told), "o"
    if s == "R":
        return (quoted, True), "o"
    return state, s + "~" if (quoted or told) and s[0] in "IT" else s


def _target(state: tuple[int, int], s: str) -> tuple[tuple[int, int], str]:
    """(words for which a target is still near, words for which an untargeted insult waits for one)."""
    near, waiting = state
    if s == "G":
        return (TARGET_REACH, 0), "D" if waiting else "o"
    after = (max(0, near - 1), max(0, waiting - 1))
    if s[0] in "IT":
        return (after[0], 0 if near else AFTER_REACH), s[0] + "+" * bool(near) + s[1:]
    return after, s


def _event(state: int, s: str) -> tuple[int, str]:
    return 0, s if s in PRIOR else ""


def grammar() -> dict[int, dict[str, tuple[int, str]]]:
    neg = Transducer(0, _negation, ("o", "I", "T", "G", "N", "R", "Q"))
    rep, tgt, evt = (Transducer(s, f, ()) for s, f in (((False, False), _reported), ((0, 0), _target), (0, _event)))
    return neg.then(rep).then(tgt).then(evt).table()


@dataclass
class Model:
    classes: dict[str, str] = field(default_factory=dict)       # word -> I, T, G, N, R, Q
    stems: frozenset[str] = frozenset()                         # beginnings of insults
    weights: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    bias: float = PRIOR_BIAS

    @classmethod
    def initial(cls) -> Model:
        classes = {}
        for kind, words in (("R", REPORTERS), ("N", NEGATORS), ("G", TARGETS), ("T", THREATS), ("I", INSULTS), ("Q", QUOTES)):
            classes.update(dict.fromkeys(words, kind))
        return cls(classes)

    def symbol(self, word: str) -> str:
        kind = self.classes.get(word)
        if kind is None:
            kind = "I" if any(word[:k] in self.stems for k in STEM_LENGTHS if len(word) > k) else "o"
        return kind

    def worth(self, events: list[str]) -> float:
        return sum(self.weights[e] for e in events)


# Scan: only clauses that hold an insult or threat are run through the machine.
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:\n"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of letters in lower-cased UTF-8: a to z and beyond ASCII, without general punctuation and Latin-1 signs."""
    mask = _LETTER[data]
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
        mask[at] = mask[at + 1] = mask[at + 2] = False
        at = np.flatnonzero((data[:-1] == 0xC2) & (data[1:] >= 0xA0) & (data[1:] != 0xAA) & (data[1:] != 0xB5) & (data[1:] != 0xBA))
        mask[at] = mask[at + 1] = False
    return mask


def _head(b0, b1, b2, b3):
    return (b0 * 31 + b1 * 1009 + b2 * 10007 + b3 * 40009) & 0xFFFF


def _heads(model: Model) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    for w in [w for w, k in model.classes.items() if k in "IT"] + list(model.stems):
        table[_head(*(int(x) for x in w.encode()[:4]))] = True
    return table


def scan(model: Model, machine: dict, heads: np.ndarray, column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(row, events of one clause) for each clause with an event."""
    data, offsets = flat(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = runs(_letters(data), offsets)
    room = np.flatnonzero(ends - starts >= MIN_BYTES)
    s = starts[room]
    d = data.astype(np.int64)
    room = room[heads[_head(d[s], d[s + 1], d[s + 2], d[s + 3])]] if len(s) else room
    raw = data.tobytes()
    hits = [i for i in room.tolist() if model.symbol(raw[starts[i]:ends[i]].decode("utf-8", "replace")) in "IT"]
    if not hits:
        return
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(_BREAK[data]) + 1]))
    at = np.unique(np.searchsorted(cuts, starts[hits], side="right") - 1)
    rows = np.searchsorted(offsets, cuts[at], side="right") - 1
    for row, lo, hi in zip(rows.tolist(), cuts[at].tolist(), cuts[at + 1].tolist()):
        state, events = 0, []
        for word in _TOKEN.findall(raw[lo:hi].decode("utf-8", "replace")):
            state, event = machine[state][model.symbol(word)]
            if event:
                events.append(event)
        if events:
            yield row, events


def _events(model: Model):
    """Arrow function: events of each document by kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, heads, index = grammar(), _heads(model), {e: i for i, e in enumerate(EVENTS)}
        for batch in batches:
            for part in slices(batch):
                counts = np.zeros((part.num_rows, len(EVENTS)), np.int32)
                for row, events in scan(model, machine, heads, part.column("text")):
                    for e in events:
                        counts[row, index[e]] += 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(counts), pa.list_(pa.int32()))],
                                                 names=["doc_id", "label", "counts"])
    return run


def score_texts(model: Model, machine: dict, heads: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: score, number of events, of matched clauses, worth of the worst clause."""
    weights, index = np.array([model.weights[e] for e in EVENTS]), {e: i for i, e in enumerate(EVENTS)}
    n = len(column)
    counts, clauses, most = np.zeros((n, len(EVENTS))), np.zeros(n, np.int64), np.zeros(n)
    for row, events in scan(model, machine, heads, column):
        clauses[row] += 1
        most[row] = max(most[row], model.worth(events))
        for e in events:
            counts[row, index[e]] += 1
    return 1 / (1 + np.exp(-(model.bias + np.log1p(counts) @ weights))), counts.sum(1).astype(np.int64), clauses, most


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, heads = grammar(), _heads(model)
        for batch in batches:
            for part in slices(batch):
                score, events, clauses, most = score_texts(model, machine, heads, part.column("text"))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(events),
                    pa.array(clauses), pa.array(most)], names=[f.split()[0] for f in SCHEMA.split(", ")])
    return run


# Fit
def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _word_keys(word):
    """A word itself and, for longer ones, its beginnings with a trailing '*'."""
    return F.array_compact(F.array(word, *(F.when(F.length(word) > k, F.concat(F.substring(word, 1, k), F.lit("*"))) for k in STEM_LENGTHS)))


def learn_lexicon(rows: DataFrame, max_entries: int = 4096, least: int = 5, log_odds: float = 3.0, z: float = 4.0) -> list[str]:
    """Words and stems (``stem*``) typical of label 1, by documents and different left neighbours."""
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = size.get(1, 0), size.get(0, 0)
    if not pos or not neg:
        return []
    words = rows.select("doc_id", "label", _words(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.col("w").alias("x"), F.concat(F.array(F.lit(None).cast("string")), "w").alias("p"))
    toxic = (words.filter("label = 1").select("doc_id", F.explode(F.filter(pairs, lambda y: y["x"].isNotNull())).alias("y"))
             .select("doc_id", F.col("y.p").alias("p"), F.explode(_word_keys(F.col("y.x"))).alias("k"))
             .filter(F.octet_length("k") >= MIN_BYTES + F.when(F.endswith("k", F.lit("*")), 1).otherwise(0))
             .groupBy("k").agg(F.countDistinct("doc_id").alias("a"), F.countDistinct("p").alias("v"))
             .filter(F.col("v") >= F.greatest(F.lit(least), 0.3 * F.col("a"))).filter(F.col("a") >= least)
             .orderBy(F.desc("a"), "k").limit(20 * max_entries))     # the rest has the least support
    clean = (words.filter("label = 0").select(F.explode(F.array_distinct(F.flatten(F.transform(F.array_distinct("w"), _word_keys)))).alias("k"))
             .groupBy("k").agg(F.count("*").alias("b")))
    a, b = F.col("a"), F.coalesce(F.col("b"), F.lit(0))
    lo = F.log((a + 0.5) / (pos - a + 0.5)) - F.log((b + 0.5) / (neg - b + 0.5))
    return [r["k"] for r in toxic.join(clean, "k", "left").withColumn("lo", lo)
            .withColumn("z", F.col("lo") / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
            .filter((F.col("lo") >= log_odds) & (F.col("z") >= z)).orderBy(F.desc("z"), "k").limit(max_entries).select("k").collect()]


def _fit_weights(counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a normal prior around the grammar's weights (Newton steps, weights not below 0)."""
    x = np.column_stack([np.log1p(counts), np.ones(len(y))])
    prior = np.array([PRIOR[e] for e in EVENTS] + [PRIOR_BIAS])
    inv = np.full(len(prior), PRIOR_SPREAD ** -2)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + inv * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(inv)
        step = np.linalg.solve(h, g)
        w = w - step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = 10_000) -> Model:
    """Fit on about ``sample_rows`` labelled rows at most (chosen by a hash of the id; all if there are fewer)."""
    ship(docs.sparkSession)
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label")))
    n = known.count()
    model = Model.initial()
    if not n:
        return model
    share = min(1.0, sample_rows / n)
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < F.lit(int(share * (1 << 62))))
    rows = saved(text_column(docs, id_col, text_col).join(some, "doc_id").dropDuplicates(["text", "label"]), "toxicity-sample")
    for key in learn_lexicon(rows):
        if key.endswith("*"):
            model.stems |= {key[:-1]}
        else:
            model.classes.setdefault(key, "I")
    got = rows.mapInArrow(lean(_events(model)), "doc_id long, label int, counts array<int>").select("label", "counts").collect()
    drop_saved(rows)
    y = np.array([r["label"] for r in got], float)
    if 0 < y.sum() < len(y):
        weights, model.bias = _fit_weights(np.array([r["counts"] for r in got], float), y)
        model.weights = dict(zip(EVENTS, weights.tolist()))
    return model


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: score, 0/1 prediction, numbers of events and matched clauses, the worth of the worst clause."""
    ship(docs.sparkSession)
    return text_column(docs, id_col, text_col).mapInArrow(lean(_score(model)), SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic."""
    machine, heads = grammar(), _heads(model)
    return filter_rows(docs, lambda column: score_texts(model, machine, heads, column)[0] < 0.5, text_col)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
