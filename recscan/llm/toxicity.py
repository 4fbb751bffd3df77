"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words of a clause become symbols of a tape. Five weighted transducers read it one after the other,
each what the one before wrote: the first marks insults (learned words, word beginnings and
phrases), the second threats (a violent or intended act and whom it is aimed at), the third the
insults aimed at someone, the fourth what is negated, the fifth what is reported speech. Each adds
weights; some guess what is still to come, and only paths whose guesses come true count. The best
path of their composition says in which context each hit of a clause stands, and the clause's
weight. Insult patterns and the weights of contexts are learned from labels; closed word classes
are fixed values. A document's score is the logistic of its clauses' hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import BROADCAST_ROWS, fit_logistic, materialize, small_batches

#: At most so many labelled rows, those with the smallest hashed ids, are learned from.
MAX_TRAIN = 20_000
#: A pattern needs this log-likelihood ratio (a phrase more, as there are more of them) and this share of toxic rows.
LEAST_G2, LEAST_G2_PHRASE, LEAST_SHARE = 20.0, 40.0, 0.5
#: Lengths of the word beginnings that are patterns, besides whole words, and of phrases in words.
STEMS, PHRASES = (4, 5, 6, 7, 8), (2, 3)
#: A beginning is a pattern if at least so many words with it, and this share of them, are mostly toxic.
STEM_WORDS, STEM_SHARE = 3, 0.8
THRESHOLD = 0.3

# Closed word classes of the grammar, in English, German, French and Spanish.
# Violent acts, in the forms that stand in threats.
ACTS = frozenset(
    "kill kills killed killing murder murders murdered murdering hurt hurts hurting destroy destroys destroying strangle strangles strangling stab stabs stabbing "
    "shoot shoots shooting beat beats beating burn burns burning töte töten umbringen vernichte vernichten erschieße erschießen schlage schlagen "
    "tuer tue tuerai tuons détruire frapper frappe frapperai matar mato mataré destruir golpear golpeo golpearé".split()
)
# Acts that hold their object: "I will kill you" in one word.
ACTS_ON_YOU = frozenset("matarte mataros golpearte destruirte pegarte romperte".split())
# Acts that threaten only where someone intends them, and nothing follows their object.
MILD_ACTS = frozenset("find get catch hunt break come finde finden kriege kriegen hole holen trouver trouverai attraper encontrar encontraré pillar".split())
INTENTIONS = frozenset("will gonna going shall want wanna werden wollen voulons veux".split())
# The speaker, as a pronoun or in the form of the verb.
SPEAKERS = frozenset("i we i'll we'll i'm we're i'd ich wir werde je nous vais allons yo voy vamos quiero queremos".split())
TARGETS = frozenset("you your yours yourself u ur du dein deine deiner ihr euer tu toi ton ta tes vous votre tú tus usted ustedes vosotros".split())
# Targets that can be an act's object, and words that may stand before one.
DIRECT = frozenset("you u ya yourself yourselves toi vous".split())
FILLERS = frozenset("all of every each one both alle tous toutes todos".split())
# What begins a second object, or makes the act a figure of speech: to beat you to it, to shoot you an email.
COMPLEMENTS = frozenset("a an the some any to at another more my our this that one's ein eine einen den die das un une la le les una el".split())
# What may end a mild threat.
CLOSINGS = frozenset("soon now tonight tomorrow again later all bald alle bientôt pronto".split())
# Words for a target that stand before the verb as well.
OBJECTS = frozenset("dich dir euch te ti os".split())
NEGATIONS = frozenset("not no never isn't aren't don't won't nicht kein keine nie niemals pas jamais ne nunca jamás".split())
REPORTS = frozenset("said says claimed quoted wrote called according sagte sagt schrieb laut dit disait écrit selon dijo dice escribió según".split())

OTHER, ACT, MILD_ACT, INTENTION, TARGET, OBJECT, NEGATION, REPORT, SPEAKER, YOU, FILLER, COMPLEMENT, CLOSING, ACT_ON_YOU = range(14)
_CLASSES = (
    (COMPLEMENTS, COMPLEMENT), (FILLERS, FILLER), (CLOSINGS - FILLERS, CLOSING), (ACTS, ACT), (ACTS_ON_YOU, ACT_ON_YOU), (MILD_ACTS, MILD_ACT), (INTENTIONS, INTENTION), (SPEAKERS, SPEAKER),
    (TARGETS, TARGET), (OBJECTS, OBJECT), (DIRECT, YOU), (NEGATIONS, NEGATION), (REPORTS, REPORT),
)
#: A hit on the tape: this bit, and what holds for it.
HIT, AIMED, NEGATED, REPORTED, THREAT = 16, 1, 2, 4, 8
#: How many words on an intention, a target, a negation and a report reach.
INTENTION_REACH, TARGET_REACH, NEGATION_REACH, REPORT_REACH = 4, 5, 3, 12
#: Weights of arcs: a threat, one with an intention, and what the contexts add.
THREATENS, INTENDED = 1.5, 0.5
ADDED = {AIMED: 0.3, NEGATED: -0.7, REPORTED: -0.6}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")


# ---- transducers --------------------------------------------------------------------------


class Transducer(NamedTuple):
    """A weighted transducer: in a state, on a symbol, some arcs (what it writes, to a state, weight)."""

    start: tuple
    arcs: Callable[[tuple, object], list[tuple[object, tuple, float]]]
    accepts: Callable[[tuple], bool] = lambda state: True


def insults(words: dict[str, float], phrases: dict[tuple[str, ...], float]) -> Transducer:
    """Reads (class, word or pattern); marks insulting words, and the last word of phrases it guessed at."""
    begun = {p[:n] for p in phrases for n in range(1, len(p))}

    def arcs(state: tuple, symbol: tuple[int, str]) -> list:
        kind, word = symbol
        path = (*state, word)
        on = [(kind, path, 0.0)] if path in begun else []
        if state:
            return on + ([(HIT, (), phrases[path])] if path in phrases else [])
        return [*on, (HIT, (), words[word]) if word in words else (kind, (), 0.0)]

    return Transducer((), arcs, lambda state: not state)


#: What a guessed threat still owes: its object next; no complement next; a mild one's object next; the end.
NOTHING, OBJECT_NEXT, NO_COMPLEMENT, MILD_OBJECT_NEXT, END = range(5)
#: What the transducers behind need not tell apart.
_AIMS, _PLAIN = (TARGET, OBJECT, YOU), frozenset((ACT, MILD_ACT, INTENTION, SPEAKER, FILLER, COMPLEMENT, CLOSING, ACT_ON_YOU))


def threats(reach: int = INTENTION_REACH) -> Transducer:
    """Marks acts as threats: of the speaker, or an order at the clause's start, with you as the verb's object.

    The object follows at once, or stands before the verb where languages put it there; no second object or
    figure of speech may follow, and nothing at all where the act alone is harmless.
    State: whether the clause has begun, words left of a speaker, of an intention and of an object before, what is owed.
    """

    def arcs(state: tuple, x: int) -> list:
        begun, speaker, intended, seen, owed = state
        if owed in (OBJECT_NEXT, MILD_OBJECT_NEXT):
            if x in (YOU, OBJECT):
                owed += 1
            elif x != FILLER:
                return []
        elif owed == NO_COMPLEMENT:
            if x == COMPLEMENT:
                return []
            owed = NOTHING
        elif owed == END and x not in (FILLER, CLOSING):
            return []
        speaks = x == SPEAKER or x == INTENTION and not begun
        ahead = (True, reach if speaks else max(speaker - 1, 0), reach if x == INTENTION or speaks else max(intended - 1, 0), reach if x == OBJECT else max(seen - 1, 0))
        plain = (TARGET if x in _AIMS else OTHER if x in _PLAIN else x, (*ahead, owed), 0.0)
        orders = not begun and x == ACT
        if owed or not (x in (ACT, ACT_ON_YOU) and (speaker or orders) or x == MILD_ACT and speaker and intended):
            return [plain]
        due = END if x == MILD_ACT and seen else MILD_OBJECT_NEXT if x == MILD_ACT else NO_COMPLEMENT if seen or x == ACT_ON_YOU else OBJECT_NEXT
        return [plain, (HIT | THREAT, (*ahead, due), THREATENS + INTENDED * (intended > 0))]

    return Transducer((False, 0, 0, 0, NOTHING), arcs, lambda state: state[4] in (NOTHING, NO_COMPLEMENT, END))


def targets(reach: int = TARGET_REACH) -> Transducer:
    """Marks insults as aimed where a target stands within reach before them, or is guessed to come."""

    def arcs(state: tuple, x: int) -> list:
        seen, owed = state
        if owed == 1 and x != TARGET:
            return []
        ahead = (reach if x == TARGET else max(seen - 1, 0), 0 if x == TARGET else max(owed - 1, 0))
        out = [(OTHER if x == TARGET else x, ahead, 0.0)]
        if x == HIT:
            aimed = ahead if seen or ahead[1] else (ahead[0], reach)
            out.append((x | AIMED, aimed, ADDED[AIMED]))
        return out

    return Transducer((0, 0), arcs, lambda state: not state[1])


def within(symbol: int, reach: int, flag: int) -> Transducer:
    """Adds ``flag`` and its weight to hits within ``reach`` words behind ``symbol``."""

    def arcs(state: tuple, x: int) -> list:
        (near,) = state
        ahead = (reach if x == symbol else max(near - 1, 0),)
        hit = x & HIT and near
        return [(x | flag if hit else OTHER if x == symbol else x, ahead, ADDED[flag] if hit else 0.0)]

    return Transducer((0,), arcs)


class Cascade:
    """The composition of transducers, each reading what the one before writes; built as it is walked."""

    def __init__(self, *parts: Transducer) -> None:
        self.parts, self.start = parts, tuple(p.start for p in parts)
        self.known: dict[tuple, list] = {}

    def arcs(self, state: tuple, symbol: object) -> list[tuple[int, tuple, float]]:
        found = self.known.get((state, symbol))
        if found is None:
            found = [(symbol, (), 0.0)]
            for part, s in zip(self.parts, state, strict=True):
                found = [(z, (*done, t), w + v) for y, done, w in found for z, t, v in part.arcs(s, y)]
            self.known[state, symbol] = found
        return found

    def best(self, tape: list) -> tuple[float, list[tuple[int, float]]]:
        """Weight of the best path over a tape, and its hits with their arcs' weights; ties go to the first found."""
        front: dict[tuple, tuple[float, tuple | None]] = {self.start: (0.0, None)}
        for symbol in tape:
            new: dict[tuple, tuple[float, tuple | None]] = {}
            for state, (weight, hits) in front.items():
                for x, to, w in self.arcs(state, symbol):
                    if to not in new or new[to][0] < weight + w:
                        new[to] = (weight + w, (hits, x, w) if x & HIT else hits)
            front = new
        ends = [v for state, v in front.items() if all(p.accepts(s) for p, s in zip(self.parts, state, strict=True))]
        weight, link = max(ends, key=lambda v: v[0])
        found = []
        while link is not None:
            link, x, w = link
            found.append((x, w))
        return weight, found[::-1]


#: Features of a document: weight of its strongest hits in each context (all flags of a mark), and of the strongest clause. Further
#: hits add nothing, so that a long text is not toxic by its length.
CONTEXTS, STRONGEST = 16, 3
FEATURES = CONTEXTS + 1


def _added(context: int) -> float:
    return sum(w for flag, w in ADDED.items() if context & flag)


#: Weights before learning: a hit counts, more if aimed, less if negated or reported.
PRIOR = np.array([max(0.1, 1.0 + _added(c)) for c in range(CONTEXTS)] + [1.0])
BIAS = -3.0


class Lexicon:
    """Learned insult patterns with their weights, the closed classes, and the machine composed for them."""

    def __init__(self, patterns: dict[str, float]) -> None:
        self.words = {p: w for p, w in patterns.items() if " " not in p and not p.endswith("*")}
        self.stems = {p[:-1]: w for p, w in patterns.items() if p.endswith("*")}
        self.phrases = {tuple(p.split(" ")): w for p, w in patterns.items() if " " in p}
        self.classes = {w: c for words, c in _CLASSES for w in words}
        self.hits = frozenset(self.words) | ACTS | ACTS_ON_YOU
        self.heads = frozenset(s[: STEMS[0]] for s in self.stems)
        self.firsts = {p[:2] for p in self.phrases}
        self.named = {w for p in self.phrases for w in p}
        self.machine = Cascade(
            insults(self.words | {f"{s}*": w for s, w in self.stems.items()}, self.phrases), threats(), targets(),
            within(NEGATION, NEGATION_REACH, NEGATED), within(REPORT, REPORT_REACH, REPORTED),
        )

    def symbol(self, word: str) -> tuple[int, str]:
        """The class of a word and, if the insult transducer knows it, the word or its heaviest pattern."""
        kind = self.classes.get(word, OTHER)
        if word in self.words or word in self.named:
            return kind, word
        stems = [word[:n] for n in STEMS if len(word) > n and word[:n] in self.stems] if word[: STEMS[0]] in self.heads else []
        return (kind, max(stems, key=lambda s: (self.stems[s], s)) + "*") if stems else (kind, "")

    def matches(self, words: list[str]) -> Iterator[tuple[str, int, int]]:
        """(pattern, start, end) of all patterns in a list of words."""
        for i, word in enumerate(words):
            if word in self.words:
                yield word, i, i + 1
            if word[: STEMS[0]] in self.heads:
                yield from ((f"{word[:n]}*", i, i + 1) for n in STEMS if len(word) > n and word[:n] in self.stems)
            if tuple(words[i : i + 2]) in self.firsts:
                yield from ((" ".join(p), i, i + n) for n in PHRASES if (p := tuple(words[i : i + n])) in self.phrases)

    def features(self, text: str | None) -> np.ndarray:
        """The features of a whole text; a text without any hit costs only its set of words."""
        out = np.zeros(FEATURES)
        low = (text or "").lower()
        seen = set(_WORD.findall(low))
        hit = not self.hits.isdisjoint(seen) or any(w[: STEMS[0]] in self.heads for w in seen)
        threat = not (MILD_ACTS.isdisjoint(seen) or SPEAKERS.isdisjoint(seen) and INTENTIONS.isdisjoint(seen))
        if not hit and not threat and self.named.isdisjoint(seen):
            return out
        weights: dict[int, list[float]] = {}
        for clause in _CLAUSE.split(low):
            tape = [self.symbol(w) for w in _WORD.findall(clause)]
            if not any(word or kind in (ACT, MILD_ACT, ACT_ON_YOU) for kind, word in tape):
                continue
            weight, hits = self.machine.best(tape)
            for mark, w in hits:
                context = mark & (CONTEXTS - 1)
                weights.setdefault(context, []).append(w - _added(context))
            out[CONTEXTS] = max(out[CONTEXTS], weight)
        for context, each in weights.items():
            out[context] = sum(sorted(each, reverse=True)[:STRONGEST])
        return out


# ---- learning -----------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and toxic of at most ``max_train`` labelled documents that are not held out."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_train)
    # max_train bounds what is broadcast: two numbers a row
    # copies of a text are one row: they would pass off its words as signs
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic")


def _stems(n: int) -> Column:
    """The beginnings of n letters of longer words."""
    return F.transform(F.filter(F.array_distinct("w"), lambda x: F.length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))


def _phrases(n: int) -> Column:
    """The phrases of n words."""
    none = F.array().cast("array<string>")
    return F.when(F.size("w") < n, none).otherwise(F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.concat_ws(" ", *(F.get("w", i + k) for k in range(n)))))


def _evidence(counted: DataFrame, base: float) -> DataFrame:
    """(pattern, g2, odds) of what is seen k of n times on the toxic side, where base is expected."""
    n, k = F.col("n"), F.col("k")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (part(k, n * base) + part(n - k, n * (1 - base)))
    odds = F.log((k + 0.5) / (n - k + 0.5)) - float(np.log(base / (1 - base)))
    found = counted.filter(k / n >= max(LEAST_SHARE, base)).select("pattern", g2.alias("g2"), odds.alias("odds"))
    least = F.when(F.contains("pattern", F.lit(" ")), LEAST_G2_PHRASE).otherwise(LEAST_G2)
    return found.filter((F.col("g2") >= least) & (F.col("odds") > 0))


def _counted_phrases(texts: DataFrame, base: float) -> DataFrame:
    """(pattern, n, k) of the phrases that stand in enough toxic rows to reach the ratio at all; only those are counted in other rows."""
    phrases = F.explode(F.array_distinct(F.concat(*map(_phrases, PHRASES)))).alias("pattern")
    least = LEAST_G2_PHRASE / (2 * float(np.log(1 / base)))
    toxic = texts.filter("toxic = 1").select(phrases).groupBy("pattern").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least)
    toxic = materialize(toxic, "phrases")
    names = toxic.select("pattern")
    names = F.broadcast(names) if toxic.count() <= BROADCAST_ROWS else names
    others = texts.filter("toxic = 0").select(phrases).join(names, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("o"))
    return toxic.join(others, "pattern", "left").select("pattern", (F.col("k") + F.coalesce("o", F.lit(0))).alias("n"), "k")


def _contexts(rows: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, n, k): in how many different pairs of neighbours a pattern stands, and how many are toxic.

    Copies of a text repeat its contexts, so that words which only copies spread don't count. A
    word beginning stays only if several words with it, and nearly all of them, are mostly toxic.
    """
    lexicon = Lexicon(dict.fromkeys(patterns, 1.0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"pattern": [], "word": [], "around": [], "toxic": []}
            for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                words = _WORD.findall((text or "").lower())
                for pattern, i, j in lexicon.matches(words):
                    around = " ".join(("", *words)[i : i + 1] + (*words, "")[j : j + 1])
                    for column, value in zip(out.values(), (pattern, " ".join(words[i:j]), around, toxic), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([*((c, pa.string()) for c in ("pattern", "word", "around")), ("toxic", pa.int32())]))

    seen = rows.select("text", F.col("toxic").cast("int")).mapInArrow(scan, "pattern string, word string, around string, toxic int")
    once = seen.groupBy("pattern", "word", "around").agg(F.min("toxic").alias("toxic"))
    by_word = once.groupBy("pattern", "word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    bad = F.count(F.when(F.col("k") >= F.col("n") / 2, 1)).alias("bad")
    counted = by_word.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("words"), bad)
    return counted.filter(~F.endswith("pattern", F.lit("*")) | ((F.col("bad") >= STEM_WORDS) & (F.col("bad") >= STEM_SHARE * F.col("words"))))


def learn_patterns(rows: DataFrame) -> dict[str, float]:
    """Words, word beginnings and phrases that mark toxic rows, with capped log-odds as weights.

    Candidates are found by the rows they stand in, then tested by the contexts they stand in. A
    phrase with a word that is a pattern is none. What comes to the driver is bounded by the
    sample: a pattern stands in at least five of its toxic rows.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:'\p{L}+)?"), F.lit(0))
    patterns = F.array_distinct(F.concat("w", *map(_stems, STEMS)))
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return {}
    texts = rows.filter("text is not null").select("toxic", words.alias("w"))
    counted = texts.select("toxic", F.explode(patterns).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    base = toxic / total
    best = [r["pattern"] for found in (counted, _counted_phrases(texts, base)) for r in _evidence(found, base).collect()]
    single = Lexicon({p: 1.0 for p in best if " " not in p})
    best = [p for p in best if " " not in p or not any(single.symbol(w)[1] for w in p.split(" "))]
    kept = _evidence(_contexts(rows, best), base).collect()
    return {r["pattern"]: min(1.0, r["odds"] / 4) for r in sorted(kept, key=lambda r: (-r["g2"], r["pattern"]))}


class Model(NamedTuple):
    patterns: dict[str, float]
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Patterns, then context weights, from a bounded sample; without both labels the priors hold."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, max_train)
    patterns = learn_patterns(rows)
    lexicon = Lexicon(patterns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [lexicon.features(t).tolist() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b["toxic"]], ["x", "y"])

    # max_train rows of FEATURES numbers at most
    scanned = rows.select("text", F.col("toxic").cast("int")).mapInArrow(scan, "x array<double>, y int").collect()
    x = np.array([r["x"] for r in scanned], float).reshape(-1, FEATURES)
    y = np.array([r["y"] for r in scanned], float)
    return Model(patterns, *fit_contexts(x, y))


def fit_contexts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the features and a bias, pulled towards the priors; those alone without both labels."""
    if len(set(y)) < 2:
        return PRIOR, BIAS
    w = fit_logistic(np.hstack([x, np.ones((len(x), 1))]), y, np.append(PRIOR, BIAS), np.append(np.ones(FEATURES), 0.01))
    return w[:-1], float(w[-1])


def scores(lexicon: Lexicon, model: Model, texts: list[str | None]) -> np.ndarray:
    """The scores of some whole texts."""
    x = np.array([lexicon.features(t) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights + model.bias, -30, 30)))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), predicted (1 from THRESHOLD on).

    A null or empty text has the score of a text without hits. Ids (null too) and repeated rows
    stay as they are; other columns are not read. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.patterns)
        for b in batches:
            score = scores(lexicon, model, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below THRESHOLD, all columns unchanged.

    Rows with a null or empty text, repeated rows and those with a null id are judged like any
    other, each for itself; an empty table stays empty. Only the text is looked at, whatever other
    columns there are.
    """
    small_batches(docs.sparkSession)
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.patterns)
        for b in batches:
            score = scores(lexicon, model, b["text"].to_pylist())
            yield b.filter(pa.array(score < THRESHOLD))

    return docs.mapInArrow(scan, schema)
