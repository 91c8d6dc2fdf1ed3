"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses. Two lexical transducers turn words into symbols with weights: insults (words and
stems, weights learned from labelled rows) and threats. Three more rewrite the symbols of a clause: target
(an insult or threat within reach of a person addressed), negation (a few words after a negation) and reported speech (after
a verb of saying, to the clause's end). They are composed once into a single machine whose steps
are table look-ups; it starts anew with each clause. A clause scores the weights of its insults and threats,
each times the factor of its annotation: an insult aimed at someone counts more, a denied or reported one less; a
threat counts only if it is aimed.

A logistic model on what the matched clauses score gives the probability. It is fitted on rows whose insults come from a
lexicon that the other half of the rows taught, so that a row's own words do not speak for it.

Labels are learned from at most ``POOL`` labelled ids (those with the least hash; rows with the same label and opening
words count once, as copies). Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored
from panelwise.llm.periodic import slices

POOL = 16_384
OPENING_WORDS = 8
#: A lexicon holds the heaviest terms, so many at most.
TERMS = 4_096
STEM = 6
#: A term is learned from so many toxic rows at least, or this share of them.
LEAST_ROWS = 2
LEAST_SHARE = 0.0075
LEAST_WEIGHT = 2.0
#: Standard errors taken off a term's log odds ratio.
CAUTION = 0.75
SEED = 13

PART = re.compile(r"[^\W\d_]+|[.!?;:\n]+")

# Fixed word lists of the grammar, lower case, in English, German, French and Spanish.
THREATS = """kill killed hurt destroy shoot stab beat burn hang strangle smash crush choke punish murder slaughter attack
töten umbringen schlagen verletzen vernichten erschießen verbrennen würgen zerstören angreifen
tuer frapper blesser détruire brûler étrangler égorger massacrer écraser attaquer
matar golpear herir destruir quemar disparar estrangular degollar aplastar atacar""".split()
TARGETS = """you your yours yourself u ya he him she her they them their these those people everyone
du dich dir dein deine ihr euch euer sie ihn ihnen diese leute alle
tu te toi ton ta vous votre vos ils elles eux leur gens
tú ti tu tus usted ustedes vosotros ellos ellas gente todos""".split()
NEGATIONS = """not no never nobody none neither without isn aren wasn weren don doesn didn won wouldn can't cannot hardly
nicht kein keine keinen keiner nie niemals ohne weder kaum
pas ne jamais aucun aucune sans ni
nunca jamás ningún ninguna sin tampoco""".split()
REPORTS = """said says saying wrote writes called calls told tells claimed claims reported reports quoted quotes alleged according
sagte sagt schrieb schreibt nannte nennt behauptet behauptete berichtete berichtet zitiert laut
dit disait écrit appelé traité rapporte selon affirme
dijo dice escribió escribe llamó llama según afirma informó""".split()

#: Kinds of symbols; an annotated symbol is kind * 8 + the flags set.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
AIMED, DENIED, REPORTED = 1, 2, 4
SYMBOLS = 6 * 8
#: Words after a target that it reaches, and after a negation that it denies.
REACH = 6
DENIES = 3
THREAT_WEIGHT = 2.0


@dataclass
class Machine:
    """A deterministic transducer over annotated symbols; state 0 is where a clause begins."""

    after: np.ndarray
    output: np.ndarray

    def compose(self, second: Machine) -> Machine:
        """The machine that feeds this one's output to ``second``, over the pairs of states that can be reached."""
        number = {(0, 0): 0}
        after, output = [], []
        pairs = [(0, 0)]
        for a, b in pairs:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                middle = self.output[a, symbol]
                pair = int(self.after[a, symbol]), int(second.after[b, middle])
                if pair not in number:
                    number[pair] = len(pairs)
                    pairs.append(pair)
                row.append((number[pair], int(second.output[b, middle])))
            after.append([x for x, _ in row])
            output.append([y for _, y in row])
        return Machine(np.array(after), np.array(output))


def marker(opens: int, words: int | None, flag: int) -> Machine:
    """Sets ``flag`` on symbols that follow a symbol of kind ``opens``: the next ``words`` ones, or all to the clause's end."""
    states = 2 if words is None else words + 1
    after, output = np.zeros((states, SYMBOLS), int), np.zeros((states, SYMBOLS), int)
    for state, symbol in product(range(states), range(SYMBOLS)):
        if symbol // 8 == opens:
            after[state, symbol] = states - 1
        else:
            after[state, symbol] = state if words is None else max(state - 1, 0)
        output[state, symbol] = symbol | flag if state else symbol
    return Machine(after, output)


def factor(symbol: int) -> float:
    """What an annotated symbol's weight counts."""
    kind, flags = symbol // 8, symbol % 8
    if kind == INSULT:
        worth = 1.5 if flags & AIMED else 1.0
    elif kind == THREAT:
        worth = 1.0 if flags & AIMED else 0.0
    else:
        return 0.0
    return worth * (0.1 if flags & DENIED else 1.0) * (0.3 if flags & REPORTED else 1.0)


GRAMMAR = marker(TARGET, REACH, AIMED).compose(marker(NEGATION, DENIES, DENIED)).compose(marker(REPORT, None, REPORTED))
FACTORS = [factor(s) for s in range(SYMBOLS)]


class Lexicon(dict):
    """Kind and weight of a word; words not listed are kept as they come up, in bounded number."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems = words, stems
        self.fixed = {w: (kind, weight) for kind, weight, listed in (
            (REPORT, 0.0, REPORTS), (NEGATION, 0.0, NEGATIONS), (TARGET, 0.0, TARGETS), (THREAT, THREAT_WEIGHT, THREATS)) for w in listed}

    def __reduce__(self):
        return Lexicon, (self.words, self.stems)

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > 200_000:
            self.clear()
        weight = self.words.get(word) or self.stems.get(word[:STEM], 0.0)
        found = self.fixed.get(word) or ((INSULT, weight) if weight else (OTHER, 0.0))
        self[word] = found
        return found


END = (-1, 0.0)


def clause_scores(parts: list[str], lexicon: Lexicon, machine: Machine = GRAMMAR) -> list[tuple[int, int, float, list[int]]]:
    """(first part, part beyond, score, annotated symbols of insults and threats) of every clause that has one.

    ``parts`` are lower-case words and marks that end a clause.
    """
    found = [END if p[0] in ".!?;:\n" else lexicon[p] for p in parts]
    after, output = machine.after, machine.output
    out = []
    hits = [i for i, (kind, _) in enumerate(found) if kind in (INSULT, THREAT)]
    done = 0
    for hit in hits:
        if hit < done:
            continue
        first = hit
        while first > done and found[first - 1] is not END:
            first -= 1
        state, score, symbols, at = 0, 0.0, [], first
        while at < len(found) and found[at] is not END:
            kind, weight = found[at]
            symbol = output[state, kind * 8]
            state = after[state, kind * 8]
            if weight:
                score += weight * FACTORS[symbol]
                symbols.append(int(symbol))
            at += 1
        done = at
        out.append((first, at, score, symbols))
    return out


FEATURES = 6


def features(parts: list[str], clauses: list[tuple[int, int, float, list[int]]], lexicon: Lexicon) -> tuple:
    """What the logistic model sees: of the matched clauses the sum of scores, alone and by the root of the text's length, the highest
    score, their number, different terms; the text's length."""
    scores = [s for _, _, s, _ in clauses]
    total, n = sum(scores), len(parts)
    terms = {p for a, b, s, _ in clauses if s > 0 for p in parts[a:b] if lexicon[p][1]}
    return (math.log1p(total), total / math.sqrt(n + 25), min(max(scores, default=0.0), 20.0) / 5, math.log1p(len(scores)),
            math.log1p(len(terms)), math.log1p(n) / 5 if total else 0.0)


@dataclass
class Model:
    """Insult words and stems with weights, and the logistic model on clause scores."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slopes: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    intercept: float = 0.0

    def probability(self, x: tuple) -> float:
        z = self.intercept + sum(a * b for a, b in zip(self.slopes, x))
        return 1 / (1 + math.exp(-z)) if z > 0 else (e := math.exp(z)) / (1 + e)


def learned(counts: list[tuple[str, bool, int, int]], toxic: int, clean: int, terms: int = TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with weights, from (term, is a stem, toxic rows, clean rows with it): the log odds ratio less CAUTION standard errors."""
    found = []
    for term, stem, t, c in counts:
        if t >= max(LEAST_ROWS, LEAST_SHARE * toxic):
            ratio = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((c + 0.5) / (clean - c + 0.5))
            weight = ratio - CAUTION * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5) + 1 / (toxic - t + 0.5) + 1 / (clean - c + 0.5))
            if weight >= LEAST_WEIGHT:
                found.append((-weight, term, stem))
    found = sorted(found)[:terms]
    return {t: -w for w, t, stem in found if not stem}, {t: -w for w, t, stem in found if stem}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Slopes (shrunk by ``ridge``) and intercept by damped Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * (penalty * w * w).sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def parts_of(text: str | None) -> list[str]:
    return PART.findall((text or "").lower())


def _half(text: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(F.lit(SEED), text), F.lit(2)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, pool: int = POOL) -> DataFrame:
    """(text, toxic, half): the labelled rows that teach, one for each label and opening. ``labels`` has doc_id and toxic (0, 1; else not used).

    At most ``pool`` ids are taken, so their table is small whatever the size of the corpus and is sent to all tasks.
    """
    marks = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id").limit(pool)
    rows = docs.select(F.col("doc_id").cast("long").alias("_own"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(marks), F.col("_own") == F.col("_id")).select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    opening = F.slice(F.regexp_extract_all(F.lower(F.substring("text", 1, 400)), F.lit(r"\S+"), F.lit(0)), 1, OPENING_WORDS)
    rows = rows.groupBy("toxic", F.xxhash64(opening).alias("_opening")).agg(F.min("text").alias("text"))
    return stored(rows.select("text", "toxic", _half(F.col("_opening")).alias("half")))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, toxic and clean rows with it in each half) of every word, and of every stem of longer words."""
    schema = "term string, stem boolean, half int, toxic int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            out: list[tuple] = []
            for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = {p for p in parts_of(text) if p[0] not in ".!?;:\n"}
                stems = {w[:STEM] for w in words if len(w) > STEM}
                out += [(w, False, half, toxic) for w in words] + [(s, True, half, toxic) for s in stems]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "stem", "half", "toxic"])

    each = rows.select("text", "toxic", "half").mapInArrow(run, schema)
    n = lambda toxic, half: F.count_if((F.col("toxic") == toxic) & (F.col("half") == half))
    return each.groupBy("term", "stem").agg(*[n(t, h).alias(f"n{t}{h}") for h in (0, 1) for t in (1, 0)])


def fit(docs: DataFrame, labels: DataFrame, pool: int = POOL) -> Model:
    """A model from the rows of ``docs`` that ``labels`` marks. Without toxic or without clean rows, all scores are alike.

    The driver gets terms that occur in enough toxic rows of the pool, and FEATURES numbers for each row of the pool.
    """
    rows = training_rows(docs, labels, pool)
    sizes = {(r.toxic, r.half): r.n for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    n = lambda t, h: sizes.get((t, h), 0)
    toxic, clean = n(1, 0) + n(1, 1), n(0, 0) + n(0, 1)
    if not toxic or not clean:
        return Model(intercept=2.0 if toxic else -2.0)
    counts = [tuple(r) for r in term_counts(rows).where(f"n10 + n11 >= {LEAST_ROWS}").collect()]
    whole = learned([(w, s, a + b, c + d) for w, s, a, c, b, d in counts], toxic, clean)
    # Halves are taught by each other, so that no row meets a lexicon it has taught.
    lexicons = [Lexicon(*learned([(w, s, b, d) for w, s, a, c, b, d in counts], n(1, 1), n(0, 1))),
                Lexicon(*learned([(w, s, a, c) for w, s, a, c, b, d in counts], n(1, 0), n(0, 0)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
                parts = parts_of(text)
                found.append([float(toxic), *features(parts, clause_scores(parts, lexicons[half]), lexicons[half])])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], ["x"])

    taught = np.array([r.x for r in rows.select("text", "toxic", "half").mapInArrow(run, "x array<double>").collect()])
    slopes, intercept = logistic(taught[:, 1:], taught[:, 0])
    return Model(*whole, slopes.tolist(), intercept)


CLAUSE = "struct<start: int, end: int, score: double, insults: int, threats: int, aimed: int, denied: int, reported: int>"


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, score, clauses) of every row; clauses lists the matched ones by their characters (end exclusive), with their scores and
    how many insults and threats they have, and how many of these are aimed, denied or reported. Without ``spans`` it is empty.
    """
    lexicon = Lexicon(model.words, model.stems)
    names = ["id", "score", "clauses"]
    keys = ["start", "end", "score", "insults", "threats", "aimed", "denied", "reported"]
    kind = pa.struct([(k, pa.float64() if k == "score" else pa.int32()) for k in keys])

    def listed(text: str, found: list) -> list[dict]:
        # Lower case may change a text's length: places are those of the text as it is, if its parts are the same.
        at = [m.span() for m in PART.finditer(text)]
        out = []
        for first, beyond, score, symbols in found:
            tell = [sum(s // 8 == k for s in symbols) for k in (INSULT, THREAT)] + [sum(bool(s & f) for s in symbols) for f in (AIMED, DENIED, REPORTED)]
            place = (at[first][0], at[beyond - 1][1]) if beyond <= len(at) else (0, len(text))
            out.append(dict(zip(keys, (*place, score, *tell))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            scores, clauses = [], []
            for text in batch.column(1).to_pylist():
                parts = parts_of(text)
                found = clause_scores(parts, lexicon)
                scores.append(model.probability(features(parts, found, lexicon)))
                clauses.append(listed(text, found) if spans and found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(clauses, pa.list_(kind))], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id long, score double, clauses array<{CLAUSE}>")


def detect(docs: DataFrame, labels: DataFrame, teaches: Callable[[F.Column], F.Column] | None = None, spans: bool = True) -> DataFrame:
    """(id, score, clauses) of every row of ``docs``, with a model fitted on the labelled ids for which ``teaches`` holds (all if not given).

    NULL and empty texts have no clauses and the score of a text without a match. Repeated rows give repeated rows; NULL ids
    are scored and never teach; an id with several labels is toxic if one of them says so. Columns of docs other than doc_id and
    text are not read, whatever their names. An empty table has no rows; without labels every score is alike.
    """
    known = labels.where(teaches(F.col("doc_id"))) if teaches else labels
    return scored(docs, fit(docs, known), spans=spans)
