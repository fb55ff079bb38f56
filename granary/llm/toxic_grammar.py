"""Operator 9: toxicity by a weighted finite-state pattern grammar.

Five small transducers are composed into one: the lexicon maps words to classes
(insult, threat, target, negation, report), the negation transducer marks abuse in the
scope of a negation, the reported-speech transducer marks abuse after a verb of
saying in its clause, after such a verb and a colon, or inside quotation marks (both over ends of
clauses, up to a closing mark or the end of the line), and a clause acceptor remembers the strongest insult,
the strongest threat and whether a target was named. Its final states are the kinds
of matched clauses. A text's score is the logistic of a weighted sum over
clause kinds (of the log of one plus their number); the weights start from prior
values of the grammar and are fitted to labelled rows by ridge regression.

The lexicon starts from fixed lists and takes in all beginnings of words that
toxic texts of the labelled sample use in several different contexts and other texts hardly ever do; the sample is bounded, and so is the lexicon.

Null and empty texts score as texts without a matched clause. Null labels teach
nothing; without labels the prior weights hold. Repeated rows give equal rows; null
ids are kept; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.tables import emit, fold, opened, share, slices, string_bytes
from granary.llm.words import heads, texts_to_arrays

OTHER, INSULT, LIKELY, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, COLON, BREAK = range(11)
#: Word lists of the lexicon.
INSULTS = """idiot idiots stupid moron morons scum trash loser losers pathetic worthless disgusting clown clowns imbecile
dumb dumbass fool fools jerk pig pigs vermin filth filthy garbage bastard bastards bitch bitches asshole assholes cretin retard
idiota stupido cretino imbecille scemo schifo feccia idiote idiotes imbecile stupide connard connards salaud ordure debile
idioten dumm dummkopf abschaum arschloch trottel wertlos widerlich imbecil estupido estupida basura escoria asqueroso payaso""".split()
THREATS = """kill murder hurt destroy beat stab shoot burn hang strangle slaughter punish crush die suffer
uccidere ammazzare tuer frapper toten umbringen matar golpear""".split()
TARGETS = """you your yours yourself u they them their he him his she her those these people everyone women men
tu te vous ils elles eux du dich ihr euch sie usted ustedes ellos ellas voi loro""".split()
NEGATIONS = "not no never neither nor without cannot don't doesn't didn't isn't aren't wasn't won't pas jamais nicht kein keine nie nunca non mai".split()
REPORTS = """said says say claimed claims wrote writes quoted quotes called reported alleged told according
dit dits sagte sagt dijo dice disse""".split()
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n|]|[\"“”«»„]")
MARKS = {c: END for c in ".!?;|"} | {":": COLON, "\n": BREAK} | {c: QUOTE for c in "\"“”«»„"}
LAST = frozenset([END, COLON, BREAK])
#: Symbols between the transducers: abuse is marked as plain, reported or negated.
KINDS = {INSULT: (INSULT, 40, 41), LIKELY: (LIKELY, 40, 41), THREAT: (THREAT, 50, 51)}  # plain, reported, negated
#: What the clause acceptor keeps of each: its place in the state, and how strong it is.
GRADES = {41: (0, 1), 40: (0, 2), LIKELY: (0, 3), INSULT: (0, 4), 51: (1, 1), 50: (1, 2), THREAT: (1, 3)}


class Transducer:
    """States with arcs (state, symbol) -> (state, symbol); a symbol without an arc takes the default arc."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other one reads what this one writes."""

        def step(state, symbol):
            mine, written = self.step(state[0], symbol)
            its, out = other.step(state[1], written)
            return (mine, its), out

        return Transducer((self.start, other.start), step)

    def table(self, symbols: int) -> tuple[list[list[int]], list]:
        """The reachable states numbered, and the next state for each symbol."""
        states, arcs, at = [self.start], [], 0
        number = {self.start: 0}
        while at < len(states):
            row = []
            for symbol in range(symbols):
                to = self.step(states[at], symbol)[0]
                if to not in number:
                    number[to] = len(states)
                    states.append(to)
                row.append(number[to])
            arcs.append(row)
            at += 1
        return arcs, states


def negation(scope: int = 3) -> Transducer:
    """Abuse within ``scope`` words after a negation is marked as negated."""

    def step(left, symbol):
        if symbol in LAST:
            return 0, symbol
        if symbol == NEGATION:
            return scope, symbol
        if left and symbol in KINDS:
            return left - 1, KINDS[symbol][2]
        return max(0, left - 1), symbol

    return Transducer(0, step)


def reported() -> Transducer:
    """Abuse after a verb of saying, or inside quotation marks, is marked as reported.

    A verb of saying holds to the end of its clause; with a colon it opens a report that, like a quotation, goes on
    over the ends of clauses until a closing mark or the end of the line.
    """

    def step(state, symbol):
        said, opened, quoted = state
        if symbol == REPORT:
            return (True, opened, quoted), symbol
        if symbol == COLON:
            return (False, opened or said, quoted), symbol
        if symbol == QUOTE:  # a closing mark ends the report too
            return (said and not quoted, opened and not quoted, not quoted), symbol
        if symbol == BREAK:
            return (False, False, False), symbol
        if symbol == END:
            return (False, opened, quoted), symbol
        if (said or opened or quoted) and symbol in KINDS:
            return state, KINDS[symbol][1]
        return state, symbol

    return Transducer((False, False, False), step)


def clause() -> Transducer:
    """Keeps (insult, threat, target): 0 none, 1 negated, 2 reported, then plain (an insult 3 if learned, 4 if listed)."""

    def step(state, symbol):
        if symbol in LAST:
            return (0, 0, 0), symbol
        if symbol == TARGET:
            return (state[0], state[1], 1), symbol
        if symbol in GRADES:
            k, value = GRADES[symbol]
            return tuple(max(x, value) if i == k else x for i, x in enumerate(state)), symbol
        return state, symbol

    return Transducer((0, 0, 0), step)


class Grammar:
    """The composed transducer, its lexicon, and the weights of clause kinds."""

    def __init__(self, learned: list[str] = ()):
        self.lexicon = {w: k for k, ws in ((TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}
        self.fixed, self.stems = dict(self.lexicon), frozenset(learned)
        self.arcs, states = negation().then(reported()).then(clause()).table(11)
        kinds = sorted({s[1] for s in states if s[1][0] or s[1][1]})
        self.kinds = kinds
        self.final = [kinds.index(s[1]) if s[1][0] or s[1][1] else -1 for s in states]
        insult, threat = (0.0, -0.5, 0.5, 1.5, 3.0), (0.0, -0.5, 0.2, 0.3)
        self.prior = np.array([insult[i] + threat[t] + ((i >= 3) * 1.0 + (t == 3) * 1.7) * who for i, t, who in kinds])
        self.weights, self.bias = self.prior.copy(), -2.5
        self.stem_lengths = sorted({len(w) for w in self.stems})
        whole, _ = heads(*texts_to_arrays([w for w, k in self.lexicon.items() if k in KINDS]))
        self.abuse = [(np.uint64(0xFFFFFFFFFFFFFFFF), np.unique(whole))]
        for size in sorted({min(8, len(w.encode())) for w in self.stems}):
            mask = np.uint64((1 << 64) - (1 << (64 - 8 * size)))
            own, _ = heads(*texts_to_arrays([w for w in self.stems if min(8, len(w.encode())) == size]))
            self.abuse.append((mask, np.unique(own & mask)))

    def may_match(self, array: pa.Array) -> np.ndarray:
        """Which texts have a word that begins like one of abuse, or a character of which ``heads`` cannot tell if it ends a word or has a small letter."""
        data, ends = string_bytes(array)
        first, bounds = heads(data, ends)
        out = np.zeros(len(array), bool)
        after = np.append(data[1:], np.uint8(0))
        letter = (data == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)  # U+00C0 to U+00FF but the signs of times and division
        odd = np.flatnonzero((data >= 0xC0) & ~letter)
        out[np.searchsorted(ends, odd, side="right") - 1] = True
        for mask, known in self.abuse:
            if known.size:
                own = first & mask
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), known.size - 1)] == own)
                out[np.searchsorted(bounds, at, side="right") - 1] = True
        return out

    def class_of(self, token: str) -> int:
        if (found := self.lexicon.get(token)) is None:
            found = self.lexicon[token] = LIKELY if any(token[:k] in self.stems for k in self.stem_lengths) else OTHER
            if len(self.lexicon) > 200_000:  # a bounded memory of words met
                self.lexicon = dict(self.fixed)
        return found

    def clauses(self, text: str) -> Counter:
        """How many clauses of each kind a text has."""
        found: Counter = Counter()
        state, arcs, class_of = 0, self.arcs, self.class_of
        for token in TOKEN.findall(text.lower().replace("’", "'")):
            symbol = MARKS[token] if token in MARKS else class_of(token)
            if symbol in LAST and self.final[state] >= 0:
                found[self.final[state]] += 1
            state = arcs[state][symbol]
        if self.final[state] >= 0:
            found[self.final[state]] += 1
        return found

    def features(self, array: pa.Array) -> np.ndarray:
        out = np.zeros((len(array), len(self.kinds)))
        for i in np.flatnonzero(self.may_match(array)):
            for kind, n in self.clauses(array[int(i)].as_py()).items():
                out[i, kind] = np.log1p(n)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        """Newton's method on the logistic loss, drawn to the prior weights."""
        if not len(y) or y.min() == y.max():
            return
        full = np.hstack([x, np.ones((len(x), 1))])
        prior = np.append(self.prior, self.bias)
        draw = np.append(np.full(len(self.prior), ridge), 1e-3)

        def loss(w):
            z = full @ w
            return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (draw * (w - prior) ** 2).sum()

        w = prior.copy()
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -500, 500)))
            step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(draw), full.T @ (p - y) + draw * (w - prior))
            while np.abs(step).max() > 1e-8 and loss(w - step) > loss(w):
                step = step / 2
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        self.weights, self.bias = w[:-1], float(w[-1])


def learned_stems(sample: DataFrame, least_contexts: int = 6, rarer: int = 4, shortest: int = 3, longest: int = 10) -> list[str]:
    """Beginnings of words that mark toxic texts of the sample.

    A stem stands in ``least_contexts`` different contexts (pairs of neighbouring
    words, so that copies of a text count once) of toxic texts, and in fewer of the
    other texts by a factor ``rarer``. Stems that begin with another one add nothing and are left out.
    """
    schema = pa.schema([("stem", pa.string()), ("context", pa.int64()), ("others", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: set[tuple[str, int, int]] = set()
            others: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = re.findall(r"[^\W\d_]+", (text or "").lower())
                if not toxic:
                    others.update(w[:k] for w in words for k in range(shortest, min(longest, len(w)) + 1))
                    continue
                for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                    context = crc32(f"{before} {after}".encode()) + 1
                    rows.update((w[:k], context, 0) for k in range(shortest, min(longest, len(w)) + 1))
            out = [*rows, *((w, 0, n) for w, n in others.items())]
            yield from emit([dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in schema.names}], schema)

    seen = sample.select("text", "toxic").mapInArrow(run, "stem string, context long, others long").groupBy("stem", "context").agg(F.sum("others").alias("others"))
    n = seen.groupBy("stem").agg(F.count_if(F.col("context") > 0).alias("contexts"), F.sum("others").alias("others"))
    found = n.filter((F.col("contexts") >= least_contexts) & (F.col("others") * rarer <= F.col("contexts"))).select("stem").collect()
    kept: set[str] = set()
    for stem in sorted((r["stem"] for r in found), key=lambda x: (len(x), x)):
        if not any(stem[:k] in kept for k in range(shortest, len(stem))):
            kept.add(stem)
    return sorted(kept)


def labelled_sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """text and toxic of about ``most_rows`` labelled rows of the learning folds, drawn by a hash of the id."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null").filter(fold("doc_id", 5) != 0)
    share_of = min(1.0, most_rows / max(lab.count(), 1))
    drawn = lab.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share_of * 1_000_000)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> Grammar:
    """A grammar with learned stems and weights from a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, most_rows).cache()
    try:
        grammar = Grammar(learned_stems(sample))
        sent = share(docs.sparkSession, grammar)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = opened(sent)
            for batch in batches:
                for part in slices(batch, 0):
                    yield from emit([{"x": own.features(part.column(0)).tolist(), "y": part.column(1)}], pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

        rows = sample.mapInArrow(run, "x array<double>, y int").groupBy("x", "y").count().collect()
    finally:
        sample.unpersist()
    rows = sorted(rows, key=lambda r: (list(r["x"]), r["y"]))
    if rows:
        times = [r["count"] for r in rows]
        grammar.fit(np.repeat(np.array([list(r["x"]) for r in rows]), times, axis=0), np.repeat(np.array([r["y"] for r in rows], float), times))
    return grammar


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_clauses", pa.int64())])


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and n_clauses (matched clauses) of every whole text."""
    sent = share(docs.sparkSession, grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(sent)
        for batch in batches:
            for part in slices(batch, 1):
                x = own.features(part.column(1))
                found = own.scores(x)
                yield from emit([{"doc_id": part.column(0), "held_out": part.column(2), "score": found, "predicted": (found >= threshold).astype(np.int32), "n_clauses": np.rint(np.expm1(x).sum(axis=1)).astype(np.int64)}], OUT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold("doc_id", 5) == 0).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_clauses long")


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = 6000) -> DataFrame:
    return score(docs, fit(docs, labels, most_rows))
