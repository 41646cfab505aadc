"""Toxicity: a weighted finite-state grammar over clauses.

A lexical transducer turns a text into symbols: insult, threat verb, threat
opener, target, negation, speech verb, clause end.  Over these
run four small transducers -- insult, threat, target, and scope (negation and
reported speech) -- whose composition is one deterministic table over the
reachable product states.  Each clause end emits the clause's class; a text is
described by how many clauses of each class it has, and a logistic layer
weighs them.  A word alone decides nothing: "not an idiot" and "they called
him an idiot" are other classes than "you idiot", with their own weights.

The insult arcs of the lexical transducer are a short fixed list plus what the
labels teach: words and word stems (first 4 to 7 bytes) that occur in toxic
texts and hardly elsewhere, chosen greedily by the toxic texts that no earlier
choice explains; a fixed word that mostly occurs in harmless texts is dropped.
The class weights are then fitted on the same rows; each starts from a prior
and moves as far as its evidence goes.  Both use at most ``max_docs`` labelled
rows.  Words are runs of letters, lower-cased, so glued punctuation doesn't
hide them.

Null or empty texts have no clause and score the bias; repeated rows are
scored each; without labels the prior weights are used.  Extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from .quality import sample_labels
from .textkit import LOWER, Chunk, SegmentHasher, chunks, map_batches, segment_hashes

MAX_DOCS = 20_000

# The word lists of the lexical transducer.
INSULT, THREAT, OPENER, TARGET, NEGATION, SPEECH, END = range(7)
WORDS = {
    INSULT: """arsehole asshole bastard bitch clown coward cretin crybaby degenerate dimwit dirtbag
        disgusting dumbass dumb fool freak garbage hypocrite idiot idiotic idiots imbecile
        incompetent jackass jerk liar lowlife loser losers lunatic maggot moron moronic morons
        nitwit parasite pathetic pig pigs psycho repulsive scum scumbag shithead simpleton sleazy
        slob stupid swine traitor trash twat twit ugly useless vermin weasel worthless
        wretch abruti connard crétin imbécile ordure salaud arschloch dummkopf schwachkopf
        trottel estúpido gilipollas idiota imbécil""",
    THREAT: """annihilate beat burn bury choke crush cut destroy exterminate hang hurt kill
        murder poison punch shoot slaughter slap smash stab strangle torture""",
    OPENER: "deserve deserves gonna must should will ll wish",
    TARGET: """he her him his it she their them they these this those u ur you your yours
        yourself du euch ihr sie tu vous usted ustedes""",
    NEGATION: "aint cannot hardly isn isnt neither never nobody not nothing wasn wasnt without don doesn didn won",
    SPEECH: """accused according alleged alleges article calling called calls claimed claims
        complained heard named quote quoted quotes reported reports said saying says stated
        wrote""",
}
CLASSES = ("insult", "insult_at_target", "insult_negated", "insult_reported",
           "threat", "threat_negated_or_reported")
#: Prior weights of the classes, and the prior bias.
PRIOR = np.array([3.0, 4.0, -0.5, 0.5, 4.0, 0.0])
PRIOR_BIAS = -3.0
#: Rows of evidence that a prior weight counts for.
PRIOR_STRENGTH = 1.0


# Each transducer is a function (state, symbol) -> state over a few states;
# END resets all of them after its clause has been read off.
def _insult(s: int, x: int) -> int:
    return 1 if x == INSULT else s


def _threat(s: int, x: int) -> int:
    """0 nothing, 1 opener, 2 opener and verb, 3 verb aimed at a target."""
    if s == 0 and x == OPENER:
        return 1
    if s == 1 and x == THREAT:
        return 2
    if s == 2 and x == TARGET:
        return 3
    return s


def _target(s: int, x: int) -> int:
    return 1 if x == TARGET else s


def _scope(s: int, x: int) -> int:
    """0 plain, 1 negation before any insult or verb, 2 speech verb before, 3 fixed plain."""
    if s == 0 and x in (INSULT, THREAT):
        return 3
    if s in (0, 1) and x == SPEECH:
        return 2
    if s == 0 and x == NEGATION:
        return 1
    return s


@lru_cache(maxsize=1)
def composed() -> tuple[np.ndarray, np.ndarray]:
    """(transition table, class of each state at a clause end, -1 for none)."""
    parts = (_insult, _threat, _target, _scope)
    numbers, queue, rows = {(0, 0, 0, 0): 0}, [(0, 0, 0, 0)], []
    for state in queue:  # grows while it is read: the reachable product states
        row = []
        for x in range(END):
            to = tuple(f(s, x) for f, s in zip(parts, state))
            if to not in numbers:
                numbers[to] = len(numbers)
                queue.append(to)
            row.append(numbers[to])
        rows.append([*row, 0])
    kinds = []
    for insult, threat, target, scope in queue:
        aside = scope in (1, 2)
        if threat == 3:
            kinds.append(5 if aside else 4)
        elif insult:
            kinds.append({1: 2, 2: 3}.get(scope, 1 if target else 0))
        else:
            kinds.append(-1)
    return np.array(rows), np.array(kinds)


#: Lengths in bytes of word stems; a stem is shorter than its word.
STEMS = (4, 5, 6, 7)
#: A learned arc occurs in at least so many toxic texts not explained before it
#: (and so large a share of all toxic ones), with so large a share of toxic ones
#: among the texts that have it.
LEAST_GAIN, LEAST_SHARE, LEAST_PRECISION = 2, 0.004, 0.9
#: The first bits of a key tell whole words (0) from stems (their length).
_KEY_BITS = np.uint64(0x1FFFFFFFFFFFFFFF)


def _tagged(hashes: np.ndarray, length: int) -> np.ndarray:
    return (hashes & _KEY_BITS) | np.uint64((length - 3 if length else 0) << 61)


def _word_keys(words: str) -> np.ndarray:
    raw = [w.encode() for w in words.split()]
    ends = np.cumsum([len(w) for w in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    return _tagged(segment_hashes(data, ends - [len(w) for w in raw], ends), 0)


@dataclass
class Lexicon:
    """Keys, ascending, and the symbol of each."""

    keys: np.ndarray
    symbols: np.ndarray

    @classmethod
    def of(cls, insults: np.ndarray) -> "Lexicon":
        """The fixed lists, with ``insults`` (keys) for the insult arcs."""
        parts = [(insults, INSULT)] + [(_word_keys(w), x) for x, w in WORDS.items() if x != INSULT]
        keys = np.concatenate([k for k, _ in parts])
        symbols = np.concatenate([np.full(len(k), x) for k, x in parts])
        order = np.argsort(keys, kind="stable")
        return cls(keys[order], symbols[order])

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Symbol of each key, -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.symbols[at], -1)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[np.frombuffer(b".!?;\n\r", dtype=np.uint8)] = True


def _letters(chunk: Chunk) -> tuple[SegmentHasher, np.ndarray, np.ndarray, np.ndarray]:
    """Hasher of the lower-cased bytes; starts, ends and text of each run of letters."""
    data = LOWER[chunk.data]
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[chunk.offsets] = True
    before = np.concatenate([[False], letter[:-1]]) & ~edge[:-1]
    after = np.concatenate([letter[1:], [False]]) & ~edge[1:]
    starts = np.flatnonzero(letter & ~before)
    return (SegmentHasher(data), starts, np.flatnonzero(letter & ~after) + 1,
            np.searchsorted(chunk.offsets, starts, side="right") - 1)


def keys_of(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every word and stem, each once a text."""
    if len(chunk.data) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hasher, starts, ends, text = _letters(chunk)
    keys, texts = [_tagged(hasher(starts, ends), 0)], [text]
    for n in STEMS:
        long = ends - starts > n
        keys.append(_tagged(hasher(starts[long], starts[long] + n), n))
        texts.append(text[long])
    key, text = np.concatenate(keys), np.concatenate(texts)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[first], text[first]


def clauses(chunk: Chunk, lexicon: Lexicon) -> np.ndarray:
    """Clauses of each class in each text: one row a text, one column a class."""
    out = np.zeros((chunk.n, len(CLASSES)), dtype=np.int64)
    if len(chunk.data) == 0:
        return out
    hasher, starts, ends, owner = _letters(chunk)
    symbol = lexicon.look(_tagged(hasher(starts, ends), 0))
    tags = set((lexicon.keys >> np.uint64(61)).tolist())
    for n in STEMS:
        if n - 3 in tags:
            long = np.flatnonzero((ends - starts > n) & (symbol < 0))
            symbol[long] = lexicon.look(_tagged(hasher(starts[long], starts[long] + n), n))
    known = symbol >= 0
    where, what, owner = starts[known], symbol[known], owner[known]
    core = np.isin(what, (INSULT, THREAT))
    if not core.any():
        return out
    # clause numbers: stops seen before each position; only clauses with a core word run
    stop = _STOP[chunk.data].copy()
    stop[chunk.offsets[:-1][chunk.offsets[:-1] < len(stop)]] = True
    clause = np.cumsum(stop)[where]
    runs = np.isin(clause, clause[core])
    table, kinds = composed()
    state, now, text = 0, -1, -1
    for c, x, t in zip(clause[runs].tolist(), what[runs].tolist(), owner[runs].tolist()):
        if c != now:
            if now >= 0 and kinds[state] >= 0:
                out[text, kinds[state]] += 1
            state, now, text = 0, c, t
        state = table[state, x]
    if now >= 0 and kinds[state] >= 0:
        out[text, kinds[state]] += 1
    return out


@dataclass
class Grammar:
    """The lexicon and the weights of the clause classes."""

    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.minimum(counts, 3) @ self.weights + self.bias)))


def choose(keys: np.ndarray, docs: np.ndarray, toxic: int) -> np.ndarray:
    """Greedy choice among candidate arcs, given as (key, toxic text) pairs."""
    least = max(LEAST_GAIN, LEAST_SHARE * toxic)
    open_, chosen = np.ones(len(keys), dtype=bool), []
    names, which = np.unique(keys, return_inverse=True)
    while len(names):
        gain = np.bincount(which[open_], minlength=len(names))
        best = gain.max()
        if best < least:
            break
        k = int(np.flatnonzero(gain == best)[-1])  # the longest stem among equals
        chosen.append(names[k])
        open_ &= ~np.isin(docs, docs[which == k])
    return np.array(chosen, dtype=np.uint64)


def learn(docs: DataFrame, ids: DataFrame) -> Lexicon:
    """Insult arcs from labelled texts (``docs`` with ``label``, at most as many as ``ids``).

    The texts that have each word or stem are counted where they are read;
    what reaches the driver are the candidates' occurrences in toxic texts.
    """
    fixed = _word_keys(WORDS[INSULT])

    def pairs(batches):
        for b in batches:
            for c in chunks(b.column(1)):
                key, text = keys_of(c)
                label = b.column(2).slice(c.first, c.n).to_numpy(zero_copy_only=False)
                ids_ = b.column(0).slice(c.first, c.n).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(ids_[text]), pa.array((label[text] == 1).astype(np.int32))],
                    ["key", "doc", "toxic"])

    labelled = docs.join(F.broadcast(ids), "doc_id").select(
        F.xxhash64("text").alias("doc"), F.col("text").cast("string").alias("text"), "label").where("text is not null")
    found = map_batches(labelled, pairs, "key long, doc long, toxic int")
    # copies of one text are one piece of evidence
    arcs = (found.groupBy("key", "doc").agg(F.max("toxic").alias("toxic"))
            .groupBy("key").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"),
                                F.collect_list(F.when(F.col("toxic") == 1, F.col("doc"))).alias("docs")))
    names = [int(k) for k in fixed.view(np.int64)]
    rows = (arcs.where(((F.col("bad") >= LEAST_GAIN) & (F.col("bad") >= LEAST_PRECISION * F.col("n")))
                       | F.col("key").isin(names)).collect())
    toxic = {d for r in rows for d in r["docs"]}
    drop = {r["key"] for r in rows if r["n"] >= 5 and r["bad"] < 0.5 * r["n"]}
    new = [r for r in rows if r["bad"] >= LEAST_GAIN and r["bad"] >= LEAST_PRECISION * r["n"]]
    keys = np.array([r["key"] for r in new for _ in r["docs"]], dtype=np.int64).view(np.uint64)
    texts = np.array([d for r in new for d in r["docs"]], dtype=np.int64)
    chosen = choose(keys, texts, len(toxic))
    kept = np.array([k for k in names if k not in drop], dtype=np.int64).view(np.uint64)
    return Lexicon.of(np.unique(np.concatenate([kept, chosen])))


def train(lexicon: Lexicon, counts: np.ndarray, labels: np.ndarray, steps: int = 30) -> Grammar:
    """Logistic weights with the prior as their centre (Newton steps)."""
    x = np.column_stack([np.minimum(counts, 3), np.ones(len(counts))]).astype(float)
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + PRIOR_STRENGTH * (w - prior)
        bend = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return Grammar(lexicon, w[:-1], float(w[-1]))


def describe(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text",
             *carried: str) -> DataFrame:
    """(doc_id, one count column per clause class, carried columns as long)."""
    def run(batches):
        for b in batches:
            counts = [clauses(c, lexicon) for c in chunks(b.column(1))]
            counts = np.concatenate(counts) if counts else np.zeros((0, len(CLASSES)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(CLASSES))),
                 *(b.column(2 + k) for k in range(len(carried)))],
                ["doc_id", *CLASSES, *carried])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                     *(F.col(c).cast("long").alias(c) for c in carried))
    return map_batches(rows, run, ", ".join(f"{c} long" for c in ("doc_id", *CLASSES, *carried)))


def fit_on(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Grammar:
    """Fit on documents with a toxicity label whose crc32 of the id, modulo 4, is not 2.

    At most ``max_docs`` short rows of counts reach the driver.
    """
    ids = write_table(sample_labels(labels, "toxic", 4, 2, max_docs), "toxic-labels")
    texts = docs.select("doc_id", "text")
    lexicon = learn(texts, ids)
    rows = describe(texts.join(F.broadcast(ids), "doc_id"), lexicon, "doc_id", "text", "label").collect()
    counts = np.array([[r[c] for c in CLASSES] for r in rows], dtype=np.int64).reshape(-1, len(CLASSES))
    return train(lexicon, counts, np.array([int(r["label"] == 1) for r in rows], dtype=float))


def score(df: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted, clause counts) of every row of ``df``."""
    z = F.lit(float(grammar.bias))
    for name, weight in zip(CLASSES, grammar.weights):
        z = z + F.least(F.col(name), F.lit(3)) * F.lit(float(weight))
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return (describe(df, grammar.lexicon, id_col, text_col)
            .select("doc_id", s.alias("score"), *CLASSES)
            .select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *CLASSES))
