"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as classes (insult, threat, intent, target, negation, reported speech).
Small transducers for negation, reported speech, target and threat are composed into
one, which runs over each clause and turns plain insults into aimed, denied or reported
ones and "intent, threat, target" into a threat.  Isolated words do not score: a
matched clause does, with the weight of what it was turned into.

How far each lexicon entry is believed is learned from labels: the share of toxic
documents among all training documents where it stands in a clause that is neither
denied nor reported, drawn towards ``PRIOR`` by ``STRENGTH`` documents.  A document's
score joins its clauses as independent evidence above the share of toxic documents
among those without any clause.

The lexicon grows by stems, so that it serves languages nobody listed: word starts of
``START`` letters that stand twice or more in toxic teaching documents and hardly so in
others.  A word with such a start is read as an insult.  Chance brings such words into
long clean texts, so what they tell is a logistic function of how many of them are
neither denied nor reported and of the text's words.  Stems are learned from a sample of
about ``PER_LABEL`` documents of each label, drawn by hash; equal texts count once.

Only rows whose crc32(doc_id as text) mod 3 is not 1 teach.  Null and empty texts have
no clause and get the base score; rows are independent, so repeated rows repeat; labels
that are null teach nothing; several labels of one doc_id count as their largest; an
empty table of labels leaves the priors.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlet.llm.words import map_texts

W, INSULT, THREAT, INTENT, TARGET, NEG, REPORT, END = range(8)
DENIED, TOLD, AIMED, MENACE, MENACE_DENIED, MENACE_TOLD = range(8, 14)

# The lexicon, by class.
LEXICON = {
    INSULT: """idiot idiots idiotic moron morons moronic stupid imbecile imbeciles dumb dumbass dimwit halfwit
        fool fools loser losers scum scumbag trash garbage worthless pathetic disgusting vile vermin filth filthy
        clown clowns pig pigs swine bastard bastards bitch bitches asshole assholes jerk jerks creep creeps freak
        freaks retard retarded parasite parasites degenerate degenerates subhuman coward cowards liar liars
        hypocrite crybaby braindead brainless clueless despicable repulsive shameless lowlife deadbeat cretin
        dunce nitwit simpleton buffoon wretch wimp slut whore dirtbag douchebag twat wanker
        idiota imbécil estúpido estúpida basura escoria cabrón gilipollas connard connasse salaud abruti crétin
        ordure imbécile arschloch dummkopf vollidiot abschaum schwachkopf""".split(),
    THREAT: "kill murder hurt stab shoot strangle burn beat destroy smash crush hunt punish rape lynch".split(),
    INTENT: "will gonna shall must should going wanna want ll i'll we'll let deserve deserves hope".split(),
    TARGET: """you your you're youre yourself yourselves u ur they them their he him she her those these
        people everyone women men immigrants foreigners""".split(),
    NEG: "not no never nobody isn't aren't wasn't weren't don't doesn't didn't won't without hardly neither nor".split(),
    REPORT: """said says say called calls call quoted quote claims claimed wrote writes tweeted heard reported
        reportedly alleged word term means meaning definition""".split(),
}
CLASS = {word: kind for kind, words in LEXICON.items() for word in words}
SCORING = frozenset(w.encode() for w, k in CLASS.items() if k in (INSULT, THREAT))
#: Share of its term's belief that each kind of clause keeps, and the power to which its doubt is raised.
KEPT = {INSULT: (1.0, 1.0), AIMED: (1.0, 1.5), DENIED: (0.15, 1.0), TOLD: (0.25, 1.0),
        MENACE: (1.0, 1.0), MENACE_DENIED: (0.15, 1.0), MENACE_TOLD: (0.25, 1.0)}
PRIOR, STRENGTH, BASE, BASE_STRENGTH = 0.9, 4.0, 0.05, 50.0
#: Letters of a stem, and documents of each label that stems are learned from (expected number; the draw is by hash).
START, PER_LABEL = 4, 4000
#: A stem stands twice in so many toxic documents of the sample, at least, and this share of those it stands twice in is toxic.
STEM_DOCS, STEM_PART, STEM_SHARE = 5, 0.01, 0.5
#: Words over which a negation, an intent or a threat reaches.
REACH = 4


class Transducer:
    """States from 0; ``step(state, symbol)`` gives the next state and the symbol put out."""

    def __init__(self, step, states: int):
        self.step, self.states = step, states

    def compose(self, then: Transducer) -> Transducer:
        """Run ``then`` on what this one puts out; a state is a pair of states."""
        def step(state: int, symbol: int) -> tuple[int, int]:
            mine, out = self.step(state // then.states, symbol)
            other, out = then.step(state % then.states, out)
            return mine * then.states + other, out
        return Transducer(step, self.states * then.states)

    def table(self) -> list[list[tuple[int, int]]]:
        return [[self.step(s, x) for x in range(END + 1)] for s in range(self.states)]


def _threat(state: int, x: int) -> tuple[int, int]:
    """State: 0; 1..R words left after an intent; R+1..2R words left after a threat that followed it."""
    if x == END:
        return 0, x
    if x == INTENT:
        return REACH, x
    if x == THREAT:
        return (2 * REACH if 0 < state <= REACH else 0), W
    if x == TARGET and state > REACH:
        return 0, MENACE
    return (state - 1 if state not in (0, REACH + 1) else 0), x


def _negation(state: int, x: int) -> tuple[int, int]:
    """State: words left that a negation reaches."""
    if x == END:
        return 0, x
    if x == NEG:
        return REACH, W
    if state and x in (INSULT, MENACE):
        return state - 1, DENIED if x == INSULT else MENACE_DENIED
    return max(0, state - 1), x


def _reported(state: int, x: int) -> tuple[int, int]:
    """State: 1 after a word of reporting, up to the clause's end."""
    if x == END:
        return 0, x
    if x == REPORT:
        return 1, W
    if state and x in (INSULT, MENACE):
        return 1, TOLD if x == INSULT else MENACE_TOLD
    return state, x


def _target(state: int, x: int) -> tuple[int, int]:
    """State: 1 after somebody aimed at, up to the clause's end."""
    if x == END:
        return 0, x
    if x == TARGET:
        return 1, x
    return state, AIMED if state and x == INSULT else x


#: A threat's negation must be known before its target comes, so negation sees the menace put out.
GRAMMAR = (Transducer(_threat, 2 * REACH + 1).compose(Transducer(_negation, REACH + 1))
           .compose(Transducer(_reported, 2)).compose(Transducer(_target, 2)).table())
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
_WORD = re.compile(r"[^\W\d_]+")
_BLANK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))


def read(raw: bytes, stems: frozenset[str] = frozenset()) -> tuple[list[tuple[str, int]], int]:
    """(term, kind) of each matched clause part of a text, in order, and its words if it has any.

    The term of a word that is known by its stem only is the stem and ``*``.
    """
    if SCORING.isdisjoint(raw.lower().translate(_BLANK).split()):
        text = raw.decode("utf-8", "replace").lower()
        if (raw.isascii() or SCORING.isdisjoint(text.encode().translate(_BLANK).split())) and (
                not stems or stems.isdisjoint(w[:START] for w in _WORD.findall(text))):
            return [], 0
    found, state, threat, words = [], 0, "", 0
    for m in _TOKEN.finditer(raw.decode("utf-8", "replace").lower()):
        token = m[0]
        symbol = END if len(token) == 1 and token in ".!?;:\n" else CLASS.get(token.replace("’", "'"), W)
        words += symbol != END
        if symbol == W and token[:START] in stems:
            symbol, token = INSULT, token[:START] + "*"
        if symbol == THREAT:
            threat = token
        state, out = GRAMMAR[state][symbol]
        if out in KEPT:
            found.append((threat if out >= MENACE else token, out))
    return found, words


def clauses(raw: bytes) -> list[tuple[str, int]]:
    """(term, kind) of each clause part that the lexicon matches."""
    return read(raw)[0]


@dataclass(frozen=True)
class Stems:
    """Learned word starts, and the logistic function of log(hits) and log(words)."""
    starts: frozenset[str] = frozenset()
    of_hits: float = 0.0
    of_words: float = 0.0
    base: float = 0.0

    def chance(self, hits: int, words: int) -> float:
        x = self.of_hits * math.log(hits) + self.of_words * math.log(max(hits, words)) + self.base
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _hits(found: list[tuple[str, int]]) -> int:
    return sum(t[-1] == "*" and k in (INSULT, AIMED) for t, k in found)


def _said(labels: DataFrame) -> DataFrame:
    return labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))


def teaching_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(text, toxic, weight) of some ``per_label`` teaching documents of each label.

    The draw is by a threshold on the hash of doc_id, so no task orders a label's rows.
    """
    said = _teaching(_said(labels), 3, 1).select("doc_id", (F.col("_toxic") > 0).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in said.groupBy("toxic").count().collect()}  # two rows
    part = F.coalesce(*[F.when(F.col("toxic") == kind, F.lit(min(1.0, per_label / n))) for kind, n in sizes.items()], F.lit(1.0))
    turn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(9)), F.lit(2**30)) / F.lit(2**30)
    chosen = said.select(F.col("doc_id").alias("_llm_doc"), "toxic", part.alias("part"), turn.alias("turn")).where("turn < part")
    chosen = F.broadcast(chosen.select("_llm_doc", "toxic", (1 / F.col("part")).alias("weight")))  # some 2 * per_label rows
    return docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_llm_doc")).select("text", "toxic", "weight")


def learn_stems(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Stems:
    """Stems of toxic documents.  What comes to the driver is at most a hundred stems for each repeated start of an average text."""
    known = frozenset(w[:START] for w in CLASS)

    def repeated(raw: bytes):
        once, twice = set(), set()
        for word in _WORD.findall(raw.decode("utf-8", "replace").lower()):
            start = word[:START]
            (twice if start in once else once).add(start)
        return hash_of(raw), sorted(s for s in twice - known if len(s) == START)

    def hash_of(raw: bytes) -> bytes:
        return hashlib.blake2b(raw, digest_size=16).digest()

    sample = teaching_sample(docs, labels, per_label)
    texts = map_texts(sample, repeated, "text_hash binary, starts array<string>").dropDuplicates(["text_hash", "toxic"])
    counts = (texts.select("toxic", "weight", F.explode(F.concat(F.array(F.lit("")), "starts")).alias("start")).groupBy("start")
              .agg(F.count_if("toxic").alias("k"), F.sum(F.when(F.col("toxic"), F.col("weight")).otherwise(0.0)).alias("bad"),
                   F.sum("weight").alias("weight")))
    whole = counts.where("start = ''").select("k").scalar()
    picked = counts.where((F.col("start") != "") & (F.col("k") >= F.greatest(F.lit(STEM_DOCS), STEM_PART * whole))
                          & (F.col("bad") >= STEM_SHARE * F.col("weight")))
    starts = frozenset(r["start"] for r in picked.select("start").collect())
    if not starts:
        return Stems()

    def measured(raw: bytes):
        found, words = read(raw, starts)
        hits = _hits(found)
        return hash_of(raw), [math.log(hits), math.log(max(hits, words))] if hits else []

    rows = (map_texts(sample, measured, "text_hash binary, x array<double>").where(F.size("x") > 0)
            .dropDuplicates(["text_hash", "toxic"])
            .select(F.col("toxic").cast("double").alias("label"), "weight", array_to_vector("x").alias("features")))
    fitted = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=30).fit(rows)
    slopes = fitted.coefficients.toArray()
    return Stems(starts, float(slopes[0]), float(slopes[1]), float(max(-30.0, min(30.0, fitted.intercept))))


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """How far each term is believed; "" has the share of toxic documents without a clause.

    The clauses of all documents are found first, as short lists of terms; only those
    lists meet the labels.  What comes to the driver has a row for each lexicon entry.
    """
    said = _said(labels)

    def terms(raw: bytes):
        return (sorted({t for t, k in clauses(raw) if k in (INSULT, AIMED, MENACE)} or {""}),)

    rows = map_texts(_teaching(docs.select("doc_id", "text"), 3, 1), terms, "_terms array<string>")
    counts = (rows.join(said, "doc_id").select(F.explode("_terms").alias("term"), F.col("_toxic").cast("double").alias("t"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("k")).collect())
    belief = {w: PRIOR for w in LEXICON[INSULT] + LEXICON[THREAT]} | {"": BASE}
    for row in counts:
        prior, strength = (PRIOR, STRENGTH) if row["term"] else (BASE, BASE_STRENGTH)
        belief[row["term"]] = (row["k"] + prior * strength) / (row["n"] + strength)
    return belief


def _teaching(docs: DataFrame, folds: int, held: int) -> DataFrame:
    return docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != held)


def score_of(found: list[tuple[str, int]], belief: dict[str, float], words: int = 0, stems: Stems = Stems()) -> float:
    """One minus the joint doubt of all clauses and of the base."""
    doubt = math.log1p(-belief[""])
    for term, kind in found:
        if term[-1] != "*":
            kept, power = KEPT[kind]
            doubt += power * math.log1p(-min(0.999, kept * belief[term]))
    if hits := _hits(found):
        doubt += math.log1p(-min(0.999, stems.chance(hits, words)))
    return 1.0 - math.exp(doubt)


def score(docs: DataFrame, belief: dict[str, float], text: str = "text", stems: Stems = Stems()) -> DataFrame:
    """The table's other columns with ``score`` and ``clauses``, an array of (term, kind)."""
    names = {INSULT: "insult", AIMED: "aimed", DENIED: "denied", TOLD: "reported", MENACE: "threat",
             MENACE_DENIED: "threat denied", MENACE_TOLD: "threat reported"}

    def one(raw: bytes):
        found, words = read(raw, stems.starts)
        return score_of(found, belief, words, stems), [{"term": t, "kind": names[k]} for t, k in found]

    return map_texts(docs, one, "_llm_score double, _llm_clauses array<struct<term:string,kind:string>>", text)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels), stems=learn_stems(docs, labels))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("_llm_score").alias("score"),
                         (F.col("_llm_score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The documents whose score stays below ``limit``, with their own columns."""
    copied = docs.withColumn("_llm_text", F.col("text"))
    scored = score(copied, learn(docs, labels), "_llm_text", learn_stems(docs, labels))
    return scored.where(F.col("_llm_score") < limit).select(*docs.columns)
