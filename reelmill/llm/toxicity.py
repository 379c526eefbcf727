"""Toxicity by Levenshtein automata over a lexicon trie, weighed by the context of each match.

The lexicon is learned. Words of labelled texts go into a trie whose nodes count the toxic and clean
texts that hold a word with this beginning; copies of a text count once, since a node counts
different surroundings as well as texts; quotations do not count. A node enters the lexicon if toxic texts prevail in it by far more
than chance would give and no longer beginning explains as many of them: a whole word, or a stem with
its endings.

Matching runs each word through the automaton that accepts all entries with up to ``errors`` edits (0
below five letters, 1 below eight, 2 from there on). It is the product of the trie and the
Levenshtein automata of its entries, made deterministic state by state as words need it, so a word
costs a table look-up for each letter. Nothing limits the length of a text or word.

Each match has a context: the ``WINDOW`` words on either side. A match between quotation marks, or
after a word of reporting, is a quotation and weighs less than one in plain speech. A misspelled entry weighs
by how often toxic and clean texts of the sample hold words as near to it that are in no other text; spellings
that clean texts of the sample hold are words of their own. Both weights come from the sample, with a prior. The score is the share of toxic texts among those with as much weight, smoothed, and at
least that of less weight.

The sample is the only bound: at most ``TOXIC`` and ``CLEAN`` labelled rows, those with the least hash of
their id. Score and features never see lang, source, doc_id or labels of the scored rows.

Defined results: null and empty texts score 0; equal texts have equal scores; without labelled
rows of both kinds every text scores 0; null labels are no labels; repeated ids count once in the
sample, with the least text; columns named like the score raise an error; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from reelmill.llm.batches import text_slices, texts
from reelmill.session import store

THRESHOLD = 0.7
#: Labelled rows of each kind that the lexicon and weights are learned from, at most.
TOXIC, CLEAN = 4000, 12_000
#: Least letters of an entry, and letters of a word that its beginnings go up to in the trie.
STEM, DEEP = 4, 14
#: An entry's least number of toxic texts and surroundings, its least odds against the base rate, and the logarithm of its chance.
SUPPORT, ODDS, CHANCE = 4, 6.0, 16.0
#: Odds from which an entry weighs 1; below, by their logarithm.
CERTAIN = 200.0
#: Share of a node's toxic texts that a longer beginning must keep to take its place.
KEEPS = 0.9
WINDOW = 12
#: Prior share of toxic texts among quotations and misspellings, and how many texts it counts for.
QUOTED, MISSPELLED, PRIOR = 0.2, 0.6, 4.0
#: Least weights of the steps of the scale.
STEPS = (1e-6, 0.3, 0.6, 1.0, 1.5, 2.0, 3.0, 5.0)
#: Words that a task remembers before it starts anew, and states of an automaton.
KEPT, STATES = 300_000, 50_000
#: Quotation marks (opening, closing, both) and words of reporting.
OPENING, CLOSING, BOTH = "“«„‹", "”»›", "\"'`"
REPORTING = frozenset(
    "said says say quote quoted quotes word words term terms called calls write writes wrote written disait dit mot mots écrit citation sagte sagt wort wörter schrieb zitat dijo dice palabra palabras escribió cita".split()
)
MARKS = frozenset(OPENING + CLOSING + BOTH)


def cleaned(token: str) -> str:
    """A token in lower case without what is no letter or digit at its ends."""
    if token.isalpha():
        return token.lower()
    first, last = 0, len(token)
    while first < last and not token[first].isalnum():
        first += 1
    while last > first and not token[last - 1].isalnum():
        last -= 1
    return token[first:last].lower()


def errors_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class Automaton:
    """All entries with their edits as one automaton over letters, built as it is used.

    A state holds trie nodes with the fewest edits that lead to them. An entry that is a stem accepts
    as soon as its node is reached, whatever follows; a whole word accepts at the end of the word. ``match``
    gives the entry and edits of the best reading, or ``None``.
    """

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.stems: dict[int, int] = {}
        self.words: dict[int, int] = {}
        for number, (entry, stem, _) in enumerate(entries):
            node = 0
            for letter in entry:
                following = self.children[node].setdefault(letter, len(self.children))
                if following == len(self.children):
                    self.children.append({})
                node = following
            (self.stems if stem else self.words)[node] = number
        self.allowed = [errors_for(len(e)) for e, _, _ in entries]
        #: Most edits that any entry below a node allows.
        self.reach = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):
            own = [self.allowed[table[node]] for table in (self.stems, self.words) if node in table]
            self.reach[node] = max([*own, *(self.reach[c] for c in self.children[node].values())], default=0)
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.best: list[tuple[int, int] | None] = []  # (edits, entry) of the best stem so far
        self.ended: list[tuple[int, int] | None] = []  # the same if the word ends here
        self.steps: list[dict[str, int]] = []
        self.start = self._number({0: 0}, None)

    def _number(self, nodes: dict[int, int], best: tuple[int, int] | None) -> int:
        """The state's number, after letters that an entry has and the word lacks."""
        waiting = list(nodes.items())
        while waiting:
            node, edits = waiting.pop()
            if nodes[node] == edits:
                for child in self.children[node].values():
                    if edits < self.reach[child] and edits + 1 < nodes.get(child, 9):
                        nodes[child] = edits + 1
                        waiting.append((child, edits + 1))
        for node, edits in nodes.items():
            if node in self.stems and edits <= self.allowed[self.stems[node]]:
                best = min(best or (9, 0), (edits, self.stems[node]))
        if best is not None:  # what cannot do better is left out
            nodes = {n: e for n, e in nodes.items() if e < best[0]}
        key = frozenset([*nodes.items(), ("best", best)])
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
            self.best.append(best)
            ends = [(e, self.words[n]) for n, e in nodes.items() if n in self.words and e <= self.allowed[self.words[n]]]
            self.ended.append(min([*ends, *([best] if best else [])], default=None))
            self.steps.append({})
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < after.get(node, 9):
                after[node] = edits

        for node, edits in self.states[state].items():
            reach(node, edits + 1)  # a letter too many
            for other, child in self.children[node].items():
                reach(child, edits + (other != letter))
        return self._number(after, self.best[state])

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, edits), fewest edits first."""
        if len(self.states) > STATES:
            self.reset()
        state = self.start
        for letter in word:
            steps = self.steps[state]
            following = steps.get(letter)
            if following is None:
                following = steps[letter] = self._step(state, letter)
            state = following
            if not self.states[state]:
                break
        found = self.ended[state]
        return None if found is None else (found[1], found[0])


def opens(token: str) -> bool:
    """Whether a quotation begins with a token."""
    return token.lstrip("([{")[:1] in MARKS and token[:1] not in CLOSING


def closes(token: str) -> bool:
    """Whether a quotation ends with a token."""
    return token.rstrip(".,;:!?)]}")[-1:] in MARKS and token[-1:] not in OPENING


def quoted(tokens: list[str], i: int) -> bool:
    """Whether the word at ``i`` stands between quotation marks, or marked after a word of reporting."""
    before, own, after = tokens[max(0, i - WINDOW) : i], tokens[i], tokens[i + 1 : i + 1 + WINDOW]
    nearest = next((t for t in reversed(before) if opens(t) or closes(t)), None)
    opened = opens(own) or nearest is not None and opens(nearest) and not closes(nearest)
    nearest = next((t for t in after if opens(t) or closes(t)), None)
    closed = closes(own) or nearest is not None and closes(nearest) and not opens(nearest)
    reported = any(cleaned(t) in REPORTING for t in before[-2:]) and (opens(own) or closes(own) or before[-1].endswith(":"))
    return opened and closed or reported


class Memory(dict):
    """Match of each token, remembered."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: str):
        word = cleaned(token)
        found = self.automaton.match(word) if word else None
        if found is not None:
            found = (*found, word)
        if len(self) >= KEPT:
            self.clear()
        self[token] = found
        return found


def matches(text: str, memory: Memory) -> list[tuple[int, int, str, bool]]:
    """(entry, edits, word, quoted) of every match in a text."""
    tokens = text.split()
    found = list(map(memory.__getitem__, tokens))
    return [(*f, quoted(tokens, i)) for i, f in enumerate(found) if f is not None]


class Model:
    """What is broadcast: entries, clean spellings near them, weights of contexts and the scale of scores."""

    def __init__(self, entries=(), known=(), weights=(1.0, ()), scale=((0.0, 0.0),)):
        self.entries, self.known = list(entries), frozenset(known)
        self.quoted, self.misspelled = weights
        self.floors = np.array([f for f, _ in scale])
        self.shares = np.array([s for _, s in scale])

    def weight(self, found: list[tuple[int, int, str, bool]]) -> float:
        total = 0.0
        for entry, edits, word, is_quoted in found:
            if edits and word in self.known:
                continue
            total += self.entries[entry][2] * (self.misspelled[entry] if edits else 1.0) * (self.quoted if is_quoted else 1.0)
        return total

    def score(self, found: list[tuple[int, int, str, bool]]) -> float:
        return float(self.shares[np.searchsorted(self.floors, self.weight(found) + 1e-9, side="right") - 1])


def sample_texts(docs: DataFrame, labelled: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """label and text of the labelled rows that are learned from; stored."""
    chosen = None
    for label, size in ((0, clean), (1, toxic)):
        part = labelled.where(F.col("label") == label).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")
    return store(rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text"), "toxic-sample")


def stem_counts(sample: DataFrame) -> DataFrame:
    """stem, whole (the stem is a word), label, texts that hold such a word, and different surroundings."""
    schema = "stem string, label int, texts long, around long"

    def count(batches):
        for rows in text_slices(batches):
            for label, text in zip(rows.column("label").to_pylist(), texts(rows.column("text"))):
                tokens = text.split()
                words = [cleaned(t) for t in tokens]
                marks = not MARKS.isdisjoint(text)
                places: dict[str, int] = {}
                for i, word in enumerate(words):
                    if len(word) >= STEM and word not in places and not (marks and quoted(tokens, i)):
                        places[word] = hash_of(words[max(0, i - 1) : i], words[i + 1 : i + 2])
                seen: dict[str, int] = {}
                for word, around in places.items():
                    for n in range(STEM, min(len(word), DEEP) + 1):
                        seen.setdefault(word[:n], around)
                    seen.setdefault(word + "$", around)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([label] * len(seen), pa.int32()), pa.array([1] * len(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["stem", "label", "texts", "around"])

    found = sample.mapInArrow(count, schema)
    return found.groupBy("stem").agg(
        F.sum(F.col("label") * F.col("texts")).alias("toxic"), F.sum((1 - F.col("label")) * F.col("texts")).alias("clean"),
        F.approx_count_distinct(F.when(F.col("label") == 1, F.col("around")), 0.02).alias("around"),
    )


def hash_of(before: list[str], after: list[str]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(json.dumps([before, after])) >> 1


def choose_entries(counts: list[tuple[str, int, int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Entries (letters, whether a stem, weight) of the trie's counts (beginning, toxic, clean, surroundings)."""
    share = n_toxic / (n_toxic + n_clean)
    good: dict[str, int] = {}
    weights: dict[str, float] = {}
    for stem, toxic, clean, around in counts:
        support = min(toxic, around)
        if support < SUPPORT:
            continue
        odds = (support + 0.5) / (clean + 0.5) * (n_clean + 1) / (n_toxic + 1)
        total = support + clean
        rate = support / total
        # Logarithm of the chance of so many toxic ones among all, at the base rate.
        chance = total * (rate * math.log(rate / share) + ((1 - rate) * math.log((1 - rate) / (1 - share)) if rate < 1 else 0))
        if odds >= ODDS and rate > share and chance >= CHANCE:
            good[stem], weights[stem] = support, min(1.0, math.log(odds) / math.log(CERTAIN))
    longer = defaultdict(int)
    for stem, support in good.items():
        shorter = stem[:-1]
        longer[shorter] = max(longer[shorter], support)
    entries = []
    for stem in sorted(good):
        if longer[stem] >= KEEPS * good[stem]:
            continue  # a longer beginning holds nearly all of it
        whole = stem.endswith("$")
        letters = stem[:-1] if whole else stem
        if not any(not s.endswith("$") and s != stem and letters.startswith(s) and longer[s] < KEEPS * good[s] for s in (letters[:n] for n in range(STEM, len(letters) + 1)) if s in good):
            entries.append((letters, not whole, weights[stem]))
    return entries


def fit(docs: DataFrame, labelled: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """A model from the texts of at most ``toxic`` and ``clean`` rows of ``labelled`` (doc_id, label)."""
    sample = sample_texts(docs, labelled, toxic, clean)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model()
    # Only beginnings that toxic texts prevail in come to the driver, at most a bounded sample's.
    strong = (F.col("toxic") >= SUPPORT) & (F.col("toxic") * n_clean >= ODDS * F.col("clean") * n_toxic)
    counts = [tuple(r) for r in stem_counts(sample).where(strong).select("stem", "toxic", "clean", "around").collect()]
    entries = choose_entries(counts, n_toxic, n_clean)
    if not entries:
        return Model()

    def look(batches):
        memory = Memory(Automaton(entries))
        for rows in text_slices(batches):
            found = [json.dumps(matches(text, memory)) for text in texts(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), pa.array(found, pa.string())], names=["label", "found"])

    rows = [(r["label"], json.loads(r["found"])) for r in sample.mapInArrow(look, "label int, found string").where("found <> '[]'").collect()]

    def weight_of(kind, prior: float) -> float:
        """How far toxic texts prevail among those of a kind, from 0 to 1."""
        count = Counter(label for label, found in rows if kind(found))
        rate = (count[1] / n_toxic + prior * PRIOR / n_toxic) / (count[1] / n_toxic + count[0] / n_clean + PRIOR / n_toxic)
        return float(np.clip(2 * rate - 1, 0, 1)) if count[0] + count[1] >= SUPPORT else prior

    known = {word for label, found in rows if label == 0 for _, edits, word, _ in found if edits}
    spread = Counter(word for _, found in rows for word in {w for _, e, w, _ in found if e})
    quoted_weight = weight_of(lambda found: any(not e for _, e, _, _ in found) and all(q for _, e, _, q in found if not e), QUOTED)
    # Spellings of one text only stand for those that the sample lacks.
    misspelled = [
        weight_of(lambda found, n=n: any(e and i == n and spread[w] == 1 for i, e, w, _ in found) and all(e for _, e, _, _ in found), MISSPELLED)
        for n in range(len(entries))
    ]
    model = Model(entries, known, (quoted_weight, misspelled))
    weights = [(model.weight(found), label) for label, found in rows]
    scale, least = [(0.0, 0.0)], 0.0
    for floor, top in zip(STEPS, (*STEPS[1:], math.inf)):
        count = Counter(label for weight, label in weights if floor <= weight + 1e-9 < top)
        prior = 0.9 if floor >= 1.0 else n_toxic / (n_toxic + n_clean)
        least = max(least, (count[1] + prior * 2) / (count[1] + count[0] + 2))
        scale.append((floor, least))
    return Model(entries, known, (quoted_weight, misspelled), scale)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in ``column``, which must not be one of its own."""
    if column in docs.columns:
        raise ValueError(f"column {column} exists")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def weigh(batches):
        model = shared.value
        memory = Memory(Automaton(model.entries))
        for rows in text_slices(batches):
            found = [model.score(matches(text, memory)) if text else 0.0 for text in texts(rows.column("text"))]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.float64())], names=schema.names)

    return docs.mapInArrow(weigh, schema)


def held_out(doc_id):
    """Whether a row's label must not be learned: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id and label of the rows whose toxicity may be learned."""
    return labels.select("doc_id", F.col("toxic").alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
