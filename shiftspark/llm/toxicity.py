"""Toxicity: Levenshtein automata over a lexicon trie, then context windows.

1. The lexicon is learned: words that labelled toxic documents hold far more
   often than others, weighted by their log odds.
2. A word is matched by walking the intersection of its Levenshtein automaton
   with the lexicon's trie. States are sets of (trie node, edits) and are kept
   once met, so most words die after a few table look-ups.
   Learning and matching cut words alike: a chunk without a match as a whole is
   matched by its runs of letters and digits.
3. Around each match a window of words is scored: other matches and words of
   address speak for abuse, marks and words of quotation against it, and words
   that the labelled sample has round matches in toxic or in clean documents
   speak for or against it by their log odds there.
4. A document's sums over its matches give its score by boosted trees that are
   fitted on the labelled sample.

Labels of at most SAMPLE_ROWS documents are used, none of them held out.

Nulls, empties, repeats: a null or empty text has no match and gets the score of
such texts; a null doc_id is scored and counts as not held out; rows whose label
is null are not learned from; repeated rows are scored one by one; a very long
text is scanned whole, but its runs of 64 and more characters match no term; at
ties of edits the first term counts; without labels the lexicon is empty and every
score 0.5; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm import gbt
from shiftspark.llm.common import byte_slices, held_out_ids, stash, table, tidied
from shiftspark.llm.quality import labelled_sample

SAMPLE_ROWS = 12_000
LEXICON_TERMS = 600
#: A term is in at least so many toxic documents of the sample, and its odds there are so many times higher.
TERM_DOCUMENTS = 4
TERM_ODDS = 8.0
#: Words round matches that are scored, and in how many documents with a match one is.
CONTEXT_TERMS = 200
CONTEXT_DOCUMENTS = 10
WINDOW = 6
THRESHOLD = 0.5
SLICE_BYTES = 8 << 20
MEMO_ENTRIES = 200_000
#: Automaton states a worker remembers before it starts afresh; bounds memory only.
MEMO_STATES = 50_000

QUOTES = set('"“”„«»‘’')
QUOTING = {"said", "says", "wrote", "quoted", "quote", "called", "word", "term", "sagte", "dit", "dijo"}
ADDRESS = {"you", "your", "youre", "u", "du", "dich", "dein", "tu", "toi", "vous", "ton", "te", "usted", "eres"}

_PARTS = re.compile(r"[^\W_]+")
_EDGES = " .,;:!?#$%&*()|+=/[]{}_~@^<>¿¡'\"“”„«»‘’-"


def edits_allowed(term: str) -> int:
    """Short terms match as they are, long ones with an edit or two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyLexicon:
    """A trie of terms, met with the Levenshtein automaton of each word."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.most: list[int] = [0]  # edits that a term below a node allows at most
        for i, t in enumerate(terms):
            node, allowed = 0, edits_allowed(t)
            self.most[0] = max(self.most[0], allowed)
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({}), self.term.append(-1), self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.term[node] = i
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.step: list[dict[str, int]] = []
        self.start = self._state({(0, 0): None})

    def _state(self, reached: dict[tuple[int, int], None]) -> int:
        """The number of a set of (node, edits), closed under letters left out of the word."""
        best: dict[int, int] = {}
        todo = list(reached)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.next[node].values()]
        key = tuple(sorted(best.items()))
        if key not in self.states:
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= edits_allowed(self.terms[self.term[n]])]
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            self.accepts.append(min(ends) if ends else None)
        return self.states[key]

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term in reach, the first on ties."""
        if len(self.sets) > MEMO_STATES:
            self.clear()
        state = self.start
        for c in word:
            after = self.step[state].get(c)
            if after is None:
                reached = {}
                for node, e in self.sets[state]:
                    own = self.next[node].get(c)
                    if own is not None:
                        reached[(own, e)] = None
                    reached[(node, e + 1)] = None  # a letter put in
                    for child in self.next[node].values():  # a letter exchanged
                        reached[(child, e + 1)] = None
                after = self.step[state][c] = self._state(reached)
            if not self.sets[after]:
                return None
            state = after
        return self.accepts[state]


FEATURES = ["hits", "weight", "top", "misspelled_share", "density", "abuse", "quoted", "terms", "context", "log_words"]
Match = tuple[int, int]  # edits, term


class Scanner:
    """Features of texts for one lexicon and its context words; remembers words within a worker."""

    def __init__(self, lexicon: list[tuple[str, float]], context: list[tuple[str, float]] = ()):
        self.lexicon = FuzzyLexicon([t for t, _ in lexicon])
        self.weights = [w for _, w in lexicon]
        self.context = dict(context)
        self.memo: dict[str, tuple[Match, ...]] = {}

    def chunk(self, chunk: str) -> tuple[Match, ...]:
        """The match of a chunk without the marks round it, or else those of its runs of letters and digits."""
        word = chunk.strip(_EDGES).lower()
        if word not in self.memo:
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            whole = self._match(word)
            parts = [] if whole or word.isalnum() else map(self._match, _PARTS.findall(word))
            self.memo[word] = (whole,) if whole else tuple(m for m in parts if m)
        return self.memo[word]

    def _match(self, word: str) -> Match | None:
        return self.lexicon.match(word) if word and len(word) < 64 else None

    def _found(self, texts: pa.Array) -> tuple[list[str], list[tuple[Match, ...]], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct chunks, their matches, every chunk's number, where texts end, and where matches are."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        encoded = lists.flatten().dictionary_encode()
        chunks, index = encoded.dictionary.to_pylist(), np.asarray(encoded.indices)
        ends = np.asarray(lists.offsets).astype(np.int64)
        kinds = [self.chunk(c) for c in chunks] if self.weights else [()] * len(chunks)
        flagged = np.fromiter((bool(k) for k in kinds), bool, len(kinds))
        at = np.flatnonzero(flagged[index]) if len(kinds) else np.zeros(0, np.int64)
        return chunks, kinds, index, ends - ends[0], at

    def features(self, texts: pa.Array) -> np.ndarray:
        chunks, kinds, index, ends, at = self._found(texts)
        out = np.zeros((len(texts), len(FEATURES)))
        out[:, -1] = np.log1p(np.diff(ends))
        if not len(at):
            return out
        doc = np.searchsorted(ends, at, "right") - 1
        first, last = np.maximum(ends[doc], at - WINDOW), np.minimum(ends[doc + 1], at + WINDOW + 1)
        # what each chunk that stands in a window adds to it
        covered = np.zeros(len(index) + 1, np.int64)
        np.add.at(covered, first, 1)
        np.add.at(covered, last, -1)
        adds = np.zeros((5, len(chunks)))
        for j in np.unique(index[np.cumsum(covered)[:-1] > 0]).tolist():
            words = _PARTS.findall(chunks[j].lower())
            adds[:, j] = len(kinds[j]), not QUOTES.isdisjoint(chunks[j]), sum(2 * (w in QUOTING) for w in words), sum(w in ADDRESS for w in words), sum(self.context.get(w, 0.0) for w in words)
        sums = np.concatenate([np.zeros((5, 1)), np.cumsum(adds[:, index], axis=1)], axis=1)
        matches, marks, quoting, address, context = sums[:, last] - sums[:, first]
        quote = (marks + quoting) / 2
        # a chunk's own matches: how many, misspelled, worth together and at most
        own = np.zeros((4, len(chunks)))
        for j in np.unique(index[at]).tolist():
            worth = [self.weights[term] / (1 + edits) for edits, term in kinds[j]]
            own[:, j] = len(worth), sum(edits > 0 for edits, _ in kinds[j]), sum(worth), max(worth)
        n, misspelled, worth, top = own[:, index[at]]
        per = lambda v: np.bincount(doc, v, len(texts))
        held = np.unique(doc)
        size, count = np.diff(ends), per(n)
        best = np.zeros(len(texts))
        np.maximum.at(best, doc, top)
        cuts = np.searchsorted(doc, held)
        terms = [len({term for j in part.tolist() for _, term in kinds[j]}) for part in np.split(index[at], cuts[1:])]
        whole = np.column_stack([count, per(worth), best, per(misspelled) / np.maximum(count, 1), 100 * count / np.maximum(size, 1), per(worth * (1 + 0.5 * (matches - 1) + 0.5 * address) / (1 + quote)), per(worth * np.minimum(1.0, quote))])
        out[held, :7], out[held, 7] = whole[held], terms
        out[held, 8] = (per(context) / np.maximum(per(np.ones(len(at))), 1))[held]
        return out

    def words_beside(self, texts: pa.Array) -> list[set[str]]:
        """The words of each text that stand in the window of a match."""
        chunks, kinds, index, ends, at = self._found(texts)
        cuts = np.searchsorted(at, ends)
        out = []
        for i in range(len(texts)):
            own = set()
            for h in at[cuts[i] : cuts[i + 1]].tolist():
                around = range(max(int(ends[i]), h - WINDOW), min(int(ends[i + 1]), h + WINDOW + 1))
                own = own.union(*(_PARTS.findall(chunks[index[j]].lower()) for j in around if not kinds[index[j]]))
            out.append(own)
        return out


_SCANNERS: dict[int, Scanner] = {}


def _scanner(lexicon: list[tuple[str, float]], context: list[tuple[str, float]]) -> Scanner:
    key = hash((tuple(lexicon), tuple(context)))
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(lexicon, context)
    return _SCANNERS[key]


def learn_lexicon(sample: DataFrame, most: int = LEXICON_TERMS) -> list[tuple[str, float]]:
    """(term, log odds), the strongest first; sample: text, label."""
    size = sample.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = (size[0] or 0), size[1] - (size[0] or 0)
    if not toxic or not clean:
        return []
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"))
    seen = sample.select("label", F.explode(words).alias("term")).where(F.length("term").between(3, 40))
    seen = seen.groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("t") >= TERM_DOCUMENTS)
    odds = (F.col("t") + 0.5) / (toxic - F.col("t") + 0.5) / ((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    rows = seen.withColumn("odds", odds).where(F.col("odds") >= TERM_ODDS).orderBy(F.desc(F.log("odds") * F.col("t")), "term").limit(most).collect()
    return [(r["term"], float(np.log(r["odds"]))) for r in rows]


def learn_context(sample: DataFrame, lexicon: list[tuple[str, float]], most: int = CONTEXT_TERMS) -> list[tuple[str, float]]:
    """(word, log odds of toxic against clean documents) of words in the windows of matches; sample: text, label."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(lexicon, [])
        for batch in batches:
            for first, n in byte_slices(batch.column(1), SLICE_BYTES):
                labels = batch.column(0).slice(first, n).to_pylist()
                rows = [(w, label) for label, own in zip(labels, scanner.words_beside(batch.column(1).slice(first, n))) if own for w in [*own, ""]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows]), pa.array([label for _, label in rows], pa.int32())], ["word", "label"])

    seen = sample.select("label", "text").mapInArrow(run, "word string, label int").groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    seen = stash(seen, "contextwords")
    size = seen.where("word = ''").first()  # every text with a match
    if size is None or not size["t"] or not size["c"]:
        return []
    odds = F.log((F.col("t") + 0.5) / (size["t"] - F.col("t") + 0.5) / ((F.col("c") + 0.5) / (size["c"] - F.col("c") + 0.5)))
    rows = seen.where((F.col("word") != "") & (F.col("t") + F.col("c") >= CONTEXT_DOCUMENTS)).withColumn("odds", odds).orderBy(F.desc(F.abs("odds")), "word").limit(most).collect()
    return [(r["word"], float(r["odds"])) for r in rows]


def _featured(docs: DataFrame, lexicon: list[tuple[str, float]], context: list[tuple[str, float]], name: str, kind: str, model: gbt.Trees | None) -> DataFrame:
    """``name`` and the features of text, or with a model the score."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(lexicon, context)
        for batch in batches:
            for first, n in byte_slices(batch.column(1), SLICE_BYTES):
                own, x = batch.column(0).slice(first, n), scanner.features(batch.column(1).slice(first, n))
                if model is None:
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c) for c in x.T)], [name, *FEATURES])
                else:
                    score = model.score(x)
                    held = held_out_ids(own.to_pylist()) & np.asarray(own.is_valid())
                    yield pa.RecordBatch.from_arrays([own, pa.array(held), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [name, "held_out", "score", "predicted"])

    fields = ", ".join(f"{f} double" for f in FEATURES) if model is None else "held_out boolean, score double, predicted int"
    return docs.select(F.col(name).cast(kind), "text").mapInArrow(run, f"{name} {kind}, {fields}")


Model = tuple[list[tuple[str, float]], list[tuple[str, float]], gbt.Trees]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """(lexicon, context words, trees)"""
    sample = stash(labelled_sample(docs, labels, "toxic", rows).select("text", "label"), "toxicsample")
    lexicon = learn_lexicon(sample)
    context = learn_context(sample, lexicon) if lexicon else []
    got = _featured(sample, lexicon, context, "label", "int", None).toPandas()  # at most ``rows`` rows for each id
    if not len(got):
        return [], [], gbt.fit(np.zeros((1, len(FEATURES))), np.array([0.5]))
    return lexicon, context, gbt.fit(got[FEATURES].to_numpy(), got["label"].to_numpy(float), trees=40, depth=3)


def score(docs: DataFrame, lexicon: list[tuple[str, float]], context: list[tuple[str, float]], model: gbt.Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    return _featured(docs, lexicon, context, "doc_id", "long", model)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *fit(docs, table(spark, sf_dir, "labels")))
