"""Secrets in texts: three base patterns, and a linear-chain CRF that adds spans.

The CRF tags every token of a text as begin, inside or outside of a secret. It
sees a token's shape, the three tokens before it and the one after, whether white
space parts it from the one before, and features of the whole text. It is decoded
by Viterbi over the whole text: a bound shows for most tokens that the best path
has them outside, whatever their neighbours are; the runs of tokens that are left
are decoded exactly, at any length.

It is fitted on excerpts of a bounded sample of documents. Their labels are the
values of base matches, and, as those are all that a table without labels has,
copies of them: with words of other excerpts for their keys and marks, so that a
shape alone can carry a secret; with drawn values of other alphabets, letters
alone among them; and behind a key word without a mark. Excerpts round numbers,
addresses and mixed words that no pattern takes, and key words before plain words,
are outside. A span of its own that meets a base match is dropped.

Nulls, empties, repeats: a null or empty text has no spans; a null doc_id is kept;
repeated rows are scanned one by one; a very long text is one chain, tagged whole;
at ties Viterbi takes begin before inside before outside; a sample without matches
leaves the base alone; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import byte_slices, hash_sample, stash, table, texts_of, tidied

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: To see fast whether a text has a long run of hex digits at all.
_HEX_ONLY = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))

#: Fitting: documents read, excerpts kept (half of them with a value), steps, tokens to either side of a value.
SAMPLE_DOCUMENTS = 4_000
SAMPLE_EXCERPTS = 1_500
STEPS = 200
AROUND = 8
#: Text tagged at a time, and tokens and chunks a worker remembers before it starts afresh; bound memory only.
SLICE_BYTES = 4 << 20
MEMO = 600_000

_TOKEN = re.compile(r"[\w+/]+(?:[.-][\w+/]+)*|[^\s\w]")
_ODD = re.compile(r"(?=.*[0-9])[\w+/.-]{6,}|(?=.*[a-z])(?=.*[A-Z])\w{8,}")
B, I, O = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base matches, in the order of the digest."""
    out = []
    if "=" in text or ":" in text:  # an assignment needs one of them
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode().translate(_HEX_ONLY):
        out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]  # whole runs, as runs under 24 fail
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- features -----------------------------------------------------------------


_CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ]+")
_HEX_WORD = re.compile("[0-9a-fA-F]+")


def shape(token: str) -> list[str]:
    """Features of a token by itself."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return ["mark", f"mark={token}"]
    size = n if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 24 else 24
    case = "lower" if token.islower() else "title" if token.istitle() else "upper" if token.isupper() else "inner"
    consonants = min(7, max(map(len, _CONSONANTS.findall(token)), default=0))
    distinct = round(6 * len(set(token)) / n)
    out = ["word", f"length={size}", f"case={case},length={size}", f"distinct={distinct},length={size}", f"consonants={consonants}"]
    if not token.isascii():
        out.append("accents")
    if _HEX_WORD.fullmatch(token):
        out.append(f"hex,length={size}")
    if token.isalpha():
        return [*out, f"letters,{case},consonants={consonants},length={size}", f"letters,{case}"]
    digits = [c.isdigit() for c in token]
    turns = sum(map(int.__ne__, digits, digits[1:]))
    marks = "" if token.isalnum() else "".join(sorted(set(re.sub(r"\w", "", token))))
    return [*out, f"digits={math.ceil(6 * sum(digits) / n)},case={case}", f"turns={min(6, turns)},length={size}", f"marks={marks[:3]}"]


ROLES = ("own", "before1", "before2", "before3", "after")


def _kind(token: str) -> str:
    return "word" if token.isalpha() else "mark" if len(token) == 1 and not token.isalnum() else "digit" if any(map(str.isdigit, token)) else "word"


def role_features(token: str) -> list[list[str]]:
    """Features that a token gives itself, the tokens one, two and three places on, and the one before it."""
    kind, name = _kind(token), token.lower() if len(token) < 12 else "long"
    return [shape(token), *[[f"{role}:{kind}", f"{role}={name}"] for role in ROLES[1:4]], [f"after={name if kind == 'mark' else kind}"]]


_EDGE = [["edge"], ["before1=^"], ["before2=^"], ["before3=^"], ["after=^"]]


def file_features(text: str) -> list[str]:
    """How wide its lines are and how much of it is code-like marks."""
    if not text:
        return ["wide=0", "code=0"]
    lines, marks = text.count("\n") + 1, sum(text.count(c) for c in "={}[]();<>")
    return [f"wide={min(6, int(math.log2(1 + len(text) / lines / 40)))}", f"code={min(4, int(math.log2(1 + 200 * marks / len(text))))}"]


# --- model --------------------------------------------------------------------

_NEVER = -1e4


@dataclass(frozen=True)
class Crf:
    """weights: feature -> scores of begin, inside, outside; moves[from, to]. A chain starts from and ends in outside."""

    weights: dict[str, tuple[float, float, float]]
    moves: np.ndarray

    def score(self, features: list[str]) -> tuple[float, float, float]:
        x = y = z = 0.0
        for f in features:
            w = self.weights.get(f)
            if w is not None:
                x, y, z = x + w[0], y + w[1], z + w[2]
        return x, y, z

    def best_path(self, emit: np.ndarray) -> list[int]:
        """The best tags of a run between outside tokens, by Viterbi."""
        best, back = self.moves[O] + emit[0], []
        for e in emit[1:]:
            paths = best[:, None] + self.moves
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + e
        tags = [int((best + self.moves[:, O]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def open(self, emit: np.ndarray) -> np.ndarray:
        """Which tokens the best path may not have outside.

        Say a path has token t in a span. Take t out, and let the rest of the span
        begin anew. What that costs at most in moves and at t + 1 is bounded, so
        where outside leads by more, the path was not the best.
        """
        m = self.moves
        into = min(m[a, O] - m[a, b] for a in (B, I, O) for b in (B, I) if m[a, b] > _NEVER / 2)
        out_of = min([m[O, q] - m[b, q] for b in (B, I) for q in (B, O)] + [m[O, B] - m[b, I] for b in (B, I)])
        on = min(0.0, min(m[B, r] - m[I, r] for r in (B, I, O)))
        again = np.minimum(0, emit[1:, B] - emit[1:, I])
        lead = emit[:, O] - np.maximum(emit[:, B], emit[:, I]) + np.append(again, 0)
        return lead + into + out_of + on <= 1e-9

    def tags(self, emit: np.ndarray) -> np.ndarray:
        """The best tags of tokens, among which outside ones may be forced by their scores."""
        out = np.full(len(emit), O, np.int8)
        if not self.weights or not len(emit):
            return out
        at = np.flatnonzero(self.open(emit))
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            if len(run):
                out[run] = self.best_path(emit[run])
        return out


def fit_crf(sample: list[dict], steps: int = STEPS, rate: float = 0.5, ridge: float = 2e-4) -> Crf:
    """Maximum likelihood by Adagrad; sample: excerpts (tokens, glued, tags, file)."""
    if not any(B in x["tags"] for x in sample):
        return Crf({}, np.zeros((3, 3)))
    known = lru_cache(None)(role_features)
    longest, n = max(len(x["tags"]) for x in sample), len(sample)
    listed, gold, real = [], np.full((n, longest), O), np.zeros((n, longest), bool)
    for i, x in enumerate(sample):
        roles = [known(t) for t in x["tokens"]]
        for t, tag in enumerate(x["tags"]):
            mine = roles[t][0] + (roles[t + 1][4] if t + 1 < len(roles) else []) + x["file"] + (["glued"] if x["glued"][t] else [])
            for back in (1, 2, 3):
                mine = mine + (roles[t - back][back] if t >= back else [])
            listed.append((i * longest + t, mine))
            gold[i, t], real[i, t] = tag, True
    counts = Counter(f for _, mine in listed for f in mine)
    names = {f: k for k, f in enumerate(sorted(f for f, k in counts.items() if k >= 3))}
    pairs = [(at, names[f]) for at, mine in listed for f in mine if f in names]
    rows, cols = (np.array(c) for c in zip(*pairs))
    w, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[O, I] = _NEVER
    seen = [np.full_like(x, 1e-6) for x in (w, moves)]
    onehot = np.eye(3)[gold] * real[..., None]
    ends = real.sum(axis=1) - 1
    for _ in range(steps):
        emit = np.column_stack([np.bincount(rows, w[cols, k], n * longest) for k in range(3)]).reshape(n, longest, 3)
        step = moves + barred
        alpha, beta = np.empty_like(emit), np.zeros_like(emit)
        alpha[:, 0] = step[O] + emit[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.where(real[:, t, None], _lse(alpha[:, t - 1, :, None] + step, 1) + emit[:, t], alpha[:, t - 1])
        beta[:, longest - 1] = step[:, O]
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None], _lse(step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2), step[:, O])
        z = _lse(alpha[:, -1] + step[:, O], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * real[..., None]
        g_emit = (onehot - p).reshape(-1, 3)
        g_w = np.column_stack([np.bincount(cols, g_emit[rows, k], len(names)) for k in range(3)]) / n - ridge * w
        g_moves = np.zeros((3, 3))
        for t in range(1, longest):
            both = alpha[:, t - 1, :, None] + step + (emit[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            g_moves += (real[:, t, None, None] * (onehot[:, t - 1, :, None] * onehot[:, t, None, :] - np.exp(both))).sum(axis=0) / n
        g_moves[O] += (onehot[:, 0] - p[:, 0]).sum(axis=0) / n
        last = np.arange(n), ends
        g_moves[:, O] += (onehot[last] - p[last]).sum(axis=0) / n
        for x, g, s in zip((w, moves), (g_w, g_moves - ridge * moves), seen):
            s += g * g
            x += rate * g / np.sqrt(s)
    return Crf({f: tuple(w[i].tolist()) for f, i in names.items()}, moves + barred)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# --- fitting ------------------------------------------------------------------


def value_spans(text: str) -> list[tuple[int, int]]:
    """Where the base patterns have their values: an assignment's without its key."""
    values = [m.span(2) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    return values + [(a, b) for a, b, kind in base_spans(text) if kind != "assign"]


def excerpts(text: str) -> Iterator[dict]:
    """Tokens round each value, round odd tokens that are none, and at one place by the text's checksum."""
    found = [m.span() for m in _TOKEN.finditer(text)]
    if not found:
        return
    values, tags, inside = value_spans(text), [], False
    for a, b in found:
        hit = any(a < y and x < b for x, y in values)
        tags.append(I if hit and inside else B if hit else O)
        inside = hit
    tokens = [text[a:b] for a, b in found]
    glued = [int(i > 0 and found[i - 1][1] == a) for i, (a, _) in enumerate(found)]
    odd = [i for i, t in enumerate(tokens) if tags[i] == O and _ODD.fullmatch(t)]
    wanted = [(i, True) for i, t in enumerate(tags) if t == B] + [(i, False) for i in [*odd, zlib.crc32(text.encode()) % len(tokens)]]
    for i, hit in wanted:
        last = i + 1
        while last < len(tags) and tags[last] == I:
            last += 1
        cut = slice(max(0, i - AROUND), min(last + AROUND, i + 4 * AROUND))
        if hit or B not in tags[cut]:
            if I not in tags[cut][:1]:
                if sum(map(len, tokens[cut])) <= LONGEST_EXCERPT:
                    yield {"tokens": tokens[cut], "glued": glued[cut], "tags": tags[cut], "file": file_features(text), "hit": hit}


#: Characters of an excerpt; longer ones are left out of the fit.
LONGEST_EXCERPT = 1 << 14

#: Words that announce a secret: those of the base pattern, taken apart; what may stand between them and a value.
KEY_WORDS = [["password"], ["passwd"], ["secret"], ["token"], ["api", "key"], ["apikey"], ["api_key"], ["secret", "key"]]
LINKS = [[], ["is"], [":"], ["="], ["was"], ["is", ":"], ["=", '"'], [":", "'"]]


def drawn_value(rng: np.random.Generator) -> tuple[str, bool]:
    """A random secret, and whether only a key word before it can tell."""
    letters, lower, both = string.ascii_letters, string.ascii_lowercase, string.ascii_letters + string.digits
    of = lambda chars, a, b: "".join(rng.choice(list(chars), rng.integers(a, b)))
    styles = [
        lambda: (of("0123456789abcdef", 16, 48), False), lambda: (of("0123456789ABCDEF", 16, 48), False), lambda: (of(both, 16, 44), False), lambda: (of(both + "+/", 20, 44), False),
        lambda: (of(letters, 18, 40), False), lambda: (of(lower, 10, 32), True), lambda: (of(both, 8, 14), True), lambda: (of(lower, 4, 9) + of(string.digits, 1, 4), True),
        lambda: ("-".join(of("0123456789abcdef", n, n + 1) for n in (8, 4, 4, 4, 12)), False), lambda: (of(lower, 10, 32), True),
    ]
    return styles[rng.integers(len(styles))]()


def copies(sample: list[dict], seed: int = 0) -> list[dict]:
    """Excerpts that the base patterns cannot give: see the module's notes."""
    rng = np.random.default_rng(seed)
    said = sorted({t for x in sample for t, tag in zip(x["tokens"], x["tags"]) if tag == O and t.isalpha()})
    plain, long = [t for t in said if len(t) < 20] or ["word"], [t for t in said if len(t) >= 12]
    words = lambda n: [plain[i] for i in rng.integers(0, len(plain), n)]
    out = []

    def add(before: list[str], value: str | None, after: list[str], like: dict) -> None:
        own = [value] if value else []
        tokens = before + own + after
        glued = [int(i > 0 and tokens[i - 1] in "\"'") for i in range(len(tokens))]
        out.append({"tokens": tokens, "glued": glued, "tags": [O] * len(before) + [B] * len(own) + [O] * len(after), "file": like["file"]})

    def compound() -> str:
        """A long word as prose has them: one of the sample, words put together, or letters of one case without any key."""
        kind = rng.integers(3)
        if kind == 0 and long:
            return long[rng.integers(len(long))]
        if kind == 1:
            return "".join(words(rng.integers(2, 5))).lower()
        return "".join(rng.choice(list(string.ascii_lowercase), rng.integers(8, 36)))

    for x in sample:
        add(words(4), None, [w.title() if rng.random() < 0.2 else w for w in [compound()]] + words(3), x)
        key, link = KEY_WORDS[rng.integers(len(KEY_WORDS))], LINKS[rng.integers(len(LINKS))]
        key = [k.title() if rng.random() < 0.3 else k for k in key]
        if x["hit"]:
            at = x["tags"].index(B)
            add(words(AROUND), x["tokens"][at], words(3), x)
            value, needs_key = drawn_value(rng)
            add(words(4) + (key + link if needs_key else words(3)), value, words(3), x)
            for hidden in (False, True):  # the second is one that only the key tells
                value, needs_key = drawn_value(rng)
                while hidden and not needs_key:
                    value, needs_key = drawn_value(rng)
                add(words(rng.integers(0, 5)) + key + link, value, (["'"] if link[-1:] == ["'"] else ['"'] if link[-1:] == ['"'] else []) + words(3), x)
        else:
            add(words(4) + key + (link if rng.random() < 0.5 else []), None, words(5), x)
    return out


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, kept: int = SAMPLE_EXCERPTS) -> Crf:
    """From a bounded sample of documents, picked by a hash of their ids."""
    picked = hash_sample(docs.select("doc_id").where("doc_id is not null").distinct(), documents, "doc_id")
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``documents`` ids

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(json.dumps(x), x["hit"]) for text in texts_of(batch.column(1)) for x in excerpts(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["excerpt", "hit"])

    found = stash(sample.mapInArrow(run, "excerpt string, hit boolean").distinct(), "excerpts")
    # a bounded number of either kind, chosen by hash
    got = [r["excerpt"] for hit in ("hit", "not hit") for r in hash_sample(found.where(hit), kept // 2, "excerpt").select("excerpt").collect()]
    chosen = [json.loads(x) for x in sorted(got)]
    return fit_crf(chosen + copies(chosen)) if any(x["hit"] for x in chosen) else Crf({}, np.zeros((3, 3)))


# --- scanning -----------------------------------------------------------------


@dataclass
class Tagger:
    """Tags of texts by one model; remembers tokens and chunks within a worker."""

    model: Crf
    known: dict[str, int] = field(default_factory=dict)
    chunks: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        #: all other names have no weight beside another token
        self.names = {f.split("=", 1)[1] for f in self.model.weights if f.startswith(("before", "after=")) and "=" in f}
        self.clear()

    def clear(self) -> None:
        self.known, self.chunks = {}, {}
        self.rows = np.zeros((1024, len(ROLES), 3), np.float32)
        self.rows[0] = [self.model.score(f) for f in _EDGE]
        self.rows[0, 0] = (_NEVER, _NEVER, 0)  # an edge is outside
        self.used = 1
        self.glued = np.array(self.model.score(["glued"]), np.float32)
        self.beside: dict[tuple[str, str], list[tuple[float, float, float]]] = {}

    def _token(self, token: str) -> int:
        if token not in self.known:
            if self.used == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            kind, name = _kind(token), token.lower() if len(token) < 12 else "long"
            name = name if name in self.names else ""
            if (kind, name) not in self.beside:
                self.beside[kind, name] = [self.model.score(f) for f in role_features(token)[1:]]
            self.rows[self.used] = [self.model.score(shape(token)), *self.beside[kind, name]]
            self.known[token] = self.used
            self.used += 1
        return self.known[token]

    def _chunk(self, chunk: str) -> np.ndarray:
        if chunk not in self.chunks:
            self.chunks[chunk] = np.array([self._token(t) for t in _TOKEN.findall(chunk)], np.int32)
        return self.chunks[chunk]

    def tags(self, texts: pa.Array) -> list[np.ndarray]:
        """The tags of every text's tokens."""
        if len(self.known) + len(self.chunks) > MEMO:
            self.clear()
        lists = pc.ascii_split_whitespace(texts)
        encoded = lists.flatten().dictionary_encode()
        parts = [self._chunk(c) for c in encoded.dictionary.to_pylist()]
        sizes = np.array([len(p) for p in parts], np.int64)
        index = np.asarray(encoded.indices)
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends = ends - ends[0]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts = np.cumsum(sizes) - sizes
        count = sizes[index]
        at = np.cumsum(count)
        total = int(at[-1]) if len(at) else 0
        own = flat[np.repeat(starts[index] - at + count, count) + np.arange(total)]
        first = np.zeros(total, bool)
        first[(at - count)[count > 0]] = True
        text_ends = np.concatenate(([0], at))[ends]
        # three edges before each text, and after the last
        n = len(texts)
        where = np.arange(total) + 3 * (np.repeat(np.arange(n), np.diff(text_ends)) + 1)
        ids, glued = np.zeros(total + 3 * (n + 1), np.int32), np.zeros(total + 3 * (n + 1), np.float32)
        ids[where], glued[where] = own, ~first
        files = np.array([self.model.score(file_features(t)) for t in texts.to_pylist()], np.float32).reshape(n, 3)
        emit = self.rows[ids, 0] + glued[:, None] * self.glued
        for back in (1, 2, 3):
            emit[back:] += self.rows[ids[:-back], back]
        emit[:-1] += self.rows[ids[1:], 4]
        emit[where] += np.repeat(files, np.diff(text_ends), axis=0)
        tags = self.model.tags(emit)[where]
        return np.split(tags, text_ends[1:-1])


_TAGGERS: dict[int, Tagger] = {}


def _tagger(model: Crf) -> Tagger:
    """One for each worker process, as long as the model stays."""
    key = hash((tuple(model.weights.items()), model.moves.tobytes()))
    if key not in _TAGGERS:
        _TAGGERS.clear()
        _TAGGERS[key] = Tagger(model)
    return _TAGGERS[key]


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The model's spans that meet no base match."""
    if not (tags == B).any():
        return []
    places, out, k = [m.span() for m in _TOKEN.finditer(text)], [], 0
    for k in np.flatnonzero(tags == B).tolist():
        last = k
        while last + 1 < len(tags) and tags[last + 1] == I:
            last += 1
        a, b = places[k][0], places[last][1]
        if not any(a < y and x < b for x, y, _ in base):
            out.append((a, b, "crf"))
    return out


def spans_of(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, str]]]:
    """All spans of every text: the model's own have kind ``crf``."""
    order = (*KINDS, "crf").index
    tags = tagger.tags(pa.array(texts, pa.string())) if tagger.model.weights else [np.zeros(0, np.int8)] * len(texts)
    out = []
    for text, own in zip(texts, tags):
        base = base_spans(text)
        out.append(sorted(base + added_spans(text, own, base), key=lambda s: (s[0], order(s[2]))))
    return out


def scan(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, found array<struct<kind, start, end>> for every row; kind ``crf`` marks the model's own."""

    @tidied

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        tagger = _tagger(model)
        for batch in batches:
            for first, n in byte_slices(batch.column(1), SLICE_BYTES):
                own = texts_of(batch.column(1).slice(first, n))
                found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in spans_of(own, tagger)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, found array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of scan()."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(scan(docs, fit(docs)))
