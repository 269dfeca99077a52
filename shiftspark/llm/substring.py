"""Removal of passages of words that stand earlier in the corpus, found by anchors at fixed blocks.

A window is ``window`` consecutive words of one document. A word goes if a window
covers it whose words also start earlier: in a document of smaller doc_id, or
earlier in its own. What goes is so the union of all maximal exact repeats of at
least ``window`` words, without their first place.

1. Documents are put into packs of some MB, one compressed row each.
2. Every pack gives its anchors: the digests of the reference blocks (words 0-9,
   10-19, ... of each document; any 20 words hold a whole one) and of every rolling
   10-word window that probes them, each digest once a pack. They are dealt by ranges of the
   digest; a digest that is a reference block somewhere and stands twice is a hit.
3. Documents whose whole words stand in an earlier document go as they are, and send no windows.
4. A hit is extended word by word, both ways: the windows around it, by 96-bit
   digests of their words, meet the first document that holds them. Windows that are
   not first go back to their pack, and neighbours among them join to maximal repeats.

A passage of k places costs k digests a word at most (one a pack in fact), never pairs of places.
Digests are grouped within tasks whose number follows the number of words.

Rows: a null or empty text has no words. A null doc_id counts as the largest id.
Rows that share a doc_id are ordered by a digest of their texts, and rows that repeat both
are one document, so each gets that document's result. A very long text is one pack. Equal
windows (ties) are ordered by place. Other columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftspark.llm.common import byte_slices, stash, table, tidied

WINDOW = 20
#: Digests of anchors, and of windows, that one task groups on average.
TASK_DIGESTS = 1_000_000
#: Digests that a task gathers before it deals them out.
FLUSH = 2_000_000
#: Words whose digests a worker remembers.
KNOWN_WORDS = 400_000
#: Bytes of a text whose words are split at a time.
PIECE = 4 << 20
#: The place of a null doc_id in the order of documents.
NO_ID = np.iinfo(np.int64).max

_SPACES = b" \t\n\r\x0b\x0c"
# odd multipliers of the rolling digests: fixed values, any large odd numbers do
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_KNOWN = _Digests()


def word_digests(text: bytes) -> np.ndarray:
    """The 64-bit digest of each word; bytes.split parts at exactly the six blanks of a word's pattern."""
    parts, first = [], 0
    while first < len(text):
        last = first + PIECE
        while last < len(text) and text[last] not in _SPACES:
            last += 1
        words = text[first:last].split()
        parts.append(np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words)))
        first = last
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread what differs over all bits (the finalizer of public 64-bit hash functions)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(words: np.ndarray, size: int, by: int) -> np.ndarray:
    """A digest of every ``size`` consecutive words, put together from runs of 1, 2, 4, ... words."""
    n = max(0, len(words) - size + 1)
    out, done, run, span = np.zeros(n, np.uint64), 0, words, 1
    while done < size and n:
        if size & span:
            out += run[done : done + n] * np.uint64(pow(by, done, 1 << 64))
            done += span
        run = run[:-span] + run[span:] * np.uint64(pow(by, span, 1 << 64))
        span *= 2
    return mixed(out)


# --- Packs ------------------------------------------------------------------------


def packs(docs: DataFrame) -> DataFrame:
    """(pack, words, head, docs): documents of some MB of text a row, as a compressed Arrow stream of doc_id and text.

    head tells of each row its id (NO_ID for null), if that is null, a digest of its text, two of its words, and their number.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in byte_slices(batch.column(1)):
                part = batch.slice(first, n)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                head = np.zeros((n, 6), np.uint64)
                for row, (i, text) in enumerate(zip(part.column(0).to_pylist(), _texts(part))):
                    words = text.split()
                    whole = xxhash.xxh3_128_intdigest(b" ".join(words))
                    head[row] = (NO_ID if i is None else i) % (1 << 64), i is None, xxhash.xxh3_64_intdigest(text, seed=1), whole >> 64, whole % (1 << 32), len(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([secrets.randbits(63)]), pa.array([int(head[:, 5].sum())]), pa.array([head.tobytes()], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    ["pack", "words", "head", "docs"],
                )

    return stash(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "pack long, words long, head binary, docs binary"), "packs")


def _texts(part) -> list[bytes]:
    return [b"" if t is None else t for t in part.column(1).cast(pa.binary()).to_pylist()]


class Head:
    """The different documents of a pack in their order: ids, marks of texts, digests and numbers of words."""

    def __init__(self, head: bytes):
        rows = np.frombuffer(head, np.uint64).reshape(-1, 6)
        ids, marks = rows[:, 0].view(np.int64), rows[:, 2]
        order = np.lexsort((marks, ids))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])
        self.nulls = rows[:, 1] > 0
        self.place = np.empty(len(order), np.int64)  # each row's document
        self.place[order] = np.cumsum(fresh) - 1
        self.rows = order[fresh]  # one row of each document
        self.ids, self.marks, self.whole, self.second = ids[self.rows], marks[self.rows], rows[self.rows, 3], rows[self.rows, 4].astype(np.uint32)
        self.sizes = rows[self.rows, 5].astype(np.int64)

    def copies(self, told, least: int) -> np.ndarray:
        """Documents of ``least`` words whose whole words an earlier document has, in this pack or as ``told`` of others."""
        own = np.flatnonzero(self.sizes >= least)
        later = np.ones(len(own), bool)
        later[np.unique(self.whole[own], return_index=True)[1]] = False
        return own[later | np.isin(self.whole[own], _merged(told))]


class Pack(Head):
    """With the texts, and the digests of all words one after the other."""

    def __init__(self, head: bytes, docs: bytes):
        super().__init__(head)
        self.texts = _texts(pa.ipc.open_stream(docs).read_all().combine_chunks())
        words = [word_digests(self.texts[i]) for i in self.rows]
        self.ends = np.cumsum(self.sizes)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(words)), self.sizes)

    def starts(self, size: int, least: int) -> np.ndarray:
        """Where windows of ``size`` words start within the pack's words, in documents of ``least`` words."""
        at = np.arange(max(0, len(self.words) - size + 1))
        return at[(at + size <= self.ends[self.doc[at]]) & (self.sizes[self.doc[at]] >= least)]


# --- Dealing digests out ------------------------------------------------------------


def _placed(digest: np.ndarray, buckets: int) -> np.ndarray:
    """A digest's bucket (of its range) and the 30 bits that follow within the range, as one number in the digests' order."""
    high = (digest >> np.uint64(32)) * np.uint64(buckets)
    low = (digest & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)
    return (high + low) >> np.uint64(2)


def _bucket(digest: np.ndarray, buckets: int) -> np.ndarray:
    return (_placed(digest, buckets) >> np.uint64(30)).astype(np.int64)


def _steps(values: np.ndarray) -> bytes:
    """Rising 32-bit numbers as their steps, byte by byte: upper bytes are mostly zero, which the shuffle compresses."""
    return np.diff(values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _stepped(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def _by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edges, np.append(edges[1:], len(bucket))):
        yield int(bucket[a]), *(c[a:b] for c in columns)


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for first in range(0, len(rows), 256):
        cut = list(zip(*rows[first : first + 256]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cut, schema.types)], schema=schema)


_DEALT = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("which", pa.binary()), ("digests", pa.binary())])


def _anchors(packed: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, names, which, digests): 30 bits of each digest, then "is a block" and "stands twice in its pack"."""
    block = (window + 1) // 2

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = [], [], 0

        def flushed():
            which = np.repeat(np.arange(len(names), dtype=np.uint32), [len(c) for c in held])
            codes, own, rows = np.concatenate(held), np.array(names, np.int64), []
            for bucket, w, c in _by_bucket((codes >> np.uint64(32)).astype(np.int64), which, codes.astype(np.uint32)):
                used, counts = np.unique(w, return_counts=True)
                steps = b"".join(_steps(c[end - size : end]) for size, end in zip(counts, np.cumsum(counts)))
                rows.append((bucket, own[used].tobytes(), counts.astype(np.uint32).tobytes(), steps))
            return _rows(rows, _DEALT)

        for batch in batches:
            for pack, head, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                p = Pack(head.as_py(), blob.as_py())
                at = p.starts(block, window)
                placed = _placed(rolled(p.words, block, _FIRST)[at], buckets)
                is_block = (at - (p.ends - p.sizes)[p.doc[at]]) % block == 0
                order = np.argsort(placed)
                placed, is_block = placed[order], is_block[order]
                edges = np.flatnonzero(np.diff(placed, prepend=~placed[:1]))
                if not len(edges):
                    continue
                flags = np.maximum.reduceat(is_block.astype(np.uint64), edges) * np.uint64(2) + (np.diff(edges, append=len(placed)) > 1).astype(np.uint64)
                names.append(pack)
                held.append(placed[edges] << np.uint64(2) | flags)
                n += len(edges)
                if n >= FLUSH:
                    yield from flushed()
                    names, held, n = [], [], 0
        if held:
            yield from flushed()

    return packed.select("pack", "head", "docs").mapInArrow(run, "bucket int, names binary, which binary, digests binary")


def _hits(anchors: DataFrame, tasks: int) -> DataFrame:
    """(pack, hits): codes (bucket, 30 bits) of the digests of a pack that are a block somewhere and stand twice."""
    schema = pa.schema([("pack", pa.int64()), ("hits", pa.binary())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, packs_ = [], []
        for batch in batches:
            for bucket, names, which, digests in zip(*(c.to_pylist() for c in batch.columns)):
                counts, first = np.frombuffer(which, np.uint32), 0
                for size in counts.tolist():
                    codes.append(_stepped(digests[4 * first : 4 * (first + size)]).astype(np.uint64) | np.uint64(bucket << 32))
                    first += size
                packs_.append(np.repeat(np.frombuffer(names, np.int64), counts))
        if not codes:
            return
        code, pack = np.concatenate(codes), np.concatenate(packs_)
        del codes, packs_
        order = np.argsort(code)  # equal digests differ in their two flags alone
        code, pack = code[order], pack[order]
        digest = code >> np.uint64(2)
        edges = np.flatnonzero(np.diff(digest, prepend=~digest[:1]))
        counts = np.diff(edges, append=len(digest))
        flags = np.bitwise_or.reduceat(code & np.uint64(3), edges)
        hit = np.repeat((flags & np.uint64(2) > 0) & ((flags & np.uint64(1) > 0) | (counts > 1)), counts)
        digest, pack = digest[hit], pack[hit]
        yield from _rows([(p, d.tobytes()) for p, d in _by_bucket(pack, digest)], schema)

    return anchors.repartition(tasks, "bucket").mapInArrow(run, "pack long, hits binary")


def _merged(blobs, kind=np.uint64) -> np.ndarray:
    found = [np.frombuffer(b, kind) for b in blobs or ()]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _named_rows(digest, second, doc, own, buckets) -> Iterator[pa.RecordBatch]:
    """Rows of (bucket, names, which, digests) for digests and the documents (rows of ``own``: pack, id, mark) that hold them."""
    rows = []
    for bucket, g, s, d in _by_bucket(_bucket(digest, buckets), digest, second, doc):
        used, w = np.unique(d, return_inverse=True)
        rows.append((bucket, own[used].tobytes(), w.astype(np.uint32).tobytes(), g.tobytes() + s.tobytes()))
    return _rows(rows, _DEALT)


def _documents(pack: int, p: Head) -> np.ndarray:
    return np.stack([np.full(len(p.ids), pack), p.ids, p.marks.view(np.int64)], axis=1)


def _wholes(packed: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, names, which, digests): whole documents, each once a pack, with the pack's first document of those words."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = Head(head)
                own = np.flatnonzero(p.sizes >= window)
                own = own[np.unique(p.whole[own], return_index=True)[1]]
                yield from _named_rows(p.whole[own], p.second[own], own, _documents(pack, p), buckets)

    return packed.select("pack", "head").mapInArrow(run, "bucket int, names binary, which binary, digests binary")


def _extended(dealt: DataFrame, window: int, buckets: int) -> DataFrame:
    """(bucket, names, which, digests): windows around hits, each once a pack, with the pack's first document that holds it."""
    block = (window + 1) // 2

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, docs, n = [], [], 0, 0

        def flushed():
            return _named_rows(*(np.concatenate(x) for x in zip(*held)), np.concatenate(names), buckets)

        for batch in batches:
            for pack, head, blob, hit_lists, copies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                p, hit = Pack(head.as_py(), blob.as_py()), np.unique(_merged(hit_lists))
                anchor = np.zeros(len(p.words) + 1, np.int64)
                starts = p.starts(block, window)
                anchor[starts + 1] = np.isin(_placed(rolled(p.words, block, _FIRST)[starts], buckets), hit)
                sums = np.cumsum(anchor)
                at = p.starts(window, window)
                at = at[sums[at + window - block + 1] > sums[at]]
                at = at[~np.isin(p.doc[at], p.copies(copies, window))]
                digest, first = np.unique(rolled(p.words, window, _FIRST)[at], return_index=True)  # the first place in the pack
                at = at[first]
                if not len(at):
                    continue
                held.append((digest, rolled(p.words, window, _SECOND)[at].astype(np.uint32), p.doc[at] + docs))
                names.append(_documents(pack, p))
                docs, n = docs + len(p.ids), n + len(at)
                if n >= FLUSH // 2:
                    yield from flushed()
                    names, held, docs, n = [], [], 0, 0
        if held:
            yield from flushed()

    return dealt.select("pack", "head", "docs", "hits", "copies").mapInArrow(run, "bucket int, names binary, which binary, digests binary")


def _later(windows: DataFrame, tasks: int) -> DataFrame:
    """(pack, later): digests of a pack's windows that a document before holds."""
    schema = pa.schema([("pack", pa.int64()), ("later", pa.binary())])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for names, which, digests in zip(*(c.to_pylist() for c in batch.columns[1:])):
                name, w = np.frombuffer(names, np.int64).reshape(-1, 3), np.frombuffer(which, np.uint32)
                parts.append((np.frombuffer(digests, np.uint64, len(w)), np.frombuffer(digests, np.uint32, len(w), 8 * len(w)), *name[w].T))
        if not parts:
            return
        digest, second, pack, ids, marks = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((marks.view(np.uint64), ids, second, digest))
        digest, second, pack, ids, marks = (c[order] for c in (digest, second, pack, ids, marks))
        fresh = np.ones(len(digest), bool)
        fresh[1:] = (digest[1:] != digest[:-1]) | (second[1:] != second[:-1])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = (ids != ids[first]) | (marks != marks[first])
        yield from _rows([(p, d.tobytes()) for p, d in _by_bucket(pack[later], digest[later])], schema)

    return windows.repartition(tasks, "bucket").mapInArrow(run, "pack long, later binary")


def repeated_passages(docs: DataFrame, window: int = WINDOW, task_digests: int = TASK_DIGESTS) -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end in words: maximal repeats), kept (the words left, joined by blanks): a row for every row of docs."""
    if window < 2:
        raise ValueError("a window has two words or more")
    packed = packs(docs).where("pack is not null")
    words = packed.agg(F.sum("words")).first()[0] or 0
    tasks = max(1, -(-words // task_digests))
    by_pack = lambda found, name: found.groupBy("pack").agg(F.collect_list("later" if name != "hits" else name).alias(name))
    hits = by_pack(_hits(_anchors(packed, window, tasks), tasks), "hits")
    copies = by_pack(_later(_wholes(packed, window, tasks), tasks), "copies")
    known = stash(hits.join(copies, "pack", "full"), "known")
    # both joins read the texts as dealt here, so they are shuffled once
    dealt = packed.select("pack", "head", "docs").repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks), "pack")
    later = by_pack(_later(_extended(dealt.join(known, "pack"), window, tasks), tasks), "later")
    joined = dealt.join(known.select("pack", "copies").join(later, "pack", "left"), "pack", "left").select("head", "docs", "copies", "later")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for head, blob, copies, lists in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p = Pack(head.as_py(), blob.as_py())
                at = p.starts(window, window)
                digest = rolled(p.words, window, _FIRST)[at]
                gone = np.ones(len(digest), bool)
                gone[np.unique(digest, return_index=True)[1]] = False  # the first place within the pack
                gone |= np.isin(digest, _merged(lists)) | np.isin(p.doc[at], p.copies(copies, window))
                cover = np.zeros(len(p.words) + 1, np.int64)
                cover[: len(cover) - window] += np.bincount(at[gone], minlength=max(0, len(cover) - window)) if len(cover) > window else 0
                cover[window:] -= np.bincount(at[gone] + window, minlength=len(cover))[window:] if len(cover) > window else 0
                covered = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)
                found, kept = [], []
                for i, row in enumerate(p.rows):
                    a, b = p.ends[i] - p.sizes[i], p.ends[i]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered[a + 1 : b + 1], [0]])))
                    found.append(edges.reshape(-1, 2).tolist())
                    kept.append(_kept(p.texts[row], found[-1]))
                for first in range(0, len(p.place), 1024):
                    cut = p.place[first : first + 1024]
                    ids = [None if x else int(p.ids[i]) for i, x in zip(cut, p.nulls[first : first + 1024])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids, pa.int64()), pa.array(p.sizes[cut]), pa.array([sum(b - a for a, b in found[i]) for i in cut], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in found[i]] for i in cut], spans_type), pa.array([kept[i] for i in cut], pa.string()),
                    ], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def _kept(text: bytes, spans: list[tuple[int, int]]) -> str:
    words = text.split()
    out, first = [], 0
    for a, b in spans:
        out.extend(words[first:a])
        first = b
    return b" ".join(out + words[first:]).decode()


_NEXT = " || ' ' || ".join(f"lead(word, {j}) OVER o" for j in range(WINDOW))

OP11_SQL = rf"""
WITH words AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
windows AS (SELECT doc_id, i, {_NEXT} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i FROM windows WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM later),
kept AS (SELECT w.doc_id, count(*) AS n, count(*) FILTER (g.i IS NULL) AS k, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS text
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n - k, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
