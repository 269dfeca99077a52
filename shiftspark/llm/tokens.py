"""Token ids of whole texts by the ``tokenizers`` library, a batch at a time.

The word-level vocabulary used here drops white space and never joins across
it, so the ids of a text are the ids of its white-space separated chunks in
order. Each batch is split and dictionary-encoded by Arrow; only chunks that
the worker has not seen go to the library, and NumPy gathers the rest.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shiftspark.llm.common import cpus_quiet

DEFAULT_VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Chunks a worker remembers before it starts afresh; bounds memory only.
MEMO_ENTRIES = 300_000
#: Text encoded at a time: the more, the more often a chunk repeats within it.
SLICE_BYTES = 8 << 20

#: A run of these letters, whose lower case is one letter each, then only these
#: marks: the library splits such a chunk exactly between the two.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTER_LIST = "".join(c for c in map(chr, range(65, 256)) if c.isalpha() and c not in "ªµº")
_MARKS = "-.,;:!?#$%&*()|+=/[]{}_~@^"
_JOIN = 64


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of chunks, remembered as ranges of one flat array."""

    def __init__(self, path: str):
        cpus_quiet()
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.ends_word = np.zeros(size, bool)
        for token, i in self.tok.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {"": 0}
        self.flat, self.start, self.count = array("I"), array("q", [0]), array("i", [0])

    def _add(self, chunk: str, ids) -> int:
        self.start.append(len(self.flat))
        self.count.append(len(ids))
        self.flat.extend(ids)
        self.seen[chunk] = len(self.start) - 1
        return self.seen[chunk]

    def _one_by_one(self, chunks: list[str]) -> None:
        for chunk, e in zip(chunks, self.tok.encode_batch_fast(chunks, add_special_tokens=False)):
            self._add(chunk, e.ids)

    def _learn(self, letters: list[str], other: list[str]) -> None:
        """letters: chunks that are one word each, so many fit in one call."""
        groups = [letters[i : i + _JOIN] for i in range(0, len(letters), _JOIN)]
        encoded = self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                self._one_by_one(group)
                continue
            a, ids = 0, ids.tolist()
            for word, b in zip(group, ends.tolist()):
                self._add(word, ids[a:b])
                a = b
        self._one_by_one(other)

    def _index(self, words: list[str], simple: np.ndarray | None) -> np.ndarray:
        get = self.seen.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = {words[i]: simple is not None and bool(simple[i]) for i in new}
            self._learn([w for w, plain in fresh.items() if plain], [w for w, plain in fresh.items() if not plain])
            at[new] = [self.seen[words[i]] for i in new]
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each text); a null is an empty text."""
        if len(self.seen) > MEMO_ENTRIES:
            self.clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = np.diff(np.asarray(lists.offsets).astype(np.int64))
        encoded = lists.flatten().dictionary_encode()
        chunks = encoded.dictionary
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        words, marks, simple = self._split(chunks)
        pair = np.empty(2 * len(words), np.int64)
        pair[0::2] = self._index(words, simple)
        kinds = marks.dictionary_encode()
        pair[1::2] = self._index(kinds.dictionary.to_pylist(), None)[np.asarray(kinds.indices)]
        start, count = np.frombuffer(self.start, np.int64), np.frombuffer(self.count, np.int32).astype(np.int64)
        distinct = _gather(np.frombuffer(self.flat, np.uint32), start[pair], count[pair])
        size = count[pair].reshape(-1, 2).sum(axis=1)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        index = np.asarray(encoded.indices)
        sizes = size[index]
        flat = _gather(distinct, first[index], sizes)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        text_ends = np.concatenate(([0], np.cumsum(per_text)))
        return flat, np.diff(ends[text_ends])

    @staticmethod
    def _split(chunks: pa.Array) -> tuple[list[str], list[str], np.ndarray]:
        """Words, their trailing marks, and which chunks were split that way."""
        core = pc.utf8_rtrim(chunks, _MARKS)
        simple = pc.match_substring_regex(core, f"^[{_LETTERS}]+$")
        marks = pc.if_else(simple, pc.utf8_ltrim(chunks, _LETTER_LIST), "")
        words = pc.if_else(simple, pc.utf8_lower(core), chunks)
        return words.to_pylist(), marks, np.asarray(simple)


def _gather(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] for every i, end to end."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    at = np.repeat((start - ends + count).astype(kind), count)
    at += np.arange(total, dtype=kind)
    return values[at]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
