"""Token counts of a SentencePiece merge model by a whole-token shortcut."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barloom.llm.pieces import SPACE, Vocabulary, vocabulary
from barloom.llm.tables import in_batches
from barloom.llm.texts import binary, flat, slices

#: Merged pre-tokens that a task remembers before it starts anew.
MEMORY = 200_000


class Counter:
    """Token counts of pre-tokens.

    Pre-tokens are cut where no piece of the vocabulary can cross (checked when the model is
    loaded): before a run of spaces, and around characters that stand in no longer piece. A
    line feed is such a character, so what follows one is encoded as if it stood in a text.
    """

    def __init__(self, path: str):
        self.vocab: Vocabulary = vocabulary(path)
        self.model = self.vocab.model
        if "\n" not in self.vocab.lone:
            raise ValueError("the line feed merges with other characters in this model")
        self.whole = pa.array(sorted(self._proven()), pa.large_binary())
        self.known: dict[bytes, int] = {}
        self.alone = np.zeros(256, bool)
        self.alone[[ord(c) for c in self.vocab.lone]] = True

    def _encode(self, strings: list[str]) -> list[list[int]]:
        """Ids of strings inside a text: without the space that starts one."""
        return [ids[2:] for ids in self.model.encode(["\n" + s for s in strings], num_threads=1)]

    def _proven(self) -> list[bytes]:
        """Vocabulary strings that encode alone as one token."""
        strings = [p.replace(SPACE, " ") for p in self.vocab.ids]
        return [s.encode() for s, ids in zip(strings, self._encode(strings)) if ids == [self.vocab.ids[s.replace(" ", SPACE)]]]

    def counts(self, texts: pa.Array) -> np.ndarray:
        data, at = flat(pc.replace_substring(texts, SPACE, " "))
        size = np.diff(at)
        if not len(data):
            return np.zeros(len(size), np.int64)
        # every text that is not empty begins with a space of its own
        full = size > 0
        data = np.insert(data, at[:-1][full], 32)
        at = at + np.concatenate([[0], np.cumsum(full)])
        space, lone = data == 32, self.alone[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1]
        cut[at[:-1][full]] = True
        first = np.flatnonzero(cut)
        coded = binary(np.concatenate([first, [len(data)]]), data).dictionary_encode()
        each = self._each(coded.dictionary)
        sums = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(sums[np.searchsorted(first, at)])

    def _each(self, different: pa.Array) -> np.ndarray:
        n = np.ones(len(different), np.int64)
        rest = np.flatnonzero(~pc.is_in(different, self.whole).to_numpy(zero_copy_only=False))
        strings = different.take(pa.array(rest)).to_pylist()
        new = [s for s in strings if s not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = strings
        self.known.update(zip(new, map(len, self._encode([s.decode() for s in new]))))
        n[rest] = [self.known[s] for s in strings]
        return n


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs, path: str, limit: int = 4096):
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, where it is read.

    Null counts as empty: no bytes, no tokens. Rows are kept one by one, whatever their
    doc_id; other columns are left aside.
    """

    def run(batches):
        count = counter(path)
        for whole in batches:
            for part in slices(whole):
                text = pc.fill_null(part.column("text"), "")
                n = count.counts(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
