"""SentencePiece merge vocabularies: what the model file gives, cuts that no merge crosses,
seeded merge-dropout encoding, lossless decoding."""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from barloom.llm.tables import in_batches
from barloom.llm.texts import Rolling, binary, flat, mix, slices

SPACE = "▁"
#: Pre-tokens longer than this many symbols are merged with a heap, not in rounds.
LONG = 64
#: Characters of a long text that are worked at a time.
PART_CHARS = 1 << 20
_NONE = np.int32(2**31 - 1)


@cache
def vocabulary(path: str) -> "Vocabulary":
    return Vocabulary(path)


class Vocabulary:
    """A merge-type model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if sp.is_byte(i)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.byte_ids = np.array(byte)
        self.ids = {self.pieces[i]: i for i in plain}
        #: Best score first: candidates are merged in this order.
        self.rank = np.full(n, _NONE, np.int32)
        self.by_rank = np.array(sorted(plain, key=lambda i: (-sp.get_score(i), i)), np.int32)
        self.rank[self.by_rank] = np.arange(len(plain))

        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self._pair_table()
        #: Characters that stand in no longer piece: nothing merges with them.
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.lone = [c for c in map(chr, range(128)) if c not in inside and c != " "]
        if any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError("a piece has a space after another character, so words are not apart")
        #: Bytes of each id, for decoding.
        raw = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for k, i in enumerate(byte):
            raw[i] = bytes([k])
        self.bytes = pa.array(raw, pa.large_binary())

    def _pair_table(self) -> None:
        """Open hash table of all (left, right) whose joined string is a piece."""
        left, right, to = [], [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        bits = max(4, int(np.ceil(np.log2(len(keys) + 1))) + 2)
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.to = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at = self._slot(keys)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[todo]] == keys[todo]
            self.to[at[todo[won]]] = np.array(to, np.int32)[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(Rolling.BASE)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the piece that two neighbours make, or -1."""
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 32 | right[todo].astype(np.int64)
        at = self._slot(keys)
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.to[at[hit]]
            on = (found >= 0) & ~hit
            if not on.any():
                break
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


class Dropout:
    """Whether a candidate merge is skipped: a keyed hash of the seed, the text's key, the
    place of the left symbol in the text and both symbols, below a share of 2**64."""

    def __init__(self, share: float, seed: int):
        if not 0 <= share <= 1:
            raise ValueError("share of skipped merges must lie in 0 to 1")
        self.share, self.seed = share, np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
        self.below = np.uint64(min(int(share * 2.0**64), 2**64 - 1))

    def keys(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.astype(np.uint64) ^ mix(np.full(1, self.seed, np.uint64)))

    def skips(self, key, place, left, right) -> np.ndarray:
        if self.share == 0:
            return np.zeros(len(left), bool)
        pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        drawn = mix(key ^ mix(pair ^ place.astype(np.uint64) * np.uint64(Rolling.BASE)))
        return drawn < self.below if self.share < 1 else np.ones(len(left), bool)


def spans(text: str, limit: int) -> list[tuple[int, int]]:
    """Parts of a text, about ``limit`` characters each, cut before a space that follows no other:
    no merge crosses such a cut. A longer run without one is a part of its own."""
    out, first = [], 0
    while first < len(text):
        at = text.find(" ", first + limit)
        while at > 0 and text[at - 1] == " ":
            while at < len(text) and text[at] == " ":
                at += 1
            at = text.find(" ", at)
        stop = at if at > 0 else len(text)
        out.append((first, stop))
        first = stop
    return out


def encode(vocab: Vocabulary, texts: pa.Array, keys: np.ndarray, dropout: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each has. Without dropout these are the
    library's, but for a literal U+2581, which is written as bytes so that it decodes. A long text is
    worked in parts, each with the places that it has in the whole."""
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_buffer()) > PART_CHARS:
        text = texts[0].as_py()
        parts = [_encode(vocab, [text[a:b]], keys, dropout, a)[0] for a, b in spans(text, PART_CHARS)]
        return np.concatenate(parts), np.array([sum(map(len, parts))], np.int64)
    return _encode(vocab, texts.cast(pa.large_string()).to_pylist(), keys, dropout)


def _encode(vocab: Vocabulary, many: list[str], keys: np.ndarray, dropout: Dropout, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``start`` is where in its text a part begins; only the first has a space put before it."""
    many = [s if start or not s else " " + s for s in many]
    size = np.fromiter(map(len, many), np.int64, len(many))
    chars = np.frombuffer("".join(many).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    n = len(chars)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(many), np.int64)
    heads = np.concatenate([[0], np.cumsum(size)])
    text_of = np.repeat(np.arange(len(many)), size)
    sym = np.where(chars == 32, vocab.char[ord(SPACE)], vocab.char[chars])
    sym[chars == ord(SPACE)] = -1
    # cuts that no merge crosses
    space = chars == 32
    alone = np.zeros(128, bool)
    alone[[ord(c) for c in vocab.lone]] = True
    lone = (chars < 128) & alone[np.minimum(chars, 127)]
    cut = np.zeros(n, bool)
    cut[1:] = (space[1:] & ~space[:-1]) | lone[1:] | lone[:-1]
    cut[heads[:-1][size > 0]] = True
    seg = np.cumsum(cut) - 1
    place = np.arange(n) - heads[text_of] + (start + 1 if start else 0)
    key = dropout.keys(keys)[text_of]

    done_at, done_sym = [], []
    length = np.bincount(seg)
    if (length > LONG).any():
        first = np.flatnonzero(cut)
        for s in np.flatnonzero(length > LONG):
            part = slice(first[s], first[s] + length[s])
            at, got = _agenda(vocab, sym[part], place[part], key[part.start], dropout)
            done_at.append(at + part.start)
            done_sym.append(got)
        live = np.flatnonzero(length[seg] <= LONG)
    else:
        live = np.arange(n)
    at, got = _rounds(vocab, sym, seg, place, key, live, dropout)
    done_at.append(at)
    done_sym.append(got)
    at, got = np.concatenate(done_at), np.concatenate(done_sym)
    out = np.full(n, -2, np.int32)
    out[at] = got
    at = np.flatnonzero(out > -2)
    got = out[at]
    return _with_bytes(vocab, got, chars[at], text_of[at], len(many))


def _with_bytes(vocab, got, chars, text_of, n_texts):
    """Symbols that are no piece become the pieces of their UTF-8 bytes."""
    odd = np.flatnonzero(got < 0)
    width = np.ones(len(got), np.int64)
    if len(odd):
        width[odd] = 1 + (chars[odd] > 0x7F) + (chars[odd] > 0x7FF) + (chars[odd] > 0xFFFF)
    ids = np.repeat(got, width)
    if len(odd):
        raw = np.frombuffer("".join(map(chr, chars[odd])).encode("utf-8", "surrogatepass"), np.uint8)
        ids[ids < 0] = vocab.byte_ids[raw]
    return ids.astype(np.int32), np.bincount(text_of, weights=width, minlength=n_texts).astype(np.int64)


def _rounds(vocab, sym, seg, place, key, live, dropout):
    """The agenda of every short pre-token at once: a round merges the best candidate that
    was not skipped in each. A candidate's fate is fixed by its hash, so it is drawn when the
    candidate arises."""
    ends_at, ends_sym = [], []
    at, sym, seg = live.astype(np.int32), sym[live], seg[live].astype(np.int32)

    def draw(i):
        """Offers the pairs (i, i + 1) that join and are not skipped."""
        i = i[seg[i] == seg[i + 1]]
        left, right = sym[i], sym[i + 1]
        to = vocab.joined(left, right)
        has = to >= 0
        i, to = i[has], to[has]
        if dropout.share:
            stay = ~dropout.skips(key[at[i]], place[at[i]], left[has], right[has])
            i, to = i[stay], to[stay]
        rank[i] = vocab.rank[to]

    rank = np.full(len(at), _NONE, np.int32)
    if len(at) > 1:
        draw(np.arange(len(at) - 1, dtype=np.int32))
    while len(at):
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        best = np.minimum.reduceat(rank, first)
        span = np.diff(first, append=len(at))
        over = best == _NONE
        hit = np.flatnonzero((rank == np.repeat(best, span)) & (rank != _NONE))
        if len(hit):
            hit = hit[np.concatenate([[True], seg[hit[1:]] != seg[hit[:-1]]])]  # the leftmost of equals
        sym[hit] = vocab.by_rank[rank[hit]]
        rank[hit] = _NONE
        stay = np.ones(len(at), bool)
        if over.any():
            gone = np.repeat(over, span)
            ends_at.append(at[gone])
            ends_sym.append(sym[gone])
            stay = ~gone
        kept = stay.copy()
        kept[hit + 1] = False
        moved = (np.cumsum(kept, dtype=np.int32) - 1)[hit]
        at, sym, seg, rank = at[kept], sym[kept], seg[kept], rank[kept]
        left = moved[moved > 0] - 1
        rank[left[seg[left] == seg[left + 1]]] = _NONE
        draw(np.concatenate([left, moved[moved < len(at) - 1]]))
    return (np.concatenate(ends_at), np.concatenate(ends_sym)) if ends_at else (at, sym)


def _agenda(vocab, sym, place, key, dropout):
    """One long pre-token, with a heap of candidates and links between neighbours."""
    n = len(sym)
    sym = sym.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = [1] * n
    heap: list[tuple] = []
    keys = np.full(1, key, np.uint64)

    def offer(i, j, to):
        heap.append((int(vocab.rank[to]), i, j, size[i] + size[j], to))

    a = np.array(sym)
    to = vocab.joined(a[:-1], a[1:])
    for i in np.flatnonzero(to >= 0).tolist():
        offer(i, i + 1, int(to[i]))
    heapq.heapify(heap)
    while heap:
        _, i, j, length, to = heapq.heappop(heap)
        if not size[i] or not size[j] or size[i] + size[j] != length or after[i] != j:
            continue
        if dropout.share and dropout.skips(keys, place[i : i + 1], np.array([sym[i]]), np.array([sym[j]]))[0]:
            continue
        sym[i], size[i], size[j] = to, length, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and sym[x] >= 0 and sym[y] >= 0:
                new = int(vocab.joined(np.array([sym[x]]), np.array([sym[y]]))[0])
                if new >= 0:
                    heapq.heappush(heap, (int(vocab.rank[new]), x, y, size[x] + size[y], new))
    at = np.array([i for i in range(n) if size[i]])
    return at, np.array(sym, np.int32)[at]


def decode(vocab: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Texts of ids; the space that every encoded text begins with is taken off."""
    parts = vocab.bytes.take(pa.array(ids))
    at = np.frombuffer(parts.buffers()[1], np.int64)[: len(ids) + 1]
    raw = np.frombuffer(parts.buffers()[2], np.uint8)[: at[-1]] if at[-1] else np.zeros(0, np.uint8)
    heads = at[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(raw), bool)
    keep[heads[:-1][counts > 0]] = False
    size = np.diff(heads) - (counts > 0)
    return binary(np.concatenate([[0], np.cumsum(size)]), raw[keep])


def dropout_batches(path: str, share: float, seed: int, check: bool):
    """For ``mapInArrow``: (doc_id, text) to (doc_id, ids, n_tokens, lossless)."""

    def run(batches):
        vocab, dropout = vocabulary(path), Dropout(share, seed)
        for whole in batches:
            for part in slices(whole, limit=1 << 20):
                text = part.column("text")
                keys = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False)
                ids, counts = encode(vocab, pc.fill_null(text, ""), keys, dropout)
                null = text.is_null().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(ids), mask=pa.array(null))
                same = _same(decode(vocab, ids, counts), text) if check else np.ones(len(null), bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(counts, mask=null), pa.array(same, mask=null)],
                    ["doc_id", "ids", "n_tokens", "lossless"],
                )

    return run


def _same(got: pa.Array, text: pa.Array) -> np.ndarray:
    a, at = flat(got)
    b, bt = flat(text)
    if np.array_equal(at, bt) and np.array_equal(a, b):
        return np.ones(len(at) - 1, bool)
    return pc.equal(got, pc.fill_null(text.cast(pa.large_binary()), b"")).to_numpy(zero_copy_only=False)


def encode_dropout(docs, path: str, share: float = 0.1, seed: int = 1, check: bool = True):
    """Segmentations of every text with merge-dropout: (doc_id, ids, n_tokens, lossless).

    Narrow: a text is encoded where it is read. The same seed and doc_id give the same ids.
    A null text has null results, an empty one no ids; a null doc_id counts as 0. Other
    columns are left aside. ``lossless`` tells that the ids decode to the text itself.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return in_batches(rows).mapInArrow(
        dropout_batches(path, share, seed, check),
        "doc_id long, ids array<int>, n_tokens long, lossless boolean",
    )


def decode_ids(rows, path: str):
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            ids = batch.column("ids")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            text = decode(vocab, ids.flatten().to_numpy(zero_copy_only=False), counts)
            text = pc.if_else(pa.array(null), pa.scalar(None, pa.large_binary()), text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    return in_batches(rows.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")
