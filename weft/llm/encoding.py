"""Encoding of a corpus with a public byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that the encoding of that prefix can end with. Storing that token
per prefix gives the encoding of any prefix by walking back, lets bytes be appended at the cost of the new bytes only, and
lets an edit be re-encoded from the last place before it up to where old and new encodings meet again. Whether a token may
follow another is decided by their merges: the pair is valid if no merge across the border comes before the merges that
built the two sides.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .tokenizing import PATTERN, TOKENIZERS, ranks

_SPLIT = regex.compile(PATTERN)
#: Bytes of a piece that is encoded through the memory of pieces; longer ones are encoded each time.
REMEMBER, BOUND = 64, 500_000
#: Ids of one batch that is handed back, at least, where a batch of texts has more.
MOST_IDS = 1 << 26


class Bpe:
    """A vocabulary with what the prefix algorithm needs: how each token was merged, and which pairs merge to what."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.ranks = vocabulary
        self.bytes = {v: k for k, v in vocabulary.items()}
        self.longest = max(map(len, vocabulary))
        #: First two bytes -> length of the longest token that starts with them.
        self.reach: dict[bytes, int] = {}
        for token in vocabulary:
            if len(token) > 1:
                self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(vocabulary.items(), key=lambda x: x[1]):
            if len(token) > 1:
                p = self._halves(token, rank)
                if p is not None:
                    self.parts[rank] = p
                    self.merged[p] = rank
        self.valid = lru_cache(maxsize=1_000_000)(self._valid)
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge of a token: its bytes merged with the ranks below its own."""
        ids = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        words = [token[i : i + 1] for i in range(len(token))]
        while len(words) > 2:
            best, at = rank, -1
            for i in range(len(words) - 1):
                r = self.ranks.get(words[i] + words[i + 1], rank)
                if r < best:
                    best, at = r, i
            if at < 0:
                return None
            words[at : at + 2] = [words[at] + words[at + 1]]
            ids[at : at + 2] = [best]
        return (ids[0], ids[1]) if len(ids) == 2 else None

    def _valid(self, left: int, right: int) -> bool:
        """Whether ``right`` can follow ``left`` in an encoding: undo the merges at the border from the latest on, and see
        that no pair across the border would have been merged before them."""
        bound = 1 << 60
        while True:
            m = self.merged.get((left, right))
            if m is not None and m < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def last_tokens(self, piece: bytes, known: list[int] | None = None, old: list[int] | None = None, shift: int = 0, edited: int = 0) -> list[int]:
        """For each prefix length 1..n the one token its encoding ends with; ``known``, the table of a shorter prefix, is
        extended in place, at the cost of the new bytes.

        Tokens are tried from each start on, up to the longest token with the two bytes there; of those that end at a place
        the one that may follow the prefix before it is the last token, and there is exactly one. ``old`` is the table before
        an edit that ended at byte ``edited`` and moved the rest by ``shift``: once as many entries behind it as the longest
        token has bytes are the old ones, all that follow are, as nothing before them reaches further.
        """
        last = known if known is not None else []
        ranks, valid, reach, n, base = self.ranks, self.valid, self.reach, len(piece), len(last)
        low = max(0, base - self.longest)
        ending: dict[int, list[tuple[int, int]]] = {}
        same = 0
        for j in range(low, n):
            for i in range(max(j, base) + 1, min(n, j + reach.get(piece[j : j + 2], 1)) + 1):
                t = ranks.get(piece[j:i])
                if t is not None:
                    ending.setdefault(i, []).append((j, t))
            if j >= base:
                for start, t in ending.pop(j + 1):
                    if start == 0 or valid(last[start - 1], t):
                        last.append(t)
                        break
                if old is not None and j + 1 > edited:
                    same = same + 1 if last[j] == old[j - shift] else 0
                    if same > self.longest:
                        last += old[j + 1 - shift :]
                        break
        return last

    def walk(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of a prefix from its table of last tokens."""
        i, out = len(last) if end is None else end, []
        while i > 0:
            t = last[i - 1]
            out.append(t)
            i -= len(self.bytes[t])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        e = self.pieces.get(piece)
        if e is None:
            t = self.ranks.get(piece)
            e = (t,) if t is not None else tuple(self.walk(self.last_tokens(piece)))
            if len(piece) <= REMEMBER:
                if len(self.pieces) >= BOUND:
                    self.pieces.clear()
                self.pieces[piece] = e
        return e

    def word(self, w: str) -> tuple[int, ...]:
        """The encoding of a piece given as text, remembered by the text itself so that frequent pieces are one lookup."""
        e = self.encode_piece(w.encode("utf-8", "replace"))
        if len(w) <= REMEMBER:
            if len(self.words) >= BOUND:
                self.words.clear()
            self.words[w] = e
        return e

    def count(self, text: str) -> int:
        get, word = self.words.get, self.word
        return sum([len(get(w) or word(w)) for w in _SPLIT.findall(text)])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, word = self.words.get, self.word
        for w in _SPLIT.findall(text):
            out += get(w) or word(w)
        return out


class Piece:
    """A piece of a text between two splits; a long one keeps its table of last tokens."""

    __slots__ = ("text", "table")

    def __init__(self, bpe: Bpe, text: str, table: list[int] | None = None):
        self.text, self.table = text, table
        if table is None and len(text) > REMEMBER:
            self.table = bpe.last_tokens(text.encode("utf-8", "replace"))

    def ids(self, bpe: Bpe) -> tuple[int, ...] | list[int]:
        return bpe.word(self.text) if self.table is None else bpe.walk(self.table)

    def last(self, bpe: Bpe) -> list[int]:
        return self.table if self.table is not None else bpe.last_tokens(self.text.encode("utf-8", "replace"))


class Encoded:
    """A text with its encoding by pieces, for exact appends and edits.

    Pieces lie in blocks with their lengths, so that a place is found without counting all of them, and the text itself is only
    the pieces. An edit splits again from two pieces before it up to where old and new pieces meet. Of a long piece that
    it changes, the table of last tokens is kept up to the edit, and from where old and new tables agree again; an append
    extends the table of the last piece by the new bytes. Lone surrogates are encoded as '?'.
    """

    BLOCK = 512

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe = bpe
        self.blocks: list[list[Piece]] = [[]]
        self.sizes = [0]
        self._put(0, 0, 0, [Piece(bpe, m.group()) for m in _SPLIT.finditer(text)])

    def __len__(self) -> int:
        return sum(self.sizes)

    @property
    def text(self) -> str:
        return "".join(p.text for b in self.blocks for p in b)

    def ids(self) -> list[int]:
        return [t for b in self.blocks for p in b for t in p.ids(self.bpe)]

    def append(self, more: str) -> None:
        n = len(self)
        self.edit(n, n, more)

    def _put(self, k: int, i: int, drop: int, new: list[Piece]) -> None:
        """Replaces ``drop`` pieces from piece i of block k on, over as many blocks as they take."""
        rest, last = drop, k
        while last + 1 < len(self.blocks) and rest > len(self.blocks[last]) - (i if last == k else 0):
            rest -= len(self.blocks[last]) - (i if last == k else 0)
            last += 1
        end = (i if last == k else 0) + rest
        joined = self.blocks[k][:i] + new + self.blocks[last][end:]
        parts = [joined[a : a + self.BLOCK] for a in range(0, len(joined), self.BLOCK)] if len(joined) > 2 * self.BLOCK else [joined]
        self.blocks[k : last + 1] = parts
        self.sizes[k : last + 1] = [sum(len(p.text) for p in b) for b in parts]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]."""
        k, at = 0, 0
        while k + 1 < len(self.blocks) and at + self.sizes[k] < start:
            at += self.sizes[k]
            k += 1
        i, block = 0, self.blocks[k]
        while i < len(block) and at + len(block[i].text) < start:
            at += len(block[i].text)
            i += 1
        for _ in range(2):  # a split may depend on what follows it
            if i == 0 and k > 0:
                k, i = k - 1, len(self.blocks[k - 1])
            if i > 0:
                i -= 1
                at -= len(self.blocks[k][i].text)
        old, fresh, end0, lead = [], [], end - at, start - at
        source = self._from(k, i)
        shift, done = len(new) - (end - start), False
        length, want = 0, 4
        while not done:
            # take old pieces until the edit lies inside what was taken, then ever more until the splits meet
            taken, want = 0, 2 * want
            while (length <= end0 or taken < want) and (p := next(source, None)) is not None:
                old.append(p)
                length += len(p.text)
                taken += 1
            over = p is None
            window = "".join(p.text for p in old)
            changed = window[:lead] + new + window[end0:]
            ends = {0: 0}
            n = 0
            for j, p in enumerate(old, 1):
                n += len(p.text)
                ends[n] = j
            spans = [m.span() for m in _SPLIT.finditer(changed)]
            fresh, met = spans, len(old)
            if over:
                done = True
            else:
                # the last two splits of the window may depend on what follows it
                for j, (a, b) in enumerate(spans[:-2]):
                    o = ends.get(a - shift)
                    if a > lead + len(new) and o is not None and o < len(old) and len(old[o].text) == b - a:
                        fresh, met, done = spans[:j], o, True
                        break
        self._put(k, i, met, [self._piece(changed[a:b], a, old[:met], lead, end0, len(new)) for a, b in fresh])

    def _from(self, k: int, i: int):
        while k < len(self.blocks):
            yield from self.blocks[k][i:]
            k, i = k + 1, 0

    def _piece(self, text: str, a: int, old: list[Piece], lead: int, end: int, new: int) -> Piece:
        """The piece of the changed text at a: with the table of the old one that began there, as far as they agree."""
        at = 0
        for p in old:
            if at == a and at + len(p.text) >= lead >= at and len(text) > REMEMBER:
                kept = p.text[: lead - at]
                raw, before = text.encode("utf-8", "replace"), len(kept.encode("utf-8", "replace"))
                table = p.last(self.bpe)
                if not text.startswith(kept) or before > len(table):
                    break
                if before == len(table):
                    return Piece(self.bpe, text, self.bpe.last_tokens(raw, table))
                tail, edited = None, len(text[: lead - at + new].encode("utf-8", "replace"))
                if at + len(p.text) > end and text[lead - at + new :] == p.text[end - at :]:
                    tail = table
                return Piece(self.bpe, text, self.bpe.last_tokens(raw, table[:before], tail, len(raw) - len(table), edited))
            at += len(p.text)
        return Piece(self.bpe, text)


@lru_cache(maxsize=2)
def bpe(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Bpe:
    return Bpe(ranks(folder, name))


def encode_corpus(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, ids): the token ids of each text without special tokens; null and empty texts have an empty list.

    Every input row gives one row. Strings that look like special tokens are ordinary text.
    """

    def run(batches):
        b = bpe(folder, name)
        for batch in batches:
            lists, first, held = [], 0, 0
            for k, t in enumerate(batch.column("text").to_pylist(), 1):
                lists.append(b.encode(t) if t else [])
                held += len(lists[-1])
                if held >= MOST_IDS or k == batch.num_rows:  # offsets are 32 bits
                    flat = np.fromiter((x for y in lists for x in y), dtype=np.int32, count=held)
                    offs = np.zeros(len(lists) + 1, np.int32)
                    np.cumsum([len(x) for x in lists], out=offs[1:])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(lists)), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["doc_id", "ids"])
                    lists, first, held = [], k, 0

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def grown_otherwise(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, same): whether a text that grew by an append and edits has the ids of its whole; true for null and empty texts."""

    def run(batches):
        b = bpe(folder, name)
        for pdf in batches:
            same = []
            for t in pdf["text"]:
                t = t if isinstance(t, str) else ""
                n = len(t)
                e = Encoded(b, t[: n // 3])
                e.append(t[n // 2 :])
                e.edit(n // 3, n // 3, t[n // 3 : n // 2])
                e.edit(n // 4, n // 4 + 1, "?!")
                e.edit(n // 4, n // 4 + 2, t[n // 4 : n // 4 + 1])
                same.append(e.ids() == b.encode(t))
            yield pdf[["doc_id"]].assign(same=same)

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, same boolean")


def decoded_bytes(encoded: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, bytes): how many bytes the ids of each row of ``encode_corpus`` stand for; 0 for an empty list."""

    def run(batches):
        vocabulary = ranks(folder, name)
        sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            sizes[i] = len(token)
        for batch in batches:
            ids = batch.column("ids")
            offs, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            ends = np.concatenate([[0], np.cumsum(sizes[flat])]) if len(flat) else np.zeros(1, np.int64)
            at = np.clip(offs, 0, len(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends[at[1:]] - ends[at[:-1]])], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes long")


def token_counts(documents: DataFrame, *keep: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """The kept columns with ``tokens``, the number of tokens of the text (0 for null)."""

    def run(batches):
        b = bpe(folder, name)
        for pdf in batches:
            yield pdf[list(keep)].assign(tokens=[b.count(t) if isinstance(t, str) and t else 0 for t in pdf["text"]])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"
    return documents.select(*keep, "text").mapInPandas(run, schema)
