"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens that no cache knows are held together as one ragged array of symbols. In each
round every sequence finds its lowest-ranked pair and applies it at all its places at once
(left to right where places overlap); rounds end when no sequence has a mergeable pair, and
the symbols that survive are counted. A merge needs both its parts to exist, so every pair
that a round creates ranks after the pair applied, and the result is that of merging one
pair at a time. Long pre-tokens would need as many rounds as they have merges: their places
are listed by rank, so that a round touches only what it merges.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PATTERN, SPECIAL, Bounded, blanks
from .textkit import chunks


#: Bytes of the longest piece that takes part in the rounds; longer ones would make many rounds.
SHORT = 48


class Merges:
    """The merge ranks of a tokenizers file, as sorted arrays over pairs of symbol ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.span = len(vocab) + 1
        key = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(self.span, -1, np.int64)
        born[made[::-1]] = np.arange(len(pairs))[::-1]
        if any(max(born[vocab[a]], born[vocab[b]]) >= i for i, (a, b) in enumerate(pairs)):
            raise ValueError("a merge stands before the merge that makes its part")
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        # the alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown}
        letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
        self.byte = np.array([vocab[letter[b]] for b in range(256)], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; ``len(self.key)`` where no merge makes it."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], len(self.key))

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols left of each piece; pieces of over ``SHORT`` bytes are swept by rank."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        left = sizes.copy()
        long = np.flatnonzero(sizes > SHORT)
        short = np.flatnonzero(sizes <= SHORT)
        if len(short):
            left[short] = self._rounds([pieces[i] for i in short.tolist()])
        if len(long):
            left[long] = self._sweep([pieces[i] for i in long.tolist()])
        return left

    def _rounds(self, pieces: list[bytes]) -> np.ndarray:
        """Round by round, every sequence applies its own lowest-ranked pair; as many rounds as the longest piece has merges."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        left = sizes.copy()
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(len(pieces)), sizes)
        none = len(self.key)
        while len(sym) > 1:
            rank = np.where(row[:-1] == row[1:], self._ranks(sym[:-1], sym[1:]), none)
            rank = np.append(rank, none)
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            best = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            hit = (rank == np.repeat(best, length)) & (rank < none)
            # of runs of overlapping places (the pair of a symbol with itself) every second one counts
            place = np.flatnonzero(hit)
            if not len(place):
                break
            place = place[_every_second(np.diff(place) > 1)]
            sym[place] = self.made[rank[place]]
            alive = np.ones(len(sym), bool)
            alive[place + 1] = False
            np.subtract.at(left, row[place], 1)
            live = np.repeat(best < none, length) & alive  # sequences without a pair are done
            sym, row = sym[live], row[live]
        return left

    def _sweep(self, pieces: list[bytes]) -> np.ndarray:
        """All sequences at once, rank by rank: the places of a rank are listed, so a round costs what it merges.

        A merge makes only pairs of higher ranks, so when a rank's turn comes it is the lowest
        of every sequence that has it. Symbols are linked, about 25 bytes a byte of text.
        """
        import heapq

        sizes = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
        n, none = len(sym), len(self.key)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        rank = np.full(n, none, np.int32)
        rank[:-1] = self._ranks(sym[:-1].astype(np.int64), sym[1:].astype(np.int64))
        rank[ends - 1] = none
        gone = np.zeros(n, bool)
        order = np.argsort(rank, kind="stable").astype(np.int32)
        ranked = rank[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        listed = {int(ranked[f]): order[f:t] for f, t in zip(first, np.append(first[1:], n)) if ranked[f] < none}
        fresh: dict[int, list[int]] = {}
        turn = sorted(listed)
        while turn:
            r = heapq.heappop(turn)
            place = listed.pop(r, None)
            more = fresh.pop(r, None)
            if more is not None:
                more = np.unique(np.array(more, np.int32))
                place = more if place is None else np.union1d(place, more)
            place = place[(rank[place] == r) & ~gone[place]]
            if not len(place):
                continue
            if len(place) > 1:
                place = place[_every_second(after[place[:-1]] != place[1:])]
            lost = after[place]
            follows = after[lost]
            sym[place] = self.made[r]
            gone[lost] = True
            after[place] = follows
            before[follows[follows >= 0]] = place[follows >= 0]
            prior = before[place]
            at = np.concatenate([place, prior[prior >= 0]])
            to = after[at]
            new = np.where(to >= 0, self._ranks(sym[at].astype(np.int64), sym[to].astype(np.int64)), none)
            rank[at] = new
            for x, i in zip(new.tolist(), at.tolist()):
                if x < none:
                    if x in fresh:
                        fresh[x].append(i)
                    else:
                        fresh[x] = [i]
                        if x not in listed:
                            heapq.heappush(turn, x)
        gone = np.concatenate([[0], np.cumsum(gone)])
        return sizes - (gone[ends] - gone[ends - sizes])


def _every_second(apart: np.ndarray) -> np.ndarray:
    """Of sorted places, every second one of each run; ``apart`` says where a run ends."""
    run = np.flatnonzero(np.concatenate([[True], apart]))
    within = np.arange(len(apart) + 1) - np.repeat(run, np.diff(np.append(run, len(apart) + 1)))
    return within % 2 == 0


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


def counter(path: str, batch_bytes: int = 1 << 20):
    """A function from a list of texts to their token counts; it keeps a bounded cache."""
    import regex

    merges, cut = _merges(path), regex.compile(PATTERN)
    known, whole = Bounded(), Bounded(600_000)

    def learn(new: list[str], into: Bounded) -> None:
        block: list[str] = []
        held = 0
        for piece in [*new, None]:
            if piece is not None:
                block.append(piece)
                held += len(piece)
            if block and (piece is None or held > batch_bytes):
                into.update(zip(block, merges.count([p.encode() for p in block]).tolist()))
                block, held = [], 0

    def exact(text: str) -> int:
        """Any text, by its pre-tokens, a bounded number at a time."""
        total = 0
        for i, part in enumerate(text.split(SPECIAL)):
            total += i > 0
            held: list[str] = []
            for m in cut.finditer(part):
                held.append(m[0])
                if len(held) == 50_000:
                    total += tally(held)
                    held = []
            total += tally(held)
        return total

    def tally(pieces: list[str]) -> int:
        known.room()
        learn(list(set(pieces).difference(known)), known)
        return sum(map(known.__getitem__, pieces))

    def count(texts: list[str]) -> list[int]:
        """Texts together, so that what no cache knows is merged in one array."""
        cuts = [blanks(text) for text in texts]
        whole.room()
        new = list({p for pieces in cuts if pieces for p in pieces}.difference(whole))
        if new:
            # letters after at most one space are one pre-token as they stand
            plain = [p for p in new if p[1:].isalpha() and (p[0] == " " or p[0].isalpha())]
            learn(plain, whole)
            other = [p for p in new if p not in whole]
            parts = [cut.findall(p) for p in other]
            known.room()
            learn(list({x for p in parts for x in p}.difference(known)), known)
            whole.update((p, sum(map(known.__getitem__, x))) for p, x in zip(other, parts))
        return [exact(text) if pieces is None else sum(map(whole.__getitem__, pieces)) for text, pieces in zip(texts, cuts)]

    return count


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, in one pass without a shuffle.

    Counts are those of the tokenizers library for ``vocabulary`` (a file of public_tokenizers
    with the byte-level pattern) without added tokens; its special string counts as one token.
    Null and empty texts have 0 bytes and 0 tokens. Rows are neither merged nor dropped; null
    keys stay null; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        count = counter(public_tokenizers.path(vocabulary))
        for batch in batches:
            sizes, tokens = [], []
            for lo, hi, _, bounds in chunks(batch.column(1), 1 << 21):
                sizes += np.diff(bounds).tolist()
                tokens += count([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
