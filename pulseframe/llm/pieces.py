"""SentencePiece BPE encoding with seeded merge-dropout, and decoding without loss.

A text is cut where no piece of the vocabulary can reach across: before each run of spaces,
and around characters that stand in no longer piece. In each part an agenda holds the
candidate merges, best score first, ties from the left. A candidate is skipped when the
keyed hash of (seed, document, part number, place, merged piece) is below `dropout`; a
skipped one only comes back if a neighbour changes. So every occurrence of a word has draws
of its own, and always the same at the same place of the same document. A worker remembers
for each part the merges without dropout: an occurrence none of whose draws skips one takes
their ids, and all others are merged anew, those of one length side by side in arrays. With
`variants` above zero, the draws depend on (seed, one
of so many variants, part) instead. With dropout 0 the ids equal the library's. What is no
piece becomes bytes; a literal U+2581 does too, so that every text decodes to itself.

Defined results: null and empty texts have no ids and decode to the empty text; a null id
keys its document as -1, and rows of equal id and text have equal ids. Very long texts are
encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseframe.llm.common import per_process, pieces_of
from pulseframe.llm.wordbpe import Numbers

SPACE = "▁"
LITERAL = "\0" + SPACE  # stands for a U+2581 of the text: in no piece
#: Draws and ids that a worker remembers before it forgets them all.
REMEMBER = 8_000_000
#: Characters of the longest part that is merged beside others (its places fit six bits), parts and places worked on at a time.
LONGEST, AT_ONCE, CELLS = 64, 1 << 17, 1 << 18
NO = 1 << 62  # no candidate
M64, GOLDEN, MIX, MIX2 = 0xFFFFFFFFFFFFFFFF, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX2)
    return x ^ (x >> np.uint64(31))


def one_mixed(draw: int) -> int:
    """What Pieces.key gives for one draw."""
    x = draw * GOLDEN + GOLDEN & M64
    x = (x ^ x >> 30) * MIX & M64
    x = (x ^ x >> 27) * MIX2 & M64
    return x ^ x >> 31


class Flat:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.empty(1024, dtype), 0

    def add(self, values: np.ndarray) -> int:
        """Append `values`; where they begin."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.held):
            more = np.empty(2 * self.n, self.held.dtype)
            more[:at] = self.held[:at]
            self.held = more
        self.held[at:self.n] = values
        return at


class Symbols(dict):
    """Numbers of the characters; one that stands in no piece gets the next number when it is met."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of
        self.ids, self.start, self.size = Flat(np.int32), Flat(np.int64), Flat(np.int64)

    def symbol(self, name: str) -> int:
        ids = self.ids_of(name)
        self.start.add([self.ids.add(ids)])
        return self.size.add([len(ids)])

    def __missing__(self, c: str) -> int:
        self[c] = n = self.symbol(SPACE if c == " " else LITERAL if c == SPACE else c)
        return n


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Pieces:
    def __init__(self, path: str, dropout: float, seed: int, variants: int = 0):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dropout, self.seed, self.variants = int(dropout * 2**64), seed, variants
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {names[i]: i for i in plain if LITERAL not in names[i]}
        longer = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        self.rank = {names[i]: r for r, i in enumerate(longer)}  # best score first
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * len(names)
        for i in plain:
            self.raw[i] = names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        joined = {c for p in self.rank for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece reaches across the start of a space run")
        alone = [c for c in map(chr, range(32)) if c not in joined]
        own = "".join(map(re.escape, alone))
        self.parts = re.compile(f"[{own}]| *[^ {own}]+| +")
        self.symbols = Symbols(self.ids_of)
        for p in self.rank:  # a longer piece's number is its rank
            self.symbols.symbol(p)
        self.pairs()
        self.forget()

    def ids_of(self, p: str) -> list[int]:
        return [self.id[p]] if p in self.id else [self.byte[b] for b in (SPACE if p == LITERAL else p).encode()]

    def pairs(self) -> None:
        """A hash table of the pairs of symbols that make a piece, with linear probing."""
        rank, symbols = self.rank, self.symbols
        number = lambda p: rank.get(p) if len(p) > 1 else symbols[" " if p == SPACE else p]
        found = {a << 21 | b: r for p, r in rank.items() for k in range(1, len(p))
                 if (a := number(p[:k])) is not None and (b := number(p[k:])) is not None}
        bits = max(10, (4 * len(found)).bit_length())
        self.shift, self.pair, self.merges = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        key, value = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        for k, r, at in zip(key.tolist(), value.tolist(), self.slot(key).tolist()):
            while self.pair[at] >= 0:
                at = at + 1 & (1 << bits) - 1
            self.pair[at], self.merges[at] = k, r

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(GOLDEN) >> self.shift).view(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each two symbols make, or -1."""
        key = a << 21 | b
        at = self.slot(key)
        held = self.pair[at]
        out = np.where(held == key, self.merges[at], -1)
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] = at[on] + 1 & len(self.pair) - 1
            held = self.pair[at[on]]
            hit = held == key[on]
            out[on[hit]] = self.merges[at[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def forget(self) -> None:
        """Begin anew: no part is known."""
        self.number = Numbers(())
        self.draws, self.syms, self.firsts, self.keys, self.ids = Flat(np.uint64), Flat(np.int64), Flat(np.int64), Flat(np.uint64), Flat(np.int32)
        #: Of each part: where its draws, symbols and ids begin, and how many there are.
        self.at, self.size = ([Flat(np.int64) for _ in range(3)] for _ in range(2))
        self.long: dict[int, str] = {}

    def segment(self, part: str, dropped) -> tuple[int, ...]:
        """The ids of a part; dropped(place, rank of the merged piece) says which candidates are skipped."""
        s: list[str | None] = [SPACE if c == " " else LITERAL if c == SPACE else c for c in part]
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        agenda = [(r, i, i + 1) for i in range(n - 1) if (r := rank.get(s[i] + s[i + 1])) is not None]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            r, i, j = pop(agenda)
            left, right = s[i], s[j]
            if left is None or right is None or after[i] != j or rank.get(merged := left + right) != r:
                continue
            if dropped(i, r):
                continue
            s[i], s[j] = merged, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(merged + s[k])) is not None:
                    push(agenda, (r, i, k))
            h = before[i]
            if h >= 0 and (r := rank.get(s[h] + merged)) is not None:
                push(agenda, (r, h, i))
        out = []
        for p in s:
            if p is not None:
                if p in self.id:
                    out.append(self.id[p])
                else:
                    out += [self.byte[b] for b in (SPACE if p == LITERAL else p).encode()]
        return tuple(out)

    def key(self, place, rank) -> np.ndarray:
        """A hash of a draw's place and merged piece."""
        return mixed((np.asarray(rank, np.int64) << 32 | place).view(np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN))

    def skipped(self, own: np.ndarray, key: np.ndarray) -> np.ndarray:
        return (own ^ key) * np.uint64(MIX) < np.uint64(self.dropout)

    def merged(self, s: np.ndarray, best: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, list]:
        """The merges of many parts of one length side by side.

        `s` has a row for each place and a column for each part; `best` holds rank and place of each place's
        candidate, NO without one. Without the hashes `own` nothing is skipped, and the merges made come back
        too. A draw depends on place and merged piece only, so the best candidate left is the agenda's next.
        """
        w, n = s.shape
        out, column, done = np.empty((w, n), np.int64), np.arange(n), []
        after, before = np.repeat(np.arange(1, w + 1)[:, None], n, 1), np.repeat(np.arange(-1, w - 1)[:, None], n, 1)
        while True:
            low = best.min(axis=0)
            go = np.flatnonzero(low < NO)
            if 4 * len(go) <= 3 * n:
                ended = np.flatnonzero(low >= NO)
                out[:, column[ended]] = s[:, ended]
                if not len(go):
                    return out, done
                s, best, after, before = (x.take(go, axis=1) for x in (s, best, after, before))
                low, column = low[go], column[go]
                own, n, go = None if own is None else own[go], len(go), np.arange(len(go))
            sf, bf, af, pf = s.reshape(-1), best.reshape(-1), after.reshape(-1), before.reshape(-1)
            low = low[go]
            p, r = low & 63, low >> 6
            if own is None:
                done.append((column[go], p, r))
            at = p * n + go
            right = af[at] * n + go
            k, h = af[right], pf[at]
            sf[at], sf[right], af[at] = r, -1, k
            bf[at] = bf[right] = NO
            x, y = np.flatnonzero(k < w), np.flatnonzero(h >= 0)
            ak, ah = k[x] * n + go[x], h[y] * n + go[y]
            pf[ak] = p[x]
            to, place = np.concatenate((at[x], ah)), np.concatenate((p[x], h[y]))
            new = self.ranks(np.concatenate((r[x], sf[ah])), np.concatenate((sf[ak], r[y])))
            bf[to] = NO
            ok = np.flatnonzero(new >= 0)
            if own is not None:
                lane = np.concatenate((go[x], go[y]))[ok]
                ok = ok[~self.skipped(own[lane], self.key(place[ok], new[ok]))]
            bf[to[ok]] = new[ok] << 6 | place[ok]

    def written(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each column's symbols, one column after the other, and how many each has."""
        t = s.T
        keep = t >= 0
        sym, count = t[keep], keep.sum(axis=1)
        start, size = self.symbols.start.held[sym], self.symbols.size.held[sym]
        if int(size.sum()) == len(sym):
            return self.symbols.ids.held[start], count
        ends = np.cumsum(count)
        total = np.concatenate(([0], np.cumsum(size)))
        return self.symbols.ids.held[ragged(start, size)], total[ends] - total[ends - count]

    def learn(self, parts: list[str]) -> None:
        """Merge new parts without dropout; remember their symbols, first candidates, draws and ids."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        at, many = np.zeros((3, len(parts)), np.int64), np.zeros((3, len(parts)), np.int64)
        first = self.at[0].n
        for i in np.flatnonzero(size > LONGEST).tolist():
            seen: list[tuple[int, int]] = []
            ids = self.segment(parts[i], lambda place, r: seen.append((place, r)))
            place, r = np.array(seen, np.int64).reshape(-1, 2).T.copy()
            at[0, i], at[2, i] = self.draws.add(self.key(place, r)), self.ids.add(ids)
            many[0, i], many[2, i] = len(seen), len(ids)
            self.long[first + i] = parts[i]
        for rows, w in by_length(size, LONGEST):
            s = np.array([[self.symbols[c] for c in parts[i]] for i in rows.tolist()], np.int64).T.copy()
            best, keys = np.full(s.shape, NO, np.int64), np.zeros(s.shape, np.uint64)
            place = np.repeat(np.arange(w - 1), len(rows))
            r = self.ranks(s[:-1].reshape(-1), s[1:].reshape(-1))
            best[:-1].reshape(-1)[:] = np.where(r >= 0, r << 6 | place, NO)
            keys[:-1].reshape(-1)[:] = self.key(place, np.maximum(r, 0))
            begins = self.syms.add(s.T.reshape(-1))
            self.firsts.add(best.T.reshape(-1)), self.keys.add(keys.T.reshape(-1))
            at[1, rows], many[1, rows] = begins + np.arange(len(rows)) * w, w
            s, done = self.merged(s, best, None)
            ids, count = self.written(s)
            at[2, rows], many[2, rows] = self.ids.add(ids) + np.cumsum(count) - count, count
            if done:
                lane, place, r = map(np.concatenate, zip(*done))
                order = np.argsort(lane, kind="stable")
                count = np.bincount(lane, minlength=len(rows))
                at[0, rows] = self.draws.add(self.key(place, r)[order]) + np.cumsum(count) - count
                many[0, rows] = count
        for k in range(3):
            self.at[k].add(at[k]), self.size[k].add(many[k])

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of parts, new ones learnt."""
        got = np.fromiter(map(self.number.__getitem__, parts), np.int64, len(parts))
        if self.number.waiting:
            new, self.number.waiting = self.number.waiting, []
            self.learn(new)
        return got

    def ids_by_part(self, part: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of occurrences of parts with these hashes, and how many each has.

        Where none of the draws of the merging without dropout skips, its ids stand; the others are merged anew.
        """
        start, size = self.at[2].held[part], self.size[2].held[part]
        if not self.dropout:
            return self.ids.held[ragged(start, size)], size
        n = self.size[0].held[part]
        row = np.repeat(np.arange(len(part)), n)
        hit = np.zeros(len(part), bool)
        hit[row[self.skipped(own[row], self.draws.held[ragged(self.at[0].held[part], n)])]] = True
        plain, again = np.flatnonzero(~hit), np.flatnonzero(hit)
        w = self.size[1].held[part[again]]
        order, found = [], []
        for i in again[w == 0].tolist():  # too long to go side by side
            mine = int(own[i])
            ids = self.segment(self.long[int(part[i])], lambda place, r: (mine ^ one_mixed(r << 32 | place)) * MIX & M64 < self.dropout)
            order.append([i]), found.append(np.array(ids, np.int32))
            size[i] = len(ids)
        for rows, w in by_length(w, LONGEST):
            rows = again[rows]
            at = self.at[1].held[part[rows]] + np.arange(w)[:, None]
            mine, best = own[rows], self.firsts.held[at]
            best[self.skipped(mine, self.keys.held[at])] = NO
            ids, count = self.written(self.merged(self.syms.held[at], best, mine)[0])
            order.append(rows), found.append(ids)
            size[rows] = count
        out, begins = np.empty(int(size.sum()), np.int32), np.cumsum(size) - size
        out[ragged(begins[plain], size[plain])] = self.ids.held[ragged(start[plain], size[plain])]
        if order:
            rows = np.concatenate(order)
            out[ragged(begins[rows], size[rows])] = np.concatenate(found)
        return out, size

    def encode_all(self, texts: list[str], docs: list[int]) -> list[np.ndarray]:
        """The ids of each text of a document; some AT_ONCE parts are worked on at a time."""
        out, at = [], 0
        while at < len(texts):
            parts, bounds, hashes = [], [0], []
            while at < len(texts) and len(parts) < AT_ONCE:
                own = self.parts.findall(" " + texts[at]) if texts[at] else []
                hashes.append(self.occurrences(own, docs[at]) if self.dropout else np.zeros(len(own), np.uint64))
                parts += own
                bounds.append(len(parts))
                at += 1
            if self.draws.n + self.ids.n > REMEMBER:
                self.forget()
            own = np.concatenate(hashes)
            done = [self.ids_by_part(self.numbers(parts[i:i + AT_ONCE]), own[i:i + AT_ONCE]) for i in range(0, max(1, len(parts)), AT_ONCE)]
            flat = np.concatenate([ids for ids, _ in done])
            ends = np.cumsum(np.concatenate([[0], *(n for _, n in done)]))[bounds].tolist()
            out += [flat[i:j] for i, j in zip(ends, ends[1:])]
        return out

    def encode(self, text: str, doc: int) -> list[int]:
        return self.encode_all([text], [doc])[0].tolist()

    def occurrences(self, parts: list[str], doc: int) -> np.ndarray:
        """A hash for each part of a document; with variants, one of few for equal parts."""
        rng = np.uint64(xxhash.xxh64_intdigest(f"{self.seed} {doc}".encode()))
        own = mixed(np.arange(1, len(parts) + 1, dtype=np.uint64) * np.uint64(GOLDEN) + rng)
        if not self.variants:
            return own
        turn = ((own >> np.uint64(40)) % np.uint64(self.variants)).tolist()
        return np.array([xxhash.xxh64_intdigest(f"{self.seed} {v} {p}".encode()) for v, p in zip(turn, parts)], np.uint64)

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


def by_length(size: np.ndarray, longest: int):
    """Rows of each length of 1 to `longest`, CELLS places at most at a time, and that length."""
    order = np.argsort(size, kind="stable")
    ends = np.searchsorted(size[order], np.arange(longest + 1), side="right")
    for w in range(1, longest + 1):
        step = max(1, CELLS // w)
        for at in range(ends[w - 1], ends[w], step):
            yield order[at:min(at + step, ends[w])], w


def encoded(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 13, variants: int = 0, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Add token_ids (array<int>) and decoded (the text that they decode to) to `docs`; columns of these names are replaced."""
    keep = [c for c in docs.columns if c not in ("token_ids", "decoded")]
    key = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(id_col).cast("long").alias("token_ids"), F.col(text_col).cast("string").alias("decoded"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        pieces = per_process(("pieces", path, dropout, seed, variants), lambda: Pieces(path, dropout, seed, variants))
        for b in (x for batch in batches for x in pieces_of(batch)):
            own, texts = b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()
            ids = [i.tolist() for i in pieces.encode_all([t or "" for t in texts], [-1 if d is None else d for d in own])]
            back = [pieces.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], [*keep, "token_ids", "decoded"])
    return key.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 13, variants: int = 0, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 and lossless (decoding gives the text back) of every whole text."""
    def run(batches):
        pieces = per_process(("pieces", path, dropout, seed, variants), lambda: Pieces(path, dropout, seed, variants))
        for b in (x for batch in batches for x in pieces_of(batch)):
            rows, texts = [], [t or "" for t in b.column(1).to_pylist()]
            for t, ids in zip(texts, pieces.encode_all(texts, [-1 if d is None else d for d in b.column(0).to_pylist()])):
                rows.append((len(t.encode()), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), pieces.decode(ids.tolist()) == t))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))],
                                             ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "lossless"])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean")
