"""Token alignment of two tokenizers by sparse incidence matrices.

Token-by-byte incidence matrices A and B of a batch of texts are held in compressed rows (CSR, built here in
numpy). The row product A B' by Gustavson's method (each row gathers the rows of B' that its bytes name and adds
up equal columns) has an entry for each pair of tokens that share bytes: the overlap links, with the number of
bytes. Byte offsets where tokens of both end cut the tokens into groups; the product of the token-by-group
matrices, G_A G_B', has an entry for each pair of one group: the shared-group links. Its rows are counted by the
product's symbolic phase, so that a long group costs no quadratic memory.

Over the corpus, the document-by-pair matrix M of a batch is written beside the batch's own dictionary of id
pairs. Dictionaries, at most one row a pair and batch, are summed by pair; a batch then gets its pairs' counts
back, and the documents' sums are the products of M with these vectors. Links themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import per_process, write_stage
from pulseframe.llm.wordbpe import PLAIN, Numbers, char_class

#: Bytes of text that share a dictionary of pairs, and characters that are aligned and that are encoded at a time.
BATCH, ALIGN, ENCODE = 4 << 20, 512 << 10, 128 << 10
#: Pre-tokens whose ids a worker remembers before it forgets them all.
REMEMBER = 500_000
#: Entries that a row product expands at a time.
EXPAND = 1_000_000


@dataclass
class Csr:
    """A sparse matrix of counts in compressed rows."""
    start: np.ndarray
    column: np.ndarray
    value: np.ndarray
    width: int

    @classmethod
    def of(cls, sizes: np.ndarray, column: np.ndarray, width: int) -> Csr:
        """A matrix of ones whose rows have these sizes and columns."""
        return cls(np.concatenate(([0], np.cumsum(sizes))), column, np.ones(len(column), np.int32), width)

    @property
    def height(self) -> int:
        return len(self.start) - 1

    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def transposed(self) -> Csr:
        row = np.repeat(np.arange(self.height), self.sizes())
        ordered = len(self.column) < 2 or bool((self.column[1:] >= self.column[:-1]).all())
        order = slice(None) if ordered else np.argsort(self.column, kind="stable")
        start = np.concatenate(([0], np.cumsum(np.bincount(self.column, minlength=self.width))))
        return Csr(start, row[order], self.value[order], self.height)

    def expanded(self, other: Csr) -> np.ndarray:
        """Symbolic phase: how many entries each row of the product gathers before equal columns are added."""
        each = np.concatenate(([0], np.cumsum(other.sizes()[self.column])))
        return each[self.start[1:]] - each[self.start[:-1]]

    def products(self, other: Csr, most: int = EXPAND) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numeric phase of self x other by rows: (row, column, value) sorted by both, for a run of rows at a time.

        A run gathers about `most` entries, or those of a single row.
        """
        before = np.concatenate(([0], np.cumsum(self.expanded(other))))
        at = 0
        while at < self.height:
            to = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
            own = slice(self.start[at], self.start[to])
            inner, n = self.column[own], other.sizes()[self.column[own]]
            row = np.repeat(np.repeat(np.arange(at, to), self.sizes()[at:to]), n)
            from_ = np.repeat(other.start[inner] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            column = other.column[from_]
            value = np.repeat(self.value[own], n) * other.value[from_]
            key = row * other.width + column
            if len(key) and (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            yield key[first] // max(other.width, 1), key[first] % max(other.width, 1), np.add.reduceat(value, first) if len(first) else value
            at = to

    def product(self, other: Csr) -> Csr:
        """The whole product, where the caller knows that it is small."""
        got = list(self.products(other))
        row, column, value = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3))
        return Csr(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=self.height)))), column, value, other.width)


class Pair:
    """The two tokenizers: ids of texts, and the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.long_a, self.long_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.split, self.known = byte_level_splitter(), Numbers([])
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        n = (len(self.bytes_a), len(self.bytes_b))
        self.parts = [str(i) + end for k, ends in enumerate((",|", ",;")) for end in ends for i in range(n[k])]
        self.offset = (0, n[0], 2 * n[0], 2 * n[0] + n[1])

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of space + text. Merges never cross pre-tokens, so each distinct pre-token is merged once, by the library."""
        if len(self.known) > REMEMBER:
            self.known, self.flat, self.sizes = Numbers([]), np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts: list[np.ndarray | None] = []
        for t in texts:
            words = self.split.findall(" " + t) if PLAIN.fullmatch(t) else None
            parts.append(None if words is None else np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)))
        new, self.known.waiting = self.known.waiting, []
        if new:
            got = [e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)]
            self.flat = np.concatenate((self.flat, np.array([i for ids in got for i in ids], np.int32)))
            self.sizes = np.concatenate((self.sizes, np.array([len(ids) for ids in got], np.int64)))
        start = np.cumsum(self.sizes) - self.sizes
        whole = iter([e.ids for e in self.a.encode_batch_fast([" " + t for t, x in zip(texts, parts) if x is None], add_special_tokens=False)])
        out = []
        for x in parts:
            if x is None:
                out.append(np.array(next(whole), np.int32))
            else:
                n = self.sizes[x]
                out.append(self.flat[np.repeat(start[x] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        return out

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both, none where a text is empty or its tokens' bytes are not the text's."""
        a, none = self.ids_a(texts), np.zeros(0, np.int32)
        b = []
        for i, (t, ids) in enumerate(zip(texts, self.b.encode(texts, num_threads=1))):
            want = b" " + t.encode()
            same = t and b"".join(map(self.bytes_b.__getitem__, ids)) == want and b"".join(map(self.bytes_a.__getitem__, a[i].tolist())) == want
            b.append(np.array(ids, np.int32) if same else none)
            if not same:
                a[i] = none
        return a, b


def byte_level_splitter() -> re.Pattern:
    """The byte-level vocabulary's pre-token pattern for the characters of PLAIN, whose white space is tab, line ends and space."""
    letter, number = char_class("L"), char_class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\t\n\r {letter}{number}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Aligned:
    """Tokens, groups and links of a batch of texts; tokens, bytes and groups are numbered through the batch."""

    def __init__(self, pair: Pair, texts: list[str]):
        self.pair = pair
        a, b = [], []
        for part in by_bytes(texts):
            x, y = pair.ids(part)
            a += x
            b += y
        none = [np.zeros(0, np.int32)]
        self.n_a, self.n_b = (np.array([len(i) for i in x], np.int64) for x in (a, b))
        self.a, self.b = np.concatenate(a + none), np.concatenate(b + none)
        long_a, long_b = pair.long_a[self.a], pair.long_b[self.b]
        end_a, end_b = np.cumsum(long_a), np.cumsum(long_b)
        size = int(end_a[-1]) if len(end_a) else 0
        ends = np.zeros(size + 1, np.int8)
        ends[end_a] += 1
        ends[end_b] += 1
        #: group of each token: how many places before its end are ends of both
        before = np.cumsum(ends == 2)
        self.group_a, self.group_b = before[end_a] - (ends[end_a] == 2), before[end_b] - (ends[end_b] == 2)
        self.groups = int(before[-1])
        self.bytes_a, self.bytes_b = Csr.of(long_a, np.arange(size), size), Csr.of(long_b, np.arange(size), size)
        self.in_a = Csr.of(np.ones(len(self.a), np.int64), self.group_a, self.groups)
        self.in_b = Csr.of(np.ones(len(self.b), np.int64), self.group_b, self.groups)

    def overlap_links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token of A, token of B, shared bytes)."""
        m = self.bytes_a.product(self.bytes_b.transposed())
        return np.repeat(np.arange(m.height), m.sizes()), m.column, m.value

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(token of A, token of B) of one group, some millions at a time."""
        for row, column, _ in self.in_a.products(self.in_b.transposed()):
            yield row, column

    def group_link_counts(self) -> np.ndarray:
        """How many shared-group links each token of A has."""
        return self.in_a.expanded(self.in_b.transposed())

    def texts(self) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each text."""
        p = self.pair
        own_a, own_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        before_a, before_b = np.cumsum(own_a), np.cumsum(own_b) - own_b
        code = np.empty(len(self.a) + len(self.b), np.int64)
        at_a, at_b = np.arange(len(self.a)), np.arange(len(self.b))
        last_a, last_b = at_a == before_a[self.group_a] - 1, at_b == (before_b + own_b)[self.group_b] - 1
        code[at_a + before_b[self.group_a]] = self.a + np.where(last_a, p.offset[1], p.offset[0])
        code[at_b + before_a[self.group_b]] = self.b + np.where(last_b, p.offset[3], p.offset[2])
        cuts = np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))
        parts = list(map(p.parts.__getitem__, code.tolist()))
        return ["".join(parts[x:y])[:-1] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def by_text(self, of_a: np.ndarray) -> np.ndarray:
        """Sums over each text's tokens of A."""
        total = np.concatenate(([0], np.cumsum(of_a)))
        cuts = np.concatenate(([0], np.cumsum(self.n_a)))
        return total[cuts[1:]] - total[cuts[:-1]]


def by_bytes(texts: list[str], most: int = ENCODE) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, a text at least."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def batches_of(batches: Iterator[pa.RecordBatch], most: int = BATCH) -> Iterator[pa.Table]:
    """Tables of about `most` bytes, a row at least."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            size += held[-1].nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()



def selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def token_links(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, a_group, b_group and the overlap links link_a, link_b, link_bytes (token numbers from 0) of each text.

    Texts that are null, empty or changed by a tokenizer have empty arrays. Every row is aligned by itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = None
        for t in batches_of(batches):
            pair = pair or per_process(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))
            x = Aligned(pair, [v or "" for v in t["text"].to_pylist()])
            row, column, value = x.overlap_links()
            cut_a, cut_b = (np.concatenate(([0], np.cumsum(n))) for n in (x.n_a, x.n_b))
            cut_l = np.searchsorted(row, cut_a)
            first_a, first_b = np.repeat(cut_a[:-1], x.n_a), np.repeat(cut_b[:-1], x.n_b)
            group = x.group_a[np.minimum(cut_a[:-1], max(len(x.a) - 1, 0))] if len(x.a) else np.zeros(len(x.n_a), np.int64)

            def lists(values, cuts):
                return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))
            yield from pa.table({
                "doc_id": t["doc_id"], "a_ids": lists(x.a, cut_a), "b_ids": lists(x.b, cut_b),
                "a_group": lists(x.group_a - np.repeat(group, x.n_a), cut_a), "b_group": lists(x.group_b - np.repeat(group, x.n_b), cut_b),
                "link_a": lists(row - first_a[row], cut_l), "link_b": lists(column - first_b[column], cut_l),
                "link_bytes": lists(value, cut_l)}).to_batches()
    arrays = ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_group", "b_group", "link_a", "link_b", "link_bytes"))
    return selected(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {arrays}")


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Two kinds of rows by batch: a document's figures with its row of M (pair, times), and the batch's pairs with their documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = None, 0
        for t in batches_of(batches):
            pair = pair or per_process(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))
            texts, keys, digests, figures, at = [], [], [], [], 0
            for part in by_bytes([v or "" for v in t["text"].to_pylist()], ALIGN):
                x = Aligned(pair, part)
                row, column, _ = x.overlap_links()
                texts.append(at + np.repeat(np.arange(len(part), dtype=np.int32), x.n_a)[row])
                keys.append(x.a[row].astype(np.int64) << 32 | x.b[column])
                ends = np.concatenate(([True], x.group_a[1:] != x.group_a[:-1])) if len(x.a) else np.zeros(0, bool)
                links = np.bincount(row, minlength=len(x.a))
                figures.append((x.n_a, x.n_b, x.by_text(ends), x.by_text(links), x.by_text(x.group_link_counts())))
                digests += [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in x.texts()]
                at += len(part)
            text = np.concatenate(texts)
            key, local = np.unique(np.concatenate(keys), return_inverse=True)
            width = max(len(key), 1)
            cell, times = np.unique(text * np.int64(width) + local, return_counts=True)
            of, local = cell // width, (cell % width).astype(np.int32)
            cuts = np.searchsorted(of, np.arange(at + 1))
            block = (TaskContext.get().partitionId() << 32) + number
            number += 1
            n, one = at, pa.array([None], pa.int64())

            def blobs(values):
                return pa.array([values[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])] + [None], pa.binary())

            def whole(values):
                return pa.array([None] * n + [values.tobytes()], pa.binary())
            out = {"block": pa.array(np.full(n + 1, block)), "doc_id": pa.concat_arrays([t["doc_id"].combine_chunks(), one])}
            out |= {c: pa.concat_arrays([pa.array(np.concatenate(v), pa.int64()), one]) for c, v in zip(COUNTS, zip(*figures))}
            out |= {"groups_sha256": pa.array(digests + [None], pa.string()), "pair": blobs(local), "times": blobs(times.astype(np.int32)),
                    "keys": whole(key), "documents": whole(np.bincount(local, minlength=len(key)).astype(np.int32))}
            yield from pa.table(out).to_batches(max_chunksize=1000)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return docs.mapInArrow(run, f"block long, doc_id long, {counts}, groups_sha256 string, pair binary, times binary, keys binary, documents binary")


def dictionaries(stage: DataFrame) -> DataFrame:
    """block, at (place in the batch's dictionary), a, b, n (documents of the batch) of each pair of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                keys = np.frombuffer(keys, np.int64)
                yield from pa.table({"block": np.full(len(keys), block), "at": np.arange(len(keys), dtype=np.int32),
                                     "a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32),
                                     "n": np.frombuffer(n, np.int32)}).to_batches()
    return stage.where("keys IS NOT NULL").select("block", "keys", "documents").mapInArrow(run, "block long, at int, a int, b int, n int")


def pair_counts(dictionary: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (whether that is the highest of a)."""
    counts = write_stage(dictionary.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_shared (shared-group links) of each text.

    Texts that are null, empty or changed by a tokenizer have zeros and an empty digest. Every row is a document:
    repeated rows count twice and null ids like any other. Long texts are taken whole, a batch holds one at least.
    Ties for an id's highest count all count. Other columns are not read. An empty table gives an empty result.
    """
    stage = write_stage(linked(selected(docs, id_col, text_col), path_a, path_b), "links")
    dictionary = dictionaries(stage)
    counted = dictionary.join(pair_counts(dictionary), ["a", "b"]).select("block", "at", "count", "best")
    rows = stage.where("keys IS NULL").drop("keys", "documents")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right["at"].to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right["count"].to_numpy(), right["best"].to_numpy()
        sums, n_best = [], []
        for pair, times in zip(left["pair"], left["times"]):
            pair, times = np.frombuffer(pair.as_py(), np.int32), np.frombuffer(times.as_py(), np.int32).astype(np.int64)
            sums.append(int(times @ count[pair]))
            n_best.append(int(times @ best[pair]))
        out = {c: left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        out |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table(out | {"groups_sha256": left["groups_sha256"], "n_shared": left["n_shared"]})
    return rows.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long")
