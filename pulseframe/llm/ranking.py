"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents become short rows (counts of the items' terms, one row a document), written once. Tasks read them in
blocks of documents, turn each block into posting lists of exact integer impacts, and run every item over it:

* Precomputed for a block: each term's largest impact, and for pairs of an item's terms the list of documents
  that hold both, with the largest joint impact. Terms pair up in the order of their list lengths, as the long
  lists of frequent terms meet most often, and each pair serves all items that hold it.
* A pair bounds what both terms can add by max(joint, either alone), which is less than the sum of two term
  maxima wherever no document has both maxima. An item's bound is the sum over its pairs and single terms.
* The item's units (pairs and single terms) are taken from the highest bound down. While the bounds left can
  still lift an unseen document to the 50th best score so far, a unit's whole lists are added. If only the
  joint bound can, only the pair's intersection list brings in documents. After that, no new document can
  enter: the rest is looked up for the candidates alone, which are dropped as soon as their own bound is less.

Bounds are never less than scores, and only what is strictly less than the 50th score is skipped, so results are
exact, ties included. A task keeps its best so far from block to block; Spark ranks the tasks' best by item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import map_rows, utf8_texts, write_stage

#: Bytes of text that items of one pass may have: what a pass holds of them is bounded.
ITEM_BYTES = 8 << 20
#: Documents and postings after which a task closes a block.
BLOCK_ROWS, BLOCK_POSTINGS = 50_000, 4_000_000
#: Entries of intersection lists that a task remembers before it forgets them all.
PAIR_POSTINGS = 8_000_000
#: A-Z in lower case, digits, a-z and all bytes beyond ASCII as they are, others as a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms), terms, tfs (binary int32) of every document with at least one term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.Table:
        known = shared.value
        ids, n, held, tfs = [], [], [], []
        for i, text in enumerate(utf8_texts(batch.column(1))):
            words = terms(text)
            if words:
                c = Counter(map(known.get, words))
                c.pop(None, None)
                ids.append(i)
                n.append(len(words))
                held.append(np.fromiter(c.keys(), np.int32, len(c)).tobytes())
                tfs.append(np.fromiter(c.values(), np.int32, len(c)).tobytes())
        return pa.table({"doc_id": batch.column(0).take(pa.array(ids, pa.int64())), "n": pa.array(n, pa.int64()),
                         "terms": pa.array(held, pa.binary()), "tfs": pa.array(tfs, pa.binary())})
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                    "doc_id long, n long, terms binary, tfs binary")


def flat(column, dtype=np.int32) -> np.ndarray:
    return np.frombuffer(b"".join(v.as_py() for v in column), dtype)


def document_frequencies(index: DataFrame) -> dict[int, int]:
    """How many documents hold each of the pass's terms; as many rows as it has terms come to the driver."""
    def run(batch: pa.RecordBatch) -> pa.Table:
        t, n = np.unique(flat(batch.column(0)), return_counts=True)
        return pa.table({"t": pa.array(t, pa.int32()), "df": pa.array(n, pa.int64())})
    rows = map_rows(index.select("terms"), run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()
    return {r.t: r.df for r in rows}


class Block:
    """Posting lists of a block of documents, sorted by document, with term and pair maxima."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, total: tuple[int, int]):
        docs, length = total
        self.rows = len(n)
        if self.rows and int(n.max()) * 50 * docs >= 1 << 63:
            m = np.array([50 + 50 * int(x) * docs // length for x in n], np.int64)
        else:
            m = 50 + 50 * n * docs // max(length, 1)
        doc = np.repeat(np.arange(self.rows), sizes)
        order = np.argsort(term, kind="stable")
        term, tf, self.doc = term[order], tf[order].astype(np.int64), doc[order].astype(np.int32)
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        some = np.flatnonzero(np.diff(self.start))
        self.most = np.zeros(len(weights), np.int64)
        if some.size:
            self.most[some] = np.maximum.reduceat(self.impact, self.start[some])
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        self.paired = 0

    def list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[t], self.start[t + 1])
        return self.doc[part], self.impact[part]

    def impacts(self, t: int, docs: np.ndarray) -> np.ndarray:
        """The term's impact in each of these documents, 0 where it does not occur."""
        held, impact = self.list(t)
        if not len(held):
            return np.zeros(len(docs), np.int64)
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, impact[at], 0)

    def pair(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """(documents that hold both terms, largest joint impact), computed once for all items while there is room."""
        if (a, b) not in self.pairs:
            if self.paired > PAIR_POSTINGS:
                self.pairs, self.paired = {}, 0
            short, long = (a, b) if self.start[a + 1] - self.start[a] <= self.start[b + 1] - self.start[b] else (b, a)
            docs, impact = self.list(short)
            other = self.impacts(long, docs)
            both = other > 0
            self.paired += int(both.sum())
            self.pairs[a, b] = docs[both], int((impact + other)[both].max(initial=0))
        return self.pairs[a, b]

    def units(self, item: np.ndarray) -> list[tuple[int, int, tuple[int, ...], np.ndarray | None]]:
        """(bound, bound without both, terms, documents with both) of an item's pairs and single terms, highest bound first."""
        item = item[self.most[item] > 0]
        item = item[np.lexsort((item, self.start[item] - self.start[item + 1]))]
        out = []
        for a, b in zip(item[0::2].tolist(), item[1::2].tolist()):
            a, b = min(a, b), max(a, b)
            docs, joint = self.pair(a, b)
            alone = int(max(self.most[a], self.most[b]))
            out.append((max(joint, alone), alone, (a, b), docs))
        if len(item) % 2:
            t = int(item[-1])
            out.append((int(self.most[t]), int(self.most[t]), (t,), None))
        return sorted(out, key=lambda u: (-u[0], u[2]))

    def best(self, item: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the item's k best in the block; those under `floor` may be left out."""
        units = self.units(item)
        left = sum(u[0] for u in units)
        score = np.zeros(self.rows, np.int64)
        done = 0
        for bound, alone, held, both in units:
            if left < floor:
                break
            left -= bound
            if left + alone < floor and both is not None:
                # only documents of both terms can still enter; those met before get all that is theirs
                docs = np.union1d(both, np.flatnonzero(score))
                for t in held:
                    score[docs] += self.impacts(t, docs)
            else:
                for t in held:
                    docs, impact = self.list(t)
                    score[docs] += impact
            done += 1
            floor = max(floor, kth(score, k))
        docs = np.flatnonzero((score > 0) & (score + left >= floor))
        score = score[docs]
        for bound, _, held, _ in units[done:]:
            left -= bound
            for t in held:
                score = score + self.impacts(t, docs)
            floor = max(floor, kth(score, k))
            docs, score = docs[score + left >= floor], score[score + left >= floor]
        return top(docs, score, k)


def kth(score: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 where there are fewer."""
    if len(score) < k:
        return 0
    return int(np.partition(score, len(score) - k)[len(score) - k])


def top(docs: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, highest score first, ties in the order of documents."""
    keep = np.flatnonzero(score >= max(kth(score, k), 1))
    keep = keep[np.lexsort((docs[keep], -score[keep]))][:k]
    return docs[keep], score[keep]


def by_id(ids) -> pa.Array:
    """The order of ids, null first."""
    return pc.sort_indices(pa.table({"i": ids}), sort_keys=[("i", "ascending")], null_placement="at_start")


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item (its id), terms of each item id: rows of one id are one item with the terms of all."""
    words = F.explode(F.split(F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                              r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return items.select(F.col(item_col).alias("item"), words.alias("w")).where("w <> ''").groupBy("item").agg(
        F.array_sort(F.collect_set("w")).alias("terms"))


def search_pass(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, doc_id, score: each task's best of every item."""
    sc = docs.sparkSession.sparkContext
    vocabulary = {w: i for i, w in enumerate(sorted({t.encode() for _, ts in items for t in ts}))}
    index = write_stage(counted(docs, vocabulary, id_col, text_col), "term-counts")
    total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(index)
    weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(vocabulary))], np.int64)
    held = [np.array([vocabulary[t.encode()] for t in ts], np.int64) for _, ts in items]
    shared = sc.broadcast((held, weights, (int(total[0]), int(total[1]))))
    names = pa.array([i for i, _ in items], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight, sums = shared.value
        none = np.zeros(0, np.int64)
        ids, found = pa.array([], pa.int64()), [(none, none)] * len(queries)

        def closed(parts: list[pa.RecordBatch]) -> None:
            """Run all items over a block; what is found so far are rows of `ids`."""
            nonlocal ids, found
            t = pa.Table.from_batches(parts).combine_chunks()
            t = t.take(by_id(t["doc_id"]))
            b = Block(t["n"].to_numpy(), np.array([len(v.as_py()) // 4 for v in t["terms"]], np.int64), flat(t["terms"]), flat(t["tfs"]), weight, sums)
            fresh = [b.best(q, k, kth(s, k)) for q, (_, s) in zip(queries, found)]
            both = pa.concat_arrays([ids, t["doc_id"].combine_chunks()])
            rank = np.empty(len(both), np.int64)
            rank[by_id(both).to_numpy()] = np.arange(len(both))
            merged = []
            for (d, s), (e, u) in zip(found, fresh):
                rows, score = np.concatenate((d, e + len(ids))), np.concatenate((s, u))
                keep = np.lexsort((rank[rows], -score))[:k]
                merged.append((rows[keep], score[keep]))
            used, back = np.unique(np.concatenate([d for d, _ in merged]), return_inverse=True)
            cuts = np.cumsum([len(d) for d, _ in merged])[:-1]
            ids, found = both.take(pa.array(used)), [(d, s) for d, (_, s) in zip(np.split(back, cuts), merged)]
        parts, rows, postings = [], 0, 0
        for batch in batches:
            parts.append(batch)
            rows += batch.num_rows
            postings += batch.nbytes // 8
            if rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
                closed(parts)
                parts, rows, postings = [], 0, 0
        if rows:
            closed(parts)
        number = np.repeat(np.arange(len(queries)), [len(d) for d, _ in found])
        if len(number):
            out = pa.table({"item_id": names.take(pa.array(number)), "doc_id": ids.take(pa.array(np.concatenate([d for d, _ in found]))),
                            "score": pa.array(np.concatenate([s for _, s in found]), pa.int64())})
            yield from out.to_batches()
    return index.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", item_text: str = "text",
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents of score above 0.

    Documents without a term (null and empty texts too) take no part and do not count. Every row of `docs` is a
    document: repeated rows are ranked beside each other. A null id comes first among equal scores. Rows of one
    item id (null is one too) are one item; items without a term have no rows. Other columns are not read.
    Empty tables give an empty result. Items are taken in passes of at most ITEM_BYTES of terms (a single item
    beyond that is a pass of its own), so the driver and the tasks hold no more of them at a time.
    """
    spark = docs.sparkSession
    asked = write_stage(item_terms(items, item_col, item_text).withColumn("size", F.octet_length(F.concat_ws(" ", "terms"))), "item-terms")
    passes: list[DataFrame] = []
    held: list[tuple[int | None, list[str]]] = []
    size = 0
    for r in asked.toLocalIterator():
        if held and size + r.size > ITEM_BYTES:
            passes.append(search_pass(docs, held, k, id_col, text_col))
            held, size = [], 0
        held.append((r.item, r.terms))
        size += r.size
    if held:
        passes.append(search_pass(docs, held, k, id_col, text_col))
    if not passes:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS d, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM words WHERE len(ws) > 0),
tf AS (SELECT d, w, count(*) AS tf FROM (SELECT d, unnest(ws) AS w FROM words) GROUP BY d, w),
df AS (SELECT w, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, c GROUP BY w),
m AS (SELECT d, doc_id, 100 - 50 + (50 * len(ws) * n_docs) // n_terms AS m FROM words, c WHERE len(ws) > 0),
i AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) WHERE w <> ''),
s AS (SELECT item_id, doc_id, d, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN df USING (w) JOIN tf USING (w) JOIN m USING (d) GROUP BY item_id, doc_id, d),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50"""
