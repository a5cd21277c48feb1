"""SimHash near-duplicates with covering masks.

A fingerprint has a bit for each plane: 1 if it is set in over half of the hashes of the
text's word shingles. Fingerprints within `radius` differing bits are found by covering
masks: position i has the vector (i mod (2^(r+1) - 1)) + 1 of r+1 bits, and table v keeps
the positions whose vector has an odd inner product with v. Up to r vectors never span all
r+1 dimensions, so some v is orthogonal to all of them, and in its table the pair agrees.
Hence every pair within the radius meets in some table; each meeting is verified.

Defined results: null text is empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle make one shingle; equal texts share one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import components, map_rows, sorted_groups, utf8_texts, write_stage
from pulseframe.llm.xxh import xxh64_slices

SEED = 42
#: Rows of one bucket that are compared in one task; larger buckets are cut into pairs of such chunks.
CHUNK = 4096
#: Words of one text that are counted at a time: their sums fit 16 bits.
WORDS = 50_000
LANES = np.uint64(0x0001000100010001)
GOLDEN = 0x9E3779B97F4A7C15


def shingle_hashes(texts: list[bytes], size: int):
    """(text numbers, hashes): the XXH64 of each `size`-word shingle of the texts, A-Z in lower case.

    Yields about WORDS words at a time, so a text's shingles can come in several parts.
    """
    def parts():
        for i, text in enumerate(texts):
            words = text.lower().split()
            for at in range(0, max(1, len(words) - size + 1) if words else 0, WORDS):
                yield i, words[at:at + WORDS + size - 1]

    def hashed(held):
        words = [w for _, part in held for w in part]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        sizes = np.array([len(part) for _, part in held])
        n = np.maximum(1, sizes - size + 1)
        base = np.repeat(np.cumsum(sizes) - sizes, n)
        first = base + np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(first + size, np.repeat(np.cumsum(sizes), n)) - 1
        return np.repeat(np.array([i for i, _ in held]), n), xxh64_slices(b" ".join(words), starts[first], ends[last], SEED)

    held, n = [], 0
    for i, part in parts():
        held.append((i, part))
        n += len(part)
        if n >= WORDS:
            yield hashed(held)
            held, n = [], 0
    if held:
        yield hashed(held)


def planes(h: np.ndarray, words: int) -> list[np.ndarray]:
    """`words` 64-bit hashes of each shingle: itself, then mixes of it."""
    out = [h]
    for i in range(1, words):
        x = h + np.uint64(GOLDEN * i % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return out


def majority(texts: list[bytes], size: int, words: int = 1) -> np.ndarray:
    """The fingerprints of the texts, a row of `words` unsigned 64-bit integers for each.

    Bits are counted in 16-bit lanes of 64-bit sums: bit 16 k + j of a hash in lane k of sum j.
    """
    bits, count = np.zeros((len(texts), words, 16, 4), np.int64), np.zeros(len(texts), np.int64)
    for of, h in shingle_hashes(texts, size):
        at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        for w, x in enumerate(planes(h, words)):
            for j in range(16):
                lanes = np.add.reduceat((x >> np.uint64(j)) & LANES, at)
                bits[of[at], w, j] += lanes.view(np.uint16).reshape(-1, 4)
        count[of[at]] += np.diff(np.concatenate((at, [len(of)])))
    on = (2 * bits > count[:, None, None, None]).transpose(0, 1, 3, 2).reshape(len(texts), 64 * words)
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every whole text."""
    def run(batch):
        fps = majority(list(utf8_texts(batch.column(1))), shingle)[:, 0].view(np.int64)
        return pa.table({"doc_id": batch.column(0), "fp": pa.array(fps, pa.int64())})
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def masks(radius: int, bits: int = 64) -> list[int]:
    """The covering masks for `radius`, as signed 64-bit integers."""
    n = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >= 1 << 63 else m)
    return out


def covering_keys(fps: DataFrame, radius: int, *more: str) -> DataFrame:
    """table_no, bucket, node, w0 (and `more`) of each node in each of the tables."""
    entries = F.array(*[F.struct(F.lit(i).alias("table_no"), F.col("w0").bitwiseAND(F.lit(m)).alias("bucket"))
                        for i, m in enumerate(masks(radius))])
    return fps.select(F.explode(entries).alias("e"), "node", "w0", *more).select("e.table_no", "e.bucket", "node", "w0", *more)


def bucket_links(keys: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Edges (a, b) that connect what the pairs within `radius` bits in each bucket connect.

    keys: table_no, bucket, node and the fingerprint's `words`. A bucket of over CHUNK rows
    is cut into chunks and each pair of chunks is compared in a group of its own, so one
    bucket spreads over many tasks and none holds more than two chunks.
    """
    keys = write_stage(keys, "buckets")
    big = keys.groupBy("table_no", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    c = F.ceil(F.col("n") / CHUNK).cast("int")
    cut = keys.join(big, ["table_no", "bucket"], "left").withColumn("c", F.coalesce(c, F.lit(1)))
    cut = cut.withColumn("i", F.pmod(F.xxhash64("node"), F.col("c")).cast("int"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cut = cut.select("table_no", "bucket", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", *words)
    by = ["table_no", "bucket", "i", "j"]

    def run(t: pa.Table) -> pa.Table:
        group = np.zeros(t.num_rows, bool)
        for k in by:
            col = t[k].to_numpy()
            group[1:] |= col[1:] != col[:-1]
        ids = np.cumsum(group)
        fp = np.stack([t[w].to_numpy().view(np.uint64) for w in words], axis=1)
        a, b = link_groups(ids, fp, radius)
        node = t["node"].to_numpy()
        return pa.table({"a": pa.array(np.maximum(node[a], node[b]), pa.int64()), "b": pa.array(np.minimum(node[a], node[b]), pa.int64())})
    return sorted_groups(cut, by, run, "a long, b long", rows=50_000).distinct()


def link_groups(ids: np.ndarray, fp: np.ndarray, radius: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect, in each group of equal `ids`, what its pairs within `radius` connect."""
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(ids)])))
    left, right = [], []
    of = np.repeat(sizes, sizes)
    few = np.flatnonzero((of > 1) & (of <= small))
    for d in range(1, int(of[few].max()) if len(few) else 1):  # shift by d: all pairs of all small groups
        x = few[few + d < len(ids)]
        x = x[ids[x] == ids[x + d]]
        near = np.bitwise_count(fp[x] ^ fp[x + d]).sum(axis=1) <= radius
        left.append(x[near])
        right.append(x[near] + d)
    if left:
        left, right = spanning(np.concatenate(left), np.concatenate(right), len(ids))
        left, right = [left], [right]
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        lab = link_block(fp[s:s + n], radius)
        x = np.flatnonzero(lab != np.arange(n))
        left.append(x + s)
        right.append(lab[x] + s)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs that connect the same of n rows as the pairs (a, b)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        if (low == np.maximum(lab[a], lab[b])).all():
            break
        np.minimum.at(lab, a, low)
        np.minimum.at(lab, b, low)
        lab = lab[lab]
    x = np.flatnonzero(lab != np.arange(n))
    return x, lab[x]


def link_block(fp: np.ndarray, radius: int, rows: int = 256) -> np.ndarray:
    """For each row the first row that chains of rows within `radius` reach."""
    n = len(fp)
    lab = np.arange(n)
    while True:
        before = lab.copy()
        for at in range(0, n, rows):
            far = np.zeros((min(rows, n - at), n), np.uint16)
            for w in range(fp.shape[1]):
                far += np.bitwise_count(fp[at:at + rows, w, None] ^ fp[None, :, w])
            own = np.where(far <= radius, lab[None, :], n).min(axis=1)
            lab[at:at + rows] = np.minimum(lab[at:at + rows], own)
        while (jump := lab[lab] != lab).any():
            lab[jump] = lab[lab[jump]]
        if (lab == before).all():
            return lab


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs`.

    component_id is the smallest doc_id that chains of fingerprints within `radius` reach,
    itself included. Rows with a null id keep a row and count for no component_id.
    """
    fps = write_stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = write_stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = bucket_links(covering_keys(nodes.select(F.col("fp").alias("node"), F.col("fp").alias("w0")), radius), ["w0"], radius)
    roots = write_stage(components(links), "roots")
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = write_stage(nodes.join(low, "root").select("fp", "component_id"), "node-components")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Classes of shingles with a fingerprint of their own, and shingles that a class has at the finer of two levels.
CLASSES, CLASS_SIZE = 16, 3
#: Texts of at most so many shingles meet by single shingles instead of classes.
FEW = 64
#: Shingles of a group's texts that are compared in one task.
CHUNK_SHINGLES = 1 << 21


def distinct_shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text numbers, hashes) of the texts' distinct shingles, in that order."""
    parts = list(shingle_hashes(texts, size))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    of, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])))
    return of[new], h[new]


def class_fingerprints(of: np.ndarray, h: np.ndarray, n: int, words: int, similarity: float):
    """For `n` texts of these distinct shingles: fingerprints, `words` 64-bit integers for each
    text, and (text, table, key) triples of where texts of that similarity meet.

    A text of over FEW shingles meets others by classes. A level of 2^level classes deals
    shingles by their hash; classes 0 to CLASSES - 1 have a fingerprint. A text has the two
    levels around CLASS_SIZE shingles a class, so that texts of nearly equal size share one.
    A short text has as keys its smallest shingle hashes, one more than may be missing in a
    text of that similarity: every such pair shares one. Texts up to FEW / similarity shingles
    have these keys too, as a short text can be like them.
    """
    none = np.zeros(0, np.int64)
    wide = np.zeros((n, words), np.uint64)
    if not len(of):
        return wide, none, none, none.view(np.uint64)
    count = np.bincount(of, minlength=n)
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    for w, x in enumerate(planes(h, words)):
        wide[of[at], w] = grouped_majority(x, at)
    level = np.floor(np.log2(np.maximum(count / CLASS_SIZE, 1))).astype(np.int64)
    place = np.arange(len(of)) - np.repeat(at, np.diff(np.concatenate((at, [len(of)]))))
    keys = np.flatnonzero((count[of] <= FEW / similarity) & (place <= count[of] - np.ceil(similarity * count[of] - 1e-9)))
    out = [(of[keys], np.full(len(keys), 99), h[keys])]
    mixed = planes(h, words + 1)[words]
    for up in (0, 1):
        lv = level[of] + up
        cls = (mixed & ((np.uint64(1) << lv.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        on = np.flatnonzero((cls < CLASSES) & (count[of] > FEW))
        if len(on):
            on = on[np.lexsort((cls[on], of[on]))]
            edge = np.flatnonzero(np.concatenate(([True], (of[on][1:] != of[on][:-1]) | (cls[on][1:] != cls[on][:-1]))))
            first = on[edge]
            out.append((of[first], 100 + lv[first] * CLASSES + cls[first], grouped_majority(h[on], edge)))
    return wide, *(np.concatenate(x) for x in zip(*out))


def grouped_majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints of the groups of hashes that begin at `at`."""
    size = np.diff(np.concatenate((at, [len(h)])))
    bits = np.zeros((len(at), 64), bool)
    for j in range(64):
        bits[:, j] = 2 * np.add.reduceat((h >> np.uint64(j)) & np.uint64(1), at).astype(np.int64) > size
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]


def bits_apart(similarity: float, bits: int, deviations: float = 6) -> int:
    """Differing bits that fingerprints of sets of at least that Jaccard similarity hardly ever exceed.

    Six standard deviations over the mean; four for the worst short sets, of 4 and 5 members.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))))


def alike(of: np.ndarray, h: np.ndarray, own: np.ndarray, fp: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """For each text the first that chains of texts of at least that Jaccard similarity reach.

    of, h: distinct shingles of the texts. Texts of different parts `own` are compared, or all
    if there is one part only. Pairs that are chained already need no comparison.
    """
    n = len(own)
    ids = np.unique(h, return_inverse=True)[1]
    ends = np.searchsorted(of, np.arange(n + 1))
    sets = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
    size, lab = np.diff(ends), np.arange(n)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    cross = own.min() != own.max()
    for x in range(1, n):
        low, high = np.minimum(size[:x], size[x]), np.maximum(size[:x], size[x])
        near = (lab[:x] != lab[x]) & (low >= similarity * high - 1e-9)
        if cross:
            near &= own[:x] != own[x]
        y = np.flatnonzero(near)
        y = y[np.bitwise_count(fp[y] ^ fp[x]).sum(axis=1) <= radius]
        mark[sets[x]] = True
        while len(y):
            shared = int(mark[sets[y[0]]].sum())
            if shared >= similarity * (size[y[0]] + size[x] - shared) - 1e-9:
                one, other = sorted((lab[y[0]], lab[x]))
                lab[lab == other] = one
                y = y[lab[y] != one]
            else:
                y = y[1:]
        mark[sets[x]] = False
    return lab


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
                radius: int = 3) -> DataFrame:
    """doc_id, component_id of every row: texts whose distinct shingles have a Jaccard similarity of at least `similarity`, or linked by such.

    A text has a wide fingerprint of 256 bits over its shingles. Candidates are texts whose
    first 64 bits meet in a covering table (every pair within `radius`), that share one of
    the smallest shingle hashes (every pair, for short texts), or that agree in the
    fingerprint of a class of shingles, which pairs of that similarity nearly always do in
    one of CLASSES; and whose wide fingerprints are not too far apart. Groups of candidates
    are then compared by their shingles: only pairs of that exact similarity link. Texts of
    equal shingles are one node; a null id counts for no component_id.
    """
    words = ["w0", "w1", "w2", "w3"]
    apart = bits_apart(similarity, 256)

    def run(batch):
        texts = list(utf8_texts(batch.column(2)))
        of, h = distinct_shingles(texts, shingle)
        wide, sub_of, table_no, key = class_fingerprints(of, h, len(texts), 4, similarity)
        ends = np.searchsorted(of, np.arange(len(texts) + 1))
        node = xxh64_slices(h.tobytes(), 8 * ends[:-1], 8 * ends[1:], SEED).view(np.int64)
        entry = pa.StructArray.from_arrays([pa.array(table_no, pa.int32()), pa.array(key.view(np.int64))], ["table_no", "bucket"])
        order = np.argsort(sub_of, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(sub_of, minlength=len(wide)))))
        subs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), entry.take(pa.array(order)))
        return pa.table([batch.column(0), batch.column(1), pa.array(node), pa.array(np.diff(ends)), *(pa.array(wide[:, i].view(np.int64)) for i in range(4)), subs],
                        names=["doc_id", "text_key", "node", "size", *words, "subs"])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    fps = map_rows(own, run, f"doc_id long, text_key long, node long, size long, {', '.join(w + ' long' for w in words)}, subs array<struct<table_no int, bucket long>>")
    fps = write_stage(fps, "wide-fingerprints")
    nodes = write_stage(fps.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("size").alias("size"), *[F.min(w).alias(w) for w in words],
                                                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "subs")).alias("m")), "wide-nodes")
    keys = covering_keys(nodes, radius, *words[1:]).unionByName(
        nodes.select(F.explode("m.subs").alias("e"), "node", *words).select("e.table_no", "e.bucket", "node", *words))
    maybe = write_stage(components(bucket_links(keys, words, apart)), "candidates")
    links = exact_links(own, nodes, maybe, words, shingle, similarity, apart)
    roots = write_stage(components(links), "wide-roots")
    nodes = nodes.select("node", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.select("doc_id", "node").join(nodes.join(low, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def exact_links(own: DataFrame, nodes: DataFrame, maybe: DataFrame, words: list[str], shingle: int, similarity: float, apart: int) -> DataFrame:
    """Edges (a, b) that connect what the pairs of at least `similarity` in each group of `maybe` (node, root) connect.

    The text of a node is that of its row of the smallest id. As in bucket_links, a large
    group is cut into chunks, by its nodes and their shingles, and pairs of chunks are compared.
    """
    rows = maybe.join(nodes, "node").select("root", "node", "size", *words, F.coalesce("m.doc_id", F.lit(0)).alias("id"), F.col("m.doc_id").isNull().alias("no_id"),
                                            F.col("m.text_key").alias("text_key"))
    rows = write_stage(rows, "candidate-nodes")
    c = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("size") / CHUNK_SHINGLES)).cast("int")
    big = rows.groupBy("root").agg(c.alias("c")).where("c > 1")
    cut = rows.join(big, "root", "left").withColumn("c", F.coalesce("c", F.lit(1)))
    cut = write_stage(cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")), "candidate-chunks")
    texts = own.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key", "text")
    cut = texts.join(cut, ["id", "no_id", "text_key"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    by = ["root", "i", "j"]
    cut = cut.select("root", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own", "node", *words, "text")

    def run(t: pa.Table) -> pa.Table:
        edge = np.zeros(t.num_rows, bool)
        for k in by:
            col = t[k].to_numpy()
            edge[1:] |= col[1:] != col[:-1]
        starts = np.concatenate((np.flatnonzero(np.concatenate(([True], edge[1:]))), [t.num_rows]))
        node, a, b = t["node"].to_numpy(), [], []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            g = t.slice(s, e - s)
            fp = np.stack([g[w].to_numpy().view(np.uint64) for w in words], axis=1)
            lab = alike(*distinct_shingles(list(utf8_texts(g["text"].combine_chunks())), shingle), g["own"].to_numpy(), fp, similarity, apart)
            x = np.flatnonzero(lab != np.arange(e - s))
            a.append(node[s + x])
            b.append(node[s + lab[x]])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})
    return sorted_groups(cut, by, run, "a long, b long", rows=CHUNK).where("a <> b").distinct()
