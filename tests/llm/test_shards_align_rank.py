"""Shards, token alignment and ranked search against brute force."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseframe.llm import alignment, ranking, sharding
from pulseframe.llm.common import write_stage

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 100, 1000, 4097])
def test_permutation_and_its_inverse(n):
    p, other = sharding.Permutation(n, 3), sharding.Permutation(n, 4)
    y = p.place(np.arange(n))
    assert sorted(y) == list(range(n)) and (p.row(y) == np.arange(n)).all()
    assert p.place(np.array([n - 1]))[0] == y[-1]
    assert n < 100 or (other.place(np.arange(n)) != y).sum() > n * 0.9


def test_permutation_mixes():
    n = 40_000
    y = sharding.Permutation(n, 0).place(np.arange(n))
    cells = np.bincount((np.arange(n) * 20 // n) * 20 + y * 20 // n, minlength=400)
    assert ((cells - n / 400) ** 2 / (n / 400)).sum() < 399 + 6 * math.sqrt(2 * 399)
    assert abs(np.corrcoef(y[:-1], y[1:])[0, 1]) < 0.03
    with pytest.raises(ValueError):
        sharding.Permutation(1 << 61)


def test_shards(spark, docs, rows, tmp_path):
    extra = docs.withColumns({"slot": F.lit("x"), "r": F.lit(1), "at": F.lit(2), "w": F.lit(3)})
    sharding.write_shards(extra, str(tmp_path / "a"), 8)
    back = sharding.read_shards(spark, str(tmp_path / "a"), extra)
    assert {"r", "at", "w", "start", "lang"} <= set(back.columns)
    got = sharding.digests(back).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), hashlib.md5((r[1] or "").encode()).hexdigest()))
    place = sharding.Permutation(len(rows), 0).place(np.arange(len(rows)))
    want = [(r[0] or -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "rows", p % 8, p // 8, g)
            for g, (r, p) in enumerate(zip(order, place.tolist()))]
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32, r.law, r.shard, r.slot, r.row_number) for r in got) == sorted(want)
    assert all(r.grown_shard is None for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {len(s) for s in slots.values()} <= {len(rows) // 8, len(rows) // 8 + 1}
    again = sharding.sharded(docs.repartition(7), 8).select("doc_id", "text", "shard", "slot")
    assert again.exceptAll(back.select("doc_id", "text", "shard", F.col("slot"))).count() == 0


def test_files_of_whole_rows_are_small(spark, tmp_path, monkeypatch):
    """The numbered rows and the shards, which stand on disk at the same time, take less than the rows as plain Parquet."""
    texts = [" ".join(f"word{i * k * k % 997}" for k in range(300)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "plain"), compression="snappy")
    monkeypatch.setattr(sharding, "write_stage", lambda df, name, *a: written.append(out := write_stage(df, name, *a)) or out)
    written = []
    sharding.write_shards(docs, str(tmp_path / "s"), 2)
    size = lambda files: sum(os.path.getsize(f.removeprefix("file:")) for f in files)
    plain = size(spark.read.parquet(str(tmp_path / "plain")).inputFiles())
    assert [size(w.inputFiles()) < 0.9 * plain for w in written] == [True]
    assert size(spark.read.parquet(str(tmp_path / "s")).inputFiles()) < 0.9 * plain


def test_equal_rows_and_empty_tables_in_shards(spark, empty):
    same = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("text"))
    got = sharding.sharded(same, 3).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top"), F.countDistinct("slot").alias("d")).collect()
    assert sorted((r.n, r.top, r.d) for r in got) == [(166, 165, 166), (167, 166, 167), (167, 166, 167)]
    assert sharding.sharded(empty, 8).count() == 0


TEXTS = ["", None, "hello world", " lead", "two  spaces ▁ sign", "plain ▁", "日本語 🎉 é", "x\0y\n\n\tcode", "<|endoftext|> <s> <0x41> <unk>", "aaaa" * 300,
         "ﬁ ½ ² İ", "It's 12 don't WE'LL", "hello world again hello world"]


def plain_alignment(texts):
    """Offsets, groups and links token by token."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {c: b for b, c in enumerate(alignment.byte_letters())}
    out, count = [], Counter()
    for t in texts:
        want = b" " + (t or "").encode()
        e = tok.encode(" " + (t or ""), add_special_tokens=False)
        a = [(i, bytes(byte_of[c] for c in s)) for i, s in zip(e.ids, e.tokens)]
        b = []
        for i in sp.encode(t or ""):
            s = sp.id_to_piece(i)
            b.append((i, bytes([int(s[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", s) else s.replace("▁", " ").encode()))
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            a, b = [], []
        spans = []
        for xs in (a, b):
            at, s = 0, []
            for i, x in xs:
                s.append((i, at, at + len(x)))
                at += len(x)
            spans.append(s)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, lo, shared = [], 0, 0
        for hi in cuts:
            ga, gb = ([str(i) for i, s, e in xs if lo <= s and e <= hi] for xs in spans)
            groups.append(",".join(ga) + "|" + ",".join(gb))
            shared += len(ga) * len(gb)
            lo = hi
        out.append((len(a), len(b), links, groups, shared))
        count.update(set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(na, nb, len(g), len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", s) for na, nb, ls, g, s in out]


def test_alignment(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(alignment, "EXPAND", 50)
    more = spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id long, text string")
    got = alignment.alignment_digests(docs.unionByName(more, allowMissingColumns=True).repartition(4), A, B).collect()
    texts = [r[1] for r in rows] + TEXTS
    ids = [r[0] for r in rows] + list(range(100, 100 + len(TEXTS)))
    assert sorted((r.doc_id or -1, *tuple(r)[1:]) for r in got) == sorted((i or -1, *w) for i, w in zip(ids, plain_alignment(texts)))
    assert alignment.alignment_digests(empty, A, B).count() == 0 and alignment.token_links(empty, A, B).count() == 0


def test_links_of_tokens(spark):
    got = alignment.token_links(spark.createDataFrame([(1, "hello world"), (2, None), (3, "abcabcabc xyzzy 12")], "doc_id long, text string"), A, B).collect()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].a_ids == [] and by_id[2].link_a == []
    for r in (by_id[1], by_id[3]):
        assert sum(r.link_bytes) == len({1: " hello world", 3: " abcabcabc xyzzy 12"}[r.doc_id])
        assert all(r.a_group[i] == r.b_group[j] for i, j in zip(r.link_a, r.link_b)) and r.a_group[0] == 0


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_sparse_products(most):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, (9, 7)) * (rng.random((9, 7)) < 0.4), rng.integers(0, 3, (7, 11)) * (rng.random((7, 11)) < 0.4)

    def csr(m):
        r, c = np.nonzero(m)
        return alignment.Csr(np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(m))))), c, m[r, c], m.shape[1])

    def dense(parts, shape):
        out = np.zeros(shape, int)
        for r, c, v in parts:
            out[r, c] += v
        return out
    assert (dense(csr(x).products(csr(y), most), (9, 11)) == x @ y).all()
    assert (dense(csr(y).transposed().products(csr(x).transposed(), most), (11, 9)) == (x @ y).T).all()


def plain_search(docs, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def words(t):
        return word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = []
    for i, ts in asked.items():
        found = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                found.append((-s, d is not None, d or 0))
        out += [(i, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("k, block", [(3, 7), (50, 100_000), (1, 1)])
def test_ranked_search(spark, docs, rows, monkeypatch, k, block):
    monkeypatch.setattr(ranking, "BLOCK_ROWS", block)
    monkeypatch.setattr(ranking, "PAIR_POSTINGS", 20)
    monkeypatch.setattr(ranking, "ITEM_BYTES", 300)
    items = [(1, "river stones and the old market 12"), (2, "bread, SALT; bread!"), (3, None), (4, "   "), (None, "quiet morning light"), (5, "nothinglikeit"),
             (2, "houses sold to people from hills"), (6, rows[0][1]), (7, rows[8][1]), (6, rows[0][1]), (8, "é 日本 ab x")]
    got = ranking.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)), k).collect()
    want = plain_search([r[:2] for r in rows], items, k)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_ranked_search_of_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert ranking.search(empty, items).count() == 0 and ranking.search(docs, items.limit(0)).count() == 0


def test_pair_bounds_are_tighter_and_hold():
    """No document's score passes its item's bound; joint bounds are less than the sums of term maxima."""
    rng = np.random.default_rng(3)
    n, terms = 400, 30
    held = [np.flatnonzero(rng.random(terms) < rng.random(terms) * 0.5).astype(np.int32) for _ in range(n)]
    sizes = np.array([len(h) for h in held])
    term = np.concatenate(held)
    tf = rng.integers(1, 9, len(term)).astype(np.int32)
    b = ranking.Block(rng.integers(5, 500, n), sizes, term, tf, rng.integers(100, 5000, terms), (n, n * 100))
    for _ in range(50):
        item = rng.choice(terms, 9, replace=False)
        score = np.zeros(n, np.int64)
        for t in item:
            docs, impact = b.list(t)
            score[docs] += impact
        units = b.units(item)
        assert score.max() <= sum(u[0] for u in units) < sum(b.most[t] for t in item)
        docs, best = b.best(item, 10, 0)
        want = np.lexsort((np.arange(n), -score))[:10]
        assert docs.tolist() == want.tolist() and best.tolist() == score[want].tolist()
