"""SimHash, repeats and contamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from pulseframe.llm import contamination, repeats, simhash
from pulseframe.llm.common import components
from pulseframe.llm.xxh import xxh64_slices
from tests.llm.conftest import text


def test_hash_equals_the_library():
    rng = random.Random(1)
    data = rng.randbytes(2000)
    s = np.array([rng.randint(0, 1500) for _ in range(500)])
    e = s + np.array([rng.randint(0, 300) for _ in range(500)])
    assert xxh64_slices(data, s, e).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(s, e)]


def plain_fingerprint(t):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_components_of_near_fingerprints(docs, rows):
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(r[0], plain_fingerprint(r[1])) for r in rows]
    root = plain_components({f for _, f in fps}, 3)
    low = {}
    for d, f in fps:
        if d is not None:
            low[root[f]] = min(low.get(root[f], d), d)
    assert got == sorted((d or 0, format(f, "016x"), low.get(root[f])) for d, f in fps)


def test_covering_masks_meet_every_pair():
    rng = random.Random(2)
    for radius in (1, 2, 3):
        masks = simhash.masks(radius)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), radius):
                y ^= 1 << b
            assert any((x & m & (2**64 - 1)) == (y & m & (2**64 - 1)) for m in masks)


def test_a_hot_bucket_is_cut_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    rng = random.Random(3)
    fps = {rng.getrandbits(63)}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    fps |= {rng.getrandbits(63) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "w0 long").selectExpr("w0", "w0 AS node")
    links = simhash.bucket_links(simhash.covering_keys(df, 3), ["w0"], 3)
    got = {r.node: r.root for r in components(links).collect()}
    want = plain_components(fps, 3)
    groups, seen = {}, {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
        seen.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


def test_near_copies(spark):
    rng = random.Random(4)
    base = [text(rng, n).split() for n in (15, 40, 150, 600)]
    rows, want = [], []
    for i, w in enumerate(base):
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 4):
            v = list(w)
            if len(w) > 100:
                v[rng.randrange(20, len(w) - 20)] = f"new{k}"
            rows.append((10 * i + k, " ".join(v)))
        want += [(10 * i + k, 10 * i) for k in range(4)]
    rows += [(100 + i, text(rng, 80)) for i in range(20)]
    want += [(100 + i, 100 + i) for i in range(20)]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(want)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_near_copies_have_the_exact_similarity(spark, monkeypatch, chunk):
    """Pairs around the threshold, short and long: only exact Jaccard similarity of 0.8 links."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(11)
    rows = [(0, None), (1, ""), (2, " ")]
    for n in [5, 8, 9, 12, 13, 15, 30, 60, 70, 85, 120, 300] * 4:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for share in (1, 0.7, 0.78, 0.8, 0.82):  # a passage of so many shingles' share, then other words
            keep = n if share == 1 else int(np.ceil(2 * share / (1 + share) * (n - 4))) + 4
            rows.append((len(rows), " ".join(base[:keep] + [f"x{rng.randrange(10**6)}" for _ in range(n - keep)])))
    sets = {d: {tuple((t or "").split()[i:i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_suffix_order_and_common_prefixes():
    rng = random.Random(6)
    for k in range(60):
        b = bytes(rng.choices(b"ab\0" if k % 2 else b"a", k=rng.randint(1, 200)))
        t = np.frombuffer(b, np.uint8)
        sa = repeats.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = repeats.common_prefixes(t, sa, 20).tolist()
        for i in range(1, len(sa)):
            x, y = b[sa[i]:], b[sa[i - 1]:]
            n = next((j for j in range(20) if x[j:j + 1] != y[j:j + 1] or j >= len(x) or j >= len(y)), 20)
            assert lcp[i] == n


def plain_repeats(rows, least=100):
    """Per row: bytes, removed, runs and digest; equal id and text are one document, null ids come last."""
    seen, out = {}, {}
    for d, t in sorted({(d if d is not None else 2**63 - 1, t or "") for d, t in rows}):
        b, gone = t.encode(), set()
        for i in range(len(b) - least + 1):
            w = b[i:i + least]
            if w in seen:
                gone |= set(range(i, i + least))
            seen.setdefault(w, 1)
        left = bytes(x for i, x in enumerate(b) if i not in gone)
        out[d, t] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(left).hexdigest())
    return sorted((d or 0, *out[d if d is not None else 2**63 - 1, t or ""]) for d, t in rows)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(docs, rows, monkeypatch, hot):
    if hot:  # anchors of two segments count as hot and are dealt over many shards
        for name, value in (("HOT_SHARE", 1), ("HOT_COUNT", 2), ("HOT_SEGMENTS", 1)):
            monkeypatch.setattr(repeats, name, value)
    mine = [(d, t) for d, t, *_ in rows if not (d is None and t and len(t) > 500)]
    df = docs.where("NOT (doc_id IS NULL AND length(text) > 500)")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect())
    assert got == plain_repeats(mine)


def test_equal_windows_have_equal_anchors_across_the_cuts(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1024)
    monkeypatch.setattr(repeats, "PLACE", np.uint64(1023))
    rng = random.Random(12)
    text_ = bytes(rng.choices(b"abcdefgh", k=5000))
    found = []
    for shift in (0, 17, 68, 500):
        _, anchor, _, _, _, start, n, _ = repeats.anchored([bytes(rng.choices(b"xyz", k=shift)) + text_], np.array([1]), np.array([0]), 100, {})
        of = {s + i - shift: a for s, k, a in zip(start.tolist(), n.tolist(), anchor.tolist()) for i in range(k)}
        found.append([of[i] for i in range(5000 - 99)])
        assert len(of) == len(text_) + shift - 99
    assert all(f == found[0] for f in found)


def test_cut_texts_keep_characters_and_columns(spark):
    a = "".join(chr(0xE0 + i % 30) + str(i) for i in range(60)) + "end"
    df = spark.createDataFrame([(1, a, 0, "x"), (2, "q" + a, 0, "y"), (3, None, 0, "z")], "doc_id long, text string, n_chars long, t string")
    out = {r.doc_id: r for r in repeats.cut_texts(df).collect()}
    assert out[1].text == a and out[2].text == "q" and out[2].n_chars == 1 and out[3].text is None and out[2].t == "y"


def plain_leaks(rows, items, least=0.8):
    def grams(w):
        return [tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    counts = {i: grams((t or "").lower().split()) for i, t in items}
    share = {}
    for i, g in counts.items():
        for s in set(g):
            share.setdefault(s, set()).add(i)
    sizes, found = {len((t or "").lower().split()) for _, t in items}, {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, g in counts.items():
            n = len((dict(items)[i] or "").lower().split())
            if not n or n < 5 and n != len(w):
                continue
            for at in range(max(1, len(w) - n + 1)):
                x = grams(w[at:at + n])
                keys = set(x) | set(g)
                lo = sum(min(x.count(s), g.count(s)) / len(share.get(s, "1")) for s in keys)
                hi = sum(max(x.count(s), g.count(s)) / len(share.get(s, "1")) for s in keys)
                if hi and lo / hi >= least:
                    found[d, i] = max(found.get((d, i), 0), round(lo / hi, 9))
    assert sizes
    return found


def test_contamination(spark, docs, rows):
    rng = random.Random(7)
    long_ = next(t for d, t, *_ in rows if d == 9).split()
    items = [(1, " ".join(long_[100:130])), (2, " ".join(long_[500:560] + ["another", "end"])), (3, text(rng, 40)), (4, None), (5, ""), (6, "one"),
             (7, " ".join(long_[100:125] + text(rng, 10).split())), (8, " ".join(long_[900:920]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in contamination.leaks(docs, bench).collect()}
    want = plain_leaks([r[:2] for r in rows if r[0] is not None and len(r[1] or "") < 40_000], items)
    assert got == want and (9, 1) in got and (9, 2) in got and (7, 6) in got and (9, 8) in got


def test_contamination_of_repeated_and_odd_items(spark):
    """Items of equal text do not protect each other, a null id is an item, one id can have two texts, no radius refuses."""
    rng = random.Random(13)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(n)] for n in (58, 40, 30))
    near = [*a[:20], "changed", *a[21:]]
    items = [(1 + i, " ".join(a)) for i in range(10)] + [(None, " ".join(b)), (50, " ".join(c)), (50, " ".join(b[::-1]))]
    docs = [(1, " ".join(["x", *near, "y"])), (2, " ".join(["x", "y", *b])), (3, " ".join(c)), (4, " ".join(b[::-1]))]
    many = []
    for d in range(100, 700):  # one word at the end of 13 changed: similarity 8 of 10
        w = [f"v{rng.randrange(10**6)}" for _ in range(13)]
        items.append((d, " ".join(w)))
        docs.append((d, " ".join([*w[:-1], "other"])))
        many.append((d, d))
    got = contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == sorted([(1, 1 + i) for i in range(10)] + [(2, 0), (3, 50), (4, 50)] + many)


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_copies(empty).count() == 0
    assert repeats.without_repeats(empty).count() == 0 and repeats.cut_texts(empty).count() == 0
    assert contamination.leaks(empty, bench).count() == 0
