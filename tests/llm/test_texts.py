"""Extraction, tokens, pieces, id files, licences against the libraries or brute force."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from pulseframe.llm import extract, idfile, licences, pieces, wordbpe

WORD_BPE, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


def test_page_text(spark):
    html = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><a href="/">Home</a></nav>
      <article><h1>Main &amp; title</h1><p>First  part<br>of it &lt;3<p>Second <b>bold</b> part.</article>
      <div class="comments"><p>A reader has said something rather long about all of this.</p></div><footer>Foot</footer>"""
    rows = [(1, "u", html), (2, None, None), (None, "v", ""), (4, "w", "<p"), (1, "u", html), (5, "x", "<article><p>5 < 6 and so on</p>")]
    got = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "Main & title\n\nFirst part of it <3\n\nSecond bold part."
    assert sorted(r.text for r in got) == sorted([want, "", "", "", want, "5 < 6 and so on"])
    assert all(r.n_chars == len(r.text) for r in got)


def test_the_tree_fits_its_table():
    tree = extract.trained()
    for html, labels in extract.LABELLED:
        assert extract.kept(tree, extract.features(extract.blocks(html))).tolist() == [bool(x) for x in labels]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "content-with-nav", "search-page", "site hasSidebar"])
@pytest.mark.parametrize("header", ['<div class="article-header">{}</div>', '<header class="entry-header">{}</header>'])
def test_wrappers_of_a_text_are_not_beside_it(name, header):
    body = "<p>The ferry runs again from Monday, the town said in a letter.</p><p>It had been closed since March.</p>"
    html = f"""<div class="{name}"><div class="site-header"><p>The Daily Note, every day of the year.</p></div><article>{header.format("<h1>The ferry</h1>")}{body}</article>
      <div class="share-buttons"><p>Share this with your friends.</p></div><div class="main-nav"><p>All of our pages are here.</p></div></div>"""
    tree = extract.trained()
    found = extract.blocks(html)
    keep = extract.kept(tree, extract.features(found))
    assert [b[0] for b, k in zip(found, keep) if k] == ["The ferry", "The ferry runs again from Monday, the town said in a letter.", "It had been closed since March."]
    found = extract.blocks(f'<div class="search"><main><h1>The ferry</h1>{body}</main><p>Side.</p></div>')
    assert [b[4] for b in found] == [False, False, False, True]


@pytest.mark.parametrize("unit", ["<div>x", "<a <a ", "<a<a", "</p>", '<a ">" ', "<a '", "<b><p>x", "<!-", "</title", "<h1><i>x", '<a title="x>'])
@pytest.mark.parametrize("end", ["", ">"])
def test_broken_markup_takes_time_by_its_length(unit, end):
    html = "<title>t" * (unit == "</title") + unit * (1_000_000 // len(unit)) + end
    begun = time.process_time()
    extract.blocks(html)
    extract.blocks("<div>" * 5_000 + html)
    assert time.process_time() - begun < 20


@pytest.mark.parametrize("name, kept", [("legal-history", True), ("social-reform", True), ("social-links", False), ("legal", False), ("share-buttons", False)])
def test_subjects_of_an_article_are_not_beside_it(name, kept):
    found = extract.blocks(f'<article><p>First.</p><div class="{name}">Second part.</div></article>')
    assert [b[4] for b in found] == [False, not kept]


def test_ends_of_tags():
    """Quotes hide a `>`; where they leave no end of a tag, the first `>` ends it."""
    def texts(html):
        return [b[0] for b in extract.blocks(html)]
    assert texts("""<p title="a > b" id='x>y'>one<p title="open>two</p>""") == ["one", "two"]
    assert texts("five <!-- no > <p>no -->six<? x > 5 < 6 <!-- end") == ["five six 5 < 6"]
    assert texts("one <b two") == ["one <b two"] and texts("<p") == ["<p"]


ODD = ["", "<|endoftext|> a<|startoftext|>", "Σας ΣΑΣ", "it's 12 don't WE'LL !!'s", "İstanbul ſ ²½ x̀e", "a\x1cb\x0bc d　e", "A\tB\r\nc", "x" * 3000]


def test_token_counts(docs, rows):
    tok = wordbpe.load(WORD_BPE)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in wordbpe.token_counts(docs, WORD_BPE, limit=50).collect())
    n = [len(tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    assert got == sorted((r[0] or 0, len((r[1] or "").encode()), k, k > 50) for r, k in zip(rows, n))


def test_ids_equal_the_library():
    tok, words = wordbpe.load(WORD_BPE), wordbpe.Words(WORD_BPE, wordbpe.whole_tokens(WORD_BPE))
    assert [x.tolist() for x in wordbpe.encoded(words, ODD)] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]


@pytest.mark.parametrize("sizes", [[1], [5, 0, 2048], [2049, 4096], [6000]])
def test_frames_come_back(sizes):
    rng = np.random.default_rng(1)
    frames = [np.where(rng.random(n) < 0.5, 7, rng.integers(0, 65536, n)).astype(np.uint32) for n in sizes]
    coded = idfile.encode_frames(frames)
    packed = [(len(f), a.tobytes(), b.tobytes(), c) for f, (a, b, c) in zip(frames, coded)]
    full = [p for p in packed if p[0]]
    assert [x.tolist() for x in idfile.decode_frames(full)] == [f.tolist() for f in frames if len(f)]


def test_a_spoiled_block_is_noticed():
    coded = idfile.encode_frames([np.arange(3000, dtype=np.uint32)])[0]
    bad = bytearray(coded[2])
    bad[10] ^= 255
    with pytest.raises(ValueError):
        idfile.decode_frames([(3000, coded[0].tobytes(), coded[1].tobytes(), bytes(bad))])


def test_repeated_ids_are_coded_in_few_bytes():
    ids = np.tile(np.array([5, 900, 44, 13]), 5000).astype(np.uint32)
    assert len(idfile.encode_frames([ids])[0][2]) < len(ids) // 4


def frame_ids(rng, n):
    """Ids as texts have them: a few are frequent, many follow what they followed before."""
    ids = np.minimum(rng.zipf(1.3, n), 40000) - 1
    back = rng.integers(1, 400, n)
    for i in range(400, n):
        if i % 9 < 5:
            ids[i] = ids[i - back[i - i % 9]]
    return ids.astype(np.uint32)


def test_blocks_coded_together_are_read_apart(monkeypatch):
    rng = np.random.default_rng(4)
    frames = [frame_ids(rng, n) for n in (9000, 2048, 300, 7001, 1)]
    coded = idfile.encode_frames(frames)
    packed = [(len(f), a.tobytes(), b.tobytes(), c) for f, (a, b, c) in zip(frames, coded)]
    assert [idfile.decode_frames([p])[0].tolist() for p in packed] == [f.tolist() for f in frames]
    monkeypatch.setattr(idfile, "LANES", 3)
    assert [x.tolist() for x in idfile.decode_frames(packed)] == [f.tolist() for f in frames]
    assert [c[2] for c in idfile.encode_frames(frames)] == [c[2] for c in coded]


def test_ids_take_fewer_bytes_than_deflate():
    frame = frame_ids(np.random.default_rng(6), 100_000)
    raw = frame.astype("<u2").tobytes()
    deflated = sum(len(zlib.compress(raw[i:i + 4096], 6)) for i in range(0, len(raw), 4096))
    sizes, _, payload = idfile.encode_frames([frame])[0]
    assert len(payload) + sizes.nbytes < deflated


def test_ids_beyond_the_format_are_refused():
    with pytest.raises(ValueError):
        idfile.encode_frames([np.array([5, 1 << 16], np.uint32)])


def test_contractions_and_letters_beyond_ascii_equal_the_library():
    tok, words = wordbpe.load(WORD_BPE), wordbpe.Words(WORD_BPE, wordbpe.whole_tokens(WORD_BPE))
    rng = random.Random(2)
    common = [*"abcsStTrReEvVlLdDmM''''12  \"!.-\n\t", "é", "É", "²", "Ɓ", "ǅ", "¼"]
    signs = common + ["×", "Ⱥ", "İ", "ɐ", "\x85", "\xa0", "日", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs if i % 4 == 0 else common) for _ in range(rng.randint(0, 30))) for i in range(900)]
    texts += [None, "'", "'l", "x'", "aⱥȺ"]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in wordbpe.encoded(words, texts)] == want
    assert wordbpe.counted(words, texts).tolist() == [len(x) for x in want]
    assert wordbpe.encoded(words, []) == []


def test_id_files(spark, docs, rows, tmp_path):
    tok = wordbpe.load(WORD_BPE)
    fine = [r for r in rows if r[0] is not None and r[0] != 10]
    idfile.write_frames(docs.where("doc_id <> 10"), str(tmp_path / "f"), WORD_BPE, end_id=1)
    at, want = 0, []
    for r in sorted(fine, key=lambda r: r[0]):
        x = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(map(tuple, idfile.read_frames(spark, str(tmp_path / "f")).collect())) == want
    idfile.write_frames(docs, str(tmp_path / "g"), WORD_BPE)
    got = idfile.read_frames(spark, str(tmp_path / "g"))
    assert got.count() == len(rows) and got.where("doc_id IS NULL").count() == 2
    idfile.write_frames(docs.limit(0), str(tmp_path / "h"), WORD_BPE)
    assert idfile.read_frames(spark, str(tmp_path / "h")).count() == 0


def test_rows_of_one_id_have_one_order_and_spread(spark, tmp_path):
    rows = [(d, f"text {i} " * (i % 7)) for d in (3, None) for i in range(60)]
    found = []
    for k in (1, 5):
        df = spark.createDataFrame(rows[::-1] if k == 5 else rows, "doc_id long, text string").repartition(k)
        idfile.write_frames(df, str(tmp_path / f"n{k}"), WORD_BPE, end_id=1)
        found.append(sorted(((r.doc_id or 0, *r[1:]) for r in idfile.read_frames(spark, str(tmp_path / f"n{k}")).collect()), key=lambda r: (r[1], r[2])))
    assert found[0] == found[1] and len(found[0]) == 120
    at = 0
    for r in found[0]:
        assert r[1] == at
        at += r[2]
    assert spark.read.parquet(str(tmp_path / "n1")).select("shard").distinct().count() > 2


PLAIN = ["", " ", "  a  b ", "\n\n x\t", "日本語 🎉 é", "a" * 500, "x\0y", "    code\n        indent", "Hello, World!! 1234"]


def test_pieces_without_dropout_equal_the_library():
    sp, p = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Pieces(PIECES, 0, 1, 1)
    for t in PLAIN:
        assert p.encode(t, 3) == sp.encode(t)
        assert p.decode(p.encode(t, 3)) == t


def test_dropout_varies_and_loses_nothing(docs, rows):
    p, other, plain = pieces.Pieces(PIECES, 0.3, 1, 4), pieces.Pieces(PIECES, 0.3, 2, 4), pieces.Pieces(PIECES, 0, 1, 1)
    t = "several different words stand here and return later: several different words"
    assert p.encode(t, 1) == p.encode(t, 1) and len({tuple(p.encode(t, d)) for d in range(8)}) > 2
    assert p.encode(t, 1) != other.encode(t, 1) and len(p.encode(t, 1)) > len(plain.encode(t, 1))
    for x in [*PLAIN, "▁ literal ▁"]:
        assert p.decode(p.encode(x, 5)) == x
    got = pieces.digests(docs, PIECES).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    more = pieces.encoded(docs, PIECES)
    assert more.where("NOT (decoded <=> coalesce(text, ''))").count() == 0 and set(docs.columns) <= set(more.columns)


def test_every_occurrence_has_draws_of_its_own(spark):
    """Segmentations of a word are as frequent as with a random number for each draw, in one document and over many."""
    p, rng, n = pieces.Pieces(PIECES, 0.1, 13), np.random.default_rng(1), 8000
    word = next(w for w in ("bridge", "market", "people", "stone") if len(pieces.Pieces(PIECES, 0, 1).encode(w, 1)) == 1)
    want = Counter(p.segment(" " + word, lambda i, r: rng.random() < 0.1) for _ in range(n))
    many = Counter(tuple(p.encode(word, d)) for d in range(n))
    one = p.encode(" ".join([word] * n), 1)
    whole = max(want, key=want.get)
    assert len(whole) == 1 and abs(one.count(whole[0]) - want[whole]) < 0.03 * n
    assert len(many) > 4 and all(abs(many[k] - want[k]) < 0.03 * n for k in {*many, *want})
    rows = [(d, word) for d in range(300)]
    got = pieces.digests(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    assert len({r.ids_crc32 for r in got}) > 4 and all(r.lossless for r in got)
    again = pieces.Pieces(PIECES, 0.1, 13)  # what is remembered does not matter
    t = "x" * 300 + " several different words and several more "
    assert [again.encode(t, d) for d in (5, 3)] == [p.encode(t, d) for d in (5, 3)]


@pytest.mark.parametrize("dropout, variants", [(0, 0), (0.1, 0), (0.5, 0), (0.3, 3)])
def test_parts_merged_side_by_side_take_the_agenda_way(monkeypatch, dropout, variants):
    """Each occurrence has the ids of an agenda of its own, drawn one by one; short parts need no agenda."""
    p, rng = pieces.Pieces(PIECES, dropout, 7, variants), np.random.default_rng(3)
    letters = [*"etaoinsr  ", *"é日🎉▁\n"]
    texts = [*PLAIN, "the quick market bridges " * 40, *("".join(rng.choice(letters, 200)) for _ in range(20)), "y" * 64, "z" * 65, ""]

    def by_agenda(t, d):
        parts, ids = p.parts.findall(" " + t) if t else [], []
        for part, own in zip(parts, p.occurrences(parts, d).tolist() if parts else []):
            ids += p.segment(part, lambda i, r: (own ^ pieces.one_mixed(r << 32 | i)) * pieces.MIX % 2**64 < p.dropout)
        return ids
    want = [by_agenda(t, d) for d, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "AT_ONCE", 64)
    monkeypatch.setattr(pieces, "CELLS", 100)
    assert [x.tolist() for x in p.encode_all(texts, list(range(len(texts))))] == want
    monkeypatch.setattr(p, "segment", None)
    short = [i for i, t in enumerate(texts) if all(len(x) <= pieces.LONGEST for x in p.parts.findall(" " + t))]
    assert [p.encode(texts[i], i) for i in short] == [want[i] for i in short] and len(short) > 25


def plain_scan(t, threshold):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w, places, base = words.findall(low), [], set()
    for phrase, label in licences.PHRASES.items():
        q = phrase.split()
        here = [i for i in range(len(w) - len(q) + 1) if w[i:i + len(q)] == q]
        places += here
        base |= {label} if here else set()
    labels, best = set(base), 0.0
    for line in low.split("\n"):
        for label, template in licences.TEMPLATES:
            own = set(template.split())
            c = len(own & set(words.findall(line))) / len(own)
            if c >= threshold:
                labels.add(label)
                best = max(best, c)
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if places else best)


@pytest.mark.parametrize("threshold", [0.92, 0.6])
def test_licences(spark, rows, docs, threshold):
    more = [(900, "cc by cc by CC-BY\nall rights reserved all rights reserved"), (901, "This is under the GNU General Public License, version 3."),
            (902, "under license the apache 2.0 version, licensed"), (903, "License MIT the under released"), (904, "éall rights reservedé all rights")]
    extra = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    got = licences.scan(docs.unionByName(extra, allowMissingColumns=True), threshold).collect()
    want = [(d or 0, *plain_scan(t, threshold)) for d, t in [*[r[:2] for r in rows], *more]]
    assert sorted(map(str, ((r.doc_id or 0, *tuple(r)[1:]) for r in got))) == sorted(map(str, want))


def test_empty_tables(spark, empty):
    assert wordbpe.token_counts(empty, WORD_BPE).count() == 0 and pieces.digests(empty, PIECES).count() == 0
    assert licences.scan(empty).count() == 0
    assert extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
