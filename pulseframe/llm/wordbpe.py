"""Token counts and ids with a word-end BPE vocabulary, through a whole-token shortcut.

Which vocabulary strings encode alone as one token is proven once on the driver by encoding
each of them with the library. Texts split into pre-tokens, by the classes of their bytes and
many texts at a time; those that are whole tokens are looked up, and only the rest is merged,
by the library, once for each distinct pre-token of a worker process. The own splitter is used
for texts of characters below U+0250 without the special strings, where lower case,
composition and character classes are the same everywhere; any other text goes to the library
as a whole. So results equal the library's in every case.
"""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import map_rows, per_process

#: Pre-tokens whose ids a worker process remembers before it forgets them all.
REMEMBER = 1_000_000
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*")
#: Classes of characters; LEAD is a first byte of two.
SPACE, LETTER, NUMBER, OTHER, HARD, LEAD = range(6)
LOWER = bytes(range(256)).lower()


def char_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def splitter() -> re.Pattern:
    """The vocabulary's pre-token pattern for characters below U+0250."""
    letter, number = char_class("L"), char_class("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+")


def character_classes() -> tuple[bytes, np.ndarray]:
    """(class of each byte, of each character below U+0250). HARD: not PLAIN, or no letter of its own class in lower case."""
    def kind(c: str) -> int:
        if not PLAIN.fullmatch(c) or len(c.lower()) != 1 or unicodedata.category(c)[0] != unicodedata.category(c.lower())[0]:
            return HARD
        return SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)
    kinds = [kind(chr(c)) for c in range(0x250)]
    lead = [LEAD if 0xC2 <= b < 0xC0 + (0x250 >> 6) + 1 else HARD for b in range(128, 256)]
    return bytes(kinds[:128] + lead), np.array(kinds + [HARD] * 64, np.uint8)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def whole_tokens(path: str, suffix: str = "</w>") -> dict[str, int]:
    """Strings that the library encodes alone as one token, and that token; at most the vocabulary."""
    tok = load(path)
    names = [v[:-len(suffix)] for v in tok.get_vocab() if v.endswith(suffix)]
    texts = sorted({s for s in names if s} | {tok.decode([i]).strip() for i in tok.get_vocab().values()})
    split = splitter()
    texts = [s for s in texts if PLAIN.fullmatch(s) and split.fullmatch(s) and s == s.lower()]
    return {s: e.ids[0] for s, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1}


class Numbers(dict):
    """Gives each new key the next number and remembers it as waiting for its ids."""

    def __init__(self, known):
        super().__init__((w, i) for i, w in enumerate(known))
        self.waiting: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.waiting.append(word)
        return n


class Words:
    """Numbers the pre-tokens that a worker process meets and holds the ids of each."""

    def __init__(self, path: str, whole: dict[str, int]):
        from tokenizers.pre_tokenizers import ByteLevel
        self.tok, self.whole = load(path), whole
        self.model = self.tok.model
        self.ascii, self.two_bytes = character_classes()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # The model takes bytes as characters; the ASCII ones of a pre-token stand for themselves.
        letters = {chr(c).lower() for c in range(0x80, 0x250)}
        self.as_bytes = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in letters if len(c) == 1}
        self.forget()

    def forget(self) -> None:
        self.number = Numbers(self.whole)
        self.flat, self.n = np.fromiter(self.whole.values(), np.uint32, len(self.whole)), np.ones(len(self.whole), np.int64)
        self.start = np.arange(len(self.whole))

    def hard(self, column: pa.Array, raw: bytes, classes: np.ndarray, starts: np.ndarray) -> list[int]:
        """The texts that the own splitter does not take."""
        found = np.searchsorted(starts, np.flatnonzero(classes == HARD), side="right") - 1
        found = set(np.unique(found).tolist())
        for s in (s for s in self.special if s.encode() in raw):
            found.update(np.flatnonzero(pc.match_substring(column, s).to_numpy(zero_copy_only=False)).tolist())
        return sorted(found)

    def classes(self, column: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(the texts' bytes, the class of the character each belongs to, where each text begins, and the end)."""
        starts = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
        raw = (column.buffers()[2] or pa.py_buffer(b"")).slice(int(starts[0]), int(starts[-1] - starts[0])).to_pybytes()
        out = np.frombuffer(bytearray(raw.translate(self.ascii)), np.uint8)
        lead = np.flatnonzero(out == LEAD)
        if len(lead):
            b = np.frombuffer(raw, np.uint8)
            out[lead] = out[lead + 1] = self.two_bytes[(b[lead].astype(np.int64) - 0xC0 << 6) + (b[lead + 1] & 63)]
        return raw, out, starts - starts[0]

    def numbers(self, raw: bytes, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pre-tokens, how many begin before each text and before the end)"""
        n = len(raw)
        b = np.frombuffer(raw, np.uint8)
        begins = np.ones(n + 1, bool)
        if n:
            np.not_equal(classes[1:], classes[:-1], out=begins[1:n])
            begins[:n] |= (classes == NUMBER) & ((b & 0xC0) != 0x80)
            begins[starts] = True
        # Contractions: an apostrophe that begins a pre-token, and the letters after it.
        first = np.zeros(n + 1, bool)
        first[starts] = True
        at = np.flatnonzero(b == 39)
        at = at[begins[at] & ~first[at + 1]]
        low = np.append(np.frombuffer(raw.translate(LOWER), np.uint8), np.zeros(2, np.uint8))
        one, two = low[at + 1], np.where(first[np.minimum(at + 2, n)], 0, low[np.minimum(at + 2, n + 1)])
        short = np.isin(one, list(b"stmd"))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        begins[at[short | long] + 1] = False
        begins[at[long] + 2] = False
        begins[at[short] + 2] = True
        begins[at[long] + 3] = True
        cuts = np.flatnonzero(begins)
        held = classes[cuts[:-1]] != SPACE
        words = pa.StringArray.from_buffers(len(held), pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(low))
        words = words.filter(pa.array(held)).dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = np.fromiter(map(self.number.__getitem__, map(str.lower, known)), np.int64, len(known))
        upto = np.concatenate(([0], np.cumsum(held)))
        return own[words.indices.to_numpy()], upto[np.searchsorted(cuts, starts)]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each pre-token's begin, how many it has), after the library's model merged those that wait."""
        if self.number.waiting:
            merge = self.model.tokenize
            new = [[t.id for t in merge(w if w.isascii() else w.translate(self.as_bytes))] for w in self.number.waiting]
            self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(new), np.uint32)))
            self.n = np.concatenate((self.n, np.fromiter(map(len, new), np.int64)))
            self.start = np.cumsum(self.n) - self.n
            self.number.waiting = []
        return self.flat, self.start, self.n

    def looked_up(self, texts) -> tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
        """(numbers of pre-tokens, how many come before each text and in all, the texts taken whole by the library, their ids)."""
        if len(self.number) > REMEMBER:
            self.forget()
        column = (texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).fill_null("")
        found = self.classes(column)
        hard = self.hard(column, *found)
        whole = [np.array(self.tok.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in hard]
        if hard:
            easy = np.ones(len(column), bool)
            easy[hard] = False
            found = self.classes(pc.if_else(pa.array(easy), column, ""))
        return *self.numbers(*found), hard, whole


def process_words(path: str, whole) -> Words:
    """The words of this worker process; `whole` is the broadcast of whole_tokens(path)."""
    return per_process(("words", path), lambda: Words(path, whole.value))


def encoded(words: Words, texts: pa.Array | list[str]) -> list[np.ndarray]:
    """The ids of each text; a null text is empty."""
    x, before, hard, whole = words.looked_up(texts)
    flat, start, n = words.table()
    m = n[x]
    upto = np.concatenate(([0], np.cumsum(m)))
    at = np.repeat(start[x] - upto[:-1], m)
    at += np.arange(len(at))
    out = np.split(flat[at], upto[before[1:-1]]) if len(texts) else []
    for i, ids in zip(hard, whole):
        out[i] = ids
    return out


def counted(words: Words, texts: pa.Array | list[str]) -> np.ndarray:
    """How many tokens each text has; a null text is empty."""
    x, before, hard, whole = words.looked_up(texts)
    out = np.diff(np.concatenate(([0], np.cumsum(words.table()[2][x])))[before])
    out[hard] = [len(ids) for ids in whole]
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text; a null text is empty."""
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batch):
        n = counted(process_words(path, whole), batch.column(1))
        return pa.table({"doc_id": batch.column(0), "n_bytes": pc.binary_length(batch.column(1).fill_null("")).cast(pa.int64()),
                         "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
                    "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
