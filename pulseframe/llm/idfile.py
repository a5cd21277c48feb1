"""Token ids in an own compressed file format, and back.

Format. A file is a Parquet file of frames in ascending document order. A frame holds whole
documents: their ids (numbers and lengths as 64-bit integers) and its payload, blocks of
BLOCK ids (the last may be shorter), each coded on its own from a reset model, with its
byte length and the CRC-32 of its ids, and then the frame's distinct ids, the most frequent
first. A block that fails its checksum raises an error and harms no other block. A frame ends
at a document's end once it has FRAME ids, so a longer document makes a longer frame.

Coder. An id is coded as its rank among the frame's ids, and predicted in three orders: the id
that last followed the two ids before it (order 2), the id before it (order 1), and adaptive
frequencies of classes of ranks (order 0), taken anew every REFRESH ids. One symbol of three
outcomes says whether order 2 or else order 1 is right; if none is, the class follows and, in
plain bits, the rank within it. The symbol's probabilities mix three adaptive estimates by
weights that follow how well each has done. A range coder of 63 bits takes the probabilities;
carries are resolved when a block ends. All of it is integer arithmetic on arrays with one
lane for each block of a batch, so results do not depend on the machine, and numpy's cost is
shared by all lanes. A block: its number of coded words, these words, the plain bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulseframe.llm.common import pieces_of
from pulseframe.llm.wordbpe import encoded, process_words, whole_tokens

BLOCK = 2048
FRAME = 1 << 20
IDS = 1 << 16
CLASSES = 32
SLOTS = 1024
LANES = 3072
FRAMES = 8  # read at once
ONE = 1 << 15
BITS = 10
TOTAL = 1 << BITS
REFRESH = 256
LOW31 = (1 << 31) - 1
U = np.uint64
# Two probabilities side by side in 64 bits.
BOTH = (1 << 32) + 1
LOW32 = (1 << 32) - 1
FIELDS = ((1 << 28) - 1) * BOTH
LEAST = (ONE << 7) * BOTH
RIGHT = np.array([0, ONE - 1 >> 4, (ONE - 1 >> 4) << 32], U)
FRAME_SCHEMA = ("shard int, frame int, start_in_shard long, doc_ids binary, null_ids binary, doc_lengths binary, "
                "block_bytes binary, block_crcs binary, payload binary")


def edges() -> np.ndarray:
    """Where each class of ranks begins: 0, 1, 2, 3, then two classes an octave, so that a class holds a power of two."""
    return np.array([0, 1, 2, 3] + [b << k for k in range(1, 15) for b in (2, 3)] + [IDS], np.int64)


class Model:
    """The predictions of each lane, the same while encoding and decoding. Conditions are masks, -1 for true: numpy is quickest so."""

    def __init__(self, lanes: int):
        self.n, self.lanes, self.t = lanes, lanes, 0
        # Rank that came last after a context, << 3, and how sure it is; order 2, then order 1.
        self.last = np.full(2 * lanes * SLOTS, 0, np.int32)
        # Probability of order 2 in the low half, of order 1 in the high half.
        self.est = np.full(3 * lanes * 16, (ONE >> 2) * BOTH, U)
        self.bad = np.zeros((3, lanes), np.int64)
        self.prev, self.prev2, self.past = (np.zeros(lanes, np.int64) for _ in range(3))
        self.count = np.full((lanes, CLASSES), 2, np.int64)
        self.seen = np.zeros((REFRESH, lanes), np.uint8)
        self.held = 0
        self.keep(lanes)
        self.weigh()
        self.refresh()

    def keep(self, n: int) -> None:
        """Lanes from n on have ended."""
        self.n, self.k = n, np.arange(n)
        self.prev, self.prev2, self.past, self.count = self.prev[:n], self.prev2[:n], self.past[:n], self.count[:n]
        self.bad, self.seen = self.bad[:, :n], self.seen[:, :n]
        self.slot = np.stack((self.k, self.k + self.lanes)) * SLOTS
        self.place = (self.k + np.arange(3)[:, None] * self.lanes) * 16
        self.at, self.key, self.cell, self.value = np.empty((3, n), np.int64), np.empty((2, n), np.int64), self.k * CLASSES, self.k * TOTAL
        if self.t:  # as they were: what a lane does must not depend on when others end
            self.w = np.ascontiguousarray(self.w[:, :n])
            self.freq, self.start, self.class_at = self.freq[:n * CLASSES], self.start[:n * CLASSES], self.class_at[:n * TOTAL]

    def weigh(self) -> None:
        """An estimate's weight falls with the square of how far it was off, of late."""
        q = ((1 << 26) // (self.bad + 4096)) ** 2
        self.w = (q * (ONE - (ONE >> 7)) // q.sum(axis=0)).astype(U)
        self.bad >>= 1

    def refresh(self) -> None:
        """Frequencies of classes anew from the misses so far."""
        n = self.n
        if self.held:
            new = np.bincount((self.seen[:self.held] + self.k * (2 * CLASSES)).ravel(), minlength=n * 2 * CLASSES)
            self.count += new.reshape(n, 2 * CLASSES)[:, :CLASSES] * 8
            self.held = 0
        f = 1 + self.count * (TOTAL - CLASSES) // self.count.sum(axis=1)[:, None]
        f[self.k, f.argmax(axis=1)] += TOTAL - f.sum(axis=1)
        self.freq, self.start = f.ravel(), (np.cumsum(f, axis=1) - f).ravel()
        self.class_at = np.repeat(np.tile(np.arange(CLASSES, dtype=np.uint8), n), self.freq)
        if self.t & 511 == 0:
            self.count -= self.count >> 1

    def guess(self):
        """(the ranks that order 2 and order 1 predict, their probabilities in 1/ONE; the rest is a miss)."""
        if self.t & 15 == 0 and self.t:
            self.weigh()
            if self.t & (REFRESH - 1) == 0 or self.t in (16, 32, 64, 128):
                self.refresh()
        key, at = self.key, self.at
        np.multiply(self.prev, 40503, out=key[1])
        np.multiply(self.prev2, 30011, out=key[0])
        key[0] += key[1]
        key >>= 4
        key &= SLOTS - 1
        key += self.slot
        self.e = e = self.last.take(key)
        self.g, self.c = g, c = e >> 3, e & 7
        twice = c << 1
        twice[0] |= np.minimum(g[0] ^ g[1], 1)
        twice[1] |= c[0] >> 2
        at[:2] = twice
        at[2] = self.past
        at += self.place
        self.p = self.est.take(at)
        m = self.p * self.w
        mix = m[0]
        mix += m[1]
        mix += m[2]
        mix += LEAST
        return g, ((mix & LOW32) >> 15).view(np.int64), (mix >> 47).view(np.int64)

    def learn(self, x, x32, wrong, not2, miss, cls) -> None:
        """Rank x came. `wrong` says of each order whether it was, `miss` that both were and the class was coded."""
        p, e, c = self.p, self.e, self.c
        which = 1 - not2
        which &= ~miss
        if self.t & 15 == 0:
            chance = np.stack(((ONE * BOTH - p - (p << 32)) >> 32, p & LOW32, p >> 32)).view(np.int64)
            self.bad += 4 * (ONE - np.choose(which, chance))
        p -= (p >> 4) & FIELDS
        p += RIGHT.take(which)
        self.est[self.at.ravel()] = p.ravel()
        less = e - (c + 1 >> 1)
        less += ((x32 << 3) - less) & (c - 2 >> 31)
        more = np.minimum(e + 1, e | 7)
        more += (less - more) & wrong
        self.last[self.key.ravel()] = more.ravel()
        self.past <<= 2
        self.past |= which
        self.past &= 15
        np.bitwise_or(cls, ~miss.astype(np.uint8) & CLASSES, out=self.seen[self.held])
        self.held += 1
        self.prev2, self.prev = self.prev, x
        self.t += 1


class Words:
    """Numbers of up to 33 bits that each lane puts out, the uppermost bit being carried into the one before."""

    def __init__(self, lanes: int, room: int):
        self.lanes, self.out, self.pos = lanes, np.zeros(room * lanes, U), np.arange(lanes)

    def put(self, n: int, values, which) -> None:
        """A lane whose `which` is no -1 writes, too, but over its next number."""
        pos = self.pos[:n]
        self.out[pos] = values
        pos += which & self.lanes

    def finish(self) -> list[bytes]:
        n = self.pos // self.lanes
        out = self.out.reshape(-1, self.lanes)[:int(n.max())]
        for i in range(len(out) - 1, 0, -1):
            out[i - 1] += out[i] >> 32
        words = np.ascontiguousarray(out.T.astype(">u4"))
        return [words[i, :n].tobytes() for i, n in enumerate(n.tolist())]


class Encoder:
    """Range coder of 63 bits, and beside it the plain bits that place a rank in its class."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, 1 << 62, np.int64)
        self.acc, self.held = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.coded, self.plain = Words(lanes, steps * 27 // 32 + 4), Words(lanes, steps * 14 // 32 + 3)

    def put(self, n: int, f0, f1, not2, miss, start, freq) -> None:
        """That order 2 or order 1 is right, or a miss and the class from `start`."""
        r, low = self.range[:n], self.low[:n]
        q = r >> 15
        first, second = q * f0, q * f1
        wide = r - first
        wide -= second
        cell = wide >> BITS
        start *= cell
        start += second
        start &= miss
        start += first & not2
        low += start.view(U)
        cell *= freq
        second -= first
        second &= not2
        first += second
        cell -= first
        cell &= miss
        cell += first
        self.coded.put(n, low >> 31, small := cell - (1 << 31) >> 63)
        low &= (~small | LOW31).view(U)
        small &= 32
        low <<= small.view(U)
        np.left_shift(cell, small, out=r)

    def put_plain(self, n: int, value, bits) -> None:
        acc, held = self.acc[:n], self.held[:n]
        acc <<= bits
        acc |= value
        held += bits
        self.plain.put(n, ((acc >> (held - 32 & 63)) & LOW32).view(U), full := 31 - held >> 63)
        held -= full & 32

    def finish(self) -> list[bytes]:
        """Each lane: number of coded words, these, plain words. At least 31 bits of range are left, so one more word tells it."""
        n = len(self.low)
        self.coded.put(n, (self.low + U(LOW31)) >> 31, np.full(n, -1))
        self.plain.put(n, ((self.acc << 32 - self.held) & LOW32).view(U), -self.held >> 63)
        self.plain.out[self.plain.pos] = 0
        return [(len(a) // 4).to_bytes(2, "little") + a + b for a, b in zip(self.coded.finish(), self.plain.finish())]


class Decoder:
    def __init__(self, data: list[bytes]):
        heads = [2 + 4 * int.from_bytes(d[:2], "little") for d in data]
        base, words = self.words([d[2:h] for d, h in zip(data, heads)])
        self.code = words[base] << 31 | words[base + 1] >> 1
        self.next = (words[:-1] & 1) << 31 | words[1:] >> 1
        self.pos = base + 1
        self.range = np.full(len(data), 1 << 62, np.int64)
        base, words = self.words([d[h:] for d, h in zip(data, heads)])
        self.pairs, self.bit = words[:-1].view(U) << 32 | words[1:].view(U), base << 5

    def words(self, parts: list[bytes]):
        """Where each part begins, and all words; three of zeros follow a part."""
        parts = [d + bytes(12 + -len(d) % 4) for d in parts]
        sizes = np.array([len(d) // 4 for d in parts])
        return np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), ">u4").astype(np.int64)

    def look(self, n: int, f0, f1):
        """(order 2 is not right, a miss)"""
        r, code = self.range[:n], self.code[:n]
        q = r >> 15
        first, second = q * f0, q * f1
        not2 = first - 1 - code >> 63
        wide = r - first
        code -= first & not2
        miss = (second - 1 - code >> 63) & not2
        code -= second & miss
        wide -= second
        self.cell = wide >> BITS
        second -= first
        second &= not2
        first += second
        self.wide = first
        return not2, miss

    def look_class(self, n: int, class_at, value):
        v = (self.code[:n].view(U) // self.cell.view(U)).view(np.int64)
        np.minimum(v, TOTAL - 1, out=v)
        v += value
        return class_at.take(v)

    def take(self, n: int, miss, start, freq) -> None:
        code, cell = self.code[:n], self.cell
        start *= cell
        start &= miss
        code -= start
        cell *= freq
        cell -= self.wide
        cell &= miss
        cell += self.wide
        small, pos = cell - (1 << 31) >> 63, self.pos[:n]
        word = self.next.take(pos, mode="clip")
        word &= small
        pos -= small
        small &= 32
        code <<= small
        code |= word
        np.left_shift(cell, small, out=self.range[:n])

    def take_plain(self, n: int, bits, mask):
        bit = self.bit[:n]
        got = self.pairs.take(bit >> 5, mode="clip")
        got >>= (64 - (bit & 31) - bits).view(U)
        bit += bits
        return got.view(np.int64) & mask


def code_ranks(lengths: np.ndarray, ranks: np.ndarray | None, data: list[bytes] | None):
    """Encode rows of `ranks` (step, lane), or decode `data`; lanes are in descending order of length."""
    lanes, steps = len(lengths), int(lengths.max())
    model, edge = Model(lanes), edges()
    size = np.diff(edge)
    width = np.round(np.log2(size)).astype(np.int64)
    class_of = np.repeat(np.arange(CLASSES, dtype=np.uint8), size)
    if ranks is None:
        dec, enc, ranks = Decoder(data), None, np.zeros((steps, lanes), np.uint16)
    else:
        enc = Encoder(lanes, steps)
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()
    for t, n in enumerate(alive):
        if n < model.n:
            model.keep(n)
        g, f0, f1 = model.guess()
        if enc:
            x = ranks[t, :n].astype(np.int64)
            x32 = x.astype(np.int32)
            wrong = -(g ^ x32) >> 31
            not2 = wrong[0].astype(np.int64)
            miss = not2 & wrong[1]
            cls = class_of.take(x)
            at = model.cell + cls
            enc.put(n, f0, f1, not2, miss, model.start.take(at), model.freq.take(at))
            enc.put_plain(n, (x - edge.take(cls)) & miss, width.take(cls) & miss)
        else:
            not2, miss = dec.look(n, f0, f1)
            cls = dec.look_class(n, model.class_at, model.value)
            at = model.cell + cls
            dec.take(n, miss, model.start.take(at), model.freq.take(at))
            own = dec.take_plain(n, width.take(cls) & miss, size.take(cls) - 1)
            own += edge.take(cls)
            x = g[0] + ((g[1] - g[0]) & not2)
            x += (own - x) & miss
            x32 = x.astype(np.int32)
            ranks[t, :n] = x
            wrong = -(g ^ x32) >> 31
        model.learn(x, x32, wrong, not2, miss, cls)
    return enc.finish() if enc else ranks


def blocks_of(n: int) -> np.ndarray:
    return np.array([BLOCK] * (n // BLOCK) + [n % BLOCK] * (n % BLOCK > 0), np.int64)


def alphabet(ids: np.ndarray) -> np.ndarray:
    """The distinct ids, the most frequent first; equal ones by id."""
    n = np.bincount(ids)
    return np.argsort(-n, kind="stable")[:np.count_nonzero(n)]


def in_lanes(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of blocks that are coded side by side, longest first."""
    order = np.argsort(-lengths, kind="stable")
    yield from np.array_split(order, -(-len(order) // LANES))


def encode_frames(frames: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """(block byte lengths, block checksums, payload) of each array of ids; blocks are coded side by side."""
    lengths = np.concatenate([blocks_of(len(f)) for f in frames])
    flat = np.concatenate(frames)
    if not len(flat):
        return [(np.zeros(0, "<u4"), np.zeros(0, "<u4"), b"") for _ in frames]
    if flat.max() >= IDS:
        raise ValueError(f"ids from {IDS} on have no place in the format")
    own, ranks = [], []
    for f in frames:
        own.append(alphabet(f))
        rank_of = np.zeros(IDS, np.uint16)
        rank_of[own[-1]] = np.arange(len(own[-1]))
        ranks += np.split(rank_of.take(f), range(BLOCK, len(f), BLOCK)) if len(f) else []
    starts = np.cumsum(lengths) - lengths
    blocks = [b""] * len(lengths)
    for lanes in in_lanes(lengths):
        wide = np.zeros((len(lanes), int(lengths[lanes].max())), np.uint16)
        for i, r in zip(lanes.tolist(), wide):
            r[:lengths[i]] = ranks[i]
        for i, b in zip(lanes.tolist(), code_ranks(lengths[lanes], np.ascontiguousarray(wide.T), None)):
            blocks[i] = b
    raw = flat.astype("<u4").tobytes()
    crcs = [zlib.crc32(raw[4 * s:4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())]
    out, at = [], 0
    for f, a in zip(frames, own):
        k = len(blocks_of(len(f)))
        out.append((np.array([len(b) for b in blocks[at:at + k]], "<u4"), np.array(crcs[at:at + k], "<u4"),
                    b"".join(blocks[at:at + k]) + a.astype("<u2").tobytes()))
        at += k
    return out


def decode_frames(frames: list[tuple[int, bytes, bytes, bytes]]) -> list[np.ndarray]:
    """The ids of each frame (number of ids, block byte lengths, checksums, payload)."""
    lengths = np.concatenate([blocks_of(n) for n, *_ in frames])
    data, crcs, own = [], [], []
    for n, sizes, crc, payload in frames:
        ends = np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)).tolist()
        data += [payload[a:b] for a, b in zip([0] + ends[:-1], ends)]
        crcs += np.frombuffer(crc, "<u4").tolist()
        own.append(np.frombuffer(payload, "<u2", offset=ends[-1]).astype("<u4"))
    blocks = [None] * len(lengths)
    for lanes in in_lanes(lengths):
        ranks = np.ascontiguousarray(code_ranks(lengths[lanes], None, [data[i] for i in lanes.tolist()]).T)
        for i, r in zip(lanes.tolist(), ranks):
            blocks[i] = r[:lengths[i]]
    out, at = [], 0
    for (n, *_), a in zip(frames, own):
        k = len(blocks_of(n))
        ids = a.take(np.concatenate(blocks[at:at + k]), mode="clip")
        raw = ids.tobytes()
        for i in range(k):
            if zlib.crc32(raw[4 * BLOCK * i:4 * BLOCK * (i + 1)]) != crcs[at + i]:
                raise ValueError(f"block {i} of a frame does not match its checksum")
        out.append(ids)
        at += k
    return out


def integers(values, dtype: str = "<i8") -> bytes:
    return np.array(values, dtype).tobytes()


def write_frames(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text", coded_at_once: int = 6 << 20) -> None:
    """Encode every whole text and write the ids as files of frames under `path`.

    Documents are range-partitioned by id, so files ascend; a null id comes first. A null
    text is empty. `end_id` ends each document. A task codes frames of about
    `coded_at_once` ids side by side and holds no more than these and one document.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))

    def run(batches):
        words, shard = process_words(vocabulary, whole), TaskContext.get().partitionId()
        frames, ids, doc_ids, done, number, waiting = [], [], [], 0, 0, 0

        def close():
            nonlocal ids, doc_ids, waiting
            flat = np.concatenate(ids)
            frames.append((flat, doc_ids, [len(x) for x in ids]))
            ids, doc_ids, waiting = [], [], 0

        def rows():
            nonlocal frames, done, number
            coded = encode_frames([f[0] for f in frames])
            out = []
            for (flat, own, sizes), (lens, crcs, payload) in zip(frames, coded):
                out.append((shard, number, done, integers([x or 0 for x in own]), integers([x is None for x in own], "u1"),
                            integers(sizes), lens.tobytes(), crcs.tobytes(), payload))
                done += len(flat)
                number += 1
            frames = []
            for r in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(r, [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 6)],
                    ["shard", "frame", "start_in_shard", "doc_ids", "null_ids", "doc_lengths", "block_bytes", "block_crcs", "payload"])

        for batch in (p for b in batches for p in pieces_of(b)):
            for doc, x in zip(batch.column(0).to_pylist(), encoded(words, batch.column(1))):
                ids.append(x if end_id is None else np.append(x, np.uint32(end_id)))
                doc_ids.append(doc)
                waiting += len(ids[-1])
                if waiting >= FRAME:
                    close()
                    if sum(len(f[0]) for f in frames) >= coded_at_once:
                        yield from rows()
        if ids and waiting:
            close()
        elif ids:  # only empty documents
            frames.append((np.zeros(0, np.uint32), doc_ids, [0] * len(ids)))
        if frames:
            yield from rows()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id, or of none, go by their texts: their order is the same in every attempt, and many of them spread.
    by = ["doc_id", F.xxhash64("text")]
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = dealt.repartitionByRange(n, *by).sortWithinPartitions(*by, "text")
    dealt.mapInArrow(run, FRAME_SCHEMA).write.parquet(path)


def read_frames(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files under `path`."""
    frames = spark.read.schema(FRAME_SCHEMA).parquet(path)
    n = F.length("doc_lengths")
    shards = frames.groupBy("shard").agg(F.max(F.struct("start_in_shard", F.col("frame"))).alias("last"))
    held = frames.select("shard", "frame", "start_in_shard", "doc_lengths").where(n > 0)
    held = held.join(shards.select("shard", F.col("last.frame").alias("frame")), ["shard", "frame"])

    def totals(batches):
        for b in batches:
            own = [int(np.frombuffer(x, "<i8").sum()) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s + x for s, x in zip(b.column(1).to_pylist(), own)], pa.int64())],
                                             ["shard", "n"])
    # One row for each file: a running sum over them is small whatever the documents hold.
    size = held.select("shard", "start_in_shard", "doc_lengths").mapInArrow(totals, "shard int, n long")
    base = size.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))

    def run(batches):
        for rows in (b.slice(at, FRAMES).to_pylist() for b in batches for at in range(0, b.num_rows, FRAMES)):
            lengths = [np.frombuffer(r["doc_lengths"], "<i8") for r in rows]
            full = [(i, (int(m.sum()), r["block_bytes"], r["block_crcs"], r["payload"])) for i, (r, m) in enumerate(zip(rows, lengths)) if m.sum()]
            ids = dict(zip([i for i, _ in full], decode_frames([f for _, f in full]))) if full else {}
            for i, (r, m) in enumerate(zip(rows, lengths)):
                ends = np.cumsum(m)
                raw = ids[i].tobytes() if i in ids else b""
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), m.tolist())]
                null = np.frombuffer(r["null_ids"], "u1").astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(m), r["shard"]), pa.int32()), pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=null),
                     pa.array(r["start_in_shard"] + ends - m, pa.int64()), pa.array(m, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])
    docs = frames.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
