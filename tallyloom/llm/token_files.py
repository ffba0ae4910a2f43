"""Token ids as binary shards, packed by an adaptive context-mixing range coder.

A shard holds the ids of consecutive documents in key order, as places in the sorted list of the ids that it has. These are
cut into blocks of BLOCK. Each block is coded with models that start anew, so any block can be read alone, and carries the
CRC-32 of its ids. Orders 1 and 2 predict an id from the one and the two ids before it, by what followed them last in the
block, each with a confidence; how often each confidence has been right is learned, and both estimates are mixed by
weights that follow how well each order has done. The mix is the probability of the predicted id; the rest of the range
goes to all ids by order 0, the shard's own frequencies, kept in its header. Many blocks are coded side by side, one
numpy lane each.

File: MAGIC, a header (documents, ids, blocks, ids in a block, bytes of order 0, bits of its sum; 6 x uint64), for each
block its ids, 32-bit words and CRC-32 (3 x uint32), for each document its key (int64), whether it has one (uint8) and its
ids (uint32), order 0 (ids uint32, then frequencies uint32, deflated), then the blocks' words. All little-endian.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.shared import MOST_SHARDS, commit_files, fresh_path, hashed, located, manifest, shards_of, small_batches
from tallyloom.llm.token_counts import CONTRACTIONS, LETTER, NUMBER, OTHER, RESET, WHITE_MORE, byte_letters, classes

MAGIC = b"TLTOKEN2"
BLOCK, LANES = 1024, 4096
#: Contexts of an order in a block are numbers of SLOT bits. Frequencies of order 0 sum to 1 << PRIOR, or more where a shard
#: has many ids, up to 1 << MOST_PRIOR; probabilities are of 1 << ODDS.
SLOT, PRIOR, MOST_PRIOR, ODDS = 9, 18, 20, 12
#: Probabilities lie between LOWEST and LOWEST + FROM_TO.
LOWEST, FROM_TO = np.int16(32), np.int16((1 << ODDS) - 64)
ONE, FIVE, TOP, SPREAD = np.uint32(1), np.uint32(5), np.uint32(32 - SLOT), np.uint32(0x9E3779B1)
U = np.uint64
WORD, WORD_BITS = U((1 << 32) - 1), U(32)


class Prior:
    """Order 0: a shard's ids in ascending order with frequencies, at least 1 each, that sum to 1 << bits."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray, bits: int):
        self.ids, self.freq, self.bits = ids.astype(np.uint32), freqs.astype(np.int64), bits
        self.cum = np.cumsum(self.freq) - self.freq
        self.found = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.freq)
        self.both = (self.cum << 32 | self.freq).view(U)

    def part(self, places: np.ndarray, hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of an id's part of the range: the first ones of 1 << ODDS if it was predicted, else its share of the rest."""
        size, rest, first = self.both.take(places), U(1 << ODDS) - first, first << U(self.bits)
        start = size >> WORD_BITS
        size &= WORD
        start *= rest
        start += first
        size *= rest
        at = np.flatnonzero(hit)
        start[at], size[at] = 0, first.take(at)
        return start, size

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Prior, np.ndarray]:
        """Order 0 of these ids, and their places in it."""
        if not len(ids):
            return cls(np.zeros(1), np.full(1, 1 << PRIOR), PRIOR), np.empty(0, np.int32)
        if int(ids.max()) < 1 << 22:
            counts = np.bincount(ids)
            own = np.flatnonzero(counts)
            counts, lookup = counts[own], np.zeros(len(counts), np.int32)
            lookup[own] = np.arange(len(own), dtype=np.int32)
            places = lookup.take(ids)
        else:
            own, places, counts = np.unique(ids, return_inverse=True, return_counts=True)
        bits = max(PRIOR, (len(own) - 1).bit_length() + 1)
        if bits > MOST_PRIOR:
            raise ValueError(f"a shard has {len(own)} different ids; make shards smaller")
        f = counts * ((1 << bits) - len(own)) // len(ids) + 1
        f[f.argmax()] += (1 << bits) - f.sum()
        return cls(own, f, bits), places.astype(np.int32)

    def packed(self) -> bytes:
        return zlib.compress(self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())

    @classmethod
    def unpacked(cls, data: bytes, bits: int) -> Prior:
        raw = np.frombuffer(zlib.decompress(data), "<u4").reshape(2, -1)
        return cls(raw[0], raw[1], bits)


def chosen(which: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.where for int32, by bits: which is at random, so that a branch for each would often be guessed wrong."""
    mask = which.astype(np.int32)
    np.negative(mask, out=mask)
    mask &= a ^ b
    mask ^= b
    return mask


class Lanes:
    """Models and range coder state of n blocks that advance together. The first k lanes go on.

    Arrays of two rows hold order 1 and order 2. What follows a context is a place of an id and a confidence in one number
    (place << 3 | confidence; 0 before the context is met). The lanes' cells of one context lie side by side, as do those of
    one confidence: most lanes are at a few frequent ones, which thus stay in the processor's cache.
    """

    def __init__(self, n: int):
        self.seen = np.zeros(2 * n << SLOT, np.int32)
        self.right = np.full(2 * n * 16, 1 << (ODDS - 1), np.int16)
        self.weight = np.full(n, 1 << (ODDS - 1), np.int32)
        order, lane = np.arange(2, dtype=np.int32).reshape(2, 1) * n, np.arange(n, dtype=np.int32)
        self.n, self.slots, self.rows, self.last = n, (order << SLOT) + lane, (order << 4) + lane, np.zeros(n, np.uint32)
        self.contexts = self.slots
        self.low, self.width, self.at = np.zeros(n, U), np.full(n, U((1 << 64) - 1), U), np.zeros(n, np.int64)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The predicted id's place, its probability of 1 << ODDS, and what learn() needs."""
        at = self.contexts[:, :k].astype(np.int64)
        was = self.seen.take(at, mode="clip")
        c, s = was & 7, was >> 3
        guess = chosen(c[1] > 0, s[1], s[0])
        row = c * self.n
        row += self.rows[:, :k]
        row[0] += (s[0] != guess) * np.int32(8 * self.n)
        row = row.astype(np.int64)
        p = self.right.take(row, mode="clip")
        lead = p[0] - p[1]
        mixed = lead * self.weight[:k]
        mixed >>= ODDS
        mixed += p[1]
        return guess, mixed.astype(U), (at, was, c, s, row, p, lead)

    def learn(self, places: np.ndarray, hit: np.ndarray, told: tuple, k: int) -> None:
        """Hits raise a confidence by 1, up to 7, misses halve it, to 1 at least; what had 1 or none then gives way to the new id."""
        at, was, c, s, row, p, lead = told
        goal = hit * FROM_TO
        goal += LOWEST
        new = goal - p
        new >>= 5
        new += p
        self.right[row.ravel()] = new.ravel()
        w, turn = self.weight[:k], hit * np.int16(2)
        turn -= 1
        turn *= lead
        turn >>= 5
        w += turn
        np.maximum(w, LOWEST, out=w)
        np.minimum(w, LOWEST + FROM_TO, out=w)
        now = chosen(c < 2, places << 3 | 1, was - ((c + 1) >> 1))
        now = chosen(s == places, was + (c < 7), now)
        self.seen[at.ravel()] = now.ravel()
        one = (places.view(np.uint32) + ONE) * SPREAD
        two = ((one ^ (self.last[:k] >> FIVE)) * SPREAD) >> TOP
        self.last = one
        self.contexts = np.empty((2, k), np.int32)
        self.contexts[0], self.contexts[1] = one >> TOP, two
        self.contexts *= self.n
        self.contexts += self.slots[:, :k]

    def narrow(self, start: np.ndarray, size: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the part [start, start + size) of 1 << (bits + ODDS) of the ranges.

        Ranges that have become smaller than 1 << 32 move 32 bits on, cut before if they reach over a multiple of 1 << 32.
        Returns those lanes, the bits that leave, and the place of these among the lane's words.
        """
        low, width = self.low[:k], self.width[:k]
        width >>= U(bits + ODDS)
        low += width * start
        width *= size
        idx = np.flatnonzero(width <= WORD)
        x, at = low.take(idx), self.at.take(idx)
        low[idx] = x << WORD_BITS
        width[idx] = np.minimum(width.take(idx), WORD - (x & WORD) + U(1)) << WORD_BITS
        self.at[idx] = at + 1
        return idx, (x >> WORD_BITS).astype(np.uint32), at


def by_length(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of at most LANES blocks and about as many each, longest first: their numbers, and for each step how many still go on."""
    order = np.argsort(-lengths, kind="stable")
    for some in np.array_split(order, -(-len(order) // LANES)) if len(order) else ():
        yield some, np.searchsorted(-lengths[some], -np.arange(lengths[some[0]]), side="left")


def encode_blocks(places: np.ndarray, prior: Prior) -> list[np.ndarray]:
    """The 32-bit words of each block of BLOCK places."""
    lengths = np.full(-(-len(places) // BLOCK), BLOCK, np.int64)
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(lengths)
    if len(lengths):
        lengths[-1] -= len(lengths) * BLOCK - len(places)
    for some, going in by_length(lengths):
        n, most = len(some), int(lengths[some[0]])
        ids = np.zeros((most, n), np.int32)
        for lane, b in enumerate(some):
            ids[: lengths[b], lane] = places[b * BLOCK : b * BLOCK + lengths[b]]
        m, words = Lanes(n), np.zeros((n, most + 3), np.uint32)  # a step sends a word at most
        for t, k in enumerate(going.tolist()):
            now = ids[t, :k]
            guess, p, told = m.predict(k)
            hit = guess == now
            idx, word, at = m.narrow(*prior.part(now, hit, p), k, prior.bits)
            words[idx, at] = word
            m.learn(now, hit, told, k)
        lanes = np.arange(n)
        words[lanes, m.at], words[lanes, m.at + 1] = (m.low >> WORD_BITS).astype(np.uint32), (m.low & WORD).astype(np.uint32)
        for lane, b in enumerate(some):
            out[b] = words[lane, : m.at[lane] + 2].copy()
    return out


def decode_blocks(packed: list[np.ndarray], lengths: np.ndarray, prior: Prior) -> np.ndarray:
    """The places of all blocks, one after the other, from their words."""
    out, starts = np.empty(int(lengths.sum()), np.int32), np.cumsum(lengths) - lengths
    for some, going in by_length(lengths):
        n, most, bits = len(some), int(lengths[some[0]]), prior.bits
        words = np.zeros((n, max(len(packed[b]) for b in some) + 3), np.uint32)
        for lane, b in enumerate(some):
            words[lane, : len(packed[b])] = packed[b]
        m, ids = Lanes(n), np.zeros((most, n), np.int32)
        code, last = (words[:, 0].astype(U) << WORD_BITS) | words[:, 1].astype(U), words.shape[1] - 1
        for t, k in enumerate(going.tolist()):
            guess, p, told = m.predict(k)
            v, wide = ((code[:k] - m.low[:k]) // (m.width[:k] >> U(bits + ODDS))).view(np.int64), p.view(np.int64)
            np.minimum(v, (1 << (bits + ODDS)) - 1, out=v)
            v -= wide << bits
            hit = v < 0
            np.maximum(v, 0, out=v)
            now = chosen(hit, guess, prior.found.take((v / ((1 << ODDS) - wide)).astype(np.int64)))  # exact: both are small whole numbers
            idx, _, at = m.narrow(*prior.part(now, hit, p), k, bits)
            code[idx] = (code.take(idx) << WORD_BITS) | words[idx, np.minimum(at + 2, last)]
            m.learn(now, hit, told, k)
            ids[t, :k] = now
        for lane, b in enumerate(some):
            out[starts[b] : starts[b] + lengths[b]] = ids[: lengths[b], lane]
    return out


def packed_shard(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file's bytes. ids: uint32."""
    prior, places = Prior.of(ids)
    packed, order0 = encode_blocks(places, prior), prior.packed()
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    sums = [zlib.crc32(raw[4 * i : 4 * (i + BLOCK)]) for i in range(0, len(ids), BLOCK)]
    table = np.array([(min(BLOCK, len(ids) - BLOCK * i), len(p), c) for i, (p, c) in enumerate(zip(packed, sums, strict=True))], "<u4").reshape(-1, 3)
    return b"".join([
        MAGIC, struct.pack("<6Q", len(keys), len(ids), len(packed), BLOCK, len(order0), prior.bits), table.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is not None for k in keys], np.uint8).tobytes(), np.asarray(lengths).astype("<u4").tobytes(), order0, *(p.astype("<u4").tobytes() for p in packed),
    ])


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, numbers of ids, and ids of a shard file; raises if a block's checksum is wrong."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, _, blocks, _, order0, bits = struct.unpack_from("<6Q", data, 8)
    at = 56
    table = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * blocks
    keys = np.frombuffer(data, "<i8", docs, at).tolist()
    has = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    prior = Prior.unpacked(data[at : at + order0], bits)
    ends = at + order0 + 4 * np.cumsum(table[:, 1])
    packed = [np.frombuffer(data, "<u4", int(w), int(e - 4 * w)) for w, e in zip(table[:, 1], ends, strict=True)]
    ids = prior.ids.take(decode_blocks(packed, table[:, 0], prior))
    raw, start = memoryview(ids).cast("B"), 0
    for n, crc in zip(table[:, 0].tolist(), table[:, 2].tolist(), strict=True):
        if zlib.crc32(raw[4 * start : 4 * (start + n)]) != crc:
            raise ValueError("a block's checksum is wrong")
        start += n
    return [k if h else None for k, h in zip(keys, has, strict=True)], lengths.astype(np.int64), ids


def cuts(points: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which characters begin a pretoken, by the usual pattern of byte-level BPE; at heads a text begins anew."""
    c = CLASSES.take(points)
    c[heads] = RESET
    before, after = np.concatenate(([RESET], c[:-1])), np.concatenate((c[1:], [RESET]))
    joins = np.concatenate(([False], points[:-1] == 32))  # after a space, which goes with what follows
    joins[heads[heads < len(joins) - 1] + 1] = False
    begins = np.where(c == WHITE_MORE, (before != WHITE_MORE) | (after <= OTHER), (c != before) & ~joins)
    begins[heads] = True
    quote = np.flatnonzero((points == 39) & begins)
    if len(quote):
        ahead = np.concatenate((points, np.zeros(3, points.dtype)))
        one, two = ahead[quote + 1], ahead[quote + 2]
        short = np.isin(one, [ord(x) for x in CONTRACTIONS[1]])
        long = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in CONTRACTIONS[2]])
        begins = np.concatenate((begins, np.zeros(3, bool)))
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 2] = False
        begins[quote[long] + 3] = True
    return begins[: len(points)]


assert (LETTER, NUMBER, OTHER) == (0, 1, 2)
CLASSES = np.empty(0, np.uint8)


class Short:
    """Numbers of pretokens of 1 to 15 bytes, nearly all that a text has, looked up at once.

    A key is 64 bits: of at most 7 bytes, these and their number. Longer ones (more: True) have their first 8 bytes as a
    second column; the key holds the other bytes and the number of all.
    """

    SPREAD, STIR = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)

    def __init__(self, bits: int = 16, more: bool = False):
        self.bits, self.used = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)
        self.more = np.zeros(1 << bits, U) if more else None

    def at(self, keys: np.ndarray, more: np.ndarray | None) -> np.ndarray:
        return (((keys if more is None else keys ^ (more * self.STIR)) * self.SPREAD) >> U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        """Their numbers, -1 for a key that isn't there."""
        at, out = self.at(keys, more), np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys.take(at)
            hit = there == keys
            if more is not None:
                hit &= self.more.take(at) == more
            out[todo[hit]] = self.numbers.take(at[hit])
            on = np.flatnonzero(~hit & (there != 0))
            todo, keys, at, more = todo[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1), None if more is None else more[on]
        return out

    def add(self, keys: np.ndarray, numbers: np.ndarray, more: np.ndarray | None = None) -> None:
        """Different keys that aren't there, each with its own number. Of those that want one place one has it, the others go on. Half of the places stay free."""
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = self.keys != 0
            keys, numbers = np.concatenate((self.keys[old], keys)), np.concatenate((self.numbers[old], numbers))
            more = None if more is None else np.concatenate((self.more[old], more))
            self.__init__((2 * self.used - 1).bit_length(), more is not None)
            self.used = len(keys)
        at = self.at(keys, more)
        while len(keys):
            own = self.keys.take(at) == 0
            self.numbers[at[own]] = numbers[own]
            own &= self.numbers.take(at) == numbers
            self.keys[at[own]] = keys[own]
            if more is not None:
                self.more[at[own]] = more[own]
                more = more[~own]
            keys, numbers, at = keys[~own], numbers[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def those(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Keys, numbers and second column of those whose number is marked in which."""
        at = np.flatnonzero(self.keys)
        at = at[which.take(self.numbers.take(at))]
        return self.keys.take(at), self.numbers.take(at), None if self.more is None else self.more.take(at)


def first_bytes(eight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many bytes of each 64 bits, at most 7; the others are 0."""
    return eight & ((U(1) << (sizes << U(3))) - U(1))


class Encoder:
    """Texts' ids as the tokenizers library gives them. It encodes each pretoken alone, so its model is asked for those not met before.

    About MOST pretokens that were met are kept at most, of MOST_BYTES each at most: 80 MB. When there are more, those that no
    later call had are forgotten, most of which never come again.
    """

    MOST, MOST_BYTES = 1_000_000, 100
    #: Pretokens that the library gets at once; it takes hundreds of bytes for each.
    ASKED = 16_384

    def __init__(self, path: str):
        global CLASSES
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(path) as f:
            told = json.load(f)
        self.library = Tokenizer.from_file(path)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
        added = [a["content"] for a in told.get("added_tokens", []) if not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"])]
        #: Only for byte-level BPE with the usual pattern; other tokenizers encode whole texts.
        self.plain = bool(plain and len(added) == len(told.get("added_tokens", [])))
        if self.plain and not len(CLASSES):
            CLASSES = classes()
        self.merger = Tokenizer(self.library.model)
        self.merger.pre_tokenizer = CharDelimiterSplit("\n")
        self.letters, vocab = np.full(256, ord("\n"), "<u2"), self.library.get_vocab()
        if self.plain:
            self.library = None  # its model is the merger's too; the rest isn't asked
        self.length = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.length[i] = len(token)
        for letter, byte in byte_letters().items():
            if byte < 0xFF:  # which no UTF-8 text has: here it stands between pretokens
                self.letters[byte] = ord(letter)
        self.added = {a["content"]: a["id"] for a in told.get("added_tokens", [])}
        self.parts = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")").split if added else lambda t: [t]
        self.forget()

    def forget(self) -> None:
        """Number 0 is a head, 1 ... the added tokens, then pretokens as they come: where their ids begin and how many they are."""
        self.known: dict[bytes, int] = {}  # those of more than 15 bytes
        self.short, self.middle = Short(), Short(more=True)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), len(self.added)
        self.first, self.size, self.again = np.zeros(1 << 18, np.int32), np.zeros(1 << 18, np.int32), np.zeros(1 << 18, bool)
        self.ids[: self.used] = list(self.added.values())
        self.first[1 : self.used + 1], self.size[1 : self.used + 1] = range(self.used), 1
        self.number = {a: i for i, a in enumerate(self.added, 1)}
        self.count = self.used + 1

    def thin(self) -> None:
        """Forgets the pretokens that weren't met again since they were learnt, or since the last time; all if hardly any would go."""
        words = [x for x, n in self.known.items() if self.again[n]]
        tables = [self.short.those(self.again), self.middle.those(self.again)]
        numbers = np.concatenate([*(t[1] for t in tables), np.fromiter(map(self.known.get, words), np.int64, len(words))])
        ids, sizes = self.of(numbers), self.size.take(numbers)
        self.forget()
        if 4 * len(numbers) <= 3 * self.MOST and len(ids) <= 6 * self.MOST:
            at = self.count
            self.put(ids, sizes)
            for table, (keys, _, more) in zip((self.short, self.middle), tables, strict=True):
                table.add(keys, np.arange(at, at + len(keys)), more)
                at += len(keys)
            self.known.update(zip(words, range(at, self.count), strict=True))

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pretokens, one after the other."""
        size = self.size.take(numbers)
        ends = np.cumsum(size, dtype=np.int64)
        at = np.repeat(self.first.take(numbers) - ends + size, size)
        at += np.arange(len(at))
        return self.ids.take(at)

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Further pretokens, their ids, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        small, middle, long = np.flatnonzero(lengths <= 7), np.flatnonzero((lengths > 7) & (lengths <= 15)), np.flatnonzero(lengths > 15).tolist()
        self.short.add(np.array([words[i] for i in small.tolist()], "S8").view("<u8") | lengths[small].astype(U) << U(56), self.count + small)
        both = np.array([words[i] for i in middle.tolist()], "S16").view("<u8").reshape(-1, 2)
        self.middle.add(both[:, 1] | lengths[middle].astype(U) << U(56), self.count + middle, both[:, 0])
        self.known.update((words[i], self.count + i) for i in long)
        self.put(ids, sizes)

    def put(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the next numbers, and how many each has."""
        count, used = self.count + len(sizes), self.used + len(ids)
        self.ids, self.first, self.size, self.again = roomy(self.ids, used), roomy(self.first, count), roomy(self.size, count), roomy(self.again, count)
        self.ids[self.used : used] = ids
        self.size[self.count : count] = sizes
        self.first[self.count : count] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = used, count

    def asked(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens, and how many each has: the library gets them at once, their bytes spelt as letters, a line for each."""
        lines = self.letters.take(np.frombuffer(b"\xff".join(new), np.uint8)).tobytes().decode("utf-16-le")
        ids = np.array(self.merger.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
        ends, reach = np.cumsum([len(w) for w in new]), np.cumsum(self.length.take(ids))
        if not len(ids) or ends[-1] != reach[-1]:  # the vocabulary lacks a byte, so lengths don't tell whose ids are whose
            return ids, np.bincount(np.array(self.merger.encode(lines, add_special_tokens=False).word_ids, np.int64), minlength=len(new))
        return ids, np.diff(np.searchsorted(reach, ends, side="right"), prepend=0)

    def learn(self, words: list[bytes]) -> list[int]:
        """Numbers of pretokens that aren't known: the library's model is asked for them."""
        new = list(dict.fromkeys(words))
        found = [self.asked(new[i : i + self.ASKED]) for i in range(0, len(new), self.ASKED)]
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        numbers = dict(zip(new, range(self.count, self.count + len(new)), strict=True))
        self.add(new, ids, sizes)
        return [numbers[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if not self.plain:
            found = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
            return np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)
        pieces, numbers, firsts = [], [], []
        for t in texts:
            firsts.append(len(pieces))
            for p in self.parts(t) if any(a in t for a in self.added) else (t,):
                n = self.number.get(p, 0)
                pieces.append("" if n else p)
                numbers.append(n)
        if not pieces:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        joined = "\0" + "\0".join(pieces)
        sizes = np.array([len(p) + 1 for p in pieces], np.int64)
        heads = np.cumsum(sizes) - sizes
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.flatnonzero(cuts(points, heads))
        own = np.searchsorted(starts, heads)  # the words that are heads
        data = joined.encode("utf-8", "surrogatepass") + b"\0" * 16
        raw = np.frombuffer(data, np.uint8)[:-16]
        if len(raw) > len(points):
            starts = np.flatnonzero((raw & 0xC0) != 0x80).take(starts)
        lengths = np.diff(starts, append=len(raw))
        w = np.full(len(starts), -1, np.int64)
        eight = np.ndarray(len(raw) + 9, "V8", data, strides=(1,))  # the 8 bytes from each byte on
        small, middle, long = np.flatnonzero(lengths <= 7), np.flatnonzero((lengths > 7) & (lengths <= 15)), np.flatnonzero(lengths > 15)
        at, sizes = starts.take(small), lengths.take(small).astype(U)
        w[small] = self.short.find(first_bytes(eight[at].view("<u8"), sizes) | sizes << U(56))
        at, sizes = starts.take(middle), lengths.take(middle).astype(U)
        w[middle] = self.middle.find(first_bytes(eight[at + 8].view("<u8"), sizes - U(8)) | sizes << U(56), eight[at].view("<u8"))
        words = parted(data, starts.take(long), lengths.take(long))
        w[long] = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        w[own] = numbers
        self.again[w[w >= 0]] = True
        missing, long = np.flatnonzero(w < 0), set()
        if len(missing):
            new = parted(data, starts.take(missing), lengths.take(missing))
            w[missing] = self.learn(new)
            long = {x for x in new if len(x) > self.MOST_BYTES}
        ids, ends = self.of(w), np.cumsum(self.size.take(w), dtype=np.int64)
        for x in long:
            del self.known[x]
        if self.count > self.MOST or self.used > 8 * self.MOST:
            self.thin()
        edges, totals = np.concatenate((own[firsts], [len(w)])), np.concatenate(([0], ends))
        return ids, totals[edges[1:]] - totals[edges[:-1]]


def roomy(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)))


def parted(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    return [data[i:j] for i, j in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)]


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


FILES = "shard long, part long, temp string, name string, documents long, ids long, bytes long"


def write_token_files(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = None, folder: str | None = None, shard_bytes: int = 16 << 20) -> str:
    """Writes the ids of all texts (null: empty) in ascending key order (no key first), end_id after each; returns the folder.

    Shards are cut along the key at about shard_bytes of text, wherever the rows lie; a task writes a file for each
    shard_bytes of its shard. Equal keys stand together, by text; a key with more than shard_bytes is first dealt by a hash of
    the text. Files are written under temporary names and get their own when the job has succeeded; the manifest comes last.
    tokenizer: a file for the tokenizers library that every executor has.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = shards_of(docs, "key", F.octet_length("text") + 16, shard_bytes)
    docs = docs.withColumn("shard", shards.of(F.col("key"), hashed(F.col("text")))).repartitionById(shards.count, F.col("shard")).sortWithinPartitions("shard", "key", "text")

    def write(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, (store, root) = encoder(tokenizer), located(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        shard, part, size, keys, lengths, ids = None, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            whole = np.concatenate(ids)
            ids.clear()
            data = packed_shard(keys, np.concatenate(lengths), whole)
            temp = f"_temporary/{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{temp}") as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "temp": temp, "name": f"shard-{shard:06d}-{part:04d}.tok", "documents": len(keys), "ids": len(whole), "bytes": len(data)}])

        for b in batches:
            own = b.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if keys and (own[i] != shard or size >= shard_bytes):
                    yield flush()
                    part, size, keys, lengths = (part + 1 if own[i] == shard else 0), 0, [], []
                shard = int(own[i])
                texts = b.column(1).slice(i, j - i)
                found, sizes = enc.encode(texts.to_pylist())
                if end_id is not None:
                    found, sizes = np.insert(found, np.cumsum(sizes), end_id), sizes + 1
                keys += b.column(0).slice(i, j - i).to_pylist()
                lengths.append(sizes)
                ids.append(found)
                size += texts.nbytes
        if keys:
            yield flush()

    with small_batches(spark):
        return commit_files(docs.mapInArrow(write, FILES), folder)


def read_token_files(spark: SparkSession, folder: str, *, ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as 32-bit little-endian) and, if asked for, ids.

    The driver gets the number of ids of each shard.
    """
    files = manifest(spark, folder)
    rows, start, n = [], 0, 0
    for r in files.groupBy("shard").agg(F.sum("ids").alias("ids"), F.count("*").alias("files")).orderBy("shard").collect():
        rows.append((r.shard, start))
        start, n = start + r.ids, n + r.files
    before = F.coalesce(F.sum("ids").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.withColumn("before", before).join(F.broadcast(spark.createDataFrame(rows, "shard long, start long")), "shard")
    files = files.select("name", (F.col("start") + F.col("before")).alias("start"), F.pmod(F.col("shard") + F.col("part"), F.lit(max(n, 1))).cast("int").alias("task"))

    def read(batches):
        store, root = located(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    keys, lengths, found = read_shard(f.read())
                edges = np.concatenate(([0], np.cumsum(lengths)))
                raw, at = memoryview(found.astype("<u4", copy=False)).cast("B"), (4 * edges).tolist()
                cols = [pa.array(keys, pa.int64()), pa.array(start + edges[:-1]), pa.array(lengths), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(found, pa.int64()))] if ids else [])], ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return files.repartitionById(max(1, min(n, MOST_SHARDS)), F.col("task")).mapInArrow(read, schema)
