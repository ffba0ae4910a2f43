"""Token counts without encoding: the tokenizer is compiled to deterministic finite-state transducers.

A byte-level BPE tokenizer cuts a text into pretokens and merges each one's bytes. Both steps become transducers:

* The cutter runs over character classes. It has eight states; each character's symbol is a map of states to states.
  Texts are laid end to end and cut into chunks of equal length; maps of chunks are composed by a parallel prefix scan
  over all chunks, which gives each chunk the state it starts in, and so every pretoken's start.
* The merger runs over a pretoken's bytes. Its transitions are annotated with the tokens that they add (a number that
  can be negative, as a byte may complete a merge). The last token of a prefix's encoding is fixed by the last tokens
  of shorter prefixes, so a state holds those that a later token can still reach back to. States and transitions are
  compiled when first met and shared by all texts of a worker; all pretokens of a batch advance together.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of characters: letter, number, other; then by what follows: a space or other white space before something
#: else, or before white space or the end; an apostrophe that begins a contraction of two or three characters; a reset.
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE_MORE, SHORT, LONG, RESET = range(9)
#: States: in letters, numbers, others, a run of white space, after a space that joins the next, at an end, one or two
#: characters before the end of a contraction.
IN_L, IN_N, IN_O, IN_W, JOIN, END, ONE, TWO = range(8)
START = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, SPACE_LAST: JOIN, WHITE_LAST: END, WHITE_MORE: IN_W, SHORT: ONE, LONG: TWO, RESET: END}
#: Fixed: the pattern's contractions after the apostrophe, by length.
CONTRACTIONS = {1: "stmd", 2: ("re", "ve", "ll")}
#: White space as the pattern's \\s has it.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: whether the character begins a pretoken."""
    nxt, starts = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    for c in range(9):
        for s in range(8):
            plain = OTHER if c in (SHORT, LONG) else c
            if c == RESET:
                nxt[c, s] = END
            elif s in (ONE, TWO):
                nxt[c, s] = END if s == ONE else ONE
            elif s == JOIN or (s, plain) in ((IN_L, LETTER), (IN_N, NUMBER), (IN_O, OTHER), (IN_W, WHITE_MORE)):
                nxt[c, s] = START[plain]
            else:
                nxt[c, s], starts[c, s] = START[c], True
    return nxt, starts


NEXT, STARTS = cutter()
CHUNK = 256


def classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    out[WHITE] = WHITE_MORE
    return out


def starts_of(symbols: np.ndarray) -> np.ndarray:
    """Which characters begin a pretoken, by a scan over the state maps of chunks. The first symbol is a RESET."""
    n = -(-len(symbols) // CHUNK)
    grid = np.full(n * CHUNK, RESET, np.uint8)
    grid[: len(symbols)] = symbols
    grid = np.ascontiguousarray(grid.reshape(n, CHUNK).T)
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (n, 8)).copy()
    for row in grid:
        maps = NEXT[row[:, None], maps]
    step = 1
    while step < n:  # after each round a chunk's map is that of all of the last 2 * step chunks
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.concatenate(([END], maps[:-1, END])).astype(np.uint8)
    begins = np.empty((CHUNK, n), bool)
    for i, row in enumerate(grid):
        begins[i] = STARTS[row, state]
        state = NEXT[row, state]
    return begins.T.reshape(-1)[: len(symbols)]


class Merger:
    """The transducer of a BPE vocabulary over bytes; see the module."""

    MOST = 300_000

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        """tokens: ids by bytes; merges: for a pair of ids its rank and the id of both together."""
        self.tokens, self.merges = tokens, merges
        self.of = {i: b for b, i in tokens.items()}
        self.prefixes = {b[:i] for b in tokens for i in range(1, len(b) + 1)}
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.column, self.columns = np.full(256, -1, np.int64), 0  # of the table of moves, for bytes that texts have
        self.moves = np.full((1 << 10, 64), -1, np.int32)
        self.number((b"", ((-1, 0),)))

    def number(self, state: tuple) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.moves):
                self.moves = np.concatenate((self.moves, np.full((len(self.moves) // 2, self.moves.shape[1]), -1, np.int32)))
        return n

    def meet(self, data: np.ndarray) -> None:
        """Gives columns to bytes not met before."""
        for b in np.flatnonzero(np.bincount(data, minlength=256)):
            if self.column[b] < 0:
                self.column[b], self.columns = self.columns, self.columns + 1
        if self.columns > self.moves.shape[1]:
            self.moves = np.concatenate((self.moves, np.full((len(self.moves), 256 - self.moves.shape[1] if self.columns > 128 else 128 - self.moves.shape[1]), -1, np.int32)), axis=1)

    def encode(self, data: bytes) -> list[int]:
        """Merges by rank, the definition that all else must agree with."""
        ids = [self.tokens[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            rank, at, new = min((self.merges.get(p, (1 << 40, 0)) + (0,) for p in zip(ids, ids[1:], strict=False)), default=None)[0], 0, 0
            if rank == 1 << 40:
                break
            for at in range(len(ids) - 1):
                if (m := self.merges.get((ids[at], ids[at + 1]))) and m[0] == rank:
                    new = m[1]
                    break
            ids[at : at + 2] = [new]
        return ids

    def together(self, a: int, b: int) -> bool:
        """Whether b may follow a in an encoding: both stay as they are when merged side by side."""
        if (f := self.fits.get((a, b))) is None:
            f = self.fits[a, b] = self.encode(self.of[a] + self.of[b]) == [a, b]
        return f

    def move(self, state: int, byte: int) -> int:
        """Compiles a transition: next state << 8 | tokens added + 128.

        A state is the longest end of the prefix that begins a token, and for that end and the ends of it that begin tokens
        too: the last token of what stands before the end (-1: nothing does), and its tokens less those of the whole prefix.
        """
        tail, befores = self.states[state]
        grown = tail + bytes([byte])
        before = dict(zip(self.ends(tail), befores, strict=True))
        last = added = None
        for k in range(len(grown), 0, -1):
            if (t := self.tokens.get(grown[-k:])) is not None and (k - 1) in before:
                prior, tokens = before[k - 1]
                if prior == -1 or self.together(prior, t):
                    last, added = t, tokens + 1
                    break
        longest = next(grown[i:] for i in range(len(grown) + 1) if grown[i:] in self.prefixes or i == len(grown))
        befores = tuple((last, 0) if k == 0 else (before[k - 1][0], before[k - 1][1] - added) for k in self.ends(longest))
        return self.number((longest, befores)) << 8 | (added + 128)

    def ends(self, tail: bytes) -> list[int]:
        """Lengths of the ends of tail that begin a token, and 0."""
        return [k for k in range(len(tail), 0, -1) if tail[-k:] in self.prefixes] + [0]

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken data[start : start + length]; all advance byte by byte together."""
        self.meet(data)
        order = np.argsort(-length, kind="stable")
        start, going = start[order], np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
        for t, k in enumerate(going.tolist()):
            byte = data[start[:k] + t]
            move = self.moves[state[:k], self.column[byte]]
            if (missing := np.flatnonzero(move < 0)).size:
                for x in np.unique((state[missing] << 8) | byte[missing]).tolist():
                    y = self.move(x >> 8, x & 255)
                    self.moves[x >> 8, self.column[x & 255]] = y
                move = self.moves[state[:k], self.column[byte]]
            state[:k] = move >> 8
            total[:k] += (move & 255) - 128
        out = np.empty_like(total)
        out[order] = total
        if len(self.states) > self.MOST:
            self.reset()
        return out


def byte_letters() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes: printable Latin-1 as it is, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of texts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path) as f:
            told = json.load(f)
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        if told.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE is compiled")
        added = told.get("added_tokens", [])
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("added tokens that take white space or whole words aren't compiled")
        letters = byte_letters()
        spelt = lambda s: bytes(letters[c] for c in s)
        special = {a["content"] for a in added}
        vocab = {s: i for s, i in model["vocab"].items() if s not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = Merger({spelt(s): i for s, i in vocab.items()}, {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)})
        self.added = sorted((a["content"] for a in added), key=len, reverse=True)
        self.classes = classes()

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between added tokens, and how many of those it has."""
        if not any(a in text for a in self.added):
            return [text], 0
        import re

        found = re.split("(" + "|".join(map(re.escape, self.added)) + ")", text)
        return found[::2], len(found) // 2

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        owner, parts, out = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            own, n = self.parts(t)
            out[i] += n
            for p in own:
                if p:
                    owner.append(i)
                    parts.append(p)
        if not parts:
            return out
        joined = "\0" + "\0".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        heads = np.cumsum(sizes) - sizes
        symbols = self.classes[points]
        symbols[heads] = RESET
        after = np.concatenate((symbols[1:], [RESET]))
        white = symbols == WHITE_MORE
        last = white & (after != WHITE_MORE) & (after != RESET)
        symbols[last] = np.where(points[last] == 32, SPACE_LAST, WHITE_LAST)
        quote = np.flatnonzero((points == 39) & (symbols != RESET))
        if len(quote):
            padded = np.concatenate((points, [0, 0]))
            one, two = padded[quote + 1], padded[quote + 2]
            symbols[quote[np.isin(one, [ord(c) for c in CONTRACTIONS[1]])]] = SHORT
            for a, b in CONTRACTIONS[2]:
                symbols[quote[(one == ord(a)) & (two == ord(b))]] = LONG
        begins = starts_of(symbols)
        widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.cumsum(widths) - widths
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        first = np.flatnonzero(begins)
        edge = np.flatnonzero(begins | (symbols == RESET))
        ends = np.concatenate((at[edge], [len(data)]))
        length = ends[np.searchsorted(edge, first) + 1] - at[first]
        tokens = self.merger.counts(data, at[first], length)
        text = np.array(owner)[np.searchsorted(heads, first, side="right") - 1]
        return out + np.bincount(text, tokens, len(texts)).astype(np.int64)


COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker."""
    if path not in COUNTERS:
        COUNTERS[path] = Counter(path)
    return COUNTERS[path]


def with_token_counts(docs: DataFrame, tokenizer: str, name: str, *, text: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """docs with the number of each text's tokens (null: empty) in the column of that name. No shuffle.

    tokenizer: a byte-level BPE file for the tokenizers library that every executor has.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        own, out, some, size = counter(tokenizer), [], [], 0
        for t in texts.to_pylist():
            some.append(t or "")
            size += len(some[-1])
            if size >= batch_bytes:
                out.append(own.count(some))
                some, size = [], 0
        return pa.array(np.concatenate([*out, own.count(some)]))

    return docs.withColumn(name, count(F.col(text)))


def report(docs: DataFrame, tokenizer: str, *, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document."""
    d = with_token_counts(docs.select("doc_id", "text"), tokenizer, "n_tokens")
    return d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
