"""Encoding of the whole corpus with a public tokenizer (problem 8).

Method: a streaming transducer with bounded lookahead. The encoding of every prefix ends in exactly
one token, found among the vocabulary entries that end there by checking that it may follow the last
token of what is before it. A later token reaches back at most as many bytes as the longest entry;
that is the lookahead after which a state is out of reach. A token is stable, and is emitted, once
the back-pointers of all states still in reach run through it. Memory is the states in reach,
whatever the length of the text. Decoding is an incremental byte-to-text machine.
"""

from __future__ import annotations

import base64
import codecs
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Where the public vocabulary is found, and the pattern its authors split text with.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters taken from a text at a time, pieces remembered, and bytes between two emissions.
WINDOW, MEMORY, STEP = 1 << 16, 1 << 17, 256
#: The longest reach of the pattern past the end of a match ('re, 've, 'll need two more characters).
_HOLD = 3


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id; the id is also the rank of the merge that makes the token."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


class Merges:
    """What is derived from a vocabulary once: reach of a token, and which token may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {v: k for k, v in ranks.items()}
        #: The merge list's sufficient lookahead in bytes.
        self.lookahead = max(map(len, ranks))
        self._follows: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """data by the merge rules in their order; used on two tokens side by side."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether b may stand after a: the two, merged anew, stay as they are."""
        key = (a, b)
        ok = self._follows.get(key)
        if ok is None:
            if len(self._follows) >= MEMORY * 4:
                self._follows.clear()
            ok = self._follows[key] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return ok

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one piece of the pattern; frequent pieces are remembered, within MEMORY."""
        ids = self._known.get(text)
        if ids is None:
            machine = Transducer(self)
            ids = (*machine.feed(text.encode()), *machine.finish())
            if len(text) <= 64:
                if len(self._known) >= MEMORY:
                    self._known.clear()
                self._known[text] = ids
        return ids


class Transducer:
    """Bytes of one piece in, ids out, each as soon as no further byte can change it."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.tail = b""  # the bytes that a token ending next can reach back to
        self.at = 0  # bytes read
        self.done = 0  # bytes whose tokens have been emitted
        self.last: dict[int, int] = {}  # position -> last token of the prefix that ends there

    def feed(self, data: bytes) -> Iterator[int]:
        ranks, reach, last, follows = self.m.ranks, self.m.lookahead, self.last, self.m.follows
        for i in range(len(data)):
            self.tail = (self.tail + data[i : i + 1])[-reach:]
            self.at += 1
            tail, at = self.tail, self.at
            for n in range(len(tail), 0, -1):
                token = ranks.get(tail[-n:])
                if token is not None and (at == n or ((before := last.get(at - n)) is not None and follows(before, token))):
                    last[at] = token
                    break
            else:
                raise ValueError(f"byte {data[i]} is not in the vocabulary")
            if at - self.done > STEP and at % STEP == 0:
                yield from self._emit(self._meeting())

    def _meeting(self) -> int:
        """The last position through which the back-pointers of all states in reach run."""
        last, text = self.last, self.m.text
        live = set(range(max(self.done, self.at - self.m.lookahead) + 1, self.at + 1))
        while len(live) > 1:
            p = max(live)
            live.discard(p)
            live.add(p - len(text[last[p]]) if p > self.done else p)
            if min(live) <= self.done:
                return self.done
        return live.pop() if live else self.done

    def _emit(self, end: int) -> list[int]:
        out = []
        while end > self.done:
            out.append(self.last[end])
            end -= len(self.m.text[self.last[end]])
        if out:
            self.done += sum(len(self.m.text[t]) for t in out)
            keep = min(self.done, self.at - self.m.lookahead)
            for p in [p for p in self.last if p < keep]:
                del self.last[p]
        return out[::-1]

    def finish(self) -> list[int]:
        return self._emit(self.at)


_RUNS = [(regex.compile(p), regex.compile(p + "+")) for p in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")]


class Encoder:
    """Text in parts of any size in, ids out; holds at most a window of text."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.pattern = regex.compile(PATTERN)
        self.held = ""
        self.run = None  # inside a piece longer than a window: its transducer and the pattern it goes on with

    def feed(self, text: str) -> Iterator[int]:
        self.held += text
        if self.run and (yield from self._go_on(False)):
            return
        buffer, stable = self.held, 0
        for m in self.pattern.finditer(buffer):
            if m.end() > len(buffer) - _HOLD:
                break
            yield from self.m.piece(m[0])
            stable = m.end()
        self.held = buffer[stable:]
        if len(self.held) > WINDOW:
            spaced = self.held[0] == " " and not self.held[1].isspace()
            first = self.held[1] if spaced else self.held[0]
            more = next(more for one, more in _RUNS if one.match(first))
            self.run = (Transducer(self.m), more, more.pattern.startswith(r"\s"))
            if spaced:
                yield from self.run[0].feed(b" ")
                self.held = self.held[1:]
            yield from self._go_on(False)

    def _go_on(self, over: bool) -> Iterator[int]:
        """Feeds what belongs to the long piece; true while it has not ended."""
        machine, more, blank = self.run
        m = more.match(self.held)
        end = m.end() if m else 0
        open_ = end == len(self.held) and not over
        # The last blank of a run goes with what follows, unless nothing does.
        cut = end - 1 if blank and end and not (over and end == len(self.held)) else end
        yield from machine.feed(self.held[:cut].encode())
        self.held = self.held[cut:]
        if not open_:
            yield from machine.finish()
            self.run = None
        return open_

    def finish(self) -> Iterator[int]:
        if self.run:
            yield from self._go_on(True)
        for m in self.pattern.finditer(self.held):
            yield from self.m.piece(m[0])
        self.held = ""


def encode(merges: Merges, text: str | None) -> list[int]:
    """Ids of a text without special tokens; null and empty give an empty list."""
    out: list[int] = []
    if not text:
        return out
    if len(text) <= WINDOW:
        for p in regex.findall(PATTERN, text):
            out += merges.piece(p)
        return out
    encoder = Encoder(merges)
    for i in range(0, len(text), WINDOW):
        out.extend(encoder.feed(text[i : i + WINDOW]))
    out.extend(encoder.finish())
    return out


class Decoder:
    """Ids in, text out, each character as soon as its last byte is there; broken bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.text = merges.text
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return "".join(self.machine.decode(self.text[int(i)]) for i in ids)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


#: Ids that an output batch holds before it is sent, but for the last text's.
HELD_IDS = 1 << 20
_worker: list = [None, None]


def _merges(shared) -> Merges:
    """The broadcast vocabulary with its memories, once per Python worker."""
    ranks = shared.value
    if _worker[0] is not ranks:
        _worker[:] = [ranks, Merges(ranks)]
    return _worker[1]


def encode_corpus(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): ids of each text, array<int>; null and empty texts give an empty list.

    A row-local pass over whole texts, without a shuffle. What is broadcast is the vocabulary, whose
    size does not depend on the data. Rows with repeated keys are encoded each.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared)
        for b in batches:
            first, flat, ends = 0, array("i"), [0]
            for n in range(b.num_rows):
                flat.extend(encode(merges, b.column(1)[n].as_py()))
                ends.append(len(flat))
                # The ids of a batch of long texts leave in parts.
                if len(flat) >= HELD_IDS or n + 1 == b.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n + 1 - first), ids], names=[key, "ids"])
                    first, flat, ends = n + 1, array("i"), [0]

    return spread(df.select(key, text), key).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_corpus(df: DataFrame, key: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text) from (key, ids); a null list gives null."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(path))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared)
        for b in batches:
            out = []
            for ids in b.column(1):
                d = Decoder(merges)
                out.append(d.feed(ids.values.to_numpy(zero_copy_only=False)) + d.finish() if ids.is_valid else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return df.select(key, F.col("ids")).mapInArrow(run, f"{key} {kind}, text string")
