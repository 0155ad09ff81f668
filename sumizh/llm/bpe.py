"""Byte-level BPE as a lazily determinised finite-state transducer.

Applying merges in rank order needs a whole word before the first token is known.
The transducer instead reads bytes from left to right.  It rests on two facts:

* A sequence of tokens is the encoding of its bytes exactly if every two neighbours
  are *compatible*: no merge across their border comes before the merges that made
  them.  So the encoding of each prefix is fixed by its last token alone.
* A token that covers the end of what was read must start at a border from which the
  bytes read so far begin some token.  What the encodings of all such *live* borders
  have in common can't change any more, whatever follows.

A state is the last token given out and the bytes after it, each with the last token
of the encoding that ends there.  A step reads one byte, drops borders that are no
longer live and emits the tokens that all live borders share; a token thus comes out
after a lookahead that is bounded by the longest entry of the vocabulary.  States and
steps are built when first met and kept; when there are ``MAX_STATES`` of them they
are dropped and built anew, which bounds memory and changes no result.

Decoding runs an incremental UTF-8 machine whose state is the unfinished part of a
character, lifted from bytes to tokens the same lazy way.

Defined results: an empty and a null text give an empty list.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Where the public vocabularies lie; a parameter of every function that needs one.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: The pattern, given with the public tokenizer, that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: States, steps and words kept in memory at most.
MAX_STATES = 60_000
MAX_WORDS = 60_000


def printable_bytes() -> dict[str, int]:
    """The characters by which vocabularies of this kind write each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Merges of a vocabulary.  Tokens are numbered 0-255 for bytes, then in rank order."""

    def __init__(self, path: str = TOKENIZER) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of = printable_bytes()
        self.bytes_of: list[bytes] = [bytes([b]) for b in range(256)]
        self.number: dict[bytes, int] = {b: i for i, b in enumerate(self.bytes_of)}
        self.parts: list[tuple[int, int]] = [(-1, -1)] * 256
        self.rank: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (self.number[bytes(of[c] for c in left)], self.number[bytes(of[c] for c in right)])
            whole = self.bytes_of[pair[0]] + self.bytes_of[pair[1]]
            self.rank.setdefault(pair, len(self.bytes_of))
            if whole not in self.number:
                self.number[whole] = len(self.bytes_of)
            self.bytes_of.append(whole)
            self.parts.append(pair)
        vocabulary = {bytes(of[c] for c in k): v for k, v in model["vocab"].items() if all(c in of for c in k)}
        self.id_of = [vocabulary[b] for b in self.bytes_of]
        self.token_of_id = {i: t for t, i in enumerate(self.id_of)}
        self.starts = {b[:n] for b in self.bytes_of for n in range(len(b) + 1)}
        self.longest = max(map(len, self.bytes_of))
        self._sound: dict[int, bool] = {}
        self._compatible: dict[tuple[int, int], bool] = {}

    def _undisturbed(self, left: int, right: int, own: bool) -> bool:
        """Undo the merges of two neighbours from the last one; is none across the border earlier?

        ``own``: the merge of the two as they stand is the one asked about and doesn't count.
        """
        before = len(self.bytes_of) + 1
        while True:
            across = None if own else self.rank.get((left, right))
            own = False
            if across is not None and across < before:
                return False
            if left > right:
                if left < 256:
                    return True
                before, left = left, self.parts[left][1]
            else:
                if right < 256:
                    return True
                # of equal merges the left one comes first, so one across comes before that of the right token
                before, right = right + 1, self.parts[right][0]

    def sound(self, token: int) -> bool:
        """Does the token's own text encode to the token?"""
        if token < 256:
            return True
        known = self._sound.get(token)
        if known is None:
            left, right = self.parts[token]
            known = self.number[self.bytes_of[token]] == token and self.sound(left) and self.sound(right) and self._undisturbed(left, right, True)
            self._sound[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) > 4 * MAX_STATES:
                self._compatible.clear()
            known = self._compatible[pair] = self._undisturbed(left, right, False)
        return known


class Transducer:
    """See the module's text.  ``steps`` maps state * 256 + byte to (next state, ids emitted)."""

    NONE, DEAD = -1, -2

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.words: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PATTERN).findall
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[bytes, tuple[int, ...]]] = []
        self.known: dict[tuple[int, bytes], int] = {}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self._state(b"", (self.NONE,))

    def _state(self, pending: bytes, last: tuple[int, ...]) -> int:
        key = (last[0], pending)
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.states)
            self.states.append((pending, last))
        return state

    def _last_token(self, pending: bytes, last: list[int]) -> int:
        """The last token of the encoding of all of ``pending``, given those of its prefixes."""
        merges, end = self.merges, len(pending)
        for start in range(max(0, end - merges.longest), end):
            if last[start] == self.DEAD:
                continue
            token = merges.number.get(pending[start:])
            if token is not None and merges.sound(token) and (last[start] == self.NONE or merges.compatible(last[start], token)):
                return token
        raise AssertionError("every byte is a token, so some token ends here")

    def _chain(self, last: list[int] | tuple[int, ...], border: int) -> list[int]:
        """The borders of the encoding that ends at ``border``, from the end."""
        borders = [border]
        while border:
            border -= len(self.merges.bytes_of[last[border]])
            borders.append(border)
        return borders

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Build the step that leaves ``state`` by ``byte``."""
        pending, before = self.states[state]
        pending += bytes([byte])
        last = [*before]
        last.append(self._last_token(pending, last))
        end = len(pending)
        starts = self.merges.starts
        live = [j for j in range(max(0, end - self.merges.longest), end + 1) if last[j] != self.DEAD and pending[j:] in starts]
        chains = [self._chain(last, j) for j in live]
        common = set(chains[0]).intersection(*chains[1:])
        settled = max(common)
        emitted = tuple(self.merges.id_of[last[j]] for j in reversed(self._chain(last, settled)[:-1]))
        needed = {j for chain in chains for j in chain}
        kept = tuple(last[j] if j in needed else self.DEAD for j in range(settled, end + 1))
        found = (self._state(pending[settled:], kept), emitted)
        self.steps[state << 8 | byte] = found
        return found

    def end(self, state: int) -> tuple[int, ...]:
        """The ids still due when the input ends in ``state``."""
        due = self.ends.get(state)
        if due is None:
            pending, last = self.states[state]
            due = tuple(self.merges.id_of[last[j]] for j in reversed(self._chain(last, len(pending))[:-1]))
            self.ends[state] = due
        return due

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece of the split text."""
        if len(self.states) > MAX_STATES:
            self._reset()
        steps, state, out = self.steps, 0, []
        get = steps.get
        for byte in data:
            found = get(state << 8 | byte)
            if found is None:
                found = self.step(state, byte)
            state, emitted = found
            if emitted:
                out += emitted
        out += self.end(state)
        return tuple(out)

    def pieces(self, text: str) -> Iterator[tuple[int, ...]]:
        words = self.words
        for piece in self.find(text):
            ids = words.get(piece)
            if ids is None:
                if len(words) > MAX_WORDS:
                    words.clear()
                ids = self.encode_bytes(piece.encode("utf-8"))
                if len(piece) <= 64:
                    words[piece] = ids
            yield ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for ids in self.pieces(text):
            out += ids
        return out

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text))) if text else 0


class Utf8Machine:
    """Incremental UTF-8 decoding; the state is the unfinished start of a character.

    Bytes that can't be part of a character give U+FFFD, one for each longest start
    of a character that breaks off, as the Unicode standard recommends.
    """

    def __init__(self) -> None:
        self.state = b""

    @staticmethod
    def wanted(start: bytes) -> tuple[int, int, int]:
        """Length of the character that begins with ``start``, and the range of its next byte."""
        lead = start[0]
        length = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        low, high = 0x80, 0xBF
        if len(start) == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
        return length, low, high

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        state = self.state
        for byte in data:
            if state:
                length, low, high = self.wanted(state)
                if low <= byte <= high:
                    state += bytes([byte])
                    if len(state) == length:
                        out.append(state.decode("utf-8"))
                        state = b""
                    continue
                out.append("�")
                state = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif self.wanted(bytes([byte]))[0]:
                state = bytes([byte])
            else:
                out.append("�")
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        rest, self.state = self.state, b""
        return "�" if rest else ""


class StreamDecoder:
    """Ids to text, token by token; steps of the UTF-8 machine are kept per (state, id)."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.steps: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def decode(self, ids: Iterable[int]) -> str:
        state, out = b"", []
        for i in ids:
            found = self.steps.get((state, i))
            if found is None:
                if len(self.steps) > 4 * MAX_STATES:
                    self.steps.clear()
                machine = Utf8Machine()
                machine.state = state
                text = machine.feed(self.merges.bytes_of[self.merges.token_of_id[i]])
                found = self.steps[state, i] = (machine.state, text)
            state, text = found
            out.append(text)
        if state:
            out.append("�")
        return "".join(out)


_transducers: dict[str, Transducer] = {}


def given(spark: SparkSession, path: str) -> str:
    """Give a vocabulary file to the workers, which needn't have it; returns its path."""
    spark.sparkContext.addFile(path)  # the same file again is passed over
    return path


def transducer(path: str = TOKENIZER) -> Transducer:
    """One transducer per worker process and vocabulary, from the file given to the worker if there is one."""
    if path not in _transducers:
        try:
            sent = SparkFiles.get(os.path.basename(path))
        except Exception:  # outside of a worker there may be no folder of files
            sent = ""
        _transducers[path] = Transducer(Merges(sent if os.path.isfile(sent) else path))
    return _transducers[path]


def encode_documents(df: DataFrame, id_column: str, text_column: str, path: str = TOKENIZER) -> DataFrame:
    """(id, ids) for every row; no shuffle, one pass over the scan."""
    given(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            rows = [np.asarray(coder.encode(t), dtype="i4") for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, rows)]).astype("i4")
            flat = np.concatenate(rows) if rows else np.empty(0, "i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_column, "ids"])

    schema = T.StructType([df.schema[id_column], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(id_column, text_column).mapInArrow(run, schema)


def decode_documents(df: DataFrame, id_column: str, ids_column: str, path: str = TOKENIZER) -> DataFrame:
    """(id, text) for every row of ids; null ids give a null text."""
    given(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(transducer(path).merges)
        for batch in batches:
            texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    schema = T.StructType([df.schema[id_column], T.StructField("text", T.StringType())])
    return df.select(id_column, ids_column).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text_column: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` with a further column ``tokens``: the length of the text's encoding."""
    given(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            of = {t: coder.count(t) for t in dict.fromkeys(texts)}  # repeated texts once
            counts = [of[t] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "tokens"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("tokens", T.LongType())]))
