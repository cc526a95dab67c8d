"""Offset-preserving encoding with a SentencePiece BPE model, and decoding.

Normalisation follows the model: at every place the longest entry of the
compiled character map (a double-array trie of UTF-8 prefixes) replaces the
bytes it matches, anything else is copied, and every normalised character
records the byte of the source it came from.  White space is escaped, the
dummy prefix added.  Byte-pair merges then run by score, leftmost first, and
each piece is projected to the source bytes its characters came from.

If no piece of the vocabulary goes on into a space, merges never cross one,
so a text is encoded space by space.  Ids and spans of such runs, aligned to the
run's first byte, are remembered (a task keeps up to ``REMEMBERED`` of them); the place
of the run in the text is added to give the spans of every piece.

``encode`` gives ids with source spans, ``decode`` gives texts back, ``digests``
what the registered query reports.

Defined cases: a null text counts as empty and has no pieces; characters
outside the vocabulary become byte pieces (or the unknown piece, where the
model has none); repeated rows give a row each; an empty table gives an empty
result; other columns are ignored.  Models other than BPE, and user-defined or
unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from heapq import heappop, heappush
from itertools import accumulate, chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import Remembered, loaded, ship_package

SPACE = "▁"
REMEMBERED = 600_000
SHORT = 48  # characters up to which rescanning beats a heap
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
RUN = re.compile(r" +[^ ]*|[^ ]+")


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a size, a double array, and the replacements, each ended by a zero."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size:]

    def longest(self, source: bytes, at: int) -> tuple[int, bytes] | None:
        """Matched length and replacement of the longest entry that starts here."""
        units, node, found = self.units, 0, None
        node ^= _offset(units[0])
        for i in range(at, len(source)):
            c = source[i]
            node ^= c
            unit = units[node]
            if unit & 0x800000FF != c:  # the label of the unit
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:  # a value hangs below
                place = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.texts[place:self.texts.index(b"\0", place)]
        return found


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Pieces:
    def __init__(self, model: bytes):
        spec = proto.ModelProto()
        spec.ParseFromString(model)
        if spec.trainer_spec.model_type != 2:
            raise ValueError("not a BPE model")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined or unused pieces are not supported")
        if spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("white space as suffix is not supported")
        norm = spec.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        if not norm.escape_whitespaces:
            raise ValueError("white space that is not escaped is not supported")
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        self.kinds = [p.type for p in spec.pieces]
        self.names = [p.piece for p in spec.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = spec.trainer_spec.unk_surface
        # merges stay inside runs of spaces with what follows, if no piece holds a space after something else
        self.by_space = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.known = Remembered(self._encode_run, REMEMBERED)
        self.stretches = Remembered(lambda ids: self.decode([self.ids[SPACE], *ids]), REMEMBERED // 10)
        self.normal = np.array([k == NORMAL for k in self.kinds])
        self.spoken = [p.replace(SPACE, " ") for p in self.names]
        self.written = [str(i) for i in range(len(self.names))]

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text with spaces escaped, and the source byte of each character, with the end of the source last."""
        source = text.encode()
        if not source:
            return "", [0]
        chars, places = [], []
        at = 0
        if self.map is None:  # every character is copied
            places = list(range(len(source))) if text.isascii() else [0, *accumulate(len(c.encode()) for c in text[:-1])]
            if self.dummy and not self.squeeze:
                return SPACE + text.replace(" ", SPACE), [0, *places, len(source)]
            chars, at = list(text), len(source)
        while at < len(source):
            match = self.map.longest(source, at)
            if match:
                step, new = match[0], match[1].decode()
            else:
                first = source[at]
                step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = source[at:at + step].decode()
            chars += new
            places += [at] * len(new)
            at += step
        if self.squeeze:
            kept = [i for i, c in enumerate(chars) if c != " " or (i and chars[i - 1] != " ")]
            while kept and chars[kept[-1]] == " ":
                kept.pop()
            chars, places = [chars[i] for i in kept], [places[i] for i in kept]
            if not chars:
                return "", [len(source)]
        if self.dummy:
            chars, places = [" ", *chars], [places[0], *places]
        return "".join(chars).replace(" ", SPACE), [*places, len(source)]

    def merge(self, run: str) -> list[str]:
        """Pieces of a normalised run: the neighbours that make the best-scored piece merge first, the leftmost of equals."""
        part = list(run)
        score = self.score
        n = len(part)
        if n <= SHORT:
            pairs = [score.get(a + b, -inf) for a, b in zip(part, part[1:])]
            while pairs and (best := max(pairs)) > -inf:
                i = pairs.index(best)
                part[i] += part.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = score.get(part[i - 1] + part[i], -inf)
                if i < len(pairs):
                    pairs[i] = score.get(part[i] + part[i + 1], -inf)
            return part
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(left, right):
            if left >= 0 and right < n:
                both = part[left] + part[right]
                if both in score:
                    heappush(heap, (-score[both], left, right, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heappop(heap)
            if part[left] is None or part[right] is None or after[left] != right or part[left] + part[right] != both:
                continue
            part[left], part[right] = both, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in part if p is not None]

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of every piece, in bytes of the source.

        Byte pieces of one character share its span; the dummy prefix has none.
        """
        normal, places = self.normalise(text)
        out, at = [], 0
        runs = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", normal) if self.by_space else [normal] if normal else []
        for run in runs:
            out += self._aligned(run, places, at)
            at += len(run)
        return out

    def _aligned(self, run: str, places: list[int], at: int = 0) -> list[tuple[int, int, int]]:
        """Pieces of a normalised run whose first character is the one at ``at``."""
        out = []
        for piece in self.merge(run):
            end = at + len(piece)
            i = self.ids.get(piece)
            out += [(i, places[at], places[end])] if i is not None else [(i, places[at], places[end]) for i in self.ids_of(piece)]
            at = end
        return out

    def decode(self, ids) -> str:
        """Text of ids: control pieces vanish, runs of byte pieces are read as UTF-8, a byte that cannot be is replaced."""
        out, run, first = [], bytearray(), True

        def flush():
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at:at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            run.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run.append(int(self.names[i][3:5], 16))
                continue
            flush()
            if kind == CONTROL:
                continue
            text = self.unknown_text if kind == UNKNOWN else self.names[i]
            if first and not any(out) and (self.dummy or self.squeeze):
                if text.startswith(SPACE):
                    text = text[1:]
                    first = self.squeeze
            out.append(text.replace(SPACE, " "))
        flush()
        return "".join(out)

    def _encode_run(self, run: str) -> bytes:
        """(id, start, end) of each piece of a space and the run after it, in bytes from the run's start: only the first piece starts before it."""
        normal, places = self.normalise(run) if run else (SPACE, [0, 0])
        places[0] = -1  # the dummy prefix stands for the space
        return array("i", chain.from_iterable(self._aligned(normal, places))).tobytes()

    def spans(self, text: str) -> np.ndarray:
        """(id, start, end) of every piece as rows; what ``encode`` gives, by way of remembered runs where they are independent."""
        if not text:
            return np.zeros((0, 3), dtype=np.int64)
        if not (self.by_space and self.map is None and self.dummy and not self.squeeze and SPACE in self.ids) or SPACE in text:
            return np.array(self.encode(text), dtype=np.int64).reshape(-1, 3)
        if "  " in text or text[0] == " ":
            runs = [r[1:] for r in RUN.findall(" " + text)]
        else:
            runs = text.split(" ")
        found = np.frombuffer(b"".join(map(self.known.__getitem__, runs)), dtype=np.int32).reshape(-1, 3).astype(np.int64)
        # a run begins a space after the end of the one before
        first = np.flatnonzero(found[:, 1] == -1)[1:]
        step = np.zeros(len(found), dtype=np.int64)
        step[first] = found[first - 1, 2] + 1
        found[:, 1:] += np.cumsum(step)[:, None]
        found[0, 1] = 0  # no space comes before the first
        return found

    def spelled(self, ids: np.ndarray, listed: list[int]) -> str:
        """What ``decode`` gives of ids, which come as an array and as a list; stretches without bytes or control pieces are joined at once."""
        normal = self.normal[ids]
        if not self.dummy or self.squeeze or SPACE not in self.ids or not listed or not normal[0]:
            return self.decode(listed)
        out: list[str] = []
        cuts = [0, *(np.flatnonzero(normal[1:] != normal[:-1]) + 1).tolist(), len(listed)]
        for a, b in zip(cuts, cuts[1:]):
            if normal[a]:
                out.append("".join(map(self.spoken.__getitem__, listed[a:b])))
            else:  # after a first space, which decoding takes away
                out.append(self.stretches[tuple(listed[a:b])])
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str) -> tuple[int, str, str, int, str]:
        """Number of ids, SHA-256 of the ids and of the text decoded from them, the source bytes that spans cover, SHA-256 of the spans."""
        found = self.spans(text)
        ids, starts, ends = found.T
        listed = ids.tolist()
        written = ",".join(map(self.written.__getitem__, listed))
        reach = np.maximum.accumulate(ends)
        starts = starts.copy()
        starts[1:] = np.maximum(starts[1:], reach[:-1])
        covered = int(np.maximum(ends - starts, 0).sum())
        return (len(found), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(self.spelled(ids, listed).encode()).hexdigest(), covered,
                hashlib.sha256(found.astype("<i8").tobytes()).hexdigest())


def _mapped(docs: DataFrame, model: bytes, column: str, of, schema: str, kinds: dict) -> DataFrame:
    """Rows of ``of(pieces, value)`` beside doc_id."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a file of fixed size

    def run(batches):
        pieces = loaded(Pieces, shared.value)
        for batch in batches:
            rows = [of(pieces, v) for v in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds.values()))], ["doc_id", *kinds])

    return docs.select("doc_id", column).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids, starts, ends): pieces and their spans in the bytes of the text."""

    def of(pieces, text):
        found = pieces.encode(text or "")
        return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]

    ints = pa.list_(pa.int32())
    return _mapped(docs, model, "text", of, "ids array<int>, starts array<int>, ends array<int>", {"ids": ints, "starts": ints, "ends": ints})


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of ids; null ids count as none."""
    return _mapped(encoded, model, "ids", lambda pieces, ids: (pieces.decode(ids or []),), "text string", {"text": pa.string()})


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes, spans_sha256).

    ``covered_bytes`` is what the spans of all pieces cover together, and ``spans_sha256``
    the digest of (id, start, end) of every piece, as 64-bit little-endian numbers.
    """
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "covered_bytes": pa.int64(), "spans_sha256": pa.string()}
    return _mapped(docs, model, "text", lambda pieces, text: pieces.digest(text or ""),
                   "n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long, spans_sha256 string", kinds)
