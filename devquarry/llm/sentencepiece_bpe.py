"""Exact encoding and decoding for merge-type SentencePiece models, without the library's encoder.

The text's spaces become U+2581 and units are cut before each run of them, where no piece can cross. In a
unit the longest piece at each place comes from one Aho-Corasick pass; a path of longest pieces is kept
while adjacent pieces are compatible, that is while merging the characters of both anew gives just these
two; else the shorter prefixes are tried, and places from which the unit's end can't be reached are marked
in a bitfield. The only path that reaches the end is what merging yields. Characters without a piece
become byte pieces. Merges of U+2581 alone share one score, so runs of them are merged by position.

Null and empty texts encode to no ids, or to the end id alone. Units of any length work; those over
``CACHED`` characters are not remembered. Repeated rows encode alike, a null id stays null, and an empty
table gives an empty result. Only the id and the text are read, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices

SPACE = "▁"
#: Longest unit that is remembered, and how many are.
CACHED, CACHE = 48, 400_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # kinds of pieces in the model's format


class Tokenizer:
    """A merge-type model read from its file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format  # the file's format alone; merging and decoding are done here

        m = format.ModelProto.FromString(model)
        n, t = m.normalizer_spec, m.trainer_spec
        if t.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or t.treat_whitespace_as_suffix or not t.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and plain text as it is are supported")
        self.prefix = n.add_dummy_prefix
        self.kinds = [p.type or NORMAL for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if self.kinds[i] == NORMAL}
        self.pieces = [p.piece for p in m.pieces]
        self.scores = {p.piece: p.score for i, p in enumerate(m.pieces) if self.kinds[i] == NORMAL}
        self.bytes = [self.kinds.index(BYTE) + b for b in range(256)]
        self.end = self.pieces.index("</s>")
        own = [p for p in self.ids if set(p) != {SPACE} or len(p) == 1]
        many = [p for p in own if len(p) > 1]
        if USER in self.kinds or any(SPACE in p[1:] for p in own) or any("\n" in p for p in own) or len({self.scores[p] for p in many}) < len(many) or any(c not in self.ids for p in own for c in p):
            raise ValueError("the pieces of this model could cross a unit's end")
        own = [p for p in own if self.merged(p) == [p]]  # others never come out of merging
        self.automaton = ahocorasick.Automaton()
        for p in own:
            self.automaton.add_word(p, (p, len(p) - 1))
        self.automaton.make_automaton()
        self.own, self.chars = set(own), {p for p in own if len(p) == 1}
        self.cache, self.fits, self.runs, self.shorter = {}, {}, {}, {}
        self.controls = [i for i, k in enumerate(self.kinds) if k == CONTROL]
        self.text = [self.pieces[i].replace(SPACE, " ").encode() if k == NORMAL else b"" for i, k in enumerate(self.kinds)]
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        for i, k in enumerate(self.kinds):
            if k == UNKNOWN:
                self.text[i] = " ⁇ ".encode()

    # -- encoding ------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the best pair, the leftmost of equals, again and again makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two pieces' characters anew gives the two pieces."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def prefix_of(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.own), None)
        return self.shorter[piece]

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters all are pieces."""
        longest: list[str] = [""] * len(text)
        for end, (piece, more) in self.automaton.iter(text):
            longest[end - more] = piece  # a later end is a longer piece
        failed = bytearray(len(text) // 8 + 1)
        path: list[str] = []
        at, piece = 0, longest[0]
        while at < len(text):
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not path or self.compatible(path[-1], piece)):
                path.append(piece)
                at = end
                if at < len(text):
                    piece = longest[at]
                continue
            piece = self.prefix_of(piece)
            if piece is None:  # nothing fits here: give up this place and shorten the piece before
                failed[at >> 3] |= 1 << (at & 7)
                piece = path.pop()
                at -= len(piece)
        return path

    def spaces(self, n: int) -> list[int]:
        """The ids of a run of ``n`` U+2581: pairs of equal score merge from the left, new pairs included."""
        if n in self.runs:
            return self.runs[n]
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int]] = []

        def propose(i: int) -> None:
            if 0 <= i and (j := after[i]) < n and (s := self.scores.get(SPACE * (size[i] + size[j]))) is not None:
                heapq.heappush(agenda, (-s, i, size[i] + size[j]))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, total = heapq.heappop(agenda)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != total:
                continue
            size[i], size[j], after[i] = total, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            propose(before[i])
            propose(i)
        found = [self.ids[SPACE * s] for s in size if s]
        if n <= 1024:
            self.runs[n] = found
        return found

    def unit(self, unit: str) -> tuple[int, ...]:
        """The ids of a run of U+2581, perhaps empty, and what follows up to the next."""
        if unit[1:2] != SPACE and self.chars.issuperset(unit):
            return tuple([self.ids[p] for p in self.backtrack(unit)])
        word = unit.lstrip(SPACE)
        run = len(unit) - len(word)
        body = SPACE * min(run, 1) + word
        out: list[int] = []
        for i, stretch in enumerate(re.split(self.foreign, body)):
            if i % 2:
                out += [self.bytes[b] for c in stretch for b in c.encode()]
            elif stretch:
                out += [self.ids[p] for p in self.backtrack(stretch)]
        if run > 1:
            free = out[:1] == [self.ids[SPACE]]
            out = self.spaces(run - 1 + free) + out[free:]
        return tuple(out)

    @property
    def foreign(self) -> re.Pattern:
        """Runs of characters without a piece."""
        if not hasattr(self, "_foreign"):
            known = "".join(re.escape(p) for p in self.ids if len(p) == 1)
            self._foreign = re.compile(f"([^{known}]+)")
        return self._foreign

    def units(self, text: str):
        text = text.replace(" ", SPACE)
        return re.findall(f"{SPACE}+[^{SPACE}\n]*|\n+|[^{SPACE}\n]+", SPACE + text if self.prefix and text else text)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for unit in self.units(text) if text else ():
            ids = cache.get(unit)
            if ids is None:
                ids = self.unit(unit)
                if len(unit) <= CACHED:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[unit] = ids
            out += ids
        return out

    # -- decoding ------------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: control ids are empty, bytes that are no UTF-8 become U+FFFD one by one."""
        while ids and self.kinds[ids[-1]] == CONTROL:
            ids = ids[:-1]
        if any(c in ids for c in self.controls):  # they part bytes of one character
            stretches = [list(g) for k, g in groupby(ids, lambda i: self.kinds[i] == CONTROL) if not k]
        else:
            stretches = [ids] if ids else []
        out = [b"".join(map(self.text.__getitem__, x)) for x in stretches]
        if self.prefix and out and self.kinds[stretches[0][0]] == NORMAL and out[0][:1] == b" ":
            out[0] = out[0][1:]
        return "".join(x.decode(errors="bytewise") for x in out)


def bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


import codecs  # noqa: E402

codecs.register_error("bytewise", bytewise)


@lru_cache(2)
def tokenizer(model: bytes) -> Tokenizer:
    """One for each worker."""
    return Tokenizer(model)


def model_bytes(path: str) -> bytes:
    """The model file, read once on the driver and sent along: its size does not depend on the data."""
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, end: bool = True) -> DataFrame:
    """doc_id and ids of every row."""

    def rows(batches):
        t = tokenizer(model)
        for batch in (part for whole in batches for part in slices(whole)):
            ids = [t.encode(x) + [t.end] * end for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: bytes) -> DataFrame:
    """doc_id and text of every row."""

    def rows(batches):
        t = tokenizer(model)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([t.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, model: bytes, end: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; the ids stay in the worker."""

    def rows(batches):
        t = tokenizer(model)
        names = [str(i) for i in range(len(t.pieces))]
        for batch in (part for whole in batches for part in slices(whole)):
            out = []
            for text in batch.column("text").to_pylist():
                ids = t.encode(text) + [t.end] * end
                out.append((len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return digests(documents(spark, sf_dir), model_bytes(model_path))
