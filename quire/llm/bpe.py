"""Byte-level BPE by a bounded-lookahead streaming transducer, and decoding by an incremental state machine.

The lookahead is computed from the merge list. Take a text cut anywhere and two ways to go on. Apply the merges in
order to both; at first the tokens before the cut agree. A rule (x, y) can undo the agreement of one more token, an x
at the frontier, if only one of the two goes on with y, and each rule can do so once. The rule that does so next comes
later in the list, and its y starts with the former x, which now stands behind the frontier. So the frontier moves
back by at most the largest sum of the x's over such chains of rules: tokens that end that far before the
cut are final. The sum is found in one pass over the list.

Every piece goes through the transducer. Words recur, so its output for pieces of up to REMEMBERED characters is kept, in two
generations of a bounded number each (so of bounded bytes): when the younger is full it becomes the older.

The transducer keeps the bytes after its last emitted token. Whenever these exceed the lookahead, it tokenises them,
emits the tokens that are final and keeps the rest. It finds tokens left to right, longest first, going back where a
neighbouring pair could not both survive the merges; only the merges' own result has all pairs compatible.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import trimmed

#: The pre-tokeniser's pattern and white space: fixed values of the public vocabulary.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_PIECE = regex.compile(PATTERN)
_OPEN = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "S": regex.compile(rf"[{_S}]*"), "O": regex.compile(rf"[^{_S}\p{{L}}\p{{N}}]*")}

SLICE = 1 << 16  # characters read at a time
_LONG = 1 << 13  # characters after which an unfinished piece goes to the transducer as it comes
#: Characters of a piece, or unit, whose ids are remembered, and how many are in a generation: 60 MB a generation at most.
REMEMBERED, _MEMO = 48, 150_000
#: White space other than space and line feed: fixed values. Python's own extra separators are in it, for caution.
_OTHER = regex.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_NEVER = 1 << 40


def _byte_chars() -> dict[str, int]:
    """The vocabulary's printable stand-ins for bytes: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + i)] = b
    return out


class Merges:
    """A byte-level BPE vocabulary and merge list."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("a plain byte-level BPE file is needed")
        back = _byte_chars()
        raw = lambda t: bytes(back[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.token = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.born = {self.ids[bytes([b])]: -1 for b in range(256)}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for r, merge in enumerate(model["merges"]):
            x, y = (raw(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            a, b, c = self.ids[x], self.ids[y], self.ids[x + y]
            if a not in self.born or b not in self.born or c in self.born:
                raise ValueError("the merge list makes a token twice, or uses one before it is made")
            self.rank[a, b], self.born[c], self.left[c], self.right[c] = r, r, a, b
        # a token that its own bytes do not merge into never comes out
        self.ids = {t: i for t, i in self.ids.items() if i in self.born and (self.born[i] < 0 or self._apart(self.left[i], self.right[i], self.born[i]))}
        self.longest = max(map(len, self.ids))
        self.reach: dict[bytes, int] = {}  # the longest token that starts with these four bytes
        for t in self.ids:
            if len(t) > 3:
                self.reach[t[:4]] = max(self.reach.get(t[:4], 3), len(t))
        self.shorter = {i: next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None) for t, i in self.ids.items()}
        self.lookahead = self._lookahead()
        self._fits: dict[int, bool] = {}

    def _lookahead(self) -> int:
        best: dict[bytes, int] = {}
        most = 0
        for a, b in self.rank:  # in order of rank
            x, y = self.token[a], self.token[b]
            chain = len(x) + max((best.get(y[:k], 0) for k in range(1, len(y) + 1)), default=0)
            best[x] = max(best.get(x, 0), chain)
            most = max(most, chain)
        return most + self.longest

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b, side by side, stay apart through all merges."""
        key = a << 24 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1 << 19:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b)
        return known

    def _apart(self, x: int, y: int, until: int = _NEVER) -> bool:
        # Back in time: x and y are the pieces on either side of the boundary, each until its own rank of use.
        born, x_used, y_used = self.born, until, until
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < x_used and r <= y_used:
                return False
            if born[x] > born[y]:
                x_used, x = born[x], self.right[x]
            elif born[y] < 0:
                return True
            else:
                y_used, y = born[y], self.left[y]

    def _longest_at(self, text: bytes, at: int) -> int:
        ids = self.ids
        for k in range(min(self.reach.get(text[at : at + 4], 3), len(text) - at), 1, -1):
            found = ids.get(text[at : at + k])
            if found is not None:
                return found
        return ids[text[at : at + 1]]

    def tokens(self, text: bytes, before: int | None = None) -> list[int]:
        """The tokens of ``text`` after token ``before``."""
        whole = self.ids.get(text)
        if whole is not None and before is None:
            return [whole]
        out: list[int] = []
        at, n, dead = 0, len(text), set()
        t: int | None = self._longest_at(text, 0) if n else None
        while at < n:
            prev = out[-1] if out else before
            while t is not None and ((end := at + len(self.token[t])) in dead or prev is not None and not self.fits(prev, t)):
                t = self.shorter[t]
            if t is not None:
                out.append(t)
                at = end
                t = self._longest_at(text, at) if at < n else None
                continue
            if not out:
                raise ValueError("no tokenisation; the merge list is not proper")
            dead.add(at)
            last = out.pop()
            at -= len(self.token[last])
            t = self.shorter[last]
        return out


class _Run:
    """The transducer over the bytes of one piece, fed as they come."""

    def __init__(self, merges: Merges):
        self.merges, self.held, self.last = merges, b"", None

    def feed(self, raw: bytes) -> list[int]:
        m = self.merges
        self.held += raw
        if len(self.held) < 2 * m.lookahead:
            return []
        final, at, out = len(self.held) - m.lookahead, 0, []
        for t in m.tokens(self.held, self.last):
            if at + len(m.token[t]) > final:
                break
            at += len(m.token[t])
            out.append(t)
        self.held, self.last = self.held[at:], out[-1] if out else self.last
        return out

    def finish(self) -> list[int]:
        return self.merges.tokens(self.held, self.last) if self.held else []


class _Remembered(dict):
    """Ids by text, each id as its decimal digits and a comma; of the longer texts nothing is kept."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = self.made(text)
        if len(text) <= REMEMBERED:
            if len(self) >= _MEMO:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out


class _Memo(_Remembered):
    """Ids of pieces, by the transducer."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def made(self, piece: str) -> bytes:
        run = _Run(self.merges)
        first = run.feed(piece.encode("utf-8", "surrogatepass"))
        return _digits(first + run.finish() if first else run.finish())


class _Units(_Remembered):
    """Ids of what a space and the characters up to the next space give, by these characters.

    A space after anything but white space always begins a piece, so such units tokenise alone. They are looked up
    whole; one not yet seen is cut into pieces, which are looked up in turn.
    """

    def __init__(self, memo: _Memo):
        super().__init__()
        self.memo = memo

    def made(self, unit: str) -> bytes:
        if unit.isascii() and unit.isalpha():  # one piece, which is kept here and need not be kept twice
            piece = " " + unit
            return self.memo.get(piece) or self.memo.older.get(piece) or self.memo.made(piece)
        return b"".join(map(self.memo.__getitem__, _PIECE.findall(" " + unit)))


def _digits(ids: list[int]) -> bytes:
    return ("%d," * len(ids) % tuple(ids)).encode() if ids else b""


class Encoder:
    """Encodes a text as it comes; memory does not grow with the text. Output: decimal ids, each with a comma."""

    def __init__(self, merges: Merges, memo: _Memo | None = None, units: _Units | None = None):
        self.merges = merges
        self.memo = memo if memo is not None else _Memo(merges)
        self.units = units if units is not None else _Units(self.memo)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.guard = max(map(len, merges.special), default=1) - 1
        self.ahead = ""  # may hold the start of a special token
        self.held = ""  # the end of the text so far, whose pieces may still change
        self.run: _Run | None = None
        self.kind = ""

    def feed(self, text: str) -> bytes:
        return self._split(text, False)

    def finish(self) -> bytes:
        return self._split("", True)

    def _split(self, text: str, end: bool) -> bytes:
        text, out = self.ahead + text, []
        self.ahead = ""
        if self.special is not None:
            at = 0
            for m in self.special.finditer(text):
                out += [self._pieces(text[at : m.start()], True), b"%d," % self.merges.special[m[0]]]
                at = m.end()
            text = text[at:]
            if not end and self.guard:
                text, self.ahead = text[: -self.guard] if len(text) > self.guard else "", text[-self.guard :]
        out.append(self._pieces(text, end))
        return b"".join(out)

    def _pieces(self, text: str, end: bool) -> bytes:
        out: list[bytes] = []
        if self.run is not None:
            text = self._go_on(self.held + text, end, out)
        else:
            text = self.held + text
        self.held = ""
        if self.run is not None:
            self.held = text
            return b"".join(out)
        cut = text.rfind(" ")
        if cut > 0 and "  " not in text and "\n " not in text and _OTHER.search(text) is None:
            first, *units = text[:cut].split(" ")
            out += map(self.memo.__getitem__, _PIECE.findall(first))
            if len(units) > 1:
                out += itemgetter(*units)(self.units)
            elif units:
                out.append(self.units[units[0]])
            text = text[cut:]
        if end:
            out += map(self.memo.__getitem__, _PIECE.findall(text))
            return b"".join(out)
        pieces = _PIECE.findall(text)
        left = 0  # characters of the pieces that more text may change: the last, and a contraction's start
        while pieces and left < 3:
            left += len(pieces.pop())
        out += map(self.memo.__getitem__, pieces)
        self.held = text[len(text) - left :]
        if left > _LONG:
            self._open(out)
        return b"".join(out)

    def _open(self, out: list[bytes]) -> None:
        m = _PIECE.match(self.held)  # pieces before the long one, if any, are final: it is long enough
        while m and m.end() < len(self.held):
            if len(self.held) - m.end() <= _LONG:
                return
            out.append(self.memo[m[0]])
            self.held = self.held[m.end() :]
            m = _PIECE.match(self.held)
        c = self.held[-1]
        self.kind = next(k for k in "LNSO" if _OPEN[k].fullmatch(c))
        self.run = _Run(self.merges)
        keep = 1 if self.kind == "S" else 0  # the last white space goes with what follows
        body, self.held = (self.held[:-1], c) if keep else (self.held, "")
        out.append(_digits(self.run.feed(body.encode("utf-8", "surrogatepass"))))

    def _go_on(self, text: str, end: bool, out: list[bytes]) -> str:
        stop = _OPEN[self.kind].match(text).end()
        if self.kind == "S" and (stop < len(text) or not end):
            stop = max(0, stop - 1)
        closed = stop < len(text) if self.kind != "S" else (stop + 1 < len(text) or end)
        out.append(_digits(self.run.feed(text[:stop].encode("utf-8", "surrogatepass"))))
        if closed or end:
            out.append(_digits(self.run.finish()))
            self.run = None
        return text[stop:]


class Decoder:
    """Ids to text as they come. A character's bytes may come with several ids; ill-formed bytes become U+FFFD."""

    def __init__(self, merges: Merges):
        self.digits = {b"%d" % i: t for i, t in merges.token.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, digits: bytes) -> str:
        """``digits``: decimal ids, each with a comma."""
        ids = digits.split(b",")
        ids.pop()
        return self.state.decode(b"".join(itemgetter(*ids)(self.digits) if len(ids) > 1 else map(self.digits.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def reset(self) -> None:
        self.state.reset()


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few texts and their ids are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _slices(text: str) -> Iterable[str]:
    return (text[i : i + SLICE] for i in range(0, len(text), SLICE))


@lru_cache(maxsize=2)
def _loaded(source: str) -> tuple[Merges, _Memo, _Units]:
    """The vocabulary and what is remembered of it, kept by a worker from task to task."""
    merges = Merges(source)
    memo = _Memo(merges)
    return merges, memo, _Units(memo)


def _broadcast(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:  # on the driver; a vocabulary is a file of fixed size
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the token ids of every row's whole text; null and empty texts have none.

    ``path``: a tokenizers file of a byte-level BPE, read by the driver. Other columns are ignored; an empty table
    gives an empty result. Special tokens' strings in a text become their ids, as the library does.
    """
    source = _broadcast(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memo, units = _loaded(source.value)
        for batch in _few(batches):
            ids = []
            for text in batch.column("text").to_pylist():
                enc, got = Encoder(merges, memo, units), []
                for part in _slices(text or ""):
                    got += enc.feed(part).split(b",")[:-1]
                ids.append([int(i) for i in got + enc.finish().split(b",")[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text from (doc_id, ids); a null list is an empty text."""
    source = _broadcast(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(_loaded(source.value)[0])
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                dec.reset()
                out.append(dec.feed(_digits(ids or [])) + dec.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(trimmed(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (, ids): digests of the ids and of the text decoded from them.

    Texts go through slice by slice, so only digests and the transducer's state are held; ``with_ids`` hands the ids on
    too. Defined cases as in :func:`encode`: null is the empty text.
    """
    source = _broadcast(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, memo, units = _loaded(source.value)
        dec = Decoder(merges)
        for batch in _few(batches):
            counts, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                enc, n, a, b, comma, parts = Encoder(merges, memo, units), 0, hashlib.sha256(), hashlib.sha256(), False, []
                dec.reset()
                for part in (*_slices(text or ""), None):
                    got = enc.finish() if part is None else enc.feed(part)
                    if got:
                        n += got.count(b",")
                        a.update(b"," + got[:-1] if comma else got[:-1])
                        comma = True
                        b.update(dec.feed(got).encode())
                        if with_ids:
                            parts.append(np.fromstring(got[:-1].decode(), np.int32, sep=","))
                b.update(dec.finish().encode())
                counts.append(n)
                ids_sha.append(a.hexdigest())
                text_sha.append(b.hexdigest())
                ids.append(np.concatenate(parts) if parts else [])
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)
