"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores are read from a .model file (its path is a parameter) on the
driver, which parses the few protobuf fields needed, builds the trie and ships both to the
workers. Encoding escapes spaces as the marker U+2581, puts one before the text, and takes
the segmentation of highest total score; of equal ones, that whose pieces begin earliest,
as the public library does. A character without a piece costs the least score less 10 and
comes out as its UTF-8 bytes' pieces. Decoding turns byte pieces back, markers into spaces,
and drops the first space.

A unigram model's scores are used as they are; a BPE model's are merge ranks, from which log
scores are made by a rank-frequency law (zipf()).

If no piece holds a marker after another character, every place where a marker follows
another character is a piece boundary of any segmentation, so the Viterbi search may run on
the stretches between these places, and equal stretches are looked up in a bounded memo.

Defined cases: a null text has null ids and n_tokens 0, an empty text no ids. A text that
itself holds U+2581 decodes with a space in its place, as in the public library; it is then
not round_trip. Repeated rows are encoded each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linequarry.functions.shipping import ship
from linequarry.llm.common import table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the model format: the marker, the piece types, and the penalty of a character without a piece.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PENALTY = 10.0
#: Of the Zipf-Mandelbrot law, for models whose file has ranks in place of log scores.
OFFSET = 2.7
#: Stretches kept (cleared when more), the longest kept, stretches searched at once, and documents encoded at once.
MEMO, MEMO_LONGEST, AT_ONCE, ROWS = 500_000, 40, 8192, 200


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return out, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def double_array(words: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """Character codes, base, check, and the word that ends in each state (-1: none). State 0 is the root; a child of s by code c is base[s] + c if its check is s."""
    codes = {c: i for i, c in enumerate(sorted({c for w in words for c in w}), 1)}
    children: list[dict[int, int]] = [{}]
    ends = {}
    for n, w in enumerate(words):
        at = 0
        for c in w:
            k = codes[c]
            if k not in children[at]:
                children[at][k] = len(children)
                children.append({})
            at = children[at][k]
        ends.setdefault(at, n)
    size = 2 * len(children) + 2 * len(codes) + 1024
    base, check, value, free = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.ones(size, bool)
    free[0] = False
    low, todo = 1, [(0, 0)]
    for node, state in todo:  # breadth first: todo grows
        value[state] = ends.get(node, -1)
        if not children[node]:
            continue
        kids = np.array(sorted(children[node]))
        start = low
        while True:
            if start + 2048 + len(codes) >= len(free):
                more = len(free) + 2048 + len(codes)
                base, value, check, free = (np.concatenate([x, np.full(more, f, x.dtype)]) for x, f in ((base, 0), (value, -1), (check, -1), (free, True)))
            spots = start + np.flatnonzero(free[start : start + 2048])
            spots = spots[spots >= kids[0]]
            fits = free[spots[:, None] - kids[0] + kids].all(axis=1) if len(spots) else np.zeros(0, bool)
            if fits.any():
                b = int(spots[fits.argmax()] - kids[0])
                break
            start += 2048
        base[state] = b
        free[b + kids], check[b + kids] = False, state
        todo += [(children[node][k], b + k) for k in kids.tolist()]
        while not free[low : low + 64].any():
            low += 64
    top = int(np.flatnonzero(check >= 0).max()) + len(codes) + 2 if len(words) else len(codes) + 2
    return codes, base[:top], check[:top], value[:top]


def packed(ids: tuple[int, ...]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Unigram:
    """Pieces with log scores; encode() and decode()."""

    def __init__(self, pieces: list[str], scores: list[float], types: list[int], dummy_prefix: bool = True):
        self.pieces, self.types, self.dummy_prefix = pieces, types, dummy_prefix
        usable = [i for i, t in enumerate(types) if t in (NORMAL, USER_DEFINED) and pieces[i]]
        normal = [scores[i] for i in usable if types[i] == NORMAL] or [0.0]
        # As the library does: a user-defined piece beats any segmentation of its characters.
        self.scores = [len(pieces[i]) * max(normal) - 0.1 if types[i] == USER_DEFINED else scores[i] for i in usable]
        self.ids = usable
        self.no_piece = min(normal) - PENALTY
        self.codes, base, check, value = double_array([pieces[i] for i in usable])
        self.base, self.check, self.value = base.tolist(), check.tolist(), value.tolist()
        self.unknown = types.index(UNKNOWN) if UNKNOWN in types else -1
        self.bytes_ = [-1] * 256
        for i, t in enumerate(types):
            if t == BYTE:
                self.bytes_[int(pieces[i][1:-1], 16)] = i
        self.fallback = all(i >= 0 for i in self.bytes_)
        splits = not any(re.search(f"[^{MARKER}]{MARKER}", pieces[i]) for i in usable)
        alone = "" if "\n" in self.codes else "\n"  # no piece holds it: always by itself
        self.stretches = re.compile(("\n|" if alone else "") + f"{MARKER}*[^{MARKER}{alone}]+|{MARKER}+" if splits else r"(?s:.+)").findall
        self.memo: dict[str, bytes] = {}
        self.lossy: set[str] = set()
        self.plain = [None if t == BYTE else "" if t == CONTROL else " ⁇ " if t == UNKNOWN else p.replace(MARKER, " ") for p, t in zip(pieces, types, strict=True)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("stretches", "arrays")} | {"memo": {}, "lossy": set(), "pattern": self.stretches.__self__.pattern}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.stretches = re.compile(self.pattern).findall

    def best(self, stretch: str) -> tuple[int, ...]:
        """Ids of the best segmentation of a stretch."""
        base, check, value, scores, top = self.base, self.check, self.value, self.scores, len(self.check)
        codes = [self.codes.get(c, 0) for c in stretch]
        n = len(codes)
        total, start, piece = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here, state, single = total[i], 0, False
            for j in range(i, n):
                c = codes[j]
                at = base[state] + c
                if not c or at >= top or check[at] != state:
                    break
                state, v = at, value[at]
                if v >= 0:
                    single = single or j == i
                    if (s := here + scores[v]) > total[j + 1]:
                        total[j + 1], start[j + 1], piece[j + 1] = s, i, v
            if not single and (s := here + self.no_piece) > total[i + 1]:
                total[i + 1], start[i + 1], piece[i + 1] = s, i, -1
        out: list[int] = []
        while n:
            i = start[n]
            if piece[n] >= 0:
                out.append(self.ids[piece[n]])
            elif self.fallback:
                out += [self.bytes_[b] for b in reversed(stretch[i:n].encode("utf-8", "replace"))]
            else:
                out.append(self.unknown)
            n = i
        return tuple(reversed(out))

    def best_of_many(self, stretches: list[str]) -> list[bytes]:
        """best() of each, packed, all searched at once: at each start, the trie is walked by all stretches together."""
        if not hasattr(self, "arrays"):
            self.arrays = np.array(self.base), np.array(self.check), np.array(self.value), np.array(self.scores), np.array(self.ids)
        base, check, value, scores, ids = self.arrays
        order = sorted(range(len(stretches)), key=lambda k: -len(stretches[k]))
        sizes = np.array([len(stretches[k]) for k in order])
        width, get = int(sizes[0]), self.codes.get
        codes = np.zeros((len(order), width), np.int64)
        flat = np.array([get(c, 0) for k in order for c in stretches[k]])
        codes[np.arange(width) < sizes[:, None]] = flat
        total = np.full((len(order), width + 1), -np.inf)
        total[:, 0] = 0
        start, piece = np.zeros(total.shape, np.int32), np.full(total.shape, -1, np.int32)
        for i in range(width):
            rows = np.arange(np.searchsorted(-sizes, -i))  # those longer than i
            state, here = np.zeros(len(rows), np.int64), total[rows, i]
            single = np.zeros(len(rows), bool)
            every = len(rows)
            for j in range(i, width):
                c = codes[rows, j]
                at = np.minimum(base[state] + c, len(check) - 1)
                on = (c > 0) & (check[at] == state)
                rows, state, here = rows[on], at[on], here[on]
                if not len(rows):
                    break
                v = value[state]
                is_piece = v >= 0
                if j == i:
                    single[rows[is_piece]] = True
                r, s = rows[is_piece], here[is_piece] + scores[v[is_piece]]
                more = s > total[r, j + 1]
                r = r[more]
                total[r, j + 1], start[r, j + 1], piece[r, j + 1] = s[more], i, v[is_piece][more]
            r = np.flatnonzero(~single[:every])
            s = total[r, i] + self.no_piece
            r, s = r[s > total[r, i + 1]], s[s > total[r, i + 1]]
            total[r, i + 1], start[r, i + 1], piece[r, i + 1] = s, i, -1
        at, rows, steps, odd = sizes.copy(), np.arange(len(order)), [], np.zeros(len(order), bool)
        while (at > 0).any():
            p = piece[rows, at]
            odd |= (p < 0) & (at > 0)
            steps.append(np.where((at > 0) & (p >= 0), ids[p], -1))
            at = np.where(at > 0, start[rows, at], 0)
        paths = np.stack(steps[::-1], axis=1).astype("<i4")
        size, lengths, data = 4 * paths.shape[1], (4 * (paths >= 0).sum(axis=1)).tolist(), paths.tobytes()
        out: list[bytes] = [b""] * len(order)
        for i, (k, n, by_hand) in enumerate(zip(order, lengths, odd.tolist(), strict=True)):
            out[k] = packed(self.best(stretches[k])) if by_hand else data[(i + 1) * size - n : (i + 1) * size]
        return out

    def encode_packed(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as packed int32, and whether decoding gives the text back. The memo holds packed ids, so that a text's are one join."""
        prefix = MARKER if self.dummy_prefix else ""
        parts = [self.stretches(prefix + t.replace(" ", MARKER)) if t else [] for t in texts]
        memo, lossy = self.memo, self.lossy
        if len(memo) >= MEMO:
            memo.clear()
            lossy.clear()
        new = list(set().union(*parts).difference(memo))
        short, long = [x for x in new if len(x) <= MEMO_LONGEST], [x for x in new if len(x) > MEMO_LONGEST]
        for x in long:
            memo[x] = packed(self.best(x))
        for i in range(0, len(short), AT_ONCE):
            some = short[i : i + AT_ONCE]
            memo.update(zip(some, self.best_of_many(some), strict=True))
        # Stretches end where characters and byte runs do, so a text decodes stretch by stretch.
        lossy.update(x for x in new if self.plainly(np.frombuffer(memo[x], "<i4").tolist()) != x.replace(MARKER, " "))
        get = memo.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        same = [t is None or (MARKER not in t and (not lossy or lossy.isdisjoint(p))) for t, p in zip(texts, parts, strict=True)]
        for x in long:
            del memo[x]
        return out, same

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0][0], "<i4").tolist()

    def plainly(self, ids: list[int]) -> str:
        """The text of the ids, the first marker's space included."""
        plain = self.plain
        parts = [plain[i] for i in ids]
        if None in parts:
            run, whole = bytearray(), []
            for i, p in zip(ids, parts, strict=True):
                if p is None:
                    run.append(int(self.pieces[i][1:-1], 16))
                    continue
                if run:
                    whole.append(run.decode("utf-8", "replace"))
                    run.clear()
                whole.append(p)
            parts = [*whole, run.decode("utf-8", "replace")]
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        text = self.plainly(ids)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def zipf(scores: list[float], types: list[int]) -> list[float]:
    """Log scores for a BPE model, whose file has merge ranks (negated, or a floor for pieces that no merge makes): the rank's probability by the Zipf-Mandelbrot law."""
    rank = [min(-x, float(len(scores))) + OFFSET for x in scores]
    norm = math.log(sum(1 / r for r, t in zip(rank, types, strict=True) if t == NORMAL) or 1)
    return [-math.log(r) - norm if t == NORMAL else 0.0 for r, t in zip(rank, types, strict=True)]


def parse(data: bytes) -> Unigram:
    pieces, scores, types, dummy, kind = [], [], [], True, UNIGRAM
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append(own.get(1, b"").decode("utf-8", "replace"))
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            types.append(own.get(3, NORMAL))
        elif number == 2:
            kind = dict(fields(value)).get(3, UNIGRAM)
        elif number == 3:
            own = dict(fields(value))
            dummy = bool(own.get(3, 1))
            if own.get(2):
                raise ValueError("models with a precompiled character map are not supported")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Unigram(pieces, zipf(scores, types) if kind == BPE else scores, types, dummy)


@lru_cache(maxsize=2)
def load(path: str = MODEL_PATH) -> Unigram:
    with open(path, "rb") as f:
        return parse(f.read())


#: One model a worker process, so that its memo lives longer than a task.
held: dict[str, Unigram] = {}


def encoded(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding gives the text back): one row per row of docs."""
    model, spark = load(path), docs.sparkSession
    ship(spark)
    shipped = spark.sparkContext.broadcast(model)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens long, round_trip boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.setdefault(path, shipped.value)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = part.column(1).to_pylist()
                ids, same = own.encode_packed(texts)
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(sizes), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
