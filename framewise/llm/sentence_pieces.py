"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut before each run of spaces, which no piece crosses, and the distinct segments are concatenated
and indexed by a suffix array over the longest piece's length. Binary search finds the range of suffixes that begin
with each piece; the ranges' positions are the edges of all segments' lattices. Edges are sorted by the place
where they end in their segment and relaxed in that order, for all segments at once.

A unigram model keeps the best-scoring edge into each place. A BPE model's encoding of a prefix has exactly one last
piece: the one whose neighbour on the left stays apart from it when both are merged from characters. So an edge is
taken when its piece may follow the last piece of the place where it begins; answers for pairs of pieces are kept.
Both give the library's ids. Characters without a piece fall back to bytes, or to the unknown id.

Models must use the identity normaliser, as ``supported`` checks. Defined cases: null and empty texts have no ids; a
U+2581 in a text counts as a space, as in the library; all rows and other columns stay. Relaxing takes a step for each
place of the longest segment, and memory follows that segment: a text of a million letters without a space is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewise.llm.storage import arrow_batches, release
from framewise.llm.words import U64

MARK = "▁"
INDEX_BYTES = 1 << 18
#: Bytes of segments and ids that a task keeps, about a third of what their objects take; the store is emptied when full
#: and when the task ends, which changes no result.
STORE_BYTES = 12_000_000
#: Characters of texts whose segments are held at once; a longer text is taken alone.
TEXT_CHARS = 1 << 20
_START, _NONE = -2, -1
_SLOT_BITS = 20
_SEGMENT = re.compile(" +[^ ]*")
_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_UNIGRAM, _BPE = 1, 2


class PieceModel:
    """Pieces of a model file, ready for matching."""

    def __init__(self, proto: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        supported(model)
        self.bpe = model.trainer_spec.model_type == _BPE
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.size = len(model.pieces)
        self.text = [p.piece for p in model.pieces]
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        normal = [i for i, p in enumerate(model.pieces) if p.type == _NORMAL]
        self.rank = {self.text[i]: -model.pieces[i].score for i in normal}
        self.id = {self.text[i]: i for i in normal}
        self.score = np.array([p.score for p in model.pieces], np.float32)
        self.unknown_score = np.float32(min(self.score[normal]) - 10)
        raw = sorted((self.text[i].encode(), i) for i in normal)
        self.piece = np.array([i for _, i in raw])
        self.length = np.array([len(b) for b, _ in raw])
        self.words = -(-int(self.length.max()) // 8)
        fixed = lambda fill: np.array([list(b.ljust(8 * self.words, fill)) for b, _ in raw], np.uint8)
        self.low, self.high = (fixed(f).view(">u8").astype(U64) for f in (b"\x00", b"\xff"))
        self.raw = [p.piece.replace(MARK, " ").encode() if p.type == _NORMAL else b"" for p in model.pieces]
        self.raw[self.unknown] = " ⁇ ".encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self._spines: dict[int, tuple[list, list, bool]] = {}
        self._pairs = np.full(1 << _SLOT_BITS, -1, np.int64)
        self._apart = np.zeros(1 << _SLOT_BITS, bool)
        self._store: dict[str, bytes] = {}
        self._stored = 0

    # -- matching ------------------------------------------------------------------------------------------------

    def edges(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, piece) of each occurrence of a piece in the bytes."""
        n, words = len(data), self.words
        padded = np.full(n + 8 * words + 8, 0xFF, U64)
        padded[:n] = data
        key = np.zeros(n + 8 * words, U64)
        for j in range(8):
            key |= padded[j : j + len(key)] << U64(56 - 8 * j)
        suffixes = np.argsort(key[:n])
        first = key[suffixes]
        low = np.searchsorted(first, self.low[:, 0], "left")
        high = np.searchsorted(first, self.high[:, 0], "right")
        deep = np.flatnonzero((self.length > 8) & (high > low))
        if len(deep):
            # Suffixes that share their first eight bytes with a longer piece are sorted on.
            inner = np.zeros(n + 1, np.int64)
            np.add.at(inner, low[deep], 1)
            np.add.at(inner, high[deep], -1)
            place = np.flatnonzero(np.cumsum(inner[:n]) > 0)
            rows = suffixes[place]
            suffixes[place] = rows[np.lexsort([key[rows + 8 * w] for w in range(words - 1, 0, -1)] + [first[place]])]
            for w in range(1, words):
                deep = deep[(self.length[deep] > 8 * w) & (high[deep] > low[deep])]
                bounds = [self._bisect(key, suffixes + 8 * w, low[deep], high[deep], q[deep, w], s) for q, s in ((self.low, 0), (self.high, 1))]
                low[deep], high[deep] = bounds
        many = np.maximum(high - low, 0)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return suffixes[np.repeat(low, many) + within], np.repeat(self.length, many), np.repeat(self.piece, many)

    @staticmethod
    def _bisect(key: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, right: int) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            value = key[at[np.minimum(middle, len(at) - 1)]]
            less = open_ & ((value <= wanted) if right else (value < wanted))
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment as 32-bit integers."""
        raw = [s.encode() for s in segments]
        sizes = np.array([len(x) for x in raw])
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        data = np.frombuffer(b"\xff".join([*raw, b""]), np.uint8)
        begin, length, piece = self.edges(data)
        # A character without a piece of its own is an edge that stands for its code point.
        heads = np.flatnonzero((data & 0xC0 != 0x80) & (data != 0xFF))
        alone = np.zeros(len(data), bool)
        alone[begin[length == _WIDTH[data[begin]]]] = True
        heads = heads[~alone[heads]]
        width = _WIDTH[data[heads]]
        beginning, inverse = np.unique([bytes(data[h : h + w]) for h, w in zip(heads.tolist(), width.tolist(), strict=True)] or [b""], return_inverse=True)
        points = np.array([ord(x.decode()) if x else 0 for x in beginning.tolist()])
        begin = np.concatenate([begin, heads])
        length = np.concatenate([length, width])
        piece = np.concatenate([piece, self.size + points[inverse[: len(heads)]]])
        owner = np.searchsorted(ends, begin)
        offset = begin + length - begins[owner]
        order = np.argsort(offset.astype(np.uint16) if offset.max(initial=0) < 1 << 16 else offset, kind="stable")
        begin, piece, end = begin[order], piece[order], (begin + length)[order]
        steps = np.flatnonzero(np.diff(offset[order], prepend=-1))
        last = np.full(len(data) + 1, _NONE, np.int64)
        came = np.zeros(len(data) + 1, np.int64)
        last[begins] = _START
        best = np.zeros(len(data) + 1, np.float32)
        for a, b in zip(steps.tolist(), [*steps[1:].tolist(), len(begin)], strict=True):
            (self._relax_bpe if self.bpe else self._relax_unigram)(begin[a:b], piece[a:b], end[a:b], last, came, best)
        path, at = [], ends[sizes > 0]
        while len(at):
            path.append(at)
            at = came[at]
            at = at[last[at] != _START]
        places = np.sort(np.concatenate([np.zeros(0, np.int64), *path]))
        tokens = last[places]
        cuts = np.searchsorted(places, [*begins.tolist(), len(data)], "right").tolist()
        flat = tokens.astype("<i4").tobytes()
        out = [flat[4 * a : 4 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        strange = np.searchsorted(ends, places[tokens >= self.size] - 1)
        for k in np.unique(strange).tolist():
            out[k] = self._with_bytes(tokens[cuts[k] : cuts[k + 1]].tolist())
        return out

    def _with_bytes(self, tokens: list[int]) -> bytes:
        out: list[int] = []
        for t in tokens:
            if t < self.size:
                out.append(t)
            elif self.byte:
                out += [self.byte[b] for b in chr(t - self.size).encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    # -- relaxing ------------------------------------------------------------------------------------------------

    def _relax_bpe(self, begin, piece, end, last, came, best) -> None:
        reached = last[begin] != _NONE
        begin, piece, end = begin[reached], piece[reached], end[reached]
        fits = self._may_follow(last[begin], piece)
        last[end[fits]], came[end[fits]] = piece[fits], begin[fits]

    def _relax_unigram(self, begin, piece, end, last, came, best) -> None:
        reached = last[begin] != _NONE
        begin, piece, end = begin[reached], piece[reached], end[reached]
        own = np.where(piece < self.size, self.score[np.minimum(piece, self.size - 1)], self.unknown_score)
        total = (best[begin] + own).astype(np.float32)
        order = np.lexsort((begin, -total, end))
        top = order[np.flatnonzero(np.diff(end[order], prepend=-1))]
        last[end[top]], came[end[top]], best[end[top]] = piece[top], begin[top], total[top]

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Answers come from a table with one slot for each hash of a pair; a pair that is not in its slot is worked out
        and takes the slot."""
        base = self.size + 0x110000
        asked = (left + 2) * base + right
        slot = ((asked.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - _SLOT_BITS)).astype(np.int64)
        answer = self._apart[slot]
        new = np.flatnonzero(self._pairs[slot] != asked)
        if len(new):
            fresh, back = np.unique(asked[new], return_inverse=True)
            apart = np.array([self._stay_apart(int(k // base) - 2, int(k % base)) for k in fresh], bool)
            answer[new] = apart[back]
            _, one = np.unique(slot[new], return_index=True)
            self._pairs[slot[new[one]]], self._apart[slot[new[one]]] = asked[new[one]], answer[new[one]]
        return answer

    def _spine(self, piece: int) -> tuple[list, list, bool]:
        """How a piece's first and last symbols grow when it is merged from characters: (symbol, rank of the merge
        that takes it in) each; and whether the merges end with the piece whole."""
        if piece not in self._spines:
            text = self.text[piece] if piece < self.size else chr(piece - self.size)
            symbols, firsts, lasts = list(text), [], []
            while len(symbols) > 1:
                ranks = [self.rank.get(a + b, np.inf) for a, b in zip(symbols[:-1], symbols[1:], strict=True)]
                least = min(ranks)
                if least == np.inf:
                    break
                i = ranks.index(least)
                if i == 0:
                    firsts.append((symbols[0], least))
                if i == len(symbols) - 2:
                    lasts.append((symbols[-1], least))
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            firsts.append((symbols[0], np.inf))
            lasts.append((symbols[-1], np.inf))
            self._spines[piece] = firsts, lasts, len(symbols) == 1
        return self._spines[piece]

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether text that begins with ``right`` after ``left`` keeps both as they are: at no time does a merge over
        the boundary come before the merges of the symbols beside it. Of equal ranks the leftmost comes first."""
        firsts, _, whole = self._spine(right)
        if left == _START or not whole:
            return whole
        lasts = self._spine(left)[1]
        i = j = 0
        while True:
            (a, next_a), (b, next_b) = lasts[i], firsts[j]
            across = self.rank.get(a + b, np.inf)
            if across < next_a and across <= next_b and across < np.inf:
                return False
            if next_a == next_b == np.inf:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    # -- texts ---------------------------------------------------------------------------------------------------

    def segments(self, text: str) -> list[str]:
        """The text's segments without their first space."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        if self.prefix and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        if self.prefix:
            return [s[1:] for s in _SEGMENT.findall(" " + text)]
        head, gap, rest = text.partition(" ")
        return ["\x00" + head] * bool(head) + [s[1:] for s in _SEGMENT.findall(gap + rest)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        first = size = 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size >= TEXT_CHARS or k == len(texts) - 1:
                out += self._encode(texts[first : k + 1])
                first, size = k + 1, 0
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.segments(t or "") for t in texts]
        wanted = sorted(set().union(*cut) - self._store.keys())
        if self._stored + sum(map(len, wanted)) > STORE_BYTES:
            self.forget()
            wanted = sorted(set().union(*cut))
        for part in _portions(wanted):
            spelled = [s[1:] if s[:1] == "\x00" and not self.prefix else MARK + s.replace(" ", MARK) for s in part]
            found = self.encode_segments(spelled)
            self._store.update(zip(part, found, strict=True))
            self._stored += sum(map(len, part)) + sum(map(len, found))
        return [b"".join(map(self._store.__getitem__, x)) for x in cut]

    def forget(self) -> None:
        """Empty the store."""
        self._store, self._stored = {}, 0

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode(errors="replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _portions(segments: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for s in segments:
        part.append(s)
        size += 4 + len(s)
        if size >= INDEX_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def supported(model) -> None:
    """Refuse models whose results this matching can't give."""
    spec, odd = model.normalizer_spec, []
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        odd.append("a normaliser other than identity")
    if model.trainer_spec.model_type not in (_UNIGRAM, _BPE):
        odd.append("neither unigram nor BPE pieces")
    if model.trainer_spec.treat_whitespace_as_suffix or any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type == _NORMAL):
        odd.append("pieces that cross spaces")
    if any(p.type not in (1, 2, 3, 6) for p in model.pieces):
        odd.append("user-defined pieces")
    if odd:
        raise ValueError("This model has " + ", ".join(odd))


_loaded: dict[int, PieceModel] = {}


def _model(shared) -> PieceModel:
    """A worker's one copy of the model, with what it has learnt about segments and pairs."""
    key = hash(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(shared.value)
    return _loaded[key]


def encode_texts(docs: DataFrame, model: bytes, check: bool = False) -> DataFrame:
    """(doc_id, ids) of each row of docs; with ``check`` also round_trip, whether the decoded ids are the text (spaces for
    U+2581). ``model`` is the content of a model file."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(shared)
        try:
            for batch in batches:
                given = batch.column(1).to_pylist()
                ids = pieces.encode(given)
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                columns, names = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "ids"]
                if check:
                    same = [pieces.decode(x) == (t or "").replace(MARK, " ") for x, t in zip(ids, given, strict=True)]
                    columns, names = [*columns, pa.array(same, pa.bool_())], [*names, "round_trip"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            pieces.forget()
            release()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids array<int>" + ", round_trip boolean" * check)


def decode_ids(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids decode to null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(shared)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {kind}, text string")
