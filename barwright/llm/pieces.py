"""SentencePiece BPE: ids of whole texts by a table of each prefix's last token, and their texts again."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from barwright.llm.common import small_batches
from barwright.llm.tokens import SMALL_SLICE, slices

SPACE = "▁"
#: Stretches between spaces whose ids a task remembers, and their longest; verdicts on pairs that it remembers.
REMEMBERED, LONGEST, VERDICTS = 250_000, 64, 1 << 21
#: So few stretches are gone through one by one, not side by side.
FEW = 6
_NEVER = -np.inf


class Automaton:
    """All pieces that end at a character, longest first, as tables: numpy can step through many texts at once.

    Only characters of longer pieces have columns in the table of steps; states without children share the row of their
    longest suffix. A state's `first` is its longest suffix that is a piece, a piece's `after` the next shorter one.
    """

    def __init__(self, pieces: dict[str, int]):
        chars = sorted({c for p in pieces if len(p) > 1 for c in p})
        self.column = np.zeros(0x110000, np.int16)  # 0: the character is in no longer piece
        self.column[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        children: list[dict[int, int]] = [{}]
        token, depth = [-1], [0]
        for p, i in pieces.items():
            at = 0
            for c in map(int, self.column[[ord(c) for c in p]]) if len(p) > 1 or self.column[ord(p)] else ():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    token.append(-1)
                    depth.append(depth[at] + 1)
                at = children[at][c]
            if at:
                token[at] = i
        self.token, self.depth = np.array(token, np.int64), np.array(depth, np.int64)
        self.first, self.after, self.row = (np.zeros(len(children), np.int32) for _ in range(3))
        rows, suffix, queue = [np.zeros(len(chars) + 1, np.int32)], [0] * len(children), deque([0])
        while queue:
            s = queue.popleft()
            self.after[s] = self.first[suffix[s]]
            self.first[s] = s if token[s] >= 0 else self.after[s]
            shared = rows[self.row[suffix[s]]]
            self.row[s] = self.row[suffix[s]]
            if children[s]:
                if s:
                    self.row[s] = len(rows)
                    rows.append(shared.copy())
                for c, t in children[s].items():
                    suffix[t] = int(shared[c]) if s else 0
                    rows[self.row[s]][c] = t
                    queue.append(t)
        self.steps = np.stack(rows)


class Codec:
    """Encodes as the library does with a BPE model.

    The library merges the best-scoring pair of neighbours (the leftmost of equals) until no two make a piece. Whatever
    stands in one token at the end was merged as it would have been alone, so a sequence of tokens is the result just if
    every two neighbours stay apart when they are merged together. Hence each prefix of a text has exactly one last token:
    the piece ending there, known by the automaton, that stays apart from the last token of the prefix before it. A text's
    table of last tokens is filled in one pass over the matches; its ids are read from the end.
    """

    def __init__(self, model: bytes):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.text_of = {i: sp.id_to_piece(i) for i in plain}
        self.score = {p: sp.get_score(i) for i, p in self.text_of.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.is_unused(i) for i in plain) or any(c not in self.score for p in self.score for c in p) or not all(map(sp.is_byte, self.bytes)):
            raise ValueError("models need pieces for all bytes and for all characters of pieces, and none unused")
        self.automaton = Automaton({p: i for i, p in self.text_of.items()})
        # What a character that stands in no longer piece becomes: its own piece, a byte, or -its number for several bytes.
        self.alone = -np.arange(0x110000, dtype=np.int64)
        self.alone[:128] = self.bytes[:128]
        for p, i in [(p, i) for i, p in self.text_of.items() if len(p) == 1]:
            self.alone[ord(p)] = i
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
        # No piece goes on from another character to a space, so a text falls apart before its spaces.
        apart = all(SPACE not in p.lstrip(SPACE) for p in self.score)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if apart else "(?s:.+)").findall
        self.histories: dict[int, tuple | None] = {}
        self.keys, self.verdicts = np.full(VERDICTS, -1, np.int64), np.zeros(VERDICTS, bool)
        self.remembered: dict[str, bytes] = {}

    def _history(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """Merges of a piece's own characters in order: scores, first and last symbols before each (and at the end); None if they end otherwise."""
        if token not in self.histories:
            symbols, scores = list(self.text_of[token]), []
            firsts, lasts = [symbols[0]], [symbols[-1]]
            while len(symbols) > 1:
                best, at = max((self.score.get(symbols[k] + symbols[k + 1], _NEVER), -k) for k in range(len(symbols) - 1))
                if best == _NEVER:
                    break
                symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
                scores.append(best)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
            self.histories[token] = ([*scores, _NEVER], firsts, lasts) if len(symbols) == 1 else None
        return self.histories[token]

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are never merged across: both histories are run together, best score first.

        Without a token before it (-1), whether a piece is what its characters are merged to at all.
        """
        if self._history(right) is None or left < 0:
            return self._history(right) is not None
        (a, _, lasts), (b, firsts, _) = self._history(left), self._history(right)
        i = j = 0
        while True:
            across = self.score.get(lasts[i] + firsts[j], _NEVER)
            if a[i] != _NEVER and a[i] >= across and a[i] >= b[j]:
                i += 1
            elif across != _NEVER and across >= b[j]:
                return False
            elif b[j] != _NEVER:
                j += 1
            else:
                return True

    def _fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """_apart of many pairs: verdicts are remembered in a table with a slot for each hash of a pair."""
        key = ((before + 1) << 24) | token
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (VERDICTS - 1)
        out, lost = self.verdicts[slot], np.flatnonzero(self.keys[slot] != key)
        if len(lost):
            some, first, back = np.unique(key[lost], return_index=True, return_inverse=True)
            made = np.fromiter((self._apart((k >> 24) - 1, k & 0xFFFFFF) for k in some.tolist()), bool, len(some))
            out[lost] = made[back]
            at = slot[lost[first]]
            self.keys[at], self.verdicts[at] = some, made
        return out

    def _tables(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each prefix of each part what its last token is and how long: part k's are from base[k] on; parts must be sorted, longest first."""
        a = self.automaton
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        column, start = a.column[codes], np.cumsum(size) - size
        base = start + np.arange(len(parts))
        last, made, length = np.full(len(codes) + len(parts), -1, np.int64), np.zeros(len(codes) + len(parts), np.int64), np.ones(len(codes) + len(parts), np.int64)
        state = np.zeros(len(parts), np.int32)
        active = len(parts) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))  # parts of at least so many characters
        at = 1
        for at in range(1, int(size[0]) + 1):
            m = active[at - 1]
            if m <= FEW and at > LONGEST:
                break
            c = column[start[:m] + at - 1]
            state[:m] = a.steps[a.row[state[:m]], c]
            made[base[:m] + at] = self.alone[codes[start[:m] + at - 1]]  # and last stays -1: nothing is merged with it
            todo = np.flatnonzero(c)
            found = a.first[state[todo]]
            while len(todo):
                token, n = a.token[found], a.depth[found]
                here = base[todo] + at
                fits = self._fit(last[here - n], token)
                last[here[fits]] = made[here[fits]] = token[fits]
                length[here[fits]] = n[fits]
                todo, found = todo[~fits], a.after[found[~fits]]
        else:
            return base, size, made, length
        for k in range(active[at - 1]):
            self._go_on(at, int(state[k]), codes[start[k] :], size[k], last[base[k] :], made[base[k] :], length[base[k] :])
        return base, size, made, length

    def _go_on(self, at: int, state: int, codes: np.ndarray, size: int, last: np.ndarray, made: np.ndarray, length: np.ndarray) -> None:
        """The rest of one part's table, from the prefix of `at` characters on."""
        a, verdicts = self.automaton, {}
        row, first, after, token, depth = a.row.tolist(), a.first.tolist(), a.after.tolist(), a.token.tolist(), a.depth.tolist()
        ends = last[:at].tolist()
        for code, c in zip(codes[at - 1 : size].tolist(), a.column[codes[at - 1 : size]].tolist(), strict=True):
            state = int(a.steps[row[state], c])
            if not c:
                made[at] = self.alone[code]
                ends.append(-1)
            else:
                s = first[state]
                while True:
                    pair = (ends[at - depth[s]], token[s])
                    fits = verdicts.get(pair)
                    if fits is None:
                        fits = verdicts[pair] = self._apart(*pair)
                    if fits:
                        break
                    s = after[s]
                ends.append(token[s])
                made[at], length[at] = token[s], depth[s]
            at += 1

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each part."""
        if not parts:
            return []
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        base, size, made, length = self._tables([parts[k] for k in order])
        at, rows, steps = size.copy(), np.arange(len(parts)), []
        while len(rows):  # from the ends, a token of each part at a time
            here = base[rows] + at[rows]
            steps.append((rows, made[here]))
            at[rows] -= length[here]
            rows = rows[at[rows] > 0]
        count = np.zeros(len(parts), np.int64)
        for rows, _ in steps:
            count[rows] += 1
        upto = np.cumsum(count)
        ids = np.zeros(upto[-1], np.int64)
        for step, (rows, tokens) in enumerate(steps):
            ids[upto[rows] - 1 - step] = tokens
        if (ids < 0).any():  # characters of several bytes without a piece
            coded = [[i] if i >= 0 else [self.bytes[b] for b in chr(-i).encode()] for i in ids.tolist()]
            upto = np.concatenate(([0], np.cumsum([len(x) for x in coded])))[upto]
            ids = np.array([i for x in coded for i in x])
        packed = ids.astype("<u4").tobytes()
        out: list[bytes] = [b""] * len(parts)
        for k, lo, hi in zip(order, [0, *(4 * upto[:-1]).tolist()], (4 * upto).tolist(), strict=True):
            out[k] = packed[lo:hi]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        known = self.remembered
        parts = [self.parts(t) if t else [] for t in self.library.normalize([t or "" for t in texts])]
        new = list({p for own in parts for p in own if p not in known})
        made = dict(zip(new, self._ids(new), strict=True))
        if len(known) + len(made) > REMEMBERED:
            made |= {p: known[p] for own in parts for p in own if p in known}
            known.clear()
        known.update(made)
        out = [b"".join([self.begin, *map(known.__getitem__, own), self.end]) for own in parts]
        for p in [p for p in made if len(p) > LONGEST]:
            del known[p]
        return out

    def decode(self, packed: bytes | None) -> str | None:
        return None if packed is None else self.library.decode(np.frombuffer(packed, "<u4").tolist())


_codecs: dict[bytes, Codec] = {}


def _codec(model: bytes) -> Codec:
    """A Python worker's codec of a model: it lives as long as the worker does."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(model)
    return _codecs[model]


def _by_row(df: DataFrame, model_path: str, column: str, schema: str, make: Callable[[Codec, list], list[pa.Array]]) -> DataFrame:
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())  # half a megabyte, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for b in slices(batches, column, SMALL_SLICE):
            at = b.schema.get_field_index(column)
            rest = [b.column(k) for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, *make(codec, b.column(at).to_pylist())], names=[c.split()[0] for c in schema.split(", ")])

    return small_batches(df).mapInArrow(run, schema)


def _encoded(codec: Codec, texts: list) -> list[pa.Array]:
    packed = codec.encode(texts)
    return [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]


def _decoded(codec: Codec, packed: list) -> list[pa.Array]:
    return [pa.array([codec.decode(p) for p in packed], pa.string())]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) for each row: the ids of its whole text with begin and end, packed as unsigned 32-bit integers.

    model_path is read on the driver. Null and empty texts are begin and end alone; null and repeated ids, and any other
    columns, do not matter; an empty table gives no rows. Characters without a piece become bytes. A task remembers the
    ids of at most REMEMBERED stretches between spaces.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return _by_row(rows, model_path, "text", f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary", _encoded)


def decode(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row of packed ids: what the library decodes them to; null ids give a null text."""
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return _by_row(rows, model_path, "ids", f"id {rows.schema['id'].dataType.simpleString()}, text string", _decoded)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, text): encode() with what decode() makes of the ids, in one pass over the rows."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def make(codec: Codec, texts: list) -> list[pa.Array]:
        n, packed = _encoded(codec, texts)
        return [n, packed, *_decoded(codec, packed.to_pylist())]

    return _by_row(rows, model_path, "text", f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, text string", make)
