"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.plans.session import ship

SPACE = "▁"
#: A run of spaces and what follows up to the next space: no piece goes beyond one (Vocabulary checks it).
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units longer than this have a heap of their own; shorter ones share an agenda, whose rows are searched as a whole.
ALONE = 24
#: Bounds of memory only: the places of a shared agenda, the units that are cut and segmented together, the characters of the units that a worker remembers, and the texts of a result.
CELLS, TOGETHER, REMEMBERED, ROWS = 1 << 17, 1 << 15, 1 << 21, 512
NEVER = np.iinfo(np.int32).max
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, agrees boolean"


class Vocabulary:
    """A model's pieces and the merges that they allow."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = sp.id_to_piece(list(range(n)))
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(sp.is_unused(i) for i in range(n)) or len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has unused pieces or no byte fallback")
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal):
            raise ValueError("a piece goes on beyond a space")
        self.ids = {self.pieces[i]: i for i in normal}
        # Symbols: a piece has its id; a character that is no piece has its code point, counted on from the number of pieces.
        self.symbols = np.arange(n, n + 0x110000)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        usual = set(normal)
        self.decimal = [str(i) for i in range(n)]
        self.plain = [p.replace(SPACE, " ") if i in usual else None for i, p in enumerate(self.pieces)]
        scores = {i: sp.get_score(i) for i in normal}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        merges = {}
        for i in normal:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.symbol(p[:k]), self.symbol(p[k:])
                if a is not None and b is not None:
                    merges[a, b] = (ranks[scores[i]], i)
        self.merges = merges
        keys = np.array([a << 32 | b for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in merges.values()], np.int32)[order]
        self.made = np.array([m for _, m in merges.values()], np.int64)[order]

    def symbol(self, s: str) -> int | None:
        if (i := self.ids.get(s)) is not None:
            return i
        return len(self.pieces) + ord(s) if len(s) == 1 else None

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair of symbols the rank of the piece that they make (NEVER: none) and that piece."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(good, self.ranks[at], NEVER), np.where(good, self.made[at], -1)

    def out(self, symbols) -> list[int]:
        """Symbols as ids: a character that is no piece becomes its UTF-8 bytes' ids."""
        n, ids = len(self.pieces), []
        for s in symbols:
            if s < n:
                ids.append(s)
            else:
                ids += [self.byte_ids[x] for x in chr(s - n).encode("utf-8")]
        return ids

    def alone(self, unit: str) -> list[int]:
        """A unit's ids by an agenda of its own: a heap of (rank, place), the best and leftmost pair first."""
        symbols = [self.symbol(c) for c in unit]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i):
            if 0 <= i and after[i] < n and (m := self.merges.get((symbols[i], symbols[after[i]]))):
                heapq.heappush(agenda, (m[0], i, symbols[i], symbols[after[i]]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            k = after[i]
            if symbols[i] != a or k >= n or symbols[k] != b:
                continue
            symbols[i], symbols[k], after[i] = self.merges[a, b][1], -1, after[k]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return self.out(s for s in symbols if s >= 0)

    def together(self, units: list[str]) -> list[list[int]]:
        """The ids of units of similar length, by an agenda with a row for each.

        Row r's agenda holds the rank of the pair that starts at each place; a round takes each row's best
        and leftmost pair, joins it, and scores the two pairs that the new symbol makes.
        """
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        rows, width = len(units), int(sizes.max())
        symbols = np.full((rows, width + 1), -1)  # the place after the last one stays empty
        symbols[np.arange(width + 1) < sizes[:, None]] = self.symbols[np.frombuffer("".join(units).encode("utf-32-le", "replace"), "<u4")]
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        rank, made = self.look(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(rows)
        while len(live):
            i = rank[live].argmin(axis=1)
            more = rank[live, i] != NEVER
            live, i = live[more], i[more]
            if not len(live):
                break
            k = after[live, i]
            symbols[live, i] = made[live, i]
            symbols[live, k], rank[live, k] = -1, NEVER
            q = after[live, k]
            after[live, i] = q
            inside = q < width
            before[live[inside], q[inside]] = i[inside]
            rank[live, i], made[live, i] = self.look(symbols[live, i], symbols[live, q])
            p = before[live, i]
            left = p >= 0
            rank[live[left], p[left]], made[live[left], p[left]] = self.look(symbols[live[left], p[left]], symbols[live[left], i[left]])
        left = symbols >= 0
        ends = np.cumsum(left.sum(axis=1)).tolist()
        flat = symbols[left].tolist()
        spelt = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return [self.out(x) for x in spelt] if symbols.max(initial=0) >= len(self.pieces) else spelt

    def segment(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit."""
        out: list = [None] * len(units)
        sized: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            if len(u) > ALONE:
                out[k] = self.alone(u)
            else:
                sized.setdefault((len(u) - 1).bit_length(), []).append(k)
        for places in sized.values():
            step = max(1, CELLS // max(len(units[k]) for k in places))
            for at in range(0, len(places), step):
                some = places[at : at + step]
                for k, ids in zip(some, self.together([units[k] for k in some]), strict=True):
                    out[k] = ids
        return out

    def units(self, text: str | None) -> Iterator[str]:
        """A text's units: spaces are written as SPACE, and one is set before a text that isn't empty."""
        if not text:
            return iter(())
        text = SPACE + text.replace(" ", SPACE)
        return iter(UNIT.findall(text)) if len(text) <= CELLS else (m[0] for m in UNIT.finditer(text))

    def encode(self, text: str | None) -> list[int]:
        """A text's ids, with the end id."""
        return [i for ids in self.segment(list(self.units(text))) for i in ids] + [self.end]

    def spell(self, ids) -> str:
        """The pieces of ids, with spaces for SPACE and bytes read as UTF-8; a byte that fits none becomes U+FFFD."""
        try:
            return "".join([self.plain[i] for i in ids])
        except TypeError:  # bytes, or what isn't spelled as it is written
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(lenient(bytes(run)))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.silent:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(lenient(bytes(run)))
        return "".join(out)

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding set before it."""
        first = next((i for i in ids if i not in self.silent), self.unknown)
        text = self.spell(ids)
        return text[1:] if first not in self.bytes and first != self.unknown and self.pieces[first].startswith(SPACE) else text


codecs.register_error("each byte", lambda bad: ("�", bad.start + 1))


def lenient(run: bytes) -> str:
    """Bytes as UTF-8, with a U+FFFD for every byte that belongs to no character."""
    return run.decode("utf-8", "each byte")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Memory:
    """What a worker knows of units: their ids in decimal; what the ids spell, if it isn't the unit itself; and the units that the library encodes or decodes otherwise."""

    def __init__(self, v: Vocabulary):
        self.v, self.size = v, 0
        self.ids: dict[str, str] = {}
        self.spelled: dict[str, str] = {}
        self.wrong: set[str] = set()

    def learn(self, units: list[str]) -> None:
        """Learns those of units that are new. When the memory is full, it starts anew."""
        if not (fresh := {u for u in units if u not in self.ids}):
            return
        if self.size + sum(map(len, fresh)) > REMEMBERED:
            for x in (self.ids, self.spelled, self.wrong):
                x.clear()
            self.size, fresh = 0, set(units)
        self.size += sum(map(len, fresh))
        units = sorted(fresh)
        v = self.v
        found = v.segment(units)
        said = [u[1:].replace(SPACE, " ") for u in units]
        # the library sets the first space itself, but before an empty text
        theirs = v.library.encode(said, num_threads=1)
        decoded = v.library.decode(found, num_threads=1)
        for u, ids, same, text, plain in zip(units, found, theirs, decoded, said, strict=True):
            self.ids[u] = " ".join([v.decimal[i] for i in ids])
            spelled = v.spell(ids)
            if spelled[1:] != plain or not spelled.startswith(" "):
                self.spelled[u] = spelled
            if ids != (same or [v.library.piece_to_id(SPACE)]) or spelled[1:] != text:
                self.wrong.add(u)

    def tell(self, units: list[str]) -> tuple[str, str, bool]:
        """Of units that were learned: their ids, what they spell, and whether the library agrees."""
        ids = " ".join([self.ids[u] for u in units])
        text = "".join([self.spelled.get(u, u) for u in units] if self.spelled else units).replace(SPACE, " ")
        return ids, text, self.wrong.isdisjoint(units)


@cache
def memory(path: str) -> Memory:
    return Memory(vocabulary(path))


class Digest:
    """A text's ids and decoded text, taken in part by part: their number and hashes."""

    def __init__(self):
        self.n, self.ids, self.text, self.agrees = 0, hashlib.sha256(), hashlib.sha256(), True

    def add(self, ids: str, text: str) -> None:
        self.ids.update((" " * (self.n > 0) + ids).encode())
        self.text.update(text.encode())
        self.n += ids.count(" ") + 1

    def result(self) -> tuple:
        return self.n, self.ids.hexdigest(), self.text.hexdigest(), self.agrees


class Whole:
    """A text's ids and decoded text themselves."""

    def __init__(self):
        self.ids, self.text, self.agrees = [], [], True

    def add(self, ids: str, text: str) -> None:
        self.ids += map(int, ids.split())
        self.text.append(text)

    def result(self) -> tuple:
        return self.ids, "".join(self.text), self.agrees


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids, text, agrees): each whole text's ids with the end id, and the text that they decode to.

    A text is a row of units that no merge crosses; units new to a worker are segmented together, and
    compared with the library's encoding and decoding of the same units (agrees: all of a text's units are the same). Null
    texts are empty ones: the end id alone. Texts are taken in parts, so a worker's memory does not grow with their length
    (but for what is returned). Repeated rows give repeated rows; other columns are not read.
    """
    return run_on(docs, model, key, text, Whole, pa.schema([("ids", pa.list_(pa.int32())), ("text", pa.string()), ("agrees", pa.bool_())]), "ids array<int>, text string, agrees boolean")


def digest(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_tokens, ids_sha256, decoded_sha256, agrees): encode's rows by their digests."""
    return run_on(docs, model, key, text, Digest, pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("agrees", pa.bool_())]), RESULT)


def run_on(docs: DataFrame, model: str, key: str, text: str, kind: type, schema: pa.Schema, ddl: str) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(model), memory(model)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                states = results(v, known, (x.as_py() for x in part.column(1)), kind)
                columns = [pa.array(c, t) for c, t in zip(zip(*(s.result() for s in states), strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["key", *schema.names])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {ddl}")


def results(v: Vocabulary, known: Memory, texts: Iterator[str | None], kind: type) -> list:
    """A kind for each text, with all its units and the end id taken in; about TOGETHER units are looked up at once."""
    states: list = []
    queue: list[tuple[int, int]] = []  # (text, its units) of what waits
    units: list[str] = []

    def flush():
        known.learn(units)
        at = 0
        for i, n in queue:
            s = states[i]
            ids, text, agrees = known.tell(units[at : at + n])
            at += n
            # the first unit starts with the space that was set before the text
            s.add(ids, text if s in begun else text[1:])
            s.agrees &= agrees
            begun.add(s)
        queue.clear()
        units.clear()

    begun: set = set()
    for i, text in enumerate(texts):
        states.append(kind())
        cut = v.units(text)
        while some := list(islice(cut, TOGETHER - len(units))):
            queue.append((i, len(some)))
            units += some
            if len(units) >= TOGETHER:
                flush()
    flush()
    for s in states:
        s.add(str(v.end), "")
    return states
