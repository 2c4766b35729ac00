"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is escaped (spaces become U+2581, one is put in front), cut before every
run of U+2581, and each unit is merged by an agenda of adjacent pairs, best score
first. Every candidate popped from the agenda is skipped if its hash, keyed by
(seed, text, number of the unit in it, number of the pop), falls under ``dropout``: each
occurrence of a word is drawn afresh, and the same on every run. Characters outside the
vocabulary fall back to bytes.

What a unit becomes depends on the numbers of its skipped pops alone, so the outcomes
met are kept as a tree: unit, first skip, second skip, ... Hashes are drawn for all units of
many texts at once, an outcome further down the tree a round, and outcomes not met before are
merged together, one pop of each at a time.

* Every segmentation decodes to the text exactly; a U+2581 in a text goes as its bytes.
  Without dropout ids equal the library's, but for texts with U+2581.
* Null and empty texts have no ids and decode to the empty text. Rows are encoded one by
  one; repeated rows get equal ids, as the keys depend on the text and the seed alone.
* No merge crosses two characters that no piece has side by side: units are cut there.
* Very long texts go some thousand words at a time, long units by a heap of their own.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import TOKENIZER_DIR, _arrow_schema, _to_batch, map_rows, pick

META = "▁"
#: Stands for a U+2581 of the text among the words; no word has marks at both ends.
MARK = f"{META}x{META}"
#: Words merged at a time; outcomes and words kept; characters from which a unit's outcomes are not kept (its pops fit 64 bits below).
SLICE, MOST, LONG = 300_000, 1_000_000, 20
_RUNS = re.compile(f"{META}+[^{META}]*|[^{META}]+")


def model_path(name: str = "piece_bpe_32k.model", folder: str = TOKENIZER_DIR) -> str:
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"{folder}/{name}"


def draws(key: int, units: np.ndarray, pops: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key, unit, pop), the finalizer of SplitMix64 over a linear combination."""
    x = np.asarray(key, dtype=np.uint64) + units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pops.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Table:
    """Columns of numbers that grow together."""

    def __init__(self, **kinds):
        self.n, self.kinds = 0, kinds
        self.columns = {k: np.zeros(1024, dtype=t) for k, t in kinds.items()}

    def add(self, n: int, **values) -> int:
        """Add ``n`` rows; the number of the first."""
        at, self.n = self.n, self.n + n
        for k, c in self.columns.items():
            if self.n > len(c):
                c = self.columns[k] = np.concatenate([c, np.zeros(max(n, len(c)), dtype=c.dtype)])
            c[at : self.n] = values[k]
        return at

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name][: self.n]


class DropoutBpe:
    def __init__(self, path: str, dropout: float = 0.1, seed: int = 13):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        byte_of = {i: b for b, i in enumerate(self.bytes)}
        hidden = set(self.bytes) | {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.id_of = {p: i for i, p in enumerate(pieces) if i not in hidden}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.beside = np.unique([ord(p[i]) << 21 | ord(p[i + 1]) for p in self.id_of for i in range(len(p) - 1)])
        self.text_of = [bytes((byte_of[i],)) if i in byte_of else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        self.mark = np.array([self.bytes[b] for b in META.encode()], dtype="<u4").tobytes()
        self.dropout, self.seed = min(int(dropout * 2**64), 2**64 - 1), seed

        # Symbols are pieces by their ids, and characters that are no piece from ``size`` on. A pair of symbols may make a piece.
        self.symbol_of = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        self.strange: list[str] = []
        self.scores = np.full(n, -np.inf, dtype=np.float32)
        made: dict[int, int] = {}
        for p, i in self.id_of.items():
            self.scores[i] = self.score[p]
            for k in range(1, len(p)):
                left, right = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if left is not None and right is not None:
                    made[left * n + right] = i
        self.pair_keys = np.array(sorted(made), dtype=np.int64)
        self.pair_ids = np.array([made[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.word_parts = Table(first=np.int32, count=np.int32)
        self.parts = Table(node=np.int32)
        self.units: dict[str, int] = {}
        # An outcome: its unit, the pops skipped (bits), the first open pop, how many follow if none is skipped, where its children stand.
        self.nodes = Table(skips=np.uint64, first=np.int8, open=np.int8, child=np.int32, long=bool)
        self.child = Table(node=np.int32)
        self.ids: list[bytes] = []
        self.unit_of: list[str] = []

    # --- merging ---

    def segment(self, unit: str, skipped: Callable[[int], bool] = lambda pop: False) -> tuple[list[str], int]:
        """Merge one unit by a heap: highest score first, ties from the left; a skipped pair waits for a new neighbour. -> (pieces, pops)."""
        parts = list(unit)
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        score, agenda = self.score, []
        pop = 0

        def offer(i, j):
            s = score.get(parts[i] + parts[j])
            if s is not None:
                heapq.heappush(agenda, (-s, i, j, len(parts[i]) + len(parts[j])))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != size or after[i] != j:
                continue
            pop += 1
            if skipped(pop - 1):
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p], pop

    def _as_ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for p in parts:
            i = self.id_of.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return np.array(out, dtype="<u4").tobytes()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, -1 for none."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(self.pair_keys.searchsorted(keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (left < self.size) & (right >= 0) & (right < self.size), self.pair_ids[at], -1)

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out = self.symbol_of[points]
        if len(out) and out.min() < 0:
            for c in np.unique(points[out < 0]).tolist():
                self.symbol_of[c] = self.size + len(self.strange)
                self.strange.append(chr(c))
            out = self.symbol_of[points]
        return out

    def merge(self, units: list[str], skips: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """:meth:`segment` of many units of at most LONG characters, skipping the pops whose bits are set: (ids, pops) of each."""
        out: list[bytes] = [b""] * len(units)
        pops = np.zeros(len(units), dtype=np.int64)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        for low in range(0, LONG, 10):
            chosen = np.flatnonzero((sizes > low) & (sizes <= low + 10))
            for at in range(0, len(chosen), 8192):
                rows = chosen[at : at + 8192]
                self._lockstep([units[r] for r in rows.tolist()], sizes[rows], skips[rows], low + 10, rows, out, pops)
        return out, pops

    def _lockstep(self, units: list[str], size: np.ndarray, skips: np.ndarray, width: int, rows: np.ndarray, out: list[bytes], pops: np.ndarray) -> None:
        """One pop of every row at a time, on rows of symbols and of the pieces their neighbours make."""
        place = np.arange(width + 1)
        sym = np.full((len(units), width + 1), -1, dtype=np.int32)
        sym[place < size[:, None]] = self._symbols("".join(units))
        made = np.full((len(units), width + 1), -1, dtype=np.int32)
        made[:, :width] = self._pairs(sym[:, :-1], sym[:, 1:])
        scores = np.append(self.scores, np.float32(-np.inf))  # the last one is that of -1
        worth = scores[made]
        size = size.copy()
        pop = np.zeros(len(units), dtype=np.uint64)
        while True:
            j = worth.argmax(1)
            every = np.arange(len(j))
            live = worth[every, j] > -np.inf
            n_live = int(live.sum())
            if n_live < 0.75 * len(j) or not n_live:
                done = ~live
                self._emit(sym[done], size[done], rows[done], out)
                pops[rows[done]] = pop[done]
                if not n_live:
                    return
                sym, made, worth, size, skips, pop, rows, j = (x[live] for x in (sym, made, worth, size, skips, pop, rows, j))
                every, live = every[:n_live], np.ones(n_live, dtype=bool)
            skip = live & ((skips >> pop) & np.uint64(1) == 1)
            pop[live] += np.uint64(1)
            worth[every[skip], j[skip]] = -np.inf
            r = np.flatnonzero(live & ~skip)
            k = j[r]
            at = k[:, None]
            # The pair becomes one symbol, and what stands right of it moves up.
            one, two = sym[r], made[r]
            one[:, :-1] = np.where(place[:-1] > at, one[:, 1:], one[:, :-1])
            one[:, -1] = -1
            one[np.arange(len(r)), k] = two[np.arange(len(r)), k]
            sym[r] = one
            three = worth[r]
            for moved, empty in ((two, -1), (three, -np.inf)):
                moved[:, :-1] = np.where(place[:-1] >= at, moved[:, 1:], moved[:, :-1])
                moved[:, -1] = empty
            made[r], worth[r] = two, three
            size[r] -= 1
            right = self._pairs(sym[r, k], sym[r, k + 1])
            made[r, k], worth[r, k] = right, scores[right]
            r, k = r[k > 0], k[k > 0]
            left = self._pairs(sym[r, k - 1], sym[r, k])
            made[r, k - 1], worth[r, k - 1] = left, scores[left]

    def _emit(self, sym: np.ndarray, size: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        flat = sym[np.arange(sym.shape[1]) < size[:, None]]
        ends = np.cumsum(size)
        if len(flat) and flat.max() >= self.size:
            for r, a, b in zip(rows.tolist(), (ends - size).tolist(), ends.tolist()):
                ids = chain.from_iterable([i] if i < self.size else [self.bytes[b] for b in self.strange[i - self.size].encode()] for i in flat[a:b].tolist())
                out[r] = np.fromiter(ids, dtype="<u4").tobytes()
            return
        data = flat.astype("<u4").tobytes()
        for r, a, b in zip(rows.tolist(), (4 * (ends - size)).tolist(), (4 * ends).tolist()):
            out[r] = data[a:b]

    # --- the tree of outcomes ---

    def _add_nodes(self, units: list[str], skips: np.ndarray, first: np.ndarray) -> int:
        """New outcomes; the number of the first. Long units get none, they are merged where they stand."""
        short = [u if 0 < len(u) <= LONG else "" for u in units]
        ids, pops = self.merge(short, skips)
        open_ = np.where(np.array([len(u) > LONG for u in units]), 0, np.maximum(pops - first, 0))
        at = self.nodes.add(len(units), skips=skips, first=first, open=open_, child=self.child.n + np.cumsum(open_) - open_, long=[len(u) > LONG for u in units])
        self.child.add(int(open_.sum()), node=-1)
        self.ids += ids
        self.unit_of += units
        return at

    def _learn(self, words: list[str]) -> None:
        """Cut new words into units, and merge those that are new."""
        whole = [w if w[:1] == META else w[:-1] if w[-1:] == META else META + w for w in words]
        joined = "".join(whole)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)))
        pairs = points[:-1] << 21 | points[1:]
        at = np.minimum(self.beside.searchsorted(pairs), len(self.beside) - 1)
        cut = np.append(True, self.beside[at] != pairs)
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        units = [joined[a:b] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(joined)])]
        counts = np.diff(starts.searchsorted(ends), prepend=0)
        if MARK in words:  # is no unit of a text, but itself
            units = list(chain.from_iterable([MARK] if w == MARK else units[a:b] for w, a, b in zip(words, (np.cumsum(counts) - counts).tolist(), np.cumsum(counts).tolist())))
            counts[words.index(MARK)] = 1
        new = list(dict.fromkeys(u for u in units if u not in self.units))
        if new:
            zero = np.zeros(len(new), dtype=np.int64)
            at = self._add_nodes(new, zero.astype(np.uint64), zero)
            self.units.update(zip(new, range(at, at + len(new))))
            if MARK in new:
                k = self.units[MARK]
                self.ids[k], self.nodes["open"][k] = self.mark, 0
        at = self.parts.add(len(units), node=np.fromiter(map(self.units.__getitem__, units), dtype=np.int64, count=len(units)))
        first = self.word_parts.add(len(words), first=at + np.cumsum(counts) - counts, count=counts)
        self.words.update(zip(words, range(first, first + len(words))))

    def _children(self, node: np.ndarray, pop: np.ndarray) -> np.ndarray:
        """The outcomes with one more skip."""
        slot = self.nodes["child"][node].astype(np.int64) + pop - self.nodes["first"][node]
        found = self.child["node"][slot]
        lack = np.flatnonzero(found < 0)
        if len(lack):
            slots, one = np.unique(slot[lack], return_index=True)
            of, at = node[lack[one]], pop[lack[one]]
            skips = self.nodes["skips"][of] | np.uint64(1) << at.astype(np.uint64)
            first = self._add_nodes([self.unit_of[n] for n in of.tolist()], skips, at + 1)
            self.child["node"][slots] = np.arange(first, first + len(slots))
            found = self.child["node"][slot]
        return found

    def _alone(self, unit: str, key: int, number: int) -> bytes:
        """A long unit, by the same draws: three pops a character are more than there can be."""
        skips = draws(key, np.full(1, number), np.arange(3 * len(unit))) < np.uint64(self.dropout)
        return self._as_ids(self.segment(unit, skips.__getitem__)[0])

    def _run(self, texts: list[tuple[int, list[str], int]]) -> tuple[list[bytes], list[int]]:
        """For each (key, words, units before them): ids, and units up to here."""
        if max(self.nodes.n, len(self.words)) > MOST:
            self.clear()
        words = list(chain.from_iterable(w for _, w, _ in texts)) if len(texts) > 1 else texts[0][1]
        code = np.fromiter(map(self.words.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lack = np.flatnonzero(code < 0).tolist()
        if lack:
            self._learn(list(dict.fromkeys(words[k] for k in lack)))
            code[lack] = [self.words[words[k]] for k in lack]
        n = self.word_parts["count"][code]
        total = int(n.sum())
        node = self.parts["node"][np.arange(total) + np.repeat(self.word_parts["first"][code] - (np.cumsum(n) - n), n)].astype(np.int64)
        ends = np.cumsum(n)[np.cumsum([len(w) for _, w, _ in texts]) - 1]
        each = np.diff(ends, prepend=0)
        number = np.arange(total) - np.repeat(ends - each - np.array([b for *_, b in texts]), each)
        keys = np.repeat(np.array([k for k, *_ in texts], dtype=np.uint64), each)
        active = np.arange(total) if self.dropout else ()
        while len(active):
            here = node[active]
            open_ = self.nodes["open"][here].astype(np.int64)
            some = open_ > 0
            active, here, open_ = active[some], here[some], open_[some]
            which = np.repeat(np.arange(len(active)), open_)
            pops = np.arange(len(which)) + np.repeat(self.nodes["first"][here] - (np.cumsum(open_) - open_), open_)
            at = active[which]
            hit = np.flatnonzero(draws(keys[at], number[at], pops) < np.uint64(self.dropout))
            which = which[hit]
            new = np.append(True, which[1:] != which[:-1]) if len(which) else np.zeros(0, dtype=bool)
            active = active[which[new]]
            if len(active):
                node[active] = self._children(node[active], pops[hit[new]])
        out = list(map(self.ids.__getitem__, node.tolist()))
        for k in np.flatnonzero(self.nodes["long"][node]).tolist():
            out[k] = self._alone(self.unit_of[node[k]], int(keys[k]), int(number[k]))
        starts = (ends - each).tolist()
        return [b"".join(out[a:b]) for a, b in zip(starts, ends.tolist())], [b + e for (*_, b), e in zip(texts, each.tolist())]

    # --- texts ---

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text: without their space, or as a run of U+2581 and what follows, or with a U+2581 behind if no space is before them."""
        if META not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        words: list[str] = []
        for i, part in enumerate(text.split(META)):
            if i:
                words.append(MARK)
            for unit in _RUNS.findall(("" if i else META) + part.replace(" ", META)):
                words.append(unit + META if unit[0] != META else unit[1:] if unit[1:2] not in ("", META) else unit)
        return words

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, tuple[int, list[str], int]]] = []
        weight = 0

        def flush():
            for (i, _), ids in zip(held, self._run([h for _, h in held])[0]):
                out[i] = ids
            held.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            key, words = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), self.seed), self.split(text)
            if len(words) > SLICE:
                made, base = [], 0
                for at in range(0, len(words), SLICE):
                    ids, (base,) = self._run([(key, words[at : at + SLICE], base)])
                    made += ids
                out[i] = b"".join(made)
                continue
            held.append((i, (key, words, 0)))
            weight += len(words)
            if weight >= SLICE:
                flush()
                weight = 0
        if held:
            flush()
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=1)
def shared_bpe(path: str, dropout: float, seed: int) -> DropoutBpe:
    """One a Python worker: the outcomes met in a task serve the next one."""
    return DropoutBpe(path, dropout, seed)


def encode_documents(docs: DataFrame, dropout: float = 0.1, seed: int = 13, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, lossless (decoding gives the text back), and ids if asked for."""
    path = path or model_path()

    schema = "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + (", ids array<long>" if with_ids else "")
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(path, dropout, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = []
                for doc_id, text, data in zip(part.column(0).to_pylist(), texts, bpe.encode_all(texts)):
                    row = (doc_id, len(data) // 4, zlib.crc32(data), bpe.decode(data) == text)
                    rows.append(row + ((np.frombuffer(data, dtype="<u4").astype(np.int64).tolist(),) if with_ids else ()))
                yield _to_batch(rows, arrow)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows with ids."""
    path = path or model_path()

    def make():
        bpe = shared_bpe(path, 0.0, 0)
        return lambda doc_id, ids: [(doc_id, bpe.decode(np.array(ids or (), dtype="<u4").tobytes()))]

    return map_rows(pick(encoded, "doc_id", "ids"), "doc_id long, text string", make, 2)
