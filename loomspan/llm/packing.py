"""Best-fit packing of tokenized documents by bin completion.

Pieces are counted by length; at most ``capacity`` lengths exist, so the
counts fit the driver whatever the corpus. On the counts a plan is searched
(bins with the same filling are one group with a multiplicity), and every
piece then takes the slot of its rank among the pieces of its length.

* Best-fit decreasing gives the incumbent. Bin completion then makes the plan: around the
  largest remaining length it takes undominated fillings, fullest first, and leaves branches
  whose waste exceeds what the incumbent allows. It ends at the lower bound, or with all
  branches searched (the plan is then the best there is), or after ``max_nodes`` fillings
  looked at, with the best plan so far. Fillings are enumerated lazily and never cut.
* Ranks use a two-level count over (length, salt), so a length that holds a third of all
  pieces is ranked by many tasks; a length has a salt more for each 100,000 pieces.
* A null or empty text is its end token alone: one piece. Longer documents are cut, none is
  truncated or dropped. Repeated rows are packed once each. An empty table packs to nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, SparkSession, _arrow_schema, _to_batch, kept, map_rows, materialize, pick

#: Least salts of a length, and of full pieces, which need no partner; pieces of a salt beyond those.
SALTS, FULL_SALTS, PER_SALT = 64, 4096, 100_000
#: Search frames that keep their enumeration.
FRAMES = 64


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str = TOKENIZER_DIR) -> str:
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"{folder}/{name}"


class Encoder:
    """Whole-text ids as little-endian uint32 bytes, each word encoded once.

    The tokenizer never joins across white space, nor a run of letters with
    ASCII marks after it. So a word's ids are those of its lower-cased letters
    and of its marks, and new letter runs are encoded together, in one call.
    """

    MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    MARK_BYTES = MARKS.encode()

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.limit = limit

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, texts: list[list[bytes]]) -> None:
        """Make sure that every word of ``texts`` is known."""
        every = set().union(*texts)
        new = every.difference(self.words)
        if len(self.words) + len(new) > self.limit:
            self.words.clear()
            new = every
        if new:
            self._learn(new)

    def _parts(self, raw: bytes) -> tuple[bytes, bytes] | None:
        """(lower-cased letters, ASCII marks after them); None for any other word, and where lower-casing is not letter by letter."""
        core = raw.rstrip(self.MARK_BYTES)
        if core.isalpha():  # of bytes: ASCII letters
            return core.lower(), raw[len(core) :]
        if core.isascii():
            return None
        letters = core.decode()
        low = letters.lower()
        return (low.encode(), raw[len(core) :]) if letters.isalpha() and low.isalpha() and len(low) == len(letters) and "\u03a3" not in letters else None

    def _learn(self, words: set[bytes]) -> None:
        if len(self.letters) > 1.5 * self.limit:  # what words are made of outlasts them
            self.letters.clear()
        letters, known = self.letters, self.words
        made = []
        for raw in words:
            parts = self._parts(raw)
            if parts is None:
                known[raw] = self._ids(raw.decode()).tobytes()
            else:
                made.append((raw, *parts))
        runs = list({low for _, low, _ in made}.difference(letters))
        ids = self._ids(b" ".join(runs).decode())
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(runs):
            data, at = ids.tobytes(), 0
            for run, stop in zip(runs, (4 * stops).tolist()):
                letters[run] = data[at:stop]
                at = stop
        else:  # a letter the tokenizer does not take as one: word by word
            letters.update((run, self._ids(run.decode()).tobytes()) for run in runs)
        for marks in {m for *_, m in made if m}.difference(letters):
            letters[marks] = self._ids(marks.decode()).tobytes()
        for raw, low, marks in made:
            known[raw] = letters[low] + letters[marks] if marks else letters[low]

    def join(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.words.__getitem__, words))

    def __call__(self, text: str) -> bytes:
        words = text.encode().split()
        self.learn([words])
        return self.join(words)


def shared_encoder(path: str) -> Encoder:
    """One a Python worker: what a task has learned serves the next one, and goes when another operator's begins."""
    return kept(("encoder", path), lambda: Encoder(path))


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""
    path = path or tokenizer_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    step = 4 * capacity

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches):
        encode = shared_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # words are learned for some documents at once
                part = batch.slice(at, 256)
                texts = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                encode.learn(texts)
                out = []
                for doc_id, words in zip(part.column(0).to_pylist(), texts):
                    data = encode.join(words) + end
                    for k, i in enumerate(range(0, len(data), step)):
                        ids = data[i : i + step]
                        row = (doc_id, k, i // 4, len(ids) // 4, zlib.crc32(ids))
                        out.append(row + ((np.frombuffer(ids, dtype="<u4").astype(np.int64).tolist(),) if with_ids else ()))
                yield _to_batch(out, arrow)

    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


# --- the plan, on counts of lengths -----------------------------------------------------------

Plan = list[tuple[tuple[int, ...], int]]  # (filling, largest first; number of bins)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: total size, and for each threshold the pieces that cannot share a bin."""
    lengths = sorted(n for n, c in counts.items() if c)
    best = -(-sum(n * counts[n] for n in lengths) // capacity)
    for k in [0, *[n for n in lengths if 2 * n <= capacity]]:
        big = sum(counts[n] for n in lengths if n > capacity - k)
        mid = [n for n in lengths if capacity / 2 < n <= capacity - k]
        small = sum(n * counts[n] for n in lengths if k <= n <= capacity / 2)
        n_mid = sum(counts[n] for n in mid)
        room = n_mid * capacity - sum(n * counts[n] for n in mid)
        best = max(best, big + n_mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, a group of equal bins at a time."""
    room: dict[int, list[list]] = defaultdict(list)  # space left -> [filling, bins]
    done: Plan = []
    spaces: list[int] = []

    def put(filling, bins):
        left = capacity - sum(filling)
        if left == 0:
            done.append((filling, bins))
            return
        if not room[left]:
            spaces.insert(bisect_right(spaces, left), left)
        room[left].append([filling, bins])

    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_right(spaces, n - 1)
            if at == len(spaces):
                fit = capacity // n
                if todo >= fit:
                    put((n,) * fit, todo // fit)
                    todo %= fit
                else:
                    put((n,) * todo, 1)
                    todo = 0
                continue
            left = spaces[at]
            group = room[left][-1]
            take = min(group[1], todo)
            group[1] -= take
            if not group[1]:
                room[left].pop()
                if not room[left]:
                    spaces.pop(at)
            put((*group[0], n), take)
            todo -= take
    return done + [(f, b) for groups in room.values() for f, b in groups]


def _sums(pieces: list[tuple[int, int]], most: int) -> list[int]:
    """Bit sets: entry i has bit s if some of the first i (length, count) pairs can sum to s <= most."""
    mask, reach = (1 << (most + 1)) - 1, [1]
    for n, c in pieces:
        r, step, c = reach[-1], 1, min(c, most // n)
        while c:
            step = min(step, c)
            r |= (r << (n * step)) & mask
            c -= step
            step *= 2
        reach.append(r)
    return reach


def _exactly(target: int, pieces: list[tuple[int, int]], reach: list[int], upto: int) -> Iterator[tuple[int, ...]]:
    """Every multiset of the first ``upto`` pieces that sums to ``target``, large pieces first; no dead ends."""
    if not target:
        yield ()
        return
    for j in range(upto - 1, -1, -1):
        if not reach[j + 1] >> target & 1:
            return
        n, c = pieces[j]
        for k in range(min(c, target // n), 0, -1):
            if reach[j] >> (target - k * n) & 1:
                for rest in _exactly(target - k * n, pieces, reach, j):
                    yield (n,) * k + rest


def undominated(chosen: tuple[int, ...], waste: int, others: int) -> bool:
    """No piece left over fits the gap, nor could replace some of ``chosen`` by filling more, or as much with fewer pieces.

    ``others`` is the bit set of the lengths that the bin does not use up. One swap of that kind never costs a bin, as the
    pieces taken out fit where the other came from; so only fillings without one need a look.
    """
    if others & ((1 << (waste + 1)) - 1):
        return False
    ones, more = 0, 0  # sums of one, and of two or more of the chosen
    for n in chosen:
        more |= (ones | more) << n
        ones |= 1 << n

    def smear(bits, width):  # each bit and the ``width`` above it
        done = 0
        while done < width:
            step = min(done + 1, width - done)
            bits |= bits << step
            done += step
        return bits

    return not (others & smear(more, waste) or waste and others & (smear(ones, waste - 1) << 1))


def fillings(largest: int, counts: dict[int, int], capacity: int, max_waste: int, tick: Callable[[], bool] = lambda: True) -> Iterator[tuple[int, ...]]:
    """All undominated fillings around ``largest``, fullest first, one at a time. ``tick`` is asked before each is looked at."""
    gap = capacity - largest
    have = Counter(counts)
    have[largest] -= 1
    if gap and have[gap]:  # fills the bin alone: dominates all others
        yield (largest, gap)
        return
    pieces = sorted((n, c) for n, c in have.items() if c > 0 and n <= gap)
    reach = _sums(pieces, gap)
    lengths = sum(1 << n for n, _ in pieces)
    for waste in range(min(max_waste, gap) + 1):
        for chosen in _exactly(gap - waste, pieces, reach, len(pieces)):
            if not tick():
                return
            used_up = sum(1 << n for n, k in Counter(chosen).items() if k == have[n])
            if undominated(chosen, waste, lengths & ~used_up):
                yield (largest, *chosen)


def complete_bins(counts: dict[int, int], capacity: int, incumbent: Plan, bound: int, max_nodes: int = 20_000) -> tuple[Plan, bool]:
    """Depth-first bin completion -> (plan, whether the search ended within its nodes).

    The plan is the best one completed, if it needs no more bins than ``incumbent``, else the
    incumbent. A filling is tried for as many bins as it can fill, then for one, so that every
    mix of fillings is met; what is left over is not searched again with as much waste or more.
    """
    best, best_bins = incumbent, sum(b for _, b in incumbent) + 1
    total = sum(n * c for n, c in counts.items())
    left = dict(counts)
    nodes = max_nodes
    met: dict[int, int] = {}  # hash of what is left over -> least waste

    def tick() -> bool:
        nonlocal nodes
        nodes -= 1
        return nodes >= 0

    def room(waste: int) -> int:
        return (best_bins - 1) * capacity - total - waste

    def moves(waste: int, look: Callable[[], bool] = tick) -> Iterator[tuple[tuple[int, ...], int]]:
        for filling in fillings(max(left), left, capacity, room(waste), look):
            gap = capacity - sum(filling)
            times = min(left[n] // k for n, k in Counter(filling).items())
            if gap:
                times = min(times, room(waste) // gap)
            for t in (times, 1) if times > 1 else (1,):
                yield filling, t

    def take(filling: tuple[int, ...], times: int) -> None:
        for n, k in Counter(filling).items():
            left[n] = left.get(n, 0) - k * times
            if not left[n]:
                del left[n]

    # Of a deep branch only the last frames keep their enumeration; others begin again behind what they have tried.
    stack: list[list] = [[moves(0), 0, 0, 0]]  # enumeration, tried, bins, waste
    plan: Plan = []
    while stack and nodes >= 0 and best_bins > bound:
        frame = stack[-1]
        options, tried, bins, waste = frame
        if options is None:
            options = frame[0] = moves(waste, lambda: True)
            for _ in range(tried):
                next(options, None)
        filling, times = next(options, (None, 0))
        frame[1] += 1
        if filling is None:
            stack.pop()
            if plan:
                filling, times = plan.pop()
                take(filling, -times)
            continue
        used = waste + times * (capacity - sum(filling))
        if room(used) < 0:
            continue
        take(filling, times)
        plan.append((filling, times))
        if not left and bins + times < best_bins:
            best, best_bins = list(plan), bins + times
        key = hash(frozenset(left.items()))
        if not left or met.get(key, used + 1) <= used:
            plan.pop()
            take(filling, -times)
            continue
        met[key] = used
        if len(stack) >= FRAMES:
            stack[-FRAMES][0] = None
        stack.append([moves(used), 0, bins + times, used])
    return best, best_bins <= bound or not stack and nodes >= 0


def plan_bins(counts: dict[int, int], capacity: int, max_nodes: int = 20_000) -> Plan:
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    return complete_bins(counts, capacity, best_fit(counts, capacity), lower_bound(counts, capacity), max_nodes)[0]


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, offset) of its runs; a run lasts to the next one's first rank."""
    runs: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for filling, bins in plan:
        offset = 0
        for n in filling:
            runs[n].append((used[n], first, offset))
            used[n] += bins
            offset += n
        first += bins
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(made: DataFrame, capacity: int = 2048, max_nodes: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to the rows of ``made`` (doc_id, piece, length and more); ``made`` must be written."""
    spark: SparkSession = made.sparkSession
    sizes = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most ``capacity`` rows
    wide = {n: c // PER_SALT for n, c in sizes.items() if c >= (FULL_SALTS if n == capacity else SALTS) * PER_SALT}
    salts = F.when(F.col("length") == capacity, FULL_SALTS).otherwise(SALTS)
    if wide:
        salts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for n, c in sorted(wide.items()) for x in (n, c))), F.col("length")), salts)
    salted = made.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), salts).cast("int"))
    per_salt = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()  # a row for PER_SALT pieces beyond capacity x SALTS + FULL_SALTS
    counts: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(per_salt, key=lambda r: (r["length"], r["__salt"])):
        before[r["length"], r["__salt"]] = counts[r["length"]]
        counts[r["length"]] += r["n"]
    full = counts.pop(capacity, 0)
    plan = plan_bins(dict(counts), capacity, max_nodes)
    if full:
        plan.append(((capacity,), full))
    shared = spark.sparkContext.broadcast((slots(plan), before))
    columns = [c for c in made.columns]
    # Full pieces are alone whatever their rank; all are dealt by (length, salt), and ranked within a task as they stream by.
    dealt = salted.repartition("length", "__salt").sortWithinPartitions("length", "__salt")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields)

    def make():
        by_length, base = shared.value
        at = {}

        def one(*row):
            *values, length, salt = row
            rank = at.get((length, salt), base[length, salt])
            at[length, salt] = rank + 1
            starts, firsts, offsets = by_length[length]
            k = int(np.searchsorted(starts, rank, side="right")) - 1
            yield (*values, int(firsts[k]) + rank - int(starts[k]), int(offsets[k]))

        return one

    flat = dealt.select(*columns, F.col("length").alias("__length"), "__salt")
    return map_rows(flat, f"{kinds}, sequence_id long, offset long", make, len(columns) + 2)


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, max_nodes: int = 20_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: each document tokenized once, each piece in one place."""
    return pack(materialize(pieces(docs, capacity, end_id, path), "pieces"), capacity, max_nodes)


def packed_ids(docs: DataFrame, packed: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves. Pieces are equal if their keys are."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = pieces(docs, capacity, end_id, path, with_ids=True).dropDuplicates(keys)
    placed = packed.join(ids, [packed[k].eqNullSafe(ids[k]) for k in keys]).select(packed["sequence_id"], packed["offset"], ids["ids"])
    ordered = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
