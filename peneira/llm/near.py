"""Near-duplicate records with small edits, by a prefix filter on words and bitmaps (p1).

Records are sets of words, which have one global order, rarest first, as
counted over the corpus. Two records that reach the similarity have a word in
common among the first of either, as many as a record has beyond the share it
must have in common and one more (the prefix filter); so records meet in the
lists of those words, whatever the order of their texts. Lists of rare words
are cut into fragments by word. Frequent words whose lists hold much the same
records, as those of one language do, are one list, cut into blocks that meet
each other in tasks of their own. Where records meet, bitmaps of their words
tell which can't reach the similarity; the others are verified on their whole
word sets. No pair that reaches the similarity is left out.

Exact copies are one class throughout: what is paired are classes, so a text
that holds a third of all rows is one node.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.glyphs import code_points, plain_form, to_arrow
from peneira.llm.residue import Index, Judge, Lookup, keyed_vocabulary
from peneira.llm.words import mix, ragged, words_of
from peneira.session import staged

# Counters of word occurrences: their number is fixed, so what is sent to the driver and to the tasks is 1 MB at any corpus size.
COUNTERS = 1 << 18


# Bits of a bitmap: each is whether an odd number of a record's words fall on it. Lists are compared by COARSE bits first, on
# which the bits beyond fall a second time.
BITS = 256
COARSE = 192


@dataclass(frozen=True)
class Settings:
    """similarity: least share of common words over all words of two records; block: longest list that is compared at once,
    longer ones are split into blocks of about so many, at most CUTS of them; slice_bits: 2 to this power records of LISTED
    places a fragment; hot: share of the records from which a word's list is put together with others; sample: records, drawn
    by hash, that show which."""

    similarity: float = 0.6
    block: int = 16384
    slice_bits: int = 15
    hot: float = 0.005
    sample: int = 1 << 12


# Records whose texts a task holds as code points and hashes at a time.
PIECE = 2048


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, PIECE):
            yield batch.slice(begin, PIECE)


def corpus_counts(rows: DataFrame, fields: list[str]) -> tuple[Index, np.ndarray, int]:
    """One pass over all records: the residue index, occurrences of words by counter, and the number of records."""
    keyed = keyed_vocabulary()
    find = Lookup(np.array([h for h, _ in keyed], np.uint64))
    known = len(keyed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, labelled, seen = 0, np.zeros(known, np.int64), np.zeros(COUNTERS, np.int64)
        for batch in _pieces(batches):
            pairs = []
            for i in range(len(fields)):
                row, h = words_of(*plain_form(*code_points(batch.column(i))))
                seen += np.bincount((h & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                at_row, at, _ = find(row, h)
                pairs.append(at_row * known + at)
            labelled += np.bincount(np.unique(np.concatenate(pairs)) % known, minlength=known)
            total += batch.num_rows
        every = np.concatenate([labelled, [total], seen])
        kept = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(every[kept])], ["word", "n"])

    own = rows.select(*[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)])
    got = own.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    every = np.zeros(known + 1 + COUNTERS, np.int64)
    every[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    index = Index({w: int(every[i]) for i, (_, w) in enumerate(keyed)}, int(every[known]))
    return index, np.minimum(every[known + 1 :], np.iinfo(np.int32).max).astype(np.int32), int(every[known])


def prepared(rows: DataFrame, row_id: str, title: str, company: str, body: str, counts: tuple[Index, np.ndarray, int], settings: Settings) -> DataFrame:
    """(rec, class, words, places): the records that have a body and no residue in title or body; their word sets, the class
    of records with the same set, and the words they are searched by: of the rarest, as many as may be missing in a similar
    record and one more, those that no other record can have aside."""
    index, seen, _ = counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(index)
        for batch in _pieces(batches):
            batch = batch.filter(batch.column("v2").is_valid())
            n = batch.num_rows
            if not n:
                continue
            plain = [plain_form(*code_points(batch.column(f"v{i}"))) for i in range(3)]
            words = [words_of(*p) for p in plain]
            residue = judge([to_arrow(*plain[0]), to_arrow(*plain[2])], [words[0], words[2]])
            words = [(r[~residue[r]], h[~residue[r]]) for r, h in words]
            row, h = np.concatenate([w[0] for w in words]), np.concatenate([w[1] for w in words])
            # Row and hash in one key: 44 bits of the hash, more than the sets keep of it.
            key = (row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
            order = np.argsort(key)
            key = key[order]
            order = order[np.append(True, key[1:] != key[:-1])] if len(key) else order
            row, h = row[order], h[order]
            total_h = np.concatenate([[0], np.cumsum(mix(h), dtype=np.uint64)]).astype(np.uint64)
            ends = np.searchsorted(row, np.arange(n + 1))
            kind = mix(total_h[ends[1:]] - total_h[ends[:-1]] + np.diff(ends).astype(np.uint64)).view(np.int64)
            kept = pa.array(np.flatnonzero(~residue & (np.diff(ends) > 0)))
            places = _rarest(row, h, ends, seen, settings.similarity)
            sets = ragged(row, (h >> np.uint64(32)).astype(np.uint32).view(np.int32), n, pa.int32())
            out = [batch.column("rec"), pa.array(kind), sets, ragged(*places, n, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.take(kept) for c in out], ["rec", "class", "words", "places"])

    own = rows.select(F.col(row_id).cast("bigint").alias("rec"), *[F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate((title, company, body))])
    return own.mapInArrow(run, "rec bigint, class bigint, words array<int>, places array<int>")


def _rarest(row: np.ndarray, h: np.ndarray, ends: np.ndarray, seen: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the words a record is searched by. Two records that reach the similarity have that share of the larger
    one's words in common, so the first common word in the order, by occurrences and then by hash, is among these of both."""
    often = seen[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]
    order = np.argsort((row.astype(np.uint64) << np.uint64(32)) | often.astype(np.uint64), kind="stable")
    size = np.diff(ends)
    first = size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1
    taken = order[(np.arange(len(row)) - ends[row] < first[row]) & (often[order] > 1)]
    return row[taken], (h[taken] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _bitmaps(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(size, bits): the number of words of each set, and their bitmap as four 64-bit words. Each word that only one of two
    sets has changes one bit, so the bits that differ are at most as many as such words."""
    size = np.diff(words.offsets.to_numpy())
    flat = words.flatten().to_numpy().view(np.uint32).astype(np.uint64)
    bit = ((flat * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(size)), size) * BITS + bit, minlength=len(size) * BITS) & 1
    return size.astype(np.int32), np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.uint64)


class Joint:
    """Frequent words by the list they are searched in: groups is the list of each of the words known, share the part of all
    records that a list holds, rare the number of other words a record is searched by, on the mean."""

    def __init__(self, rare: float, known: np.ndarray, groups: np.ndarray, share: np.ndarray):
        self.rare = rare
        order = np.argsort(known)
        self.known, self.groups, self.share = known[order], groups[order], share
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.known & np.uint32(0xFFFF)).astype(np.int64)] = True

    def __call__(self, place: np.ndarray) -> np.ndarray:
        """The list of each place, -1 of those that aren't known."""
        out = np.full(len(place), -1)
        if len(self.known):
            likely = np.flatnonzero(self.low[(place & np.uint32(0xFFFF)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.known, place[likely]), len(self.known) - 1)
            hit = self.known[where] == place[likely]
            out[likely[hit]] = self.groups[where[hit]]
        return out


def joint_lists(classes: DataFrame, total: int, settings: Settings) -> Joint:
    """The frequent words and the lists they share, as a sample of the classes by hash shows them. Which words share a list
    changes the work, never the pairs. Words counted are those of at least a share hot of the sample: at most places a
    record / hot, some thousands."""
    every = max(1, total // settings.sample)
    drawn = classes.where(F.pmod(F.xxhash64("class"), F.lit(every)) == 0).select("places").toPandas()["places"]
    n = len(drawn)
    at, place = np.repeat(np.arange(n), [len(x) for x in drawn]), np.concatenate([np.zeros(0, np.int32), *drawn]).astype(np.int32).view(np.uint32)
    known, which, often = np.unique(place, return_inverse=True, return_counts=True)
    # So is a list longer than a block, at any size of the table, if SHOWN records of the sample tell of it.
    hot = often >= max(2 * FEW, min(settings.hot * total, max(settings.block, SHOWN * every))) / every
    number = np.where(hot, np.cumsum(hot) - 1, -1)[which]
    rare = np.sum(number < 0) / max(1, n)
    known, at, number = known[hot], at[number >= 0], number[number >= 0]
    if not len(known):
        return Joint(rare, known, np.zeros(0, np.int64), np.zeros(0))
    has = np.zeros((n, len(known)), np.float32)
    has[at, number] = 1
    return Joint(rare, known, *min((_put_together(has, k, seed) for k, seed in ((1, 0), *itertools.product((2, 3, 4, 6), (0, 1, 2)))), key=lambda x: np.sum(x[1] ** 2)))


def _put_together(has: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(list of each word, share of the records each list holds) for records x words: records fall into k clusters by their
    words, and a word joins the list of a cluster unless the records of others that it brings cost more than a list of its own."""
    rnd = np.random.default_rng(seed)
    unit = has / np.maximum(np.sqrt(has.sum(1, keepdims=True)), 1)
    centres = unit[rnd.integers(len(unit))][None]
    for _ in range(k - 1):
        far = np.maximum(1 - (unit @ centres.T).max(1), 0).astype(np.float64) + 1e-9
        centres = np.vstack([centres, unit[rnd.choice(len(unit), p=far / far.sum())]])
    for _ in range(8):
        label = (unit @ centres.T).argmax(1)
        centres = np.stack([unit[label == c].sum(0) for c in range(k)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    inside = np.stack([has[label == c].sum(0) for c in range(k)])
    n = inside.sum(0)
    dearer = 2 * np.bincount(label, minlength=k)[:, None] * (n - inside)
    groups, own = dearer.argmin(0), dearer.min(0) > n**2
    groups[own] = k + np.arange(own.sum())
    used, groups = np.unique(groups, return_inverse=True)
    return groups, np.array([has[:, groups == g].any(1).mean() for g in range(len(used))])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(kind, size, bits, at, place) of some classes at a time: their numbers, sizes and bitmaps, and their places with the
    class each belongs to."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 1 << 15):
            # A copy without an offset: flatten() and offsets then agree.
            batch = whole.slice(begin, 1 << 15).take(pa.array(range(min(1 << 15, whole.num_rows - begin))))
            places = batch.column(2)
            at = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            yield batch.column(0).to_numpy(), *_bitmaps(batch.column(1)), at, places.flatten().to_numpy().view(np.uint32)


def _dealt(fragments: int, joint: Joint):
    """The places of classes, those in joint lists aside, by fragment: a line for each fragment and piece of a batch, holding
    its classes, their sizes and bitmaps, and its places with the class each belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, size, bits, at, place in _cells(batches):
            rare = joint(place) < 0
            at, place = at[rare], place[rare]
            part = (place % np.uint32(fragments)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            at, place, part = at[order], place[order], part[order]
            edges = np.searchsorted(part, np.arange(fragments + 1))
            lines = []
            for f in np.flatnonzero(np.diff(edges)).tolist():
                own, mine = np.unique(at[edges[f] : edges[f + 1]], return_inverse=True)
                lines.append((f, kind[own].tobytes(), size[own].tobytes(), bits[own].tobytes(), place[edges[f] : edges[f + 1]].tobytes(), mine.astype(np.uint16).tobytes()))
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*lines))], ["fragment", "kind", "size", "bits", "place", "at"])

    return run


def _blocks_of_joint_lists(joint: Joint, cuts: np.ndarray):
    """(job, side, alike, held): the classes of joint lists by block, each sent to the jobs in which its block meets another or,
    alike, itself; jobs are numbered through all lists."""
    before = np.cumsum(cuts * (cuts + 1) // 2) - cuts * (cuts + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, size, bits, at, place in _cells(batches):
            group = joint(place)
            at, group = at[group >= 0], group[group >= 0]
            at, group = np.divmod(np.unique(at * len(cuts) + group), len(cuts))
            block = (mix(kind[at].view(np.uint64)) % cuts[group].astype(np.uint64)).astype(np.int64)
            cell = group * CUTS + block
            order = np.argsort(cell, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(cell[order]) != 0)), len(order)) if len(order) else [0]
            lines, much = [], 0
            for begin, end in zip(edges[:-1], edges[1:]):
                own = at[order[begin:end]]
                held = b"".join(x[own].tobytes() for x in (kind, size, bits))
                g, k = divmod(int(cell[order[begin]]), CUTS)
                met = [(min(k, o), max(k, o)) for o in range(cuts[g])]
                lines += [(int(before[g] + i * cuts[g] - i * (i - 1) // 2 + j - i), int(k != i), i == j, held) for i, j in met]
                much += len(held) * len(met)
                if much > SENT or end == len(order):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], ["job", "side", "alike", "held"])
                    lines, much = [], 0

    return run


def _unpacked(held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, size, bits) of the classes of a block."""
    n = [len(x) // (12 + BITS // 8) for x in held]
    parts = [(np.frombuffer(x, np.int64, k), np.frombuffer(x, np.int32, k, 8 * k), np.frombuffer(x[12 * k :], np.uint64).reshape(k, -1)) for x, k in zip(held, n)]
    kind, size, bits = zip(*parts) if parts else ([np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros((0, BITS // 64), np.uint64)])
    return np.concatenate(kind), np.concatenate(size), np.concatenate(bits)


def _pairs_of_jobs(similarity: float):
    """The likely pairs of two blocks of a joint list, or within one; lines come sorted by job."""

    def met(sides: tuple[list[bytes], list[bytes]], alike: bool) -> Iterator[pa.RecordBatch]:
        left, right = map(_unpacked, sides)
        sides[0].clear()
        sides[1].clear()
        kind, size, bits = (np.concatenate(x) for x in zip(left, right))
        first = np.arange(len(left[0]))
        for a, b in _crossed(size, bits, first, first if alike else np.arange(len(first), len(kind)), similarity):
            if len(a):
                yield _pair_batch(kind[a], kind[b], np.ones(len(a), np.int64)).select(["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, alike = None, ([], []), True
        for batch in batches:
            for job, side, same, held in zip(*[c.to_pylist() for c in batch.columns]):
                if job != now:
                    yield from met(sides, alike)
                now, alike = job, same
                sides[side].append(held)
        yield from met(sides, alike)

    return run


def _likely(size: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs may reach the similarity, by their sizes and the words that at least one of two sets has alone."""
    x, y = size[a], size[b]
    # Bits that differ, summed over the bytes of four counts at once.
    apart = np.bitwise_count(bits[a] ^ bits[b]).view(np.uint32)[:, 0]
    apart = (apart & np.uint32(0xFF00FF)) + ((apart >> np.uint32(8)) & np.uint32(0xFF00FF))
    apart = (apart & np.uint32(0xFFFF)) + (apart >> np.uint32(16))
    return (apart <= (x + y) * ((1 - similarity) / (1 + similarity)) + 1e-6) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)


def _crossed(size: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, similarity: float, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The likely pairs of left x right, or of left with itself where right is left, by products of bitmaps: of COARSE
    signs the ones alike less the ones that differ. A line of the left holds two records, the second FIELD times as large,
    so one product counts for both. Each count is raised so that its bit FLAG is set where the pair may reach the
    similarity, and both are added to 2^23, so that the digits of a float32 are those of the whole number, without rounding:
    all sums stay below 2^24."""
    share = 2 * (1 - similarity) / (1 + similarity)

    def signs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        odd = bits[of].view(np.uint8)
        odd[:, : (BITS - COARSE) // 8] ^= odd[:, COARSE // 8 :]
        # How many signs a record's size lets differ, twice; from twice COARSE on all may.
        return SIGNED[odd[:, : COARSE // 8]].reshape(len(of), COARSE), np.minimum(np.ceil(share * size[of] - 1e-6), 2 * COARSE).astype(np.float32)

    def lines(of: np.ndarray) -> np.ndarray:
        (s, most), half = signs(of), -(-len(of) // 2)
        x = np.empty((half, COARSE + 2), np.float32)
        x[:, :COARSE], x[:, COARSE], x[:, COARSE + 1] = s[:half], 1 + FIELD, 2**23 + (1 + FIELD) * (FLAG - COARSE) + most[:half]
        x[: len(of) - half, :COARSE] += FIELD * s[half:]
        x[: len(of) - half, COARSE + 1] += FIELD * most[half:]
        return x

    def columns(of: np.ndarray) -> np.ndarray:
        s, most = signs(of)
        return np.concatenate([s, most[:, None], np.ones((len(of), 1), np.float32)], axis=1)

    # One place for all products: to ask for new memory each time costs as much as they do.
    held = np.empty(-(-min(step, len(left)) // 2) * min(step, len(right)), np.float32)
    # Signs are held of SIGNS records at a time, whatever the length of the sides.
    for begin, i in itertools.product(range(0, len(right), SIGNS), range(0, len(left), step)):
        first = max(begin, i) if right is left else begin
        if i == 0:
            rights = [columns(right[j : j + step]) for j in range(begin, min(begin + SIGNS, len(right)), step)]
        if first >= begin + SIGNS:
            continue
        x = lines(left[i : i + step])
        for j in range(first, min(begin + SIGNS, len(right)), step):
            width = min(step, len(right) - j)
            product = held[: len(x) * width]
            np.matmul(x, rights[(j - begin) // step].T, out=product.reshape(len(x), width))
            counts = product.view(np.uint32)
            found = np.flatnonzero((counts & FLAGS) != 0)
            if not len(found):
                continue
            (a, b), flags = np.divmod(found, width), counts[found]
            low, high = (flags & np.uint32(FLAG)) > 0, (flags & np.uint32(FLAG * FIELD)) > 0
            a, b = np.concatenate([a[low], a[high] + len(x)]), np.concatenate([b[low], b[high]])
            kept = (a < b) if right is left and i == j else a < len(left) - i
            a, b = left[i + a[kept]], right[j + b[kept]]
            kept = _likely(size, bits, a, b, similarity)
            a, b = a[kept], b[kept]
            yield np.minimum(a, b), np.maximum(a, b)


# Counts of two pairs in one number: FLAG is the bit that tells of a likely pair, FIELD what the second count is multiplied by.
FLAG, FIELD = 1 << 10, 1 << 11
FLAGS = np.uint32(FLAG | FLAG * FIELD)
# The signs of the eight bits of a byte.
SIGNED = 1 - 2 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
# Records whose signs are held at a time, a multiple of the step: 16 MB.
SIGNS = 1 << 14

# Blocks of a long list, at most: what is shuffled so that each meets each is in proportion to the list.
CUTS = 16
# Records of the sample that tell a long list from chance.
SHOWN = 8
# Bytes of blocks that are given out at once.
SENT = 1 << 22
# Pairs of blocks of long lists that a task holds at most, on the mean.
MET = 16
# Places of a record that a fragment is reckoned with; records of more make more fragments.
LISTED = 8
# Pairs and their counts that a task holds before it gives them out.
HELD = 1 << 20

PAIRS = ["a", "b", "n", "list", "part", "total", "held"]


def _pairs_in_fragments(settings: Settings):
    """The likely pairs of classes of a fragment with the number of its places both have; of lists longer than a block, the
    blocks, each once, that are to meet elsewhere. part: its number in the list, of total."""

    def lists(lines: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        fragment = lines.pop()
        start = np.cumsum([0] + [len(x) // 8 for x in lines[0]])
        # Column by column, so that what was read goes as what is held comes.
        kind, size, bits, place = (_joined(lines, i, t) for i, t in enumerate((np.int64, np.int32, np.uint64, np.uint32)))
        mark = [np.frombuffer(x, np.uint16) for x in lines[4]]
        kind, first, same = np.unique(kind, return_index=True, return_inverse=True)
        same, size = same.astype(np.uint32), size[first]
        bits = bits.reshape(-1, BITS // 64)[first]
        key, done = place.astype(np.uint64) << np.uint64(32), 0
        del place, first
        for i, m in enumerate(mark):
            key[done : done + len(m)] |= same[m.astype(np.int64) + start[i]]
            done += len(m)
        del same, mark
        lines.clear()
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])]
        node = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        key = (key >> np.uint64(32)).astype(np.uint32)
        edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        del key
        n = np.diff(edges)
        every, counts, much = [], [], 0
        for i in np.flatnonzero(n > min(FEW, settings.block)).tolist():
            own = node[edges[i] : edges[i + 1]]
            if len(own) <= settings.block:
                for a, b in _crossed(size, bits, own, own, settings.similarity):
                    every.append((a << 32) | b)
                    counts.append(np.ones(len(a), np.int64))
                    much += len(a)
                    if much > HELD:
                        every, counts = _summed(every, counts)
                        much = len(every[0])
                        if much > HELD // 2:
                            yield _pair_batch(kind[every[0] >> 32], kind[every[0] & 0xFFFFFFFF], counts[0])
                            every, counts, much = [], [], 0
                continue
            block = max(settings.block, -(-len(own) // CUTS))
            parts = [own[k : k + block] for k in range(0, len(own), block)]
            for k, x in enumerate(parts):
                told = [pa.array([v]) for v in ((fragment << 32) | i, k, len(parts))]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + told + [pa.array([b"".join(v[x].tobytes() for v in (kind, size, bits))], pa.binary())], PAIRS)
        small = np.repeat(n <= min(FEW, settings.block), n)
        node, listed = node[small], np.repeat(np.arange(len(n)), n)[small]
        here, step = np.arange(len(node)), 1
        while True:
            here = here[here + step < len(node)]
            here = here[listed[here] == listed[here + step]]
            if not len(here):
                break
            for k in range(0, len(here), 1 << 15):  # pieces that stay in the cache
                a, b = node[here[k : k + (1 << 15)]], node[here[k : k + (1 << 15)] + step]
                kept = _likely(size, bits, a, b, settings.similarity)
                every.append((a[kept] << 32) | b[kept])
                counts.append(np.ones(len(every[-1]), np.int64))
                much += len(every[-1])
                if much > HELD:
                    every, counts = _summed(every, counts)
                    much = len(every[0])
                    if much > HELD // 2:
                        yield _pair_batch(kind[every[0] >> 32], kind[every[0] & 0xFFFFFFFF], counts[0])
                        every, counts, much = [], [], 0
            step += 1
        if sum(map(len, every)):
            (pair,), (common,) = _summed(every, counts)
            yield _pair_batch(kind[pair >> 32], kind[pair & 0xFFFFFFFF], common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list = []
        for batch in batches:
            for k in range(batch.num_rows):
                fragment = batch.column(0)[k].as_py()
                if lines and lines[-1] != fragment:
                    yield from lists(lines)
                    lines = []
                lines = lines or [[], [], [], [], [], fragment]
                for i in range(5):
                    lines[i].append(batch.column(i + 1)[k].as_py())
            del batch
        if lines:
            yield from lists(lines)

    return run


# Longest list whose pairs are taken with those of other lists; the products of longer ones are worth a call.
FEW = 64


def _joined(lines: list[list[bytes]], i: int, kind: type) -> np.ndarray:
    """A column of the lines as one array; the lines give theirs up."""
    out = np.concatenate([np.frombuffer(x, kind) for x in lines[i]])
    lines[i] = []
    return out


def _pair_batch(a: np.ndarray, b: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(common), *[pa.nulls(len(a), pa.int64())] * 3, pa.nulls(len(a), pa.binary())], PAIRS)


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct pairs and the sum of the counts of each."""
    pair, n = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(pair)
    pair, n = pair[order], n[order]
    edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return [pair[edges]], [np.add.reduceat(n, edges)]


def _pairs_of_blocks(similarity: float):
    """The likely pairs of two blocks of a long list, or within one where both are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                got = [x.as_py() for x in (left, right)]
                alike = got[0] == got[1]
                kind, size, bits = [], [], []
                for x in got[: 1 if alike else 2]:
                    n = len(x) // (12 + BITS // 8)
                    kind.append(np.frombuffer(x, np.int64, n))
                    size.append(np.frombuffer(x, np.int32, n, 8 * n))
                    bits.append(np.frombuffer(x[12 * n :], np.uint64).reshape(n, -1))
                first = np.arange(len(kind[0]))
                second = first if alike else np.arange(len(kind[1])) + len(first)
                kind, size, bits = np.concatenate(kind), np.concatenate(size), np.concatenate(bits)
                for a, b in _crossed(size, bits, first, second, similarity):
                    yield _pair_batch(kind[a], kind[b], np.ones(len(a), np.int64)).select(["a", "b", "n"])

    return run


def likely_pairs(classes: DataFrame, total: int, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of classes a < b that may reach the similarity, each once; and the staged table they come from."""
    joint = joint_lists(classes, total, settings)
    told = classes.select("class", "words", "places")
    fragments = max(1, int(np.ceil(joint.rare * total / (LISTED << settings.slice_bits))))
    dealt = told.mapInArrow(_dealt(fragments, joint), "fragment int, kind binary, size binary, bits binary, place binary, at binary")
    shape = "a bigint, b bigint, n bigint, list bigint, part bigint, total bigint, held binary"
    # A partition holds one fragment, or a few pairs of blocks below: Arrow batches are bounded by their rows, not their bytes.
    got = staged(dealt.repartitionById(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(_pairs_in_fragments(settings), shape), "likely")
    partial, blocks = got.where("held is null").select("a", "b", "n"), got.where("held is not null")
    met_blocks = blocks.agg(F.sum(F.col("total") - F.col("part"))).first()[0] or 0
    if met_blocks:
        left = blocks.select("list", F.col("part").alias("i"), F.explode(F.sequence("part", F.col("total") - 1)).alias("j"), F.col("held").alias("left"))
        right = blocks.select("list", F.explode(F.sequence(F.lit(0).cast("bigint"), "part")).alias("i"), F.col("part").alias("j"), F.col("held").alias("right"))
        met = left.join(right, ["list", "i", "j"]).select("left", "right").repartition(-(-met_blocks // MET))
        partial = partial.unionAll(met.mapInArrow(_pairs_of_blocks(settings.similarity), "a bigint, b bigint, n bigint"))
    if len(joint.known):
        cuts = np.clip(np.ceil(joint.share * total / settings.block).astype(np.int64), 1, CUTS)
        jobs = int(np.sum(cuts * (cuts + 1) // 2))
        sent = told.mapInArrow(_blocks_of_joint_lists(joint, cuts), "job int, side int, alike boolean, held binary")
        partial = partial.unionAll(sent.repartitionById(jobs, "job").sortWithinPartitions("job").mapInArrow(_pairs_of_jobs(settings.similarity), "a bigint, b bigint, n bigint"))
    return partial.select("a", "b").distinct(), got


def class_links(classes: DataFrame, likely: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b, similarity): pairs of different classes whose word sets reach the similarity."""
    sets = classes.select("class", "words")
    first = likely.join(sets.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a")
    both = first.join(sets.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    joint = F.size("wa") + F.size("wb") - common
    return both.select("a", "b", (common / joint).alias("similarity")).where(F.col("similarity") >= settings.similarity)


def near_duplicates(rows: DataFrame, row_id: str, title: str, company: str, body: str, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Members and links of near-duplicate records.

    Returns members (rec, class), one row per record that has a body and holds
    no residue, and links (a, b, similarity) between different classes. Records
    of one class have the same word set: they are copies, linked without being
    listed. A null or empty body, a record without words and residue take no
    part; title and company may be null. Repeated rows are copies of each
    other; other columns are not read. Texts are read whole at any length.

    Every pair is found, whatever the order of its words and however many
    other records have them.

    Word sets are compared as 32-bit hashes of words, exact but for collisions
    within one pair of records (for sets of 100 words, one pair in 400 000 is
    off by one word).
    """
    counts = corpus_counts(rows, [title, company, body])
    records = staged(prepared(rows, row_id, title, company, body, counts, settings), "records", by="class")
    # Copies of a text meet as one.
    classes = staged(records.groupBy("class").agg(F.first("words").alias("words"), F.first("places").alias("places")), "classes", by="class")
    likely, fragments = likely_pairs(classes, counts[2], settings)
    members = records.select("rec", "class")
    # released(members) removes what both results are read from.
    members._peneira_remove = lambda: (records._peneira_remove(), classes._peneira_remove(), fragments._peneira_remove())
    return members, class_links(classes, likely, settings)


# Copies of one text that meet in one task: larger classes are cut into blocks that meet in tasks of their own.
COPIES = 1 << 12


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): all pairs of linked records a < b, copies expanded; for results that ask for every pair."""
    x, y = members.select(F.col("rec").alias("ra"), F.col("class").alias("a")), members.select(F.col("rec").alias("rb"), F.col("class").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b")
    # Copies: only classes of several records are paired within, large ones block by block.
    several = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class", F.ceil(F.col("n") / COPIES).cast("int").alias("cuts"))
    cut = members.join(several, "class").withColumn("block", F.pmod(F.xxhash64("rec"), F.col("cuts")).cast("int"))
    left = cut.select("class", F.col("rec").alias("ra"), F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("cuts") - 1)).alias("j"))
    right = cut.select("class", F.col("rec").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    within = left.join(right, ["class", "i", "j"]).where("i < j or ra < rb")
    every = across.select("ra", "rb").unionAll(within.select("ra", "rb"))
    return every.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
