"""Repeated passages: every byte covered by a string of a given length that also starts elsewhere.

All suffixes of a corpus can't be sorted in one place, so they are dealt out first: each string of ``LENGTH`` bytes is
filed under its anchor, the least of its hashed ``ANCHOR``-byte substrings, which depends on the string alone. Equal
strings therefore meet under one anchor, at one distance from it. A run of starts that share an anchor and place is a
segment; its bytes, from the first start to the end of the last string, are its context. Contexts are grouped by their
bytes, and those that occur twice are repeated as a whole. Where one anchor has several different contexts, their
suffixes are sorted from the anchor in both directions, by a mergesort that compares prefix polynomial hashes, and common
extensions, checked byte by byte, tell which starts repeat. Digests deal rows and speed comparisons; no byte is removed
whose string was not compared with an equal one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, in_arrow, materialize, row_hash, small_join, text_or_empty

LENGTH, ANCHOR = 200, 50
BLOCK = 1 << 18  # starts that are hashed at a time, whatever the length of the text
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd, so each has an inverse
HOT = 512  # contexts of one anchor that are sorted together
CHUNK = 20_000  # contexts that one call sorts
BUCKET = 20_000  # strings of a crowded anchor that meet in one place


class Powers:
    """Powers of a base and of its inverse, modulo 2^64."""

    def __init__(self, base: int, size: int):
        self.up = np.ones(size, np.uint64)
        self.up[1:] = np.uint64(base)
        self.up = np.multiply.accumulate(self.up)
        self.down = np.ones(size, np.uint64)
        self.down[1:] = np.uint64(pow(base, -1, 1 << 64))
        self.down = np.multiply.accumulate(self.down)


_POWERS: dict[int, Powers] = {}


def powers(base: int, size: int) -> Powers:
    found = _POWERS.get(base)
    if found is None or len(found.up) < size:
        found = _POWERS[base] = Powers(base, max(size, BLOCK + LENGTH + 8))
    return found


def prefix_sums(data: np.ndarray, base: int) -> np.ndarray:
    """sums[i]: the polynomial hash of data[:i], from which that of any substring follows."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data) + 1).up[: len(data)], out=sums[1:])
    return sums


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed places (first start << 16 | anchor's distance << 8 | starts - 1), anchor hashes and context digests."""
    parts = [_block(data, at) for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK)]
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _block(data: bytes, at: int):
    piece = data[at : at + BLOCK + LENGTH - 1]
    raw = np.frombuffer(piece, np.uint8)
    sums, width = prefix_sums(raw, BASES[0]), LENGTH - ANCHOR + 1
    hashes = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(BASES[0], len(sums)).down[: len(sums) - ANCHOR])
    # the least hash of each window, the first of equal ones: place in the low half, as ties fall to the smaller
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    starts = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    anchors = (np.minimum(right[:starts], left[width - 1 : width - 1 + starts]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    anchor = anchors[first]
    digest = b"".join([hashlib.blake2b(piece[a : b + LENGTH], digest_size=8, salt=bytes((d,))).digest() for a, b, d in zip(first.tolist(), last.tolist(), (anchor - first).tolist(), strict=True)])
    return (first + at) << 16 | (anchor - first) << 8 | (last - first), hashes[anchor].view(np.int64), np.frombuffer(digest, np.int64)


def _segment_rows(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        found = [segments(t.as_buffer().to_pybytes()) for t in texts]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
        join = lambda k: pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64), pa.int64())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), join(0), join(1), join(2)], names=["id", "h", "pos", "ah", "ch"])


class Sorted:
    """The strings of groups in order, and the common extension of each with the one before it in its group."""

    def __init__(self, strings: list[bytes], groups: np.ndarray, base: int = 0):
        self.size = np.array([len(s) for s in strings], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
        self.base = BASES[base]
        self.sums = prefix_sums(self.data, self.base)
        self.down = powers(self.base, len(self.sums)).down
        self.order = self._sort(groups)
        a, b = self.order[:-1], self.order[1:]
        self.common = np.full(len(self.order), -1, np.int64)
        same = np.flatnonzero(groups[a] == groups[b])
        self.common[same + 1] = self.extension(a[same], b[same])
        if not self._verified(a[same], b[same], self.common[same + 1]):
            if base + 1 == len(BASES):
                raise ArithmeticError("hash collisions under every base")
            self.__init__(strings, groups, base + 1)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each pair, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        a, b = self.at[x], self.at[y]
        da, db, sa, sb = self.down[a], self.down[b], self.sums[a], self.sums[b]
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            equal = (self.sums[a + mid] - sa) * da == (self.sums[b + mid] - sb) * db
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        common = self.extension(x, y)
        over_x, over_y = common >= self.size[x], common >= self.size[y]
        differ = self.data[np.where(over_x, 0, self.at[x] + common)] < self.data[np.where(over_y, 0, self.at[y] + common)]
        return np.where(over_x, ~over_y, ~over_y & differ)

    def _sort(self, groups: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of all groups at once. ``groups`` ascends. Each element finds its rank in the sibling
        run by binary search; equal strings keep their order."""
        n = len(groups)
        order = np.arange(n)
        if not n:
            return order
        first = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1])
        length = np.diff(np.concatenate([first, [n]]))
        start, size = np.repeat(first, length), np.repeat(length, length)
        width = 1
        while width < length.max():
            busy = np.flatnonzero(size > width)
            place = busy - start[busy]
            run = place // width
            on_left = run % 2 == 0
            sibling = np.where(on_left, run + 1, run - 1) * width
            low = np.minimum(sibling, size[busy])
            high = np.minimum(sibling + width, size[busy])
            begin = low.copy()
            mine = order[busy]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                other = order[start[busy[open_]] + mid]
                left = on_left[open_]
                a, b = np.where(left, other, mine[open_]), np.where(left, mine[open_], other)
                before = self.less(a, b)
                before = np.where(left, before, ~before)  # a left element passes only smaller ones, a right one also equal ones
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            rank = low - begin
            target = start[busy] + np.where(on_left, place, place - width) + rank
            order[target] = mine.copy()
            width *= 2
        return order

    def _verified(self, x: np.ndarray, y: np.ndarray, common: np.ndarray) -> bool:
        """Whether the bytes agree just as far as the hashes said."""
        total = int(common.sum())
        step = np.arange(total) - np.repeat(np.cumsum(common) - common, common)
        if not np.array_equal(self.data[np.repeat(self.at[x], common) + step], self.data[np.repeat(self.at[y], common) + step]):
            return False
        inside = (common < self.size[x]) & (common < self.size[y])
        return bool(np.all(self.data[(self.at[x] + common)[inside]] != self.data[(self.at[y] + common)[inside]]))


def repeats(contexts: list[bytes], groups: np.ndarray, distance: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts of groups (``groups`` ascends), each with its anchor at ``distance`` and ``starts`` starts: which
    starts repeat within the group, as a matrix by context and start; and a class number for each start's string."""
    n, most = len(contexts), LENGTH - ANCHOR + 1
    after = Sorted([c[d:] for c, d in zip(contexts, distance.tolist(), strict=True)], groups)
    ahead = Sorted([c[:d][::-1] for c, d in zip(contexts, distance.tolist(), strict=True)], groups)
    flags = np.zeros((n, most), bool)
    classes = np.full((n, most), -1, np.int64)
    seen = 0
    for d in range(most):
        has = np.flatnonzero((distance >= d) & (distance - starts < d))
        if not len(has):
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[after.order] = np.cumsum(after.common < LENGTH - d)
        left[ahead.order] = np.cumsum(ahead.common < d)
        _, number, count = np.unique(right[has] * (n + 1) + left[has], return_inverse=True, return_counts=True)
        flags[has, distance[has] - d] = count[number] > 1
        classes[has, distance[has] - d] = seen + number
        seen += len(count)
    return flags, classes


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true values in each row."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _cut(batches):
    """Rows (id, h, text, wanted) to one row a segment, with its context."""
    for batch in batches:
        take, pos, ah, ch, out = [], [], [], [], []
        for row, (text, wanted) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True)):
            data = text.as_buffer().to_pybytes()
            for w in wanted:
                first, more = w["pos"] >> 16, w["pos"] & 255
                take.append(row)
                pos.append(w["pos"])
                ah.append(w["ah"])
                ch.append(w["ch"])
                out.append(data[first : first + more + LENGTH])
        rows = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(pos, pa.int64()), pa.array(ah, pa.int64()), pa.array(ch, pa.int64()), pa.array(out, pa.binary())],
            names=["id", "h", "pos", "ah", "ch", "context"])


def _whole_groups(batches, keys: list[str]):
    """Tables of about CHUNK rows that end where a group ends; rows arrive in the order of ``keys``."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= CHUNK:
            table = pa.Table.from_batches(held).combine_chunks()
            numbers = np.stack([table.column(k).to_numpy() for k in keys])
            cut = np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0))
            if len(cut):
                yield table.slice(0, cut[-1] + 1)
                table = table.slice(cut[-1] + 1)
            held, count = table.to_batches(), table.num_rows
    if count:
        yield pa.Table.from_batches(held)


def _numbered(table: pa.Table, keys: list[str]) -> np.ndarray:
    numbers = np.stack([table.column(k).to_numpy() for k in keys])
    return np.concatenate([[0], np.cumsum((numbers[:, 1:] != numbers[:, :-1]).any(axis=0))])


def _measured(table: pa.Table, keys: list[str]):
    pos = table.column("pos").to_numpy()
    distance, starts = pos >> 8 & 255, (pos & 255) + 1
    flags, classes = repeats([c.as_py() for c in table.column("context")], _numbered(table, keys), distance, starts)
    return pos >> 16, flags, classes


def _sorted_groups(batches):
    """Repeated spans (id, h, a, b) of the contexts that occur once, group by group."""
    for table in _whole_groups(batches, ["ah", "salt"]):
        first, flags, _ = _measured(table, ["ah", "salt"])
        flags &= (table.column("n").to_numpy() == 1)[:, None]
        row, a, b = _runs(flags)
        rows = pa.array(row, pa.int64())
        made = pa.table([table.column("id").take(rows), table.column("h").take(rows), pa.array(first[row] + a, pa.int64()), pa.array(first[row] + b + LENGTH, pa.int64())], names=["id", "h", "a", "b"])
        yield from made.combine_chunks().to_batches()


def _digests(sums_of, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the strings that start at ``at``; they bring equal strings together and prove nothing."""
    found = []
    for base in BASES[1:3]:
        sums = sums_of(base)
        found.append(mixed((sums[at + LENGTH] - sums[at]) * powers(base, len(sums)).down[at]).view(np.int64))
    return found


def _open_strings(batches):
    """For salted groups: one representative of each different string, packed by anchor and bucket of its hash.
    A string that repeats within the salt, or whose context does, is settled and goes along only to meet others."""
    for table in _whole_groups(batches, ["ah", "salt"]):
        _, flags, classes = _measured(table, ["ah", "salt"])
        texts = [c.as_py() for c in table.column("context")]
        settled = flags | (table.column("n").to_numpy() > 1)[:, None]
        row, start = np.nonzero(classes >= 0)
        _, one = np.unique(classes[row, start], return_index=True)
        row, start = row[one], start[one]
        data = np.frombuffer(b"".join(texts), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[row] + start
        digests = _digests(lambda base: prefix_sums(data, base), at)  # noqa: B023
        m, ah = table.column("m").to_numpy()[row], table.column("ah").to_numpy()[row]
        buckets = -(-m * (LENGTH - ANCHOR + 1) // BUCKET)
        bucket = (digests[0].view(np.uint64) % buckets.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((bucket, ah))
        edges = np.concatenate([[0], np.flatnonzero((np.diff(ah[order]) != 0) | (np.diff(bucket[order]) != 0)) + 1, [len(order)]])
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values[order], kind))  # noqa: E731, B023
        ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), table.column("id").combine_chunks().take(pa.array(row[order])))
        heads = order[edges[:-1]]
        place = table.column("pos").to_numpy()[row] << 8 | start
        yield pa.RecordBatch.from_arrays(
            [pa.array(ah[heads]), pa.array(bucket[heads]), lists(digests[0], pa.int64()), lists(digests[1], pa.int64()), ids, lists(table.column("h").to_numpy()[row], pa.int64()),
             lists(place, pa.int64()), lists(~settled[row, start], pa.bool_())], names=["ah", "bucket", "d1", "d2", "ids", "hs", "places", "open"])


def _met(batches):
    """Strings that seem to occur under another salt, beside one representative of their hashes: the first by text hash
    and place, so that neighbouring strings of a passage have representatives in one context."""
    for table in _whole_groups(batches, ["ah", "bucket"]):
        count = pa.compute.list_value_length(table.column("d1")).to_numpy()
        flat = lambda k: table.column(k).combine_chunks().flatten()  # noqa: E731, B023
        group = np.repeat(_numbered(table, ["ah", "bucket"]), count)
        _, number = np.unique(np.stack([group, flat("d1").to_numpy(), flat("d2").to_numpy()]), axis=1, return_inverse=True)
        number, hs, places, open_ = number.ravel(), flat("hs").to_numpy(), flat("places").to_numpy(), flat("open").to_numpy(zero_copy_only=False)
        order = np.lexsort((places, hs, number))
        first = np.concatenate([[True], np.diff(number[order]) != 0]) if len(order) else np.zeros(0, bool)
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        hit = np.flatnonzero(~first & (open_[order] | open_[head]))
        mine, other = pa.array(order[hit], pa.int64()), pa.array(head[hit], pa.int64())
        ids = flat("ids")
        made = pa.table([ids.take(mine), pa.array(hs[order[hit]]), pa.array(places[order[hit]] >> 8), ids.take(other), pa.array(hs[head[hit]]), pa.array(places[head[hit]] >> 8),
                         pa.array(places[order[hit]] & 255), pa.array(places[head[hit]] & 255)], names=["id", "h", "pos", "o_id", "o_h", "o_pos", "at", "o_at"])
        yield from made.combine_chunks().to_batches()


def _compared(batches):
    """Rows of two contexts and the starts at which their strings seem equal, to spans of those that are, and, with its
    bytes, to each string that is not."""
    for batch in batches:
        take, other_side, a, b, strings = [], [], [], [], []
        for row, r in enumerate(batch.select(["pos", "o_pos", "ats", "shift", "context", "o_context"]).to_pylist()):
            sides = ((False, r["pos"] >> 16, 0, r["context"]), (True, r["o_pos"] >> 16, r["shift"], r["o_context"]))
            string = lambda side, at: side[3][at + side[2] : at + side[2] + LENGTH]
            equal = [at for at in r["ats"] if string(sides[0], at) == string(sides[1], at)]
            spans = [(x, y, None) for x, y in merged([(at, at + 1) for at in equal])]
            spans += [(at, at + 1, at) for at in r["ats"] if at not in equal]
            for side in sides:
                for x, y, at in spans:
                    take.append(row)
                    other_side.append(side[0])
                    a.append(side[1] + side[2] + x)
                    b.append(side[1] + side[2] + y - 1 + LENGTH)
                    strings.append(None if at is None else string(side, at))
        rows, theirs = pa.array(take, pa.int64()), pa.array(other_side, pa.bool_())
        pick = lambda mine, other: pa.compute.if_else(theirs, batch.column(other).take(rows), batch.column(mine).take(rows))  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([pick("id", "o_id"), pick("h", "o_h"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(strings, pa.binary())], names=["id", "h", "a", "b", "string"])


def _place(prefix: str = "") -> list[str]:
    return [f"{prefix}id", f"{prefix}h", f"{prefix}pos"]


def _across(hot: DataFrame, kind: str) -> DataFrame:
    """Spans (id, h, a, b) of strings that crowded anchors have under different salts. ``hot``: their contexts."""
    dealt = hot.repartition("ah", "salt").sortWithinPartitions("ah", "salt", "ch")
    packed = dealt.transform(in_arrow, _open_strings, f"ah long, bucket long, d1 array<long>, d2 array<long>, ids array<{kind}>, hs array<long>, places array<long>, open array<boolean>")
    met = packed.repartition("ah", "bucket").sortWithinPartitions("ah", "bucket").transform(in_arrow, _met, f"id {kind}, h long, pos long, o_id {kind}, o_h long, o_pos long, at long, o_at long")
    # neighbouring strings of two contexts are compared together
    pairs = met.groupBy(*_place(), *_place("o_"), (F.col("o_at") - F.col("at")).alias("shift")).agg(F.array_sort(F.collect_set("at")).alias("ats"))
    pairs = materialize(pairs, "met")
    texts = hot.select("id", "h", "pos", "context")
    for prefix in ("", "o_"):
        side = texts.select(*[F.col(c).alias(f"t_{c}") for c in texts.columns])
        on = F.col(f"{prefix}id").eqNullSafe(F.col("t_id")) & (F.col(f"{prefix}h") == F.col("t_h")) & (F.col(f"{prefix}pos") == F.col("t_pos"))
        pairs = pairs.join(side, on).drop("t_id", "t_h", "t_pos").withColumnRenamed("t_context", f"{prefix}context")
    checked = materialize(pairs.transform(in_arrow, _compared, f"id {kind}, h long, a long, b long, string binary"), "compared")
    spans = checked.filter("string is null").select("id", "h", "a", "b").distinct()
    # strings whose hashes collided: grouped by their bytes
    odd = checked.filter("string is not null").distinct()
    if odd.isEmpty():
        return spans
    twice = odd.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string")
    return spans.unionByName(odd.join(twice, "string", "left_semi").select("id", "h", "a", "b"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, h, spans) per row key of ``docs`` with a repeated string; spans may overlap."""
    rows = docs.select(F.col(id_column).alias("id"), row_hash(text_column).alias("h"), text_or_empty(text_column).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    segs = materialize(rows.transform(in_arrow, _segment_rows, f"id {kind}, h long, pos long, ah long, ch long"), "segments")
    shared = materialize(segs.groupBy("ah").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("ah"), "anchors")
    hits = materialize(segs.join(shared, "ah"), "hits")
    discard(segs, shared)

    # a segment's context is cut from its text, and equal contexts meet: by their bytes, combined in the tasks first
    wanted = hits.groupBy(F.col("id").alias("w_id"), F.col("h").alias("w_h")).agg(F.collect_set(F.struct("pos", "ah", "ch")).alias("wanted"))
    with_text = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("id", "h", "t", "wanted")
    pieces = with_text.transform(in_arrow, _cut, f"id {kind}, h long, pos long, ah long, ch long, context binary")
    contexts = pieces.groupBy("ah", "ch", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "h", "id")).alias("one"))
    contexts = materialize(contexts.select("ah", "ch", "context", "n", "one.pos", "one.h", "one.id"), "contexts")

    span = [(F.shiftright("pos", 16)).alias("a"), (F.shiftright("pos", 16) + F.col("pos").bitwiseAND(F.lit(255)) + LENGTH).alias("b")]
    digests = materialize(contexts.groupBy("ah", "ch").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("n")), "digests")
    copied = materialize(digests.filter("kinds = 1 and n > 1").select("ah", "ch"), "copied-contexts")
    found = small_join(hits, copied, ["ah", "ch"]).select("id", "h", *span)
    collided = digests.filter("kinds > 1").select("ah", "ch")
    if not collided.isEmpty():
        # contexts whose digests agree and whose bytes don't: their segments are told apart by bytes
        twice = contexts.filter("n > 1").join(collided, ["ah", "ch"], "left_semi").select("ah", "ch", "context")
        found = found.unionByName(pieces.join(twice, ["ah", "ch", "context"], "left_semi").select("id", "h", *span))

    # different contexts of one anchor; an anchor with very many is salted
    anchors = materialize(digests.groupBy("ah").agg(F.sum("kinds").alias("m")).filter("m > 1"), "mixed-anchors")
    sorted_ = small_join(contexts, anchors, ["ah"]).withColumn("salt", F.when(F.col("m") > HOT, F.pmod(F.col("ch"), F.ceil(F.col("m") / HOT))).otherwise(F.lit(0)).cast("long"))
    dealt = sorted_.repartition("ah", "salt").sortWithinPartitions("ah", "salt", "ch")
    found = found.unionByName(dealt.transform(in_arrow, _sorted_groups, f"id {kind}, h long, a long, b long"))
    if not anchors.filter(F.col("m") > HOT).isEmpty():
        found = found.unionByName(_across(materialize(sorted_.filter(F.col("m") > HOT), "hot-contexts"), kind))
    spans = materialize(found.groupBy("id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    discard(hits, contexts, digests, copied, anchors)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row (id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of ``docs``; kept, the bytes that remain, is
    null unless ``keep_bytes``.

    A byte goes if a string of 200 bytes that covers it starts anywhere else too, in the same text or another; all
    occurrences go. Strings never cross texts and are judged on the input. A null text counts as empty; texts of
    under 200 bytes lose nothing; rows that repeat id and text are occurrences of their own, so all of a
    repeated text of 200 bytes or more goes. Cuts may fall within a character, so ``kept`` is binary. Texts are read
    whole, in blocks; an empty table gives an empty one; other columns are not read, whatever their names."""
    spans = repeated_spans(docs, id_column, text_column).withColumnsRenamed({"id": "s_id", "h": "s_h"})
    rows = docs.select(F.col(id_column).alias("id"), row_hash(text_column).alias("h"), text_or_empty(text_column).alias("t"))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_h")), "left").select("id", "t", "spans")

    def run(batches):
        for batch in batches:
            sizes, removed, counts, digests, kept = [], [], [], [], []
            for text, spans_ in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                gone = merged([(s["a"], s["b"]) for s in spans_ or ()])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in gone))
                counts.append(len(gone))
                if gone:
                    ends = [0, *(b for _, b in gone)]
                    data = b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)], strict=True))
                digests.append(hashlib.sha256(data).hexdigest())
                kept.append(data if keep_bytes else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
