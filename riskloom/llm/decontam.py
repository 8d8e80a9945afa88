"""Benchmark decontamination by template windows with slot consistency."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import drop_rows, in_arrow, materialize, row_hash, text_or_empty

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb lbs oz ml l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years "
    "meter meters metre metres inch inches foot feet mile miles gram grams kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents usd eur percent degrees mph kmh".split()
)
NUMBER = re.compile(r"[+-]?\d[\d.,:/]*$")
JOINED = re.compile(r"(?<=\d)(?=[A-Za-z°%])")
STRIP = ".,;:!?\"'()[]{}<>|*#$%&~^=_«»“”‘’¿¡…-"
WIDTH, LITERALS = 8, 4
NUM, UNIT, NAME = 1, 2, 3
VOCABULARY = 300_000
CROWD = 64  # items that share a window before it waits for another window of its item
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD_BYTES = 32  # of an item's words that go to the tasks, on average
# letters that Arrow and Python may fold differently, or that are capitals without a small letter
ODD = r"[\x{130}\x{3A3}\x{3D2}-\x{3D4}\x{1C80}-\x{1C8F}\x{2100}-\x{214F}\x{A7C0}-\x{A7FF}\x{10000}-\x{10FFFF}]"
DIGIT, SPLIT = r"\p{Nd}", r"\p{Nd}[A-Za-z°%]"


class Tokens(NamedTuple):
    """Spellings of a text, and of those that are not only symbols: places among the spellings, hashes and slot types,
    the same two with names taken for words, and hashes of the words alone."""

    raw: list[str]
    at: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray
    plain: np.ndarray
    plain_kinds: np.ndarray
    words: np.ndarray


class Canonical(dict):
    """Template tokens of a text. A token is a typed slot or a folded word; its kind is kept by spelling, in this
    table, which is emptied when it is full; that changes nothing but speed."""

    def __init__(self):
        self.clear()
        # by spelling: hash within a sentence, hash as its first word, hash of the word itself
        self.hashes = np.zeros((1 << 16, 3), np.uint64)
        # by spelling: slot within a sentence, slot as its first word, ends a sentence, has only symbols
        self.marks = np.zeros((1 << 16, 4), np.int8)

    def __missing__(self, raw: str) -> int:
        core = raw.strip(STRIP)
        low = core.lower()
        kind = NUM if NUMBER.match(core) else UNIT if low in UNITS else 0
        named = NAME if not kind and len(core) > 1 and core[0].isupper() and core[1:].islower() else kind
        value = xxhash.xxh64_intdigest(low.encode(), 0) | 4
        at = self[raw] = len(self)
        if at == len(self.hashes):
            self.hashes, self.marks = np.concatenate([self.hashes] * 2), np.concatenate([self.marks] * 2)
        ends = raw[-1:] in ".!?:|" or raw.rstrip("\"')]»”").endswith((".", "!", "?"))
        self.hashes[at] = named or value, kind or value, value
        self.marks[at] = named, kind, ends, not core
        return at

    def tokens(self, text: str) -> Tokens:
        if len(self) > VOCABULARY:
            self.__init__()
        raw = text.split()
        if any(c in text for c in "0123456789"):
            raw = [p for t in raw for p in (JOINED.split(t) if t[:1].isdigit() or t[-1:].isalpha() and any(map(str.isdigit, t)) else (t,))]
        if not raw:
            none = np.zeros(0, np.int64)
            return Tokens([], none, none.view(np.uint64), none, none.view(np.uint64), none, none.view(np.uint64))
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        marks = self.marks[at]
        # the first token opens a sentence, and each that follows one that ends it
        column = np.concatenate([[1], marks[:-1, 2]])
        keep = np.flatnonzero(marks[:, 3] == 0)
        return Tokens(raw, keep, self.hashes[at, column][keep], marks[np.arange(len(at)), column][keep], self.hashes[at, 1][keep], marks[keep, 1], self.hashes[at, 2][keep])


def windows(hashes: np.ndarray, kinds: np.ndarray, width: int = WIDTH, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows of ``width`` tokens with at least ``literals`` words outside slots."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    words = np.concatenate([[0], np.cumsum(kinds == 0)])
    use = np.flatnonzero(words[width:] - words[:-width] >= literals)
    return use, out[use]


def whole(words: np.ndarray, width: int) -> tuple[int, np.ndarray]:
    """For items without a template window: the width of their windows of words as they are, and the windows' hashes. An
    item of fewer words than ``width`` is one window of its own length."""
    own = min(width, len(words))
    return own, windows(words, np.zeros(len(words), np.int8), own, 0)[1] if own else np.zeros(0, np.uint64)


class Wanted:
    """Hashes that some benchmark item has, sorted. A bit table, far sparser than full, rules out nearly all others
    before they are searched."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - min(26, max(10, int(len(self.hashes)).bit_length() + 5)))
        self.maybe = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.maybe[self.hashes >> self.shift] = True

    def among(self, values: np.ndarray) -> np.ndarray:
        """Places of the wanted ones."""
        place = np.flatnonzero(self.maybe[values >> self.shift])
        near = np.minimum(np.searchsorted(self.hashes, values[place]), len(self.hashes) - 1)
        return place[self.hashes[near] == values[place]] if len(self.hashes) else place[:0]


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of words side by side."""
    return ((left * MULTIPLIER) ^ right) * MULTIPLIER


class Sieve:
    """Rules out texts that can't have a window of an item, a batch at once and without a look at each token in Python.
    In such a window every token is a word of some item or may be a slot, and words that stand side by side do so in
    some item. What can't be told here for certain counts as fitting, and a text that may have a window is read
    token by token, so nothing is lost."""

    def __init__(self, words: pa.Array, hashes: np.ndarray, pairs: np.ndarray, width: int, widths: list[int]):
        self.words, self.hashes, self.pairs = words, np.append(hashes, np.uint64(0)), Wanted(pairs)
        self.width, self.widths = width, sorted(widths)

    def _in_a_row(self, fits: np.ndarray, words: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, least: int) -> np.ndarray:
        """Where stretches of fitting tokens that make up ``least`` begin; ``words`` is 0 for what may stand beside all."""
        begins = ~fits
        begins[firsts] = True
        known = words != 0
        sides = np.flatnonzero(known[1:] & known[:-1])
        apart = np.ones(len(sides), bool)
        apart[self.pairs.among(pair(words[sides], words[sides + 1]))] = False
        begins[sides[apart] + 1] = True
        begins = np.flatnonzero(begins)
        return begins[np.add.reduceat(np.where(fits, sizes, 0), begins) >= least]

    def among(self, texts: pa.Array) -> list[int]:
        """Places of the texts that may have a window."""
        split = pc.utf8_split_whitespace(texts)
        tokens = split.flatten().dictionary_encode()
        spellings, at = tokens.dictionary, tokens.indices.to_numpy()
        core = pc.utf8_trim(spellings, STRIP)
        low = pc.utf8_lower(core)
        flags = lambda a: a.to_numpy(zero_copy_only=False)
        place = flags(pc.fill_null(pc.index_in(low, value_set=self.words.cast(low.type)), -1))
        digit = flags(pc.match_substring_regex(core, DIGIT))
        # tokens that a joined number and unit make beyond one
        more = np.zeros(len(core), np.int64)
        more[digit] = flags(pc.count_substring_regex(spellings.filter(pa.array(digit)), SPLIT))
        odd = flags(pc.match_substring_regex(core, ODD)) | (more > 0)
        named = flags(pc.and_(pc.not_equal(core, low), pc.equal(pc.utf8_slice_codeunits(core, 1), pc.utf8_slice_codeunits(low, 1))))
        slot = odd | digit | named | flags(pc.is_in(low, value_set=pa.array(sorted(UNITS), low.type)))
        keep = flags(pc.not_equal(core, ""))[at]
        at, offsets = at[keep], np.concatenate([[0], np.cumsum(keep)])[split.offsets.to_numpy()]
        if not len(at):
            return []
        firsts, found = offsets[:-1][offsets[:-1] < len(at)], []
        for wild, least in [(slot, self.width), *[(odd, w) for w in self.widths[:1]]]:
            fits, words = wild | (place >= 0), np.where(wild, np.uint64(0), self.hashes[place])
            found.append(self._in_a_row(fits[at], words[at], (more + 1)[at], firsts, least))
        return np.unique(np.searchsorted(offsets, np.concatenate(found), "right") - 1).tolist()


def _slots(tokens: Tokens, kinds, place: int, width: int) -> list[str]:
    return [tokens.raw[tokens.at[i]].strip(STRIP).lower() for i in range(place, place + width) if kinds[i]]


def _found(tokens: Tokens, width: int, literals: int):
    """(places, hashes, whether a name is a slot) of the template windows of a text."""
    use, values = windows(tokens.hashes, tokens.kinds, width, literals)
    typed = np.ones(len(use), bool)
    if (tokens.kinds == NAME).any():
        # windows with a name also with the name as a word, for texts that change only the case
        names = np.concatenate([[0], np.cumsum(tokens.kinds == NAME)])
        more, plain = windows(tokens.plain, tokens.plain_kinds, width, literals)
        own = names[more + width] > names[more]
        use, values, typed = np.concatenate([use, more[own]]), np.concatenate([values, plain[own]]), np.concatenate([typed, np.zeros(own.sum(), bool)])
    return use, values, typed


class _Rows:
    """Window rows of a batch as they are found."""

    def __init__(self):
        self.row, self.place, self.window, self.slots, self.words = [], [], [], [], []

    def add(self, row: int, places, hashes: np.ndarray, slots, words: int = 0) -> None:
        for p, v, s in zip(places, hashes.view(np.int64).tolist(), slots, strict=True):
            self.row.append(row)
            self.place.append(p)
            self.window.append(v)
            self.slots.append(s)
            self.words.append(words)

    def batch(self, ids, hs) -> pa.RecordBatch:
        picked = pa.array(self.row, pa.int64())
        columns = [ids.take(picked), hs.take(picked), pa.array(self.place, pa.int32()), pa.array(self.window, pa.int64()), pa.array(self.slots, pa.list_(pa.string())), pa.array(self.words, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["id", "h", "place", "window", "slots", "words"])


def _item_windows(width: int, literals: int):
    """Window rows of items; ``words`` is 0, or the width of a window of words as they are."""

    def run(batches):
        canonical = Canonical()
        for batch in batches:
            rows = _Rows()
            for row, text in enumerate(batch.column(2).to_pylist()):
                tokens = canonical.tokens(text)
                use, values, typed = _found(tokens, width, literals)
                rows.add(row, use.tolist(), values, [_slots(tokens, tokens.kinds if t else tokens.plain_kinds, p, width) for p, t in zip(use.tolist(), typed.tolist(), strict=True)])
                if not len(use) and any(map(str.isalnum, text)):
                    own, values = whole(tokens.words, width)
                    rows.add(row, range(len(values)), values, [[]] * len(values), own)
            yield rows.batch(batch.column(0), batch.column(1))

    return run


def _item_words(batches):
    """(word, hash, pair) of the tokens of items; ``pair`` is null for the last one."""
    canonical = Canonical()
    for batch in batches:
        words, hashes, pairs = [], [], []
        for text in batch.column(2).to_pylist():
            tokens = canonical.tokens(text)
            words += [tokens.raw[i].strip(STRIP).lower() for i in tokens.at]
            hashes += tokens.words.view(np.int64).tolist()
            pairs += [*pair(tokens.words[:-1], tokens.words[1:]).view(np.int64).tolist(), None][: len(tokens.words)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(hashes, pa.int64()), pa.array(pairs, pa.int64())], names=["word", "hash", "pair"])


def _text_windows(width: int, literals: int, widths: list[int], hashes, spelled=None):
    """Window rows of documents; ``hashes`` (broadcast, sorted) keeps only windows that some item has, ``widths`` are
    those of items that are matched by their words; ``spelled`` (broadcast) are the items' words, their hashes, and
    those of their pairs, sorted, and spares most texts the search."""

    def run(batches):
        canonical, wanted = Canonical(), None if hashes is None else Wanted(hashes.value)
        sieve = None if spelled is None else Sieve(*spelled.value, width, widths)
        for batch in batches:
            rows, texts = _Rows(), batch.column(2)
            for row in sieve.among(texts) if sieve else range(len(texts)):
                tokens = canonical.tokens(texts[row].as_py())
                use, values, typed = _found(tokens, width, literals)
                if wanted:
                    hit = wanted.among(values)
                    use, values, typed = use[hit], values[hit], typed[hit]
                rows.add(row, use.tolist(), values, [_slots(tokens, tokens.kinds if t else tokens.plain_kinds, p, width) for p, t in zip(use.tolist(), typed.tolist(), strict=True)])
                for own in widths:
                    use, values = windows(tokens.words, np.zeros(len(tokens.words), np.int8), own, 0)
                    if wanted:
                        hit = wanted.among(values)
                        use, values = use[hit], values[hit]
                    rows.add(row, use.tolist(), values, [[]] * len(use), own)
            yield rows.batch(batch.column(0), batch.column(1))

    return run


def _spelled(rows: DataFrame, limit: int):
    """What ``Sieve`` needs of the items ``rows`` (id, h, t), broadcast, or None if that is more than ``limit`` allows."""
    tokens = materialize(rows.transform(in_arrow, _item_words, "word string, hash long, pair long"), "item-words")
    words, pairs = tokens.select("word", "hash").distinct(), tokens.select("pair").filter("pair is not null").distinct()
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("word")).alias("bytes")).first()
    if size["n"] > limit or (size["bytes"] or 0) > limit * WORD_BYTES or pairs.limit(limit + 1).count() > limit:
        return None
    listed, numbers = words.toArrow(), lambda column: column.to_numpy().view(np.uint64)
    value = listed.column("word").combine_chunks(), numbers(listed.column("hash")), np.sort(numbers(pairs.toArrow().column("pair")))
    return rows.sparkSession.sparkContext.broadcast(value)


def _windows_of(rows: DataFrame, function) -> DataFrame:
    """``rows`` (id, h, t) to one row per window."""
    return rows.transform(in_arrow, function, f"id {rows.schema['id'].dataType.simpleString()}, h long, place int, window long, slots array<string>, words int")


def _leading(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """``items`` with ``leads``: false for a window that more than CROWD items share, if its item has enough others. Of
    an item's n windows any ``need`` hold one of the n - need + 1 rarest, so a text that matches the item has one of
    the windows that lead."""
    crowd = items.groupBy("window").agg(F.count_distinct("item").alias("crowd"))
    at_place = items.join(crowd, "window").withColumn("most", F.max("crowd").over(Window.partitionBy("item", "item_place")))
    ranked = at_place.withColumn("rank", F.dense_rank().over(Window.partitionBy("item").orderBy("most", "item_place")))
    return ranked.join(sizes, "item").withColumn("leads", (F.col("most") <= CROWD) | (F.col("rank") <= F.col("item_windows") - F.col("need") + 1)).select(*items.columns, "leads")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH,
                 literals: int = LITERALS, run: int = 13, share: float = 0.5, limit: int = 2_000_000) -> DataFrame:
    """One row (id, h, item_id, windows, item_windows) per document and benchmark item found in it.

    Texts become templates: numbers, units and names (capitalised words within a sentence) are typed slots, all
    else is folded to lower case without punctuation; windows with names also stand with the names as words. Windows of
    ``width`` template tokens with ``literals`` words outside slots are joined by hash. The matched windows of a document
    and item on one diagonal count if their slots agree: each value of the item always meets the same value in the
    document, as in a question with other numbers. A document is contaminated by an item when the windows that count are
    as many as ``run`` words in sequence have, or make up ``share`` of the item's windows if that is less (two at least,
    or all). Where a value meets two, windows whose slots hold the same values as the item's, or that have no slots,
    still count, and of the others those that don't hold that value, if with the former they make so many in sequence.

    An item without a template window, as it is short or has hardly a word beside numbers, units and names, is looked
    for by its words as they are, numbers included: in windows of ``width`` words, or as one window if it has fewer. A
    benchmark item of one common word is thus found wherever that word stands. Items of only symbols match nothing.

    The item windows, once counted, go to the tasks as a table of hashes up to ``limit`` and drop other windows at
    the source, and with the items' words and which of them stand side by side most texts are ruled out before they are
    searched; beyond that every window goes through the same join by shuffle. A window that very many items share
    makes no pairs by itself where its item has rarer ones. Null texts count as empty and match nothing, items given
    twice match under both ids, repeated rows share a result, empty tables give an empty one, texts are read whole, and
    no other columns of either table are read."""
    texts = benchmark.select(F.col("item_id"), row_hash("text").alias("item"), text_or_empty("text").alias("t"))
    whole_items = texts.groupBy(F.col("item").alias("id")).agg(F.first("t").alias("t")).select("id", F.col("id").alias("h"), "t")
    items = _windows_of(whole_items, _item_windows(width, literals)).select(F.col("id").alias("item"), F.col("place").alias("item_place"), "window", F.col("slots").alias("item_slots"), "words")
    items = materialize(items, "item-windows")
    sizes = items.groupBy("item").agg(F.count_distinct("item_place").alias("item_windows"))
    sizes = sizes.withColumn("need", F.least(F.lit(run - width + 1), F.greatest(F.ceil(F.col("item_windows") * share), F.least(F.lit(2), F.col("item_windows")))))
    sizes = materialize(sizes, "item-sizes")
    widths = sorted(r["words"] for r in items.select("words").filter("words > 0").distinct().collect())  # at most ``width`` numbers
    keys = items.select("window").distinct()
    hashes = spelled = None
    if keys.limit(limit + 1).count() <= limit:
        spelled = _spelled(whole_items, limit)
        hashes = docs.sparkSession.sparkContext.broadcast(np.sort(keys.toPandas()["window"].to_numpy(dtype=np.int64).view(np.uint64)))
    rows = docs.select(F.col(id_column).alias("id"), row_hash(text_column).alias("h"), text_or_empty(text_column).alias("t"))
    found = materialize(_windows_of(rows, _text_windows(width, literals, widths, hashes, spelled)), "windows")

    led = materialize(_leading(items, sizes), "leading-windows")
    met = lambda texts_, side: texts_.join(side, (F.col("window") == F.col("i_window")) & (F.col("words") == F.col("i_words"))).drop("i_window", "i_words")
    side = lambda keep: led.filter(keep).select("item", "item_place", F.col("window").alias("i_window"), "item_slots", F.col("words").alias("i_words"))
    pairs = met(found, side("leads")).withColumn("diagonal", F.col("place") - F.col("item_place"))
    if not led.filter("not leads").isEmpty():
        known = materialize(pairs.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), F.col("item").alias("k_item")).distinct(), "led-pairs")
        waiting = found.join(led.filter("not leads").select("window").distinct(), "window", "left_semi")
        waiting = waiting.join(known, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h")))
        more = met(waiting, side("not leads")).filter("item = k_item").drop("k_id", "k_h", "k_item").withColumn("diagonal", F.col("place") - F.col("item_place"))
        pairs = materialize(pairs.unionByName(more), "pairs")
    judged = _judged(pairs, sizes)
    names = texts.select("item", "item_id").distinct()
    return judged.join(names, "item").select("id", "h", "item_id", "windows", "item_windows")


def _judged(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Windows that count, by document and item; all by aggregates with map-side combining but for the stretches of
    diagonals with a clash, which are no longer than an item."""
    line = ["id", "h", "item", "diagonal"]
    slots = pairs.filter(F.size("slots") > 0).select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("s")).select(*line, F.col("s.item_slots").alias("mine"), F.col("s.slots").alias("theirs"))
    clash = slots.groupBy(*line, "mine").agg((F.min("theirs") != F.max("theirs")).alias("clash")).filter("clash").groupBy(*line).agg(F.collect_set("mine").alias("clashing"))
    clash = clash.select(F.col("id").alias("c_id"), F.col("h").alias("c_h"), F.col("item").alias("c_item"), F.col("diagonal").alias("c_diagonal"), "clashing")
    on = F.col("id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")) & (F.col("item") == F.col("c_item")) & (F.col("diagonal") == F.col("c_diagonal"))
    judged = pairs.join(clash, on, "left").withColumn("sure", F.col("clashing").isNull() | (F.col("item_slots") == F.col("slots")))
    sure = judged.filter("sure").select("id", "h", "item", "item_place")
    left = judged.filter(F.col("clashing").isNotNull() & (F.col("sure") | ~F.arrays_overlap("item_slots", "clashing"))).select(*line, "item_place").distinct()
    in_line = Window.partitionBy(*line)
    left = left.withColumn("stretch", F.col("item_place") - F.row_number().over(in_line.orderBy("item_place"))).withColumn("long", F.count(F.lit(1)).over(Window.partitionBy(*line, "stretch")))
    left = left.join(sizes, "item").filter(F.col("long") >= F.col("need")).select("id", "h", "item", "item_place")
    agreed = sure.unionByName(left).groupBy("id", "h", "item", "item_place").agg(F.lit(1).alias("one"))
    counted = agreed.groupBy("id", "h", "item").agg(F.count(F.lit(1)).alias("windows"))
    return counted.join(sizes, "item").filter(F.col("windows") >= F.col("need")).select("id", "h", "item", "windows", "item_windows")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without contaminated rows, all columns kept whatever their names; what is contaminated is as above, so
    rows with a null or empty text stay."""
    doomed = materialize(contaminated(docs, benchmark, **options).select("id", "h").distinct(), "contaminated")
    return drop_rows(docs, doomed, options.get("id_column", "doc_id"), options.get("text_column", "text"))
