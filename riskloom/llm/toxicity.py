"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, fresh, in_arrow, materialize, spread, text_or_empty, training_ids

#: Letters of other alphabets, and of this one in other shapes, that pass for a Latin letter; decomposition has dealt
#: with accents, full-width, circled and mathematical forms before.
LOOKALIKES = dict(zip("аеорсухіјѕԁɡһкмтвнѵԛԝαεορυικντηχωγıłøđħŧſɑɩɪʀɴʟʏʙɢʜ", "aeopcyxijsdghkmtbhvqwaeopuikntnxwyilodhtsaiirnlybgh", strict=True))
DIGITS = dict(zip("01345789@$!€", "oieastbgasie", strict=True))
FOLD = LOOKALIKES | DIGITS
FOLDED = re.compile(f"[{''.join(map(re.escape, FOLD))}]")
#: Accents, variation selectors, and characters without width.
UNSEEN = re.compile("[\u00ad\u0300-\u036f\u061c\u180b-\u180e\u1ab0-\u1aff\u1dc0-\u1dff\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u20d0-\u20ff\ufe00-\ufe0f\ufe20-\ufe2f\ufeff]+")
#: The same without combining accents.
INVISIBLE = re.compile("[\u00ad\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]+")
#: Four characters or more that stand alone, with a mark or two between each.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*·•|/~]{1,2}){3,}[^\W_](?![^\W_])")
MARKS = re.compile(r"[ .\-_*·•|/~]+")
IS_MARK = np.zeros(0x2024, bool)
IS_MARK[[ord(c) for c in " .-_*·•|/~"]] = True
REPEATED = re.compile(r"([^\W\d_])\1{2,}")

SEED_LEXICON = {w: 2.0 for w in ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting", "imbecile", "bastard")}
#: Phrases in which a listed or learned word is harmless: a match inside one does not count.
EXCEPTIONS = ("pond scum", "soap scum", "stupid question", "idiot proof", "idiot-proof", "sore loser rule", "class clown", "clown fish", "clownfish", "trash can", "trash bin")
END = "\0"  # closes a whole word in a stem
SHORTEST, LONGEST, WORD_LONGEST = 3, 14, 64
WORD = re.compile(r"[^\W\d_]+")


def _shape(low: str) -> tuple[bool, bool]:
    """Whether a text can hold letters set apart, and whether a letter stands three times in a row: cheap tests, as hardly
    a text has either."""
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < 3:
        return False, False
    same = codes[1:] == codes[:-1]
    repeated = any(chr(c).isalpha() for c in np.unique(codes[2:][same[1:] & same[:-1]]).tolist())
    mark = IS_MARK[np.minimum(codes, len(IS_MARK) - 1)]
    alone = ~mark[1:-1] & mark[:-2] & mark[2:]
    # of four letters or more the inner ones have a mark or two on both sides
    return bool((alone[:-2] & alone[2:]).any() or (alone[:-3] & alone[3:]).any()), repeated


def plain(text: str) -> str:
    """Lower case without invisible characters, compatibility forms resolved, and letters that were set apart
    ("i.d.i.o.t") joined."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
    low = text.lower()
    return SPACED.sub(lambda m: MARKS.sub("", m.group()), low) if _shape(low)[0] else low


def views(text: str) -> list[str]:
    """The plain text as it is and, if it has any, without accents, as these make words in some languages and hide them
    in others. Where a letter stands three times or more in a row, each once with one and once with two of it."""
    found = [plain(text)]
    if not found[0].isascii() and (bare := UNSEEN.sub("", unicodedata.normalize("NFKD", found[0]))) != found[0]:
        found.append(bare)
    if any(_shape(low)[1] for low in found):
        found = list(dict.fromkeys(REPEATED.sub(r, low) for low in found for r in (r"\1", r"\1\1")))
    return found


def fold(low: str) -> str:
    """Plain text with look-alike letters and digit substitutions folded, character for character, so that places in
    both agree."""
    return FOLDED.sub(lambda m: FOLD[m.group()], low)


def words(text: str) -> set[str]:
    """Folded words of three letters or more. Digits fold to letters, so a number is no word unless it holds a letter."""
    found = {(m.group(), low[m.start() : m.end()]) for low in views(text) for m in WORD.finditer(fold(low))}
    return {w for w, raw in found if len(w) >= SHORTEST and any(map(str.isalpha, raw))}


@dataclass
class Lexicon:
    """Stems with weights (a stem that ends in END is a whole word), exception phrases, and a logistic scale."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "scale": self.scale, "_machine": None}

    def entries(self) -> dict[str, tuple[int, float, bool]]:
        """By word: length, weight, and whether it counts as a whole word only; an open stem of the same spelling wins,
        as it covers the word and its forms. Exception phrases have weight 0."""
        made: dict[str, tuple[int, float, bool]] = {}
        for stem, weight in self.weights.items():
            word = stem.removesuffix(END)
            _, other, whole = made.get(word, (0, weight, True))
            made[word] = (len(word), max(weight, other), whole and stem.endswith(END))
        return made | {phrase: (len(phrase), 0.0, True) for phrase in self.exceptions}

    def machine(self):
        if self._machine is None:
            made = ahocorasick.Automaton()
            for word, entry in self.entries().items():
                made.add_word(word, entry)
            made.make_automaton()
            self._machine = made
        return self._machine

    def _total(self, low: str) -> float:
        found, spared = {}, []
        for end, (size, weight, whole) in self.machine().iter(fold(low)):
            start, after = end - size + 1, end + 1
            if start and low[start - 1].isalpha():
                continue
            if whole and after < len(low) and low[after].isalpha():
                continue
            if not any(map(str.isalpha, low[start:after])):
                continue  # a number, not a word
            if weight:
                found[start] = max(found.get(start, 0.0), weight)
            else:
                spared.append((start, after))
        if spared:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in spared)}
        return float(sum(found.values()))

    def measure(self, text: str) -> tuple[float, float]:
        """Summed weights of the matches, and the same for each 100 words; of several views of a text the greatest."""
        if not text or not self.weights:
            return 0.0, 0.0
        total = max(map(self._total, views(text)))
        return total, 100.0 * total / max(1, len(text.split())) if total else 0.0

    def score(self, text: str) -> float:
        a, b, c = self.scale
        total, rate = self.measure(text)
        return float(1.0 / (1.0 + np.exp(-np.clip(a + b * np.log1p(total) + c * np.log1p(rate), -30, 30))))


def _stem_counts(batches):
    """(stem, label, documents) of one task, combined over its batches."""
    counts: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stems = set()
            for word in words(text):
                stems.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
                if len(word) <= WORD_LONGEST:  # what is longer is no word, but its stems count
                    stems.add(word + END)
            counts.update((s, label) for s in stems)
            if len(counts) > 100_000:
                yield _count_batch(counts)
                counts.clear()
    yield _count_batch(counts)


def _count_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["stem", "label", "n"])


def choose_stems(counts: dict[str, tuple[int, int]], toxic: int, clean: int, least: int, odds: float) -> dict[str, float]:
    """Stems whose smoothed log odds between toxic and clean documents reach ``odds``. Of a chain of stems, the
    one that starts it is lengthened as long as one extension keeps nine tenths of its documents."""
    weight = lambda a, b: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
    good = {s: weight(a, b) for s, (a, b) in counts.items() if a >= least and weight(a, b) >= odds}
    longer: dict[str, list[str]] = {}
    for s in good:
        longer.setdefault(s[:-1], []).append(s)
    chosen = {}
    for stem in sorted(s for s in good if s[:-1] not in good):
        start = counts[stem][0]
        while rest := [s for s in longer.get(stem, ()) if counts[s][0] >= 0.9 * start]:
            stem = max(rest, key=lambda s: (counts[s][0], s))
        chosen[stem] = good[stem]
    return chosen


def _newton(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    x = np.column_stack([np.ones(len(rows)), np.log1p(rows)])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(3), x.T @ (labels - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, odds: float = 2.5, id_column: str = "doc_id", text_column: str = "text") -> Lexicon:
    """A lexicon from labelled documents outside the held-out fold.

    At most ``sample`` labelled ids are used, the first by a hash of the id; that bound is what makes the broadcast
    of the ids, the collected stems and the fitted scale bounded. Stems are counted by document in the tasks, and
    only those found in at least three toxic documents (or 1 % of them) come to the driver. Texts are read whole; null
    texts count as empty, null ids and labels not at all, an id given twice or labelled twice counts once and as toxic
    if either says so. With no toxic or no clean label, as in empty tables, the seed lexicon and a fixed scale are used.
    Columns other than id and text are not read."""
    chosen = training_ids(labels, "toxic", sample)
    picked = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("t")).join(F.broadcast(chosen), "doc_id")
    # of equal texts one counts, else the words of a text that was copied often look like a lexicon
    picked = materialize(picked.groupBy(F.sha2("t", 256)).agg(F.first("t").alias("t"), F.max("label").alias("label")).select("t", "label"), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({k + END: v for k, v in SEED_LEXICON.items()})
    least = max(3, toxic // 100)
    stems = spread(picked).transform(in_arrow, _stem_counts, "stem string, label int, n long").groupBy("stem").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    ratio = (F.col("a") + 0.5) / (toxic + 1) / ((F.col("b") + 0.5) / (clean + 1))
    stems = stems.filter((F.col("a") >= least) & (ratio >= float(np.exp(odds))))
    weights = choose_stems({r["stem"]: (r["a"], r["b"]) for r in stems.toLocalIterator()}, toxic, clean, least, odds)
    lexicon = Lexicon({k + END: v for k, v in SEED_LEXICON.items()} | weights)

    def measured(batches):
        for batch in batches:
            both = [lexicon.measure(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in both], pa.float64()), pa.array([x for _, x in both], pa.float64()), batch.column(1)], names=["total", "rate", "label"])

    rows = picked.transform(in_arrow, measured, "total double, rate double, label int").collect()  # at most `sample` rows of three numbers
    lexicon.scale = _newton(np.array([[r["total"], r["rate"]] for r in rows]), np.array([r["label"] for r in rows], dtype=float))
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with ``score`` between 0 and 1 added, from the whole text of each row; one pass, no shuffle.

    A null or empty text has no match and scores the scale's floor. Equal texts score equally, long ones are read whole,
    an empty table gives an empty one. A column of ``docs`` that is named like the score stays as ``<name>_input``."""
    docs = aside(docs, [score_column])
    text = fresh(docs.columns, "__t")
    rows = docs.withColumn(text, text_or_empty(text_column)).select(*docs.columns, text)
    place = len(docs.columns)

    def run(batches):
        for batch in batches:
            scores = pa.array([lexicon.score(t) for t in batch.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], scores], names=[*batch.schema.names[:place], score_column])

    return rows.transform(in_arrow, run, T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())]))


def save(lexicon: Lexicon) -> str:
    return json.dumps({"weights": lexicon.weights, "exceptions": lexicon.exceptions, "scale": lexicon.scale}, ensure_ascii=False)


def load(text: str) -> Lexicon:
    found = json.loads(text)
    return Lexicon(found["weights"], tuple(found["exceptions"]), tuple(found["scale"]))
