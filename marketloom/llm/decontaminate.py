"""Benchmark decontamination by templates, so that re-parameterised items are found too.

A text becomes tokens: words without the punctuation around them, folded to small letters
(A-Z and all scripts below U+0800); tokens of punctuation alone vanish. It is read four
ways: as spelled; with numbers, in digits or in words of four languages, and units as typed
placeholders; with capitalised words that open no sentence as names
too; with capitalised words that open one as names as well. Names side by side, and a
number with its unit, are one placeholder, whose joined spelling is its slot value.
Windows of `width` tokens of each reading are joined by hash with those of the benchmark; a
fixed-size bitmap of the benchmark's windows keeps all other document windows out of the
shuffle. A window with placeholders needs at least `literals` ordinary words (a word that
opens a sentence is one); a window as spelled needs none, so capitals and many numbers hide
no copy. An item of fewer than `width` tokens, or of so few placeholders and words, is one window.

Windows that agree at one shift between a document and an item are laid together, and those
of shifts no more than NEIGHBOURS apart. The document holds the item if they cover `enough`
of its tokens in all (or the whole of a shorter item) and the slots are consistent: one value
of the item always became one value of the document (windows as spelled have no slots).
Items of fewer than `width` tokens are found as spelled, whole, in any capitals. Null and
empty texts hold nothing; repeated rows are each reported; an empty benchmark leaves every
document alone; an empty table gives no rows. Columns besides ids and texts are carried
along as they are, whatever their names. Equal windows tie without effect: all are laid.
A text of any length is held whole by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm import text as T

_U = np.uint64
# Fixed values.
UNITS = ("%", "$", "€", "£", "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yards", "mile", "miles", "mg", "g", "kg", "lb", "lbs", "pounds", "tons",
         "ml", "l", "liter", "liters", "litres", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month",
         "months", "year", "years", "dollar", "dollars", "euro", "euros", "cents", "percent", "degrees", "mph", "kmh", "watts", "volts")
#: Number words; those that are articles, too, are left out.
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
           "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million",
           "null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun", "zehn", "elf", "zwölf", "zwanzig", "dreißig", "vierzig", "fünfzig", "sechzig", "siebzig", "achtzig",
           "neunzig", "hundert", "tausend",
           "zéro", "deux", "trois", "quatre", "cinq", "sept", "huit", "neuf", "dix", "onze", "douze", "treize", "quatorze", "quinze", "seize", "vingt", "trente", "quarante",
           "cinquante", "soixante", "cent", "mille",
           "cero", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve", "diez", "once", "doce", "trece", "catorce", "quince", "veinte", "treinta", "cuarenta", "cincuenta",
           "sesenta", "setenta", "ochenta", "noventa", "cien", "ciento", "mil")
NUMBER, NAME, UNIT = (_U(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x6A09E667F3BCC909))
#: The readings of a text, the surest first; shifts that far apart are neighbours.
SPELLED, COUNTED, PLACED, OPENED = range(4)
NEIGHBOURS = 4
_B = np.arange(256)
_DIGIT = (_B >= 48) & (_B <= 57)
_CAPITAL = (_B >= 65) & (_B <= 90)
_CORE = _DIGIT | _CAPITAL | ((_B >= 97) & (_B <= 122)) | (_B >= 128) | np.isin(_B, (36, 37))  # $ and % can stand alone
_CLOSES = np.isin(_B, np.frombuffer(b".!?:", np.uint8))


def _small(code: int) -> int:
    """The small letter of a character that takes two bytes, where it takes two as well."""
    low = chr(code).lower()
    return ord(low) if len(low) == 1 and 0x80 <= ord(low) < 0x800 else code


#: By code point below U+0800: small letter, and whether it is a capital.
SMALL = np.array([_small(c) for c in range(0x800)])
LARGE = np.array([chr(c).isupper() for c in range(0x800)])


def _two_bytes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the two-byte characters that begin at `at`."""
    return (data[at].astype(np.int64) & 0x1F) << 6 | (data[at + 1].astype(np.int64) & 0x3F)


def _fold(data: np.ndarray) -> np.ndarray:
    out = np.where(_CAPITAL[data], data + 32, data).astype(np.uint8)
    at = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF)) if len(data) else np.zeros(0, np.int64)
    small = SMALL[_two_bytes(data, at)]
    out[at], out[at + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
    return out


@cache
def _named(words: tuple[str, ...]) -> np.ndarray:
    """Names of some spelled tokens, in order."""
    spelled = [u.encode() for u in words]
    ends = np.cumsum([len(u) for u in spelled])
    return np.sort(T.byte_roll(np.frombuffer(b"".join(spelled), np.uint8)).span(np.concatenate([[0], ends[:-1]]), ends))


def _among(spelled: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
    known = _named(words)
    return known[np.minimum(np.searchsorted(known, spelled), len(known) - 1)] == spelled


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Folded spelling, number, number word, unit, capital, opener and glue of each token, and
    the first token of each text. An opener stands first in a text, line or sentence; a token is glued
    to the one before it if neither an opening nor a mark stands between them."""
    starts, ends, first = T.words(data, offsets)
    if not len(starts):
        none = np.zeros(0, bool)
        return np.zeros(0, _U), none, none, none, none, none, none, first
    core, at = _CORE[data], np.arange(len(data))
    opens = np.minimum.accumulate(np.where(core, at, len(data))[::-1])[::-1][starts]
    closes = np.maximum.accumulate(np.where(core, at, -1))[ends - 1] + 1
    solid = opens < ends
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[1:] > first[:-1]]] = False
    inner[1:] &= ~_CLOSES[data[ends[:-1] - 1]] & (breaks[starts[1:]] == breaks[ends[:-1]])
    glued = np.zeros(len(starts), bool)
    glued[1:] = inner[1:] & solid[:-1] & (opens[1:] == starts[1:]) & (closes[:-1] == ends[:-1])
    a, b = opens[solid], closes[solid]
    wide = np.flatnonzero((data[a] >= 0xC2) & (data[a] <= 0xDF))
    large = _CAPITAL[data[a]]
    large[wide] = LARGE[_two_bytes(data, a[wide])]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    spelled = T.byte_roll(_fold(data)).span(a, b)
    worded = _among(spelled, NUMBERS)
    number = _DIGIT[data[a]] | (((data[a] == 36)) & (digits[b] > digits[a])) | worded
    unit = ~number & _among(spelled, UNITS)
    capital = large & ~number & ~unit
    return spelled, number, worded, unit, capital, ~inner[solid], glued[solid], np.concatenate([[0], np.cumsum(solid)])[first]


def _collapsed(number: np.ndarray, worded: np.ndarray, unit: np.ndarray, name: np.ndarray, glued: np.ndarray) -> np.ndarray:
    """The first token of each run: names or number words side by side and a number with its unit are one."""
    more = np.zeros(len(glued), bool)
    more[1:] = glued[1:] & ((name[1:] & name[:-1]) | (worded[1:] & worded[:-1]) | (unit[1:] & number[:-1]))
    return np.flatnonzero(~more)


def _windows(width: int, literals: int, wanted: np.ndarray | None, short: tuple[tuple[int, int], ...] = ()):
    """Windows of each text (id, key): the reading it is taken from, how many tokens of that
    reading it has, its span in tokens and its place in placeholders, the tokens of the text,
    its name and slots. Texts of the benchmark (`wanted` is None) that are too short for a
    window give one of their whole; `short` says which of these to look for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in T.chunks(batch):
                spelled, number, worded, unit, capital, opener, glued, first = tokens(data, offsets)
                n = len(spelled)
                if not n:
                    continue
                words = T.Roll(spelled)
                size = np.diff(first)
                place = None
                never = np.zeros(n, bool)
                parts = []
                for reading, name in ((PLACED, capital & ~opener), (SPELLED, None), (COUNTED, never), (OPENED, capital)):
                    if reading == SPELLED:
                        head, value, slot, heads = np.arange(n), spelled, np.zeros(n, _U), first
                        special = None
                    else:
                        head = _collapsed(number, worded, unit, name, glued)
                        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, spelled)))[head]
                        ordinary = ~(number | unit | name)[head]
                        value, heads = kind, np.searchsorted(head, first)
                        slot = np.where(ordinary, _U(0), words.span(head, np.append(head[1:], n)))
                        # a window is given by the first reading that makes it
                        special = {COUNTED: ~ordinary, PLACED: name[head], OPENED: name[head] & opener[head]}[reading]
                        if reading == PLACED:
                            at_head = np.zeros(n, np.int64)
                            at_head[head] = 1
                            place = np.cumsum(at_head) - 1
                            place -= np.repeat(place[np.minimum(first[:-1], n - 1)], size)
                        if reading == OPENED:  # an opener may be any word
                            ordinary |= opener[head] & name[head]
                        plain, marks = (np.concatenate([[0], np.cumsum(x)]) for x in (ordinary, special))
                    m, ends = len(head), np.append(head, n)
                    owner = np.repeat(np.arange(len(size)), np.diff(heads))
                    last, own = heads[1:][owner], np.diff(heads)[owner]
                    roll = words if reading == SPELLED else T.Roll(value)
                    for w in (range(1, width + 1) if wanted is None else [width, *(k for r, k in short if r == reading)]):
                        if m < w:
                            continue
                        at = np.arange(m - w + 1)
                        ok = at + w <= last[at]
                        if w < width:
                            if wanted is None:
                                ok &= own[at] == w
                            if reading != SPELLED:
                                ok &= size[owner[at]] >= width if wanted is None else True
                        if special is not None:
                            ok &= (plain[at + w] - plain[at] >= literals) & (marks[at + w] > marks[at])
                        at = at[ok]
                        named = roll.span(at, at + w)
                        if wanted is not None:
                            here = T.in_bitmap(named, wanted)
                            at, named = at[here], named[here]
                        if not len(at):
                            continue
                        slots = slot[at[:, None] + np.arange(w)].reshape(-1) if special is not None else np.zeros(0, _U)
                        each = w if special is not None else 0
                        parts.append((reading, w, owner[at], head[at], ends[at + w], named, each, slots))
                for reading, w, doc, start, end, named, each, slots in parts:
                    k = len(doc)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a).take(pa.array(doc)), batch.column(1).slice(a, b - a).take(pa.array(doc)),
                         pa.array(np.full(k, reading)), pa.array(np.full(k, w)), pa.array(start - first[doc]), pa.array(end - first[doc]), pa.array(place[start]),
                         pa.array(size[doc]), pa.array(T.signed(named)),
                         pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * each, pa.int32()), pa.array(T.signed(slots)))],
                        names=["id", "key", "reading", "width", "at", "to", "place", "size", "name", "slots"])

    return T.tidy(run)


_OUT = "id long, key long, reading long, width long, at long, to long, place long, size long, name long, slots array<long>"


def _covered(laid: Column) -> Column:
    """Item tokens under the spans of `laid`; 0 where one value became several."""
    def more(state, s):
        return F.struct((state["n"] + F.greatest(s["to"] - F.greatest(s["at"], state["reach"]), F.lit(0).cast("long"))).alias("n"),
                        F.greatest(state["reach"], s["to"]).alias("reach"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    pairs = F.array_distinct(laid["pairs"])
    consistent = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda s: s["item_slots"])))
    return F.when(consistent, F.aggregate(F.array_sort(F.array_distinct(laid["spans"])), zero, more)["n"]).otherwise(F.lit(0).cast("long"))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, literals: int = 5, enough: int = 13) -> DataFrame:
    """doc_id, key (a name of the row's id and text), item_ids and n_covered of each row
    that holds an item; n_covered is the most tokens that any of its items shares."""
    def texts(df, name):
        df = df.select(F.col(name).cast("long").alias("id"), "text")
        return df.select("id", F.xxhash64("id", "text").alias("key"), F.col("text").cast("binary").alias("text"))

    items = texts(benchmark, "item_id").mapInArrow(_windows(width, literals, None), _OUT)
    short = tuple(sorted(tuple(r) for r in items.where(F.col("width") < width).select("reading", "width").distinct().collect()))
    items = items.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("to").alias("item_to"), F.col("place").alias("item_place"),
                         F.col("size").alias("item_size"), F.col("reading").alias("item_reading"), "name", F.col("slots").alias("item_slots")).distinct()
    # each reading may meet the others' windows, so all look for every short width
    short = tuple((r, w) for r in (SPELLED, COUNTED, PLACED, OPENED) for w in sorted({w for s, w in short if (s == SPELLED) == (r == SPELLED)}))
    seen = texts(docs, "doc_id").mapInArrow(_windows(width, literals, T.bitmap(items.select("name").distinct(), "name"), short), _OUT)
    # windows of a row that occurs several times are the same rows here
    met = seen.dropDuplicates(["key", "at", "name"]).join(items, "name")
    # By tokens for windows without names, and by placeholders, where a name's length moves nothing. `beyond`
    # windows are the less certain half: they may add to the others' tokens, not take from them.
    surest = F.greatest("reading", "item_reading")
    ways = F.filter(F.array(
        F.struct(F.lit(0).alias("way"), (F.col("at") - F.col("item_at")).alias("shift"), (surest > SPELLED).alias("beyond"), (surest <= COUNTED).alias("fits")),
        F.struct(F.lit(1).alias("way"), (F.col("place") - F.col("item_place")).alias("shift"), (surest > PLACED).alias("beyond"), F.lit(True).alias("fits"))),
        lambda x: x["fits"])
    met = met.select("id", "key", "item_id", "item_size", F.struct(F.col("item_at").alias("at"), F.col("item_to").alias("to")).alias("span"), F.inline(ways),
                     F.filter(F.arrays_zip("item_slots", "slots"), lambda s: s["item_slots"] != 0).alias("pairs"))
    kept = [F.struct(F.collect_set(F.when(sure, F.col("span"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set(F.when(sure, F.col("pairs"))))).alias("pairs"))
            for sure in (~F.col("beyond"), F.lit(True))]
    of = ["id", "key", "item_id", "way"]
    laid = met.groupBy(*of, "shift").agg(F.max("item_size").alias("item_size"), *[k.alias(f"laid{i}") for i, k in enumerate(kept)])
    order = Window.partitionBy(*of).orderBy("shift")
    apart = F.coalesce((F.col("shift") - F.lag("shift").over(order) > NEIGHBOURS).cast("long"), F.lit(0).cast("long"))
    laid = laid.withColumn("apart", apart).withColumn("near", F.sum("apart").over(order))
    near = laid.groupBy(*of, "near").agg(F.max("item_size").alias("item_size"), *[F.collect_list(f"laid{i}").alias(f"laid{i}") for i in range(2)])
    covered = F.greatest(*[x for i in range(2) for x in (
        F.array_max(F.transform(f"laid{i}", _covered)),
        _covered(F.struct(F.flatten(F.col(f"laid{i}.spans")).alias("spans"), F.flatten(F.col(f"laid{i}.pairs")).alias("pairs"))))])
    held = near.withColumn("covered", covered).where(F.col("covered") >= F.least(F.lit(enough), "item_size"))
    found = held.groupBy("id", "key").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("n_covered"))
    return found.select(F.col("id").alias("doc_id"), "key", "item_ids", "n_covered")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, all columns as given."""
    bad = leaks(docs, benchmark, **how).select("key").distinct()
    row = docs.select(F.struct("*").alias("row"))
    named = row.withColumn("key", F.xxhash64(F.col("row.doc_id").cast("long"), "row.text"))
    return named.join(bad, "key", "left_anti").select("row.*")
