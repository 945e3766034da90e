"""Benchmark decontamination by template canonicalisation.

Words of documents and benchmark items become templates: numbers, units after a number and names (capitalised inside
a sentence) are replaced by typed placeholders, the rest is lowered. A capitalised word that begins a sentence may be
a name or not, so its windows are searched both ways. Windows of template words are hash-joined; those with few literal
words, which any table of numbers would match, by their own words instead.

Items that differ in nothing but what fills their slots are one class, and documents are joined with classes, so that
the copies of a popular template don't multiply. Windows of one alignment (place in the document less place in the
item) must fill the slots consistently: one value of the item becomes one value of the document, the one that most
windows have; windows that say otherwise don't count. A document holds a class if half of its windows are found, or a
run of RUN words. Re-parameterised questions pass; texts that only have a pattern in common don't.

A bitmap of the benchmark's window hashes, of a fixed size whatever the benchmark's, keeps nearly all other windows
from leaving the tasks; the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import table
from .words import Spans, Words, chunks, column, mix, signed

#: Words of a window, literal words of it that a template needs, the share of windows and the words of a run that count as held.
WINDOW, MIN_LITERALS, MIN_SHARE, RUN = 8, 4, 0.5, 20
#: Items of fewer words are looked for as whole documents only: inside a text they say nothing.
SHORT = 4
BITMAP_BITS = 24
#: Units, by symbol and by name in six languages; a parameter of `contamination`.
UNITS = (
    "km m cm mm mi ft in yd kg g mg lb lbs oz t l ml cl s sec min h hr d w kw kwh v hz khz mhz ghz kb mb gb tb usd eur gbp mph kmh kph °c °f "
    "mile miles foot feet inch inches yard yards ton tons litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros pound pounds percent degree degrees meter meters metre metres kilometer kilometers gram grams "
    "metro metros kilómetro kilómetros gramo gramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares grado grados "
    "mètre mètres kilomètre kilomètres gramme grammes seconde secondes heure heures jour jours semaine semaines mois an ans degré degrés "
    "stunde stunden tag tage woche wochen monat monate jahr jahre sekunde sekunden grad prozent "
    "metri chilometri grammi secondi minuti ora ore giorno giorni settimana settimane mese mesi anno anni gradi dia ano anos mês"
)
_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_END = np.zeros(256, np.int32)
_END[[ord(c) for c in ".!?\n:"]] = 1
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65))


def unit_hashes(units: str = UNITS) -> np.ndarray:
    return np.sort(Words(pa.array([units]), lower=True, word_bytes=_WORD).hashes())


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


class Template:
    """The words of texts: own hashes, template codes and slots, and which words begin a sentence with a capital."""

    def __init__(self, texts: pa.Array, units: np.ndarray):
        texts = texts.cast(pa.large_string())
        low = pc.utf8_lower(texts)
        # a text of which lowering moves bytes is lowered in its ASCII letters alone
        low = pc.if_else(pc.equal(pc.binary_length(low), pc.binary_length(texts)), low, pc.ascii_lower(texts))
        w = self.words = Words(texts, word_bytes=_WORD)
        if not len(w):
            self.own = self.code = np.zeros(0, np.uint64)
            self.slot = self.opening = np.zeros(0, bool)
            return
        w.bytes = Words(low, word_bytes=_WORD).bytes
        self.own = w.hashes()
        lead = np.maximum.accumulate(np.where((w.raw & 0xC0) != 0x80, np.arange(len(w.raw)), 0))  # where each byte's character begins
        big = np.zeros(len(w.raw), bool)
        big[lead[w.raw != w.bytes]] = True
        digit, capital, ends, letters = (np.concatenate(([0], np.cumsum(x))) for x in ((w.raw >= 48) & (w.raw < 58), big, _END[w.raw], (w.raw & 0xC0) != 0x80))
        number = digit[w.end] > digit[w.start]
        first = np.zeros(len(w), bool)
        first[w.of_row[:-1][w.count > 0]] = True
        before = np.concatenate(([0], w.end[:-1]))
        starts = first | (ends[w.start] > ends[np.minimum(before, w.start)])
        upper = big[w.start] & (capital[w.end] - capital[w.start] == 1) & (letters[w.end] - letters[w.start] > 1) & ~number
        unit = np.concatenate(([False], number[:-1])) & ~first & ~number & _among(self.own, units)
        name = upper & ~starts & ~unit
        self.opening = upper & starts
        self.code = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, self.own)))
        self.slot = number | unit | name

    def forms(self) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Codes and slots, sentence openings read as literals and then as names."""
        yield self.code, self.slot, False
        if self.opening.any():
            yield np.where(self.opening, _NAME, self.code), self.slot | self.opening, True


def _found(t: Template, lengths: tuple[int, ...], window: int, items: bool, bits: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length and form: hashes of windows, their first words, and the words that are slots with how many each window has."""
    w = t.words
    row = w.row()
    at, left = np.arange(len(w)) - w.of_row[row], w.count[row]
    opened = np.concatenate(([0], np.cumsum(t.opening)))
    own = Spans(t.own)
    for code, slot, names in t.forms():
        spans, slots = Spans(code), np.concatenate(([0], np.cumsum(slot)))
        places = np.flatnonzero(slot)
        for n in lengths:
            # a short item is one window of its own length, and a very short one a whole document
            fits = (at == 0) & (left == n) if n < SHORT or items and n < window else at + n <= left
            start = np.flatnonzero(fits)
            if names:
                start = start[opened[start + n] > opened[start]]
            size = slots[start + n] - slots[start]
            rich = n - size >= MIN_LITERALS
            if names:
                start, size, rich = start[rich], size[rich], rich[rich]
            h = np.where(rich, spans.hash(start, start + n, n), mix(own.hash(start, start + n, 0x100 + n)))
            if bits is not None:
                k = h >> np.uint64(64 - BITMAP_BITS)
                hit = (bits[(k >> np.uint64(3)).astype(np.int64)] >> (k & np.uint64(7)).astype(np.uint8)) & 1 == 1
                start, h, size = start[hit], h[hit], size[hit]
            if len(h):
                first = np.cumsum(size) - size
                word = places[np.arange(size.sum()) - np.repeat(first, size) + np.repeat(slots[start], size)]
                yield h, start, word, size


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values))


def _seen(window: int, lengths: tuple[int, ...], units: np.ndarray, bitmap):
    """h, doc_id, pos, vals: the documents' windows that the bitmap lets through, with what fills their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in chunks(batches, "text"):
            t = Template(column(batch, "text"), units)
            row = t.words.row()
            for h, start, word, size in _found(t, lengths, window, False, bits):
                pos = (start - t.words.of_row[row[start]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(h), column(batch, "doc_id").take(pa.array(row[start])), pa.array(pos), _lists(signed(t.own[word]), size)], ["h", "doc_id", "pos", "vals"])

    return run


def _variables(t: Template) -> tuple[np.ndarray, np.ndarray]:
    """Per word the number of its value among the row's slots and openings, by first appearance (-1: neither), and per row its class: template and pattern of equal values."""
    w, number = t.words, np.full(len(t.words), -1)
    for a, b in zip(w.of_row[:-1], w.of_row[1:], strict=True):
        flagged = a + np.flatnonzero((t.slot | t.opening)[a:b])
        _, first, which = np.unique(t.own[flagged], return_index=True, return_inverse=True)
        number[flagged] = np.argsort(np.argsort(first))[which] if len(flagged) else number[flagged]
    whole = Spans(mix(t.code) + (number + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return number, whole.hash(w.of_row[:-1], w.of_row[1:])


def _wanted(window: int, units: np.ndarray):
    """h, class, at, vars: the items' windows, with the numbers of the values in their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            t = Template(column(batch, "text"), units)
            number, whole = _variables(t)
            row = t.words.row()
            for h, start, word, size in _found(t, tuple(range(1, window + 1)), window, True, None):
                at = (start - t.words.of_row[row[start]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(h), signed(whole[row[start]]), pa.array(at), _lists(number[word].astype(np.int32), size)], ["h", "class", "at", "vars"])

    return run


def _items(window: int, units: np.ndarray):
    """item_id, class, n_words, vals: the item's values in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            t = Template(column(batch, "text"), units)
            number, whole = _variables(t)
            values = []
            for a, b in zip(t.words.of_row[:-1], t.words.of_row[1:], strict=True):
                seen, first = np.unique(number[a:b], return_index=True)
                values.append(signed(t.own[a:b])[first[seen >= 0]].tolist())
            yield pa.RecordBatch.from_arrays([column(batch, "item_id"), signed(whole), pa.array(t.words.count.astype(np.int32)), pa.array(values, pa.list_(pa.int64()))], ["item_id", "class", "n_words", "vals"])

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for batch in batches:
        bits[np.asarray(column(batch, "h")).view(np.uint64) >> np.uint64(64 - BITMAP_BITS)] = True
    at = np.flatnonzero(np.packbits(bits, bitorder="little"))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.packbits(bits, bitorder="little")[at].astype(np.int32))], ["at", "byte"])


def classes(benchmark: DataFrame, units: str = UNITS) -> DataFrame:
    """item_id, class, least (the smallest item_id of the class), n_words, vals: which items are one question with other values."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    own = items.mapInArrow(_items(WINDOW, unit_hashes(units)), "item_id long, class long, n_words int, vals array<long>").where("n_words > 0")
    return own.withColumn("least", F.min("item_id").over(W.partitionBy("class")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share: float = MIN_SHARE, run: int = RUN, units: str = UNITS) -> DataFrame:
    """doc_id, item_id (the least of its class), n_windows (of the item), n_found, share, run (words of the longest run found), exact_item (the least item whose values the document has throughout, else null), exact.

    Pairs of a document and a class of items of which it holds min_share of the windows, or a run of so many words. An item
    shorter than a window is one window of its own length, and one of fewer than SHORT words must be the whole document.
    Windows with under MIN_LITERALS literal words must be held as they are, values included. Null texts and null ids match
    nothing, nor do items without a word; an item or document that repeats counts once; an empty table on either side
    gives an empty result. Texts of any length are searched whole. Other columns of docs and benchmark aren't read.
    """
    spark, known = docs.sparkSession, unit_hashes(units)
    members = classes(benchmark, units)
    items = benchmark.select("text").where("item_id IS NOT NULL AND text IS NOT NULL")
    wanted = items.mapInArrow(_wanted(window, known), "h long, class long, at int, vars array<int>").dropDuplicates(["class", "at", "h"])
    cells = wanted.select("h").mapInArrow(_bitmap, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toPandas()  # 2**BITMAP_BITS / 8 rows at most
    bits = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    bits[cells["at"].to_numpy()] = cells["byte"].to_numpy()
    lengths = tuple(sorted(r[0] for r in members.select(F.least("n_words", F.lit(window))).distinct().collect()))  # at most `window` numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    seen = texts.mapInArrow(_seen(window, lengths, known, spark.sparkContext.broadcast(bits.tobytes())), "h long, doc_id long, pos int, vals array<long>")
    key = ["doc_id", "class", "shift"]
    met = seen.join(wanted, "h").select("doc_id", "class", (F.col("pos") - F.col("at")).alias("shift"), "at", F.arrays_zip("vars", "vals").alias("fill"))
    votes = met.select(*key, "at", F.explode("fill").alias("x")).groupBy(*key, "x").agg(F.countDistinct("at").alias("n"))
    chosen = votes.groupBy(*key, F.col("x.vars").alias("var")).agg(F.max_by(F.col("x.vals"), F.struct("n", "x.vals")).alias("val"))
    filled = chosen.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("var", "val"))).alias("m"))  # at most the item's slots
    agreed = met.join(filled, key, "left").where(F.forall("fill", lambda x: F.col("m")[x.vars] == x.vals)).select(*key, "at", "m").dropDuplicates([*key, "at"])
    islands = agreed.withColumn("island", F.col("at") - F.row_number().over(W.partitionBy(*key).orderBy("at")))
    runs = islands.groupBy(*key, "island").agg(F.count("*").alias("long"), F.collect_set("at").alias("ats"), F.first("m").alias("m"))
    aligned = runs.groupBy(*key).agg(F.max("long").alias("long"), F.flatten(F.collect_list("ats")).alias("ats"), F.first("m").alias("m"))
    whole = aligned.groupBy("doc_id", "class").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_found"), F.max("long").alias("long"), F.max_by(F.struct("m"), F.struct(F.size("ats"), -F.col("shift"))).m.alias("m"))
    per_class = members.groupBy("class").agg(F.first("least").alias("item_id"), F.first("n_words").alias("n_words"), F.first(F.size("vals")).alias("k"))
    windows = F.greatest(F.col("n_words") - (window - 1), F.lit(1)).cast("long")
    held = whole.join(per_class, "class").withColumn("n_windows", windows).withColumn("share", F.col("n_found") / F.col("n_windows")).withColumn("run", (F.col("long") + F.least("n_words", F.lit(window)) - 1).cast("long"))
    held = held.where((F.col("share") >= min_share) | (F.col("run") >= run))
    numbers = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    values = F.when(F.col("share") == 1, F.xxhash64(F.transform(numbers, lambda v: F.coalesce(F.col("m")[v], F.lit(0).cast("long")))))
    same = members.groupBy("class", F.xxhash64("vals").alias("v")).agg(F.min("item_id").alias("exact_item"))
    out = held.withColumn("v", values).join(same, ["class", "v"], "left")
    return out.select("doc_id", "item_id", "n_windows", "n_found", "share", "run", "exact_item", F.col("exact_item").isNotNull().alias("exact"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
