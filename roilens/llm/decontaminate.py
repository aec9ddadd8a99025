"""Benchmark decontamination by template canonicalisation.

Texts become tokens; numbers, units after a number, and names turn into typed
placeholders that keep their value as a slot. Each text is read in three ways:
names are the capitalised words that somewhere in the text do not begin a sentence
and never occur in small letters; or all capitalised words, whatever else the text
holds; or none. A document is judged by what matches in the first and third, and by
what matches in the second and third, so neither its other text nor its capitals
hide an item. Windows of ``WINDOW`` tokens are
hashed: documents and benchmark items meet where template windows are equal
(shuffle hash-join on 64-bit hashes), so an item is found whatever numbers,
names and units it was filled with; a run of names, or of numbers, is one token.
Matches of one document and item at one offset form an alignment. One that goes
on at an offset shifted by at most ``SHIFT`` tokens (words were inserted or
dropped) is chained to it. The slots of the whole must be consistent: each value
of the item stands for one value of the document throughout, and different names
and units stay different; runs are compared word by word if they have as many. A document is contaminated by an item if a consistent alignment
covers ``COVER`` of the item's tokens or ``LEAST_RUN`` of them, whichever is less.

Before the join, documents' windows pass a Bloom filter of the benchmark's
(fixed at ``BLOOM_BITS`` bits, whatever the benchmark's size), so that only
probable matches are shuffled; the join then removes its false positives and no
match is lost.

Windows need ``LEAST_WORDS`` literal tokens, or tables of numbers would match
each other. Items shorter than a window are one window of their own length; items
with fewer than ``LEAST_WORDS`` literal tokens in every window take no part.

Defined results: null and empty texts match nothing; each text is judged for
itself, whatever other rows its id has; repeated rows of a document id give one
row for each item, that of the best text; a null document id is an id of its own;
``clean`` drops contaminated texts, not other texts of their ids; repeated items are one item for each id; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

WINDOW, LEAST_WORDS, LEAST_RUN, COVER, SHIFT = 8, 4, 13, 0.8, 8
BLOOM_BITS, BLOOM_HASHES = 1 << 24, 3
NUMBER, UNIT, NAME = "\x00num", "\x00unit", "\x00name"
KINDS = (NUMBER, UNIT, NAME)
CHARS_AT_ONCE = 1 << 20

# Units of measure and money that count as units after a number.
UNITS = frozenset("""
mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles metre metres meter meters kilometre kilometres
kilometer kilometers centimetre centimetres centimeter centimeters mg g kg t gram grams kilogram kilograms ton tons
tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l litre litres liter liters gallon gallons pint pints cup cups
s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years
dollar dollars cent cents euro euros usd eur gbp yen rupee rupees percent degrees degree mph kmh watt watts volt volts
""".split())

OTHER, LETTER, DIGIT, END, JOINT, POINT = range(6)


class _Memo(dict):
    """Tables that a worker makes once; they are not shipped with the functions that use them."""

    def __reduce__(self):
        return _Memo, ()


_MEMO = _Memo()
PLANE = 0x10000  # characters beyond the basic plane count as neither letters nor digits


def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, lower-case form, and case (1 capital, 2 small)."""
    if "characters" in _MEMO:
        return _MEMO["characters"]
    kind, low, case = np.zeros(PLANE, np.uint8), np.arange(PLANE, dtype=np.uint32), np.zeros(PLANE, np.uint8)
    for i in range(PLANE - 1):
        c = chr(i)
        if c.isalpha():
            kind[i] = LETTER
            if len(c.lower()) == 1:
                low[i] = ord(c.lower())
            case[i] = c.isupper() + 2 * c.islower()
        elif c.isdecimal():
            kind[i] = DIGIT
    for chars, k in ((".!?:\n", END), ("'’", JOINT), (",", POINT)):
        for c in chars:
            kind[ord(c)] = k
    _MEMO["characters"] = kind, low, case
    return kind, low, case


PRIME = 0x9E3779B97F4A7C15


def _powers(upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse modulo 2 ** 64, ``upto`` at least."""
    if len(_MEMO.get("powers", [[]])[0]) <= upto:
        size = 1 << max(14, upto.bit_length())
        factors = [np.full(size, p, dtype=np.uint64) for p in (PRIME, pow(PRIME, -1, 1 << 64))]
        for f in factors:
            f[0] = 1
        _MEMO["powers"] = tuple(np.cumprod(f, dtype=np.uint64) for f in factors)
    return _MEMO["powers"]


def _scan(text: str) -> tuple[np.ndarray, ...]:
    """Words, numbers and sentence ends of at most CHARS_AT_ONCE characters: hash of the lower-case form,
    kind, whether it begins with a capital (and is not all capitals), start and stop."""
    kinds, low, cases = _characters()
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), PLANE - 1)
    kind, case = kinds[code], cases[code]
    inner = slice(1, -1)
    if len(code) > 2:  # an apostrophe joins letters; a point or comma joins digits
        before, after, here = kind[:-2], kind[2:], kind[inner]
        letters = (here == JOINT) & (before == LETTER) & (after == LETTER)
        digits = ((here == POINT) | (code[inner] == ord("."))) & (before == DIGIT) & (after == DIGIT)
        here[letters], here[digits] = LETTER, DIGIT
    kind[kind > END] = OTHER
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == END)]))
    start = edge[kind[edge] != OTHER]
    stop = np.append(edge, len(code))[1:][kind[edge] != OTHER]
    power, inverse = _powers(len(code))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((low[code] + np.uint32(1)) * power[:len(code)], dtype=np.uint64)])
        h = (total[stop] - total[start]) * inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    small = np.concatenate([[0], np.cumsum(case == 2)])
    capital = (case[start] == 1) & ((stop - start == 1) | (small[stop] > small[start]))
    return h, kind[start], capital, start, stop


def scan(text: str) -> tuple[np.ndarray, ...]:
    """``_scan`` of a text of any length, in pieces cut at spaces."""
    found, at = [], 0
    while at < len(text):
        end = at + CHARS_AT_ONCE
        if end < len(text):
            end = max((text.rfind(c, at, end) for c in " \n")) + 1 or end
            end = end if end > at else at + CHARS_AT_ONCE
        part = _scan(text[at:end])
        found.append((*part[:3], part[3] + at, part[4] + at))
        at = end
    if not found:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return tuple(map(np.concatenate, zip(*found, strict=True)))


HASH = {kind: np.uint64(int.from_bytes(hashlib.blake2b(kind.encode(), digest_size=8).digest(), "little")) for kind in KINDS}


def _unit_hashes() -> np.ndarray:
    if "units" not in _MEMO:
        _MEMO["units"] = np.array([_scan(u)[0][0] for u in sorted(UNITS)], dtype=np.uint64)
    return _MEMO["units"]


class Template:
    """A text as template tokens: ``hashes`` of the words, ``kinds`` (0: literal, else the place in KINDS from 1; no names
    yet), ``named`` (the names by the whole text), ``capital`` (those by the word alone), ``joined`` (no sentence ends before the token), and where each is in the text."""

    def __init__(self, text: str | None):
        self.text = text or ""
        hashes, kind, capital, start, stop = scan(self.text)
        end = kind == END
        begins = np.concatenate([[True], end[:-1]])[:len(end)]
        name = np.zeros(len(end), dtype=bool)
        if not self.text.isupper():  # where all is in capitals they tell nothing
            found = np.unique(hashes[capital & ~begins])
            if len(found):
                found = found[~np.isin(found, hashes[(kind == LETTER) & ~capital])]
                name = np.isin(hashes, found) & capital
        kept = np.flatnonzero(~end)
        number = kind[kept] == DIGIT
        self.kinds = np.zeros(len(kept), dtype=np.int8)
        after = np.flatnonzero(number[:-1] & ~number[1:]) + 1
        if len(after):
            self.kinds[after[np.isin(hashes[kept[after]], _unit_hashes())]] = 2
        self.kinds[number] = 1
        self.named, self.capital, self.joined = name[kept], capital[kept], ~begins[kept]
        self.hashes = hashes[kept]
        self.start, self.stop = start[kept], stop[kept]

    def __len__(self) -> int:
        return len(self.start)

    def views(self) -> list[tuple[int, View]]:
        """(bits, tokens): names by the whole text (1), by the word alone (2), and none, which serves both."""
        held: dict[bytes, tuple[int, np.ndarray]] = {}
        for bits, names in ((1, self.named), (2, self.capital), (3, np.zeros(len(self), dtype=bool))):
            names = names & (self.kinds == 0)
            held[names.tobytes()] = held.get(names.tobytes(), (0,))[0] | bits, names
        return [(bits, View(self, names)) for bits, names in held.values()]


class View:
    """A text's tokens with some of them as names; a run of names, or of numbers, is one token. ``first``: the place of each
    in the text's tokens, with the number of those as its last."""

    def __init__(self, t: Template, names: np.ndarray):
        self.t = t
        kinds = np.where(names & (t.kinds == 0), np.int8(3), t.kinds)
        run = (kinds[1:] == kinds[:-1]) & ((kinds[1:] == 1) | (kinds[1:] == 3)) & t.joined[1:]
        first = np.flatnonzero(np.concatenate([[True], ~run])[:len(kinds)])
        self.kinds, self.hashes, self.first = kinds[first], t.hashes[first], np.append(first, len(kinds))
        self.slots = np.flatnonzero(self.kinds)
        for i, k in enumerate(KINDS):
            self.hashes[self.slots[self.kinds[self.slots] == i + 1]] = HASH[k]

    def __len__(self) -> int:
        return len(self.kinds)

    def slot(self, place: int) -> tuple[str, str]:
        """Kind and value: the words of the run."""
        t, run = self.t, range(self.first[place], self.first[place + 1])
        return KINDS[self.kinds[place] - 1][1:], " ".join(t.text[t.start[j]:t.stop[j]].lower() for j in run)


def windows(t: View, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signed hashes) of the windows of ``length`` tokens that hold LEAST_WORDS literal tokens."""
    n = len(t) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.full(n, length, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            total = (total ^ t.hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    literal = np.concatenate([[0], np.cumsum(t.kinds == 0)])
    places = np.flatnonzero(literal[length:] - literal[:-length] >= LEAST_WORDS)
    return places, total[places].view(np.int64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(BLOOM_HASHES, hashes) places in the filter."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(h + np.uint64(i) * step) % np.uint64(BLOOM_BITS) for i in range(BLOOM_HASHES)]).astype(np.int64)


def passes(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes)
    return ((bloom[at >> 3] >> (at & 7)) & 1).all(axis=0)


def _windowed(parts: Iterator[pd.DataFrame], lengths: list[int] | None, bloom: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Windows of all texts: of the given lengths, or of each item's own if None; only those the filter passes."""
    names = WINDOWED_COLS
    for part in parts:
        cols: dict[str, list] = {c: [] for c in names}
        for i, row, text in zip(part["id"], part["row"], part["text"], strict=True):
            t = Template(text)
            for views, v in t.views():
                for length in lengths if lengths is not None else [min(WINDOW, len(v))]:
                    places, hashes = windows(v, length)
                    if bloom is not None and len(places):
                        ok = passes(bloom, hashes)
                        places, hashes = places[ok], hashes[ok]
                    if not len(places):
                        continue
                    first, last = np.searchsorted(v.slots, places), np.searchsorted(v.slots, places + length)
                    for p, h, a, b in zip(places.tolist(), hashes.tolist(), first.tolist(), last.tolist(), strict=True):
                        slots = ["{}:{}={}".format(s - p, *v.slot(s)) for s in v.slots[a:b].tolist()]
                        for c, x in zip(names, (i, row, views, len(t), length, h, v.first[p], v.first[p + length], slots), strict=True):
                            cols[c].append(x)
            if len(cols["id"]) >= 50_000:
                yield _frame(cols)
                cols = {c: [] for c in cols}
        if cols["id"]:
            yield _frame(cols)


def _frame(cols: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(x, dtype=object) if c in ("id", "slots") else x for c, x in cols.items()})


WINDOWED = "id string, row long, views int, n int, length int, hash long, place int, stop int, slots array<string>"
WINDOWED_COLS = [c.split()[0] for c in WINDOWED.split(", ")]


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, text): ids as text, which keeps nulls and all digits on the way through pandas; ``row`` is the text's hash."""
    return df.select(F.col(id_col).cast("long").cast("string").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return _texts(benchmark, id_col, text_col).mapInPandas(lambda parts: _windowed(parts, None, None), WINDOWED)


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """The filter of a column ``hash``: each task makes one, and they are merged in tasks, so
    the driver gets 16 of BLOOM_BITS bits at most."""

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        any_ = False
        for part in parts:
            at = _bits(part["hash"].to_numpy(dtype=np.int64)).ravel()
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
            any_ = any_ or len(at) > 0
        if any_:
            yield pd.DataFrame({"bits": [held.tobytes()]})

    out = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for row in hashes.select("hash").coalesce(16).mapInPandas(fill, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def consistent(pairs: set[tuple[str, str, str]]) -> bool:
    """Whether each value (kind, item's, document's) of the item has one of the document, and different names and units different ones."""
    strict = {p for p in pairs if p[0] != "num"}
    return len({p[:2] for p in pairs}) == len(pairs) and len({(k, y) for k, _, y in strict}) == len(strict)


def slot_pairs(item_slots: list[str], slots: list[str]) -> set[tuple[str, str, str]]:
    """Values that meet: word by word where both runs have as many or the document's begins or ends with the item's, else
    run by run."""
    out = set()
    for a, b in zip(item_slots, slots, strict=True):
        head, x = a.split("=", 1)
        y = b.split("=", 1)[1]
        kind, xs, ys = head.split(":")[1], x.split(" "), y.split(" ")
        if xs in (ys[:len(xs)], ys[-len(xs):]):  # a word before or after a name that looks like one
            ys = xs
        out |= set(zip([kind] * len(xs), xs, ys, strict=True)) if len(xs) == len(ys) else {(kind, x, y)}
    return out


def covered(spans: list[tuple[int, int]]) -> int:
    total = end = 0
    for a, b in sorted(spans):
        total, end = total + max(0, b - max(a, end)), max(end, b)
    return total


def chains(found: list[tuple[int, int, int, set]], n: int) -> tuple[int, bool, int] | None:
    """The best (covered tokens, exact, minus the offset at which it begins) of windows (offset, item place, item stop, slot
    pairs) of one text and one item of n tokens. Windows of one offset are an alignment. An alignment is continued by such
    as begin and end later in the item, are shifted by at most SHIFT tokens against the last and keep all slots consistent."""
    at: dict[int, tuple[list, set]] = {}
    for offset, place, stop, pairs in found:
        spans, held = at.setdefault(offset, ([], set()))
        spans.append((place, stop))
        held |= pairs
    parts = [(o, min(s)[0], max(x[1] for x in s), s, p) for o, (s, p) in at.items() if consistent(p)]
    parts.sort(key=lambda x: (x[0] + x[1], x[0]))
    best = None
    for i, (offset, start, stop, spans, pairs) in enumerate(parts):
        last, spans, pairs = offset, list(spans), set(pairs)
        for o, a, b, more, other in parts[i + 1:]:
            if o + a > last + n + SHIFT:
                break
            if abs(o - last) <= SHIFT and a > start and b > stop and consistent(pairs | other):
                last, start, stop, spans, pairs = o, a, b, spans + more, pairs | other
        c = covered(spans)
        if c >= min(LEAST_RUN, math.ceil(n * COVER)):
            got = (c, all(x == y for _, x, y in pairs), -offset)
            best = got if best is None or got > best else best
    return best


def _judged(g: pd.DataFrame) -> pd.DataFrame:
    """The verdict on one text and item, by each view alone."""
    n, best = int(g["n"].iloc[0]), None
    rows = [(v, p - i, i, s, slot_pairs(list(a), list(b))) for v, p, i, s, a, b in zip(
        g["views"], g["place"], g["item_place"], g["item_stop"], g["item_slots"], g["slots"], strict=True)]
    for view in (1, 2):
        got = chains([x[1:] for x in rows if x[0] & view], n)
        best = got if best is None or got is not None and got > best else best
    one = g.iloc[:1]
    out = pd.DataFrame({"id": one["id"], "row": one["row"], "item": one["item"], "n": one["n"]})
    if best is None:
        return out.iloc[:0].assign(covered=0, exact=False, back=0)
    return out.assign(covered=best[0], exact=best[1], back=best[2])


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, row, item, n, covered, exact, back) of contaminated texts and items, once for each id and text (``row`` is its hash)."""
    spark = docs.sparkSession
    items = benchmark_windows(benchmark, item_col, item_text_col)
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # WINDOW at most
    bloom = spark.sparkContext.broadcast(bloom_filter(items))  # BLOOM_BITS bits
    seen = _texts(docs, id_col, text_col).mapInPandas(lambda parts: _windowed(parts, lengths, bloom.value), WINDOWED)
    seen = seen.select("id", "row", F.col("views").alias("own"), "hash", "place", "slots").distinct()
    known = items.select(F.col("id").alias("item"), "views", "n", "hash", F.col("place").alias("item_place"),
                         F.col("stop").alias("item_stop"), F.col("slots").alias("item_slots")).distinct()
    slot = lambda s: F.substring_index(s, "=", 1)
    # a window of another length with the same hash differs in its slots or was hashed with that length
    met = seen.join(known, "hash").where(F.transform("slots", slot) == F.transform("item_slots", slot))
    both = F.col("own").bitwiseAND(F.col("views"))
    met = met.select("id", "row", "item", "n", F.when(both != 0, both).otherwise(3).alias("views"),
                     "place", "item_place", "item_stop", "item_slots", "slots")
    return met.groupBy("id", "row", "item", "n").applyInPandas(
        _judged, "id string, row long, item string, n int, covered int, exact boolean, back int")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each contaminated document and item: the ids, item_tokens, covered, coverage, exact
    (all slots hold the item's own values) and at (the token at which the alignment begins)."""
    best = judge(docs, benchmark, id_col, text_col, item_col, item_text_col).groupBy("id", "item").agg(
        F.max(F.struct("covered", "exact", "back", "n")).alias("best"))
    return best.select(
        F.col("id").cast("long").alias(id_col), F.col("item").cast("long").alias(item_col), F.col("best.n").alias("item_tokens"),
        F.col("best.covered").alias("covered"), (F.col("best.covered") / F.col("best.n")).alias("coverage"),
        F.col("best.exact").alias("exact"), (-F.col("best.back")).alias("at"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, all columns kept."""
    bad, row = fresh(docs, "contaminated_id"), fresh(docs, "contaminated_row")
    found = judge(docs, benchmark, id_col, text_col).select(F.col("id").cast("long").alias(bad), F.col("row").alias(row)).distinct()
    return docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(bad)) & (F.xxhash64(text_col) == F.col(row)), "left_anti")
