"""Source divergence audit: how far the term shares of each source of a language lie from those of the others.

Terms are the runs of ASCII letters and non-ASCII characters of a text, A-Z
lower-cased. A language keeps its ``V`` terms that occur in at least
``LEAST_DOCUMENTS`` of its documents. A group (language, source) with ``N`` kept
occurrences gives a term with ``c`` of them ``p = 1 + floor(UNIT * (c + 1) / (N + V))``;
so does the language as a whole. ``f = floor((p - q)^2 / q)``.

* Part ``pair``: for every ordered pair of groups of a language, ``f`` summed over
  all kept terms, ``q`` the other group's.
* Part ``term``: for every group, its terms with ``c > 0`` and ``p`` over the
  language's ``q``, by ``f``, the first ``TERM_RANKS``.

Counting. Tasks count words of their documents by group and give partial counts;
one shuffle by (language, term) adds them up and drops the terms that too few
documents hold. Counts are stored once.

Pricing by a K-squared quadtree. The matrix of groups (rows) by kept terms
(columns) of a language is mostly zero. Its columns are cut into blocks, dealt to
tasks by a hash of the term; a block's columns are ordered by the rows that they
occupy, so that zeros come together, and laid out as square tiles as wide as
there are rows. Every tile is a quadtree with two splits a side: a node is set
if its quadrant holds a count. Pairs of groups walk it jointly: a state is two
row intervals and a column interval. Where both quadrants are zero, every pair of
the two intervals has the same price in every column (that of ``c = 0``), and
only the number of columns is noted; where one is set, the state splits in eight;
at single cells the two counts are priced. The noted columns are priced once for
each pair of groups, at the end of a block. A state's children are walked in
pieces of bounded size.

All arithmetic is in integers; sums over blocks are added as decimals.

Defined results: null text, lang and source count as ''; a group occurs if a
document has it, even without terms; with ``V = 0`` pairs have value 0 and there
are no terms; a language with one source has no pairs; repeated rows count
repeatedly, each as a document; an empty table gives an empty result; a very
long text is read whole; columns other than text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_DOCUMENTS, UNIT, TERM_RANKS = 3, 1_000_000_000, 200
#: Columns of a block, partial counts that a task holds at once, states walked at once.
BLOCK_TERMS, COUNTS_AT_ONCE, STATES_AT_ONCE = 8192, 1 << 19, 1 << 18

#: Bytes that end a term become blanks, A-Z become a-z; bytes of non-ASCII characters stay.
_TERM_BYTES = bytes(b if b > 0x7F or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """Partial counts: lang, source, term, n (occurrences), docs (documents that hold it)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, size = defaultdict(Counter), defaultdict(Counter), 0

        def rows():
            for (lang, source), counts in n.items():
                if not counts:
                    continue
                d, size = held[lang, source], len(counts)
                yield pd.DataFrame({"lang": [lang] * size, "source": [source] * size,
                                    "term": [t.decode("utf-8", "replace") for t in counts],
                                    "n": np.fromiter(counts.values(), np.int64, size),
                                    "docs": np.fromiter((d[t] for t in counts), np.int64, size)})

        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"]):
                key = (lang, source)
                found = terms(text)
                before = len(n[key])
                n[key].update(found)
                held[key].update(set(found))
                size += len(n[key]) - before
                if size >= COUNTS_AT_ONCE:
                    yield from rows()
                    n.clear()
                    held.clear()
                    size = 0
        yield from rows()

    return docs.mapInPandas(count, "lang string, source string, term string, n long, docs long")


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """p of the counts."""
    if np.max(count, initial=0) >= 1 << 33:  # the product may not fit in 64 bits
        return np.asarray(1 + UNIT * (count.astype(object) + 1) // (total + kept)).astype(np.int64)
    return 1 + UNIT * (count + 1) // (total + kept)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _noted(level: int, size: int, notes: np.ndarray) -> np.ndarray:
    """Columns noted for pairs of row intervals at a level, for every pair of rows."""
    width = size >> level
    return notes.reshape(1 << level, 1 << level).repeat(width, 0).repeat(width, 1)


def tree_sums(row: np.ndarray, col: np.ndarray, n: np.ndarray, rows: int, cols: int, totals: np.ndarray,
              kept: int) -> np.ndarray:
    """For every ordered pair of rows the prices summed over the columns of a block with the given nonzero counts."""
    depth = max(1, int(rows - 1).bit_length())
    size = 1 << depth
    tiles = -(-cols // size)
    tile, inside = col // size, col % size

    def code(level: int, t, r, c):
        return (t << (2 * level)) | (r << level) | c

    cells = code(depth, tile, row, inside)
    order = np.argsort(cells)
    cells, counts = cells[order], n[order]
    nodes = [np.unique(code(lv, tile, row >> (depth - lv), inside >> (depth - lv))) for lv in range(depth)] + [cells]

    def is_set(level: int, found: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(nodes[level], found), len(nodes[level]) - 1)
        return nodes[level][at] == found

    zero = share(np.zeros(rows, np.int64), totals, kept)
    sums = np.zeros((rows, rows), np.int64)
    notes = [np.zeros(1 << (2 * lv), np.int64) for lv in range(depth + 1)]
    t = np.arange(tiles)
    todo = [(0, t, np.zeros_like(t), np.zeros_like(t), np.zeros_like(t))]
    while todo:
        level, t, a, b, c = todo.pop()
        if len(t) > STATES_AT_ONCE:
            half = len(t) // 2
            todo += [(level, *(x[:half] for x in (t, a, b, c))), (level, *(x[half:] for x in (t, a, b, c)))]
            continue
        ca, cb = code(level, t, a, c), code(level, t, b, c)
        on_a, on_b = is_set(level, ca), is_set(level, cb)
        none = ~(on_a | on_b)
        if none.any():
            width = size >> level
            first = t[none] * size + c[none] * width
            real = np.clip(cols - first, 0, width)  # the last tile may be wider than the block
            notes[level] += np.bincount((a[none] << level) | b[none], real, 1 << (2 * level)).astype(np.int64)
        t, a, b, c = (x[~none] for x in (t, a, b, c))
        if level < depth:
            t, a, b, c = (np.concatenate(x) for x in zip(*(
                (t, 2 * a + i, 2 * b + j, 2 * c + k) for i in (0, 1) for j in (0, 1) for k in (0, 1))))
            width = size >> (level + 1)  # unordered pairs of intervals that hold rows
            m = (a <= b) & (b * width < rows)
            todo.append((level + 1, *(x[m] for x in (t, a, b, c))))
        elif len(t):
            m = a < b
            t, a, b, c = t[m], a[m], b[m], c[m]
            ca, cb = code(depth, t, a, c), code(depth, t, b, c)
            p, q = (share(np.where(on, counts[np.minimum(np.searchsorted(cells, x), len(cells) - 1)], 0), totals[r], kept)
                    for on, x, r in ((is_set(depth, ca), ca, a), (is_set(depth, cb), cb, b)))
            np.add.at(sums.reshape(-1), a * rows + b, price(p, q))
            np.add.at(sums.reshape(-1), b * rows + a, price(q, p))
    alike = sum(_noted(lv, size, notes[lv])[:rows, :rows] for lv in range(depth + 1))
    alike = np.triu(alike, 1)
    return sums + (alike + alike.T) * price(zero[:, None], zero[None, :])


def price_block(counts: pd.DataFrame, sources: list[str], totals: np.ndarray, total: int, kept: int, columns: int):
    """(pair sums, term rows) of the columns of a block; ``columns`` is how many there are."""
    place = {s: i for i, s in enumerate(sources)}
    row = counts["source"].map(place).to_numpy(np.int64)
    col, names = pd.factorize(counts["term"])
    n = counts["n"].to_numpy(np.int64)
    # columns in the order of their first, last and number of rows: zeros come together
    first, last = np.full(len(names), len(sources)), np.full(len(names), -1)
    np.minimum.at(first, col, row)
    np.maximum.at(last, col, row)
    place = np.empty(len(names), np.int64)
    place[np.lexsort((np.bincount(col, minlength=len(names)), last, first))] = np.arange(len(names))
    sums = tree_sums(row, place[col], n, len(sources), columns, totals, kept)

    of_lang = np.bincount(col, n, len(names)).astype(np.int64)
    q = share(of_lang, np.int64(total), kept)[col]
    p = share(n, totals[row], kept)
    found = pd.DataFrame({"row": row, "item": counts["term"].to_numpy(), "value": price(p, q)})[p > q]
    found = found.assign(key=[t.encode("utf-8", "surrogatepass") for t in found["item"]]).sort_values(
        ["row", "value", "key"], ascending=[True, False, True]).groupby("row").head(TERM_RANKS)
    return sums, found


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value, rank."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = docs.select("lang", "source").distinct()
    of_term = Window.partitionBy("lang", "term")
    counts = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = stored(counts.withColumn("held", F.sum("docs").over(of_term)).where(F.col("held") >= least).withColumn(
        "new", (F.row_number().over(of_term.orderBy("source")) == 1).cast("int")).drop("docs", "held"), "divergence-counts")

    # one row a language: its sources in order with their totals, and how many terms it keeps
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
    langs = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(
        "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("sources"))
    kept = counts.groupBy("lang").agg(F.sum("new").alias("kept"), F.sum("n").alias("total"))
    langs = langs.join(kept, "lang", "left").fillna(0, ["kept", "total"]).withColumn(
        "blocks", F.greatest(F.ceil(F.col("kept") / BLOCK_TERMS), F.lit(1)).cast("int"))
    blocked = counts.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    heads = langs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))

    def walk(key, cells: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        lang, _ = key
        head = head.iloc[0]
        sources = [s["source"] for s in head["sources"]]
        out = {c: [] for c in ("source", "part", "item", "value")}

        def add(part, source, item, value):
            for c, x in zip(out, (source, [part] * len(value), item, value)):
                out[c].append(np.asarray(x, object))

        if len(cells):
            n = np.array([s["n"] for s in head["sources"]], np.int64)
            sums, found = price_block(cells, sources, n, int(head["total"]), int(head["kept"]), int(cells["new"].sum()))
            add("term", [sources[r] for r in found["row"]], found["item"], found["value"])
        else:
            sums = np.zeros((len(sources), len(sources)), np.int64)
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        names = np.array(sources, object)
        add("pair", names[a], names[b], sums[a, b])
        out = {c: np.concatenate(x) for c, x in out.items()}
        return pd.DataFrame({"lang": np.full(len(out["value"]), lang, object)} | out, dtype=object)

    priced = stored(blocked.select("lang", "block", "source", "term", "n", "new").groupBy("lang", "block").cogroup(
        heads.groupBy("lang", "block")).applyInPandas(walk, "lang string, source string, part string, item string, value long"),
        "divergence-priced")
    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")).withColumn("rank", F.row_number().over(ranks))
    tops = priced.where("part = 'term'").withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= TERM_RANKS)
    return pairs.unionByName(tops).select("lang", "source", "part", "item", "value", "rank")
