"""How far the sources of a language diverge from one another, by the terms they use.

Each text is tokenised without a regular expression: one ``bytes.translate`` lowers A-Z and
turns every separator into a blank, one ``bytes.split`` cuts the terms, and a ``Counter`` of
the document gives its frequencies. A task adds the counters up per (language, source), so
what is shuffled is one row per group, term and task, however long or common a text is.

A language keeps the terms that at least ``MIN_DOCS`` of its documents hold. Every group and
every language then gives each kept term a smoothed share in billionths, in exact integers.
Only occurring (group, term) pairs are ever stored: for the others the share of count zero
is one number a group, and the sums over them need only how many they are.

NULL text, language and source read as empty. A row is a document, also if its ``doc_id``
occurs again; columns other than ``text, lang, source`` are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidings.llm.common import text_bytes, whole_text
from tidings.session import stage

#: Documents of a language that a term must occur in.
MIN_DOCS = 30
#: Added to every count; shares are in units of one to ``SCALE``.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Ranks of the ``term`` part.
TOP = 50
#: Bytes of a text that are split at a time (a longer term is not cut).
PIECE = 1 << 20
#: Group terms that a task holds before it hands them on.
HELD = 400_000
#: Sources of a language that one task compares with as many others, and parts that the
#: terms of a language are dealt to.
BLOCK, PARTS = 128, 16

_SEPARATORS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_UPPER = bytes(range(0x41, 0x5B))
TABLE = bytes.maketrans(_SEPARATORS + _UPPER, b" " * len(_SEPARATORS) + _UPPER.lower())


def count_terms(text: bytes) -> Counter:
    """Frequencies of the terms of one text."""
    clean = text.translate(TABLE)
    if len(clean) <= PIECE:
        return Counter(clean.split())
    found: Counter = Counter()
    first = 0
    while first < len(clean):
        last = clean.find(b" ", first + PIECE)
        last = len(clean) if last < 0 else last
        found.update(clean[first:last].split())
        first = last
    return found


_PARTIAL = pa.schema(
    [("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()),
     ("n", pa.int64()), ("docs", pa.int64())]
)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the document counters of a task, in rounds of at most ``HELD`` terms or so."""
    counts: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for first in range(0, len(terms), 50_000):
                part = terms[first : first + 50_000]
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array(part, pa.binary()),
                    pa.array([n[t] for t in part], pa.int64()),
                    pa.array([docs[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_PARTIAL)
        counts.clear()

    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for at, group in enumerate(groups):
            found = count_terms(data[offsets[at] : offsets[at + 1]].tobytes())
            if not found:
                continue
            n, docs = counts.setdefault(group, (Counter(), Counter()))
            held -= len(n)
            n.update(found)
            docs.update(found.keys())
            held += len(n)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of a term in a group."""
    texts = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        whole_text("text").alias("text"),
    )
    partial = texts.mapInArrow(
        _partial, "lang string, source string, term binary, n long, docs long"
    )
    # counted by task already: one shuffle by term serves the sums and what follows by term
    return (
        partial.withColumn("term", F.col("term").cast("string"))
        .repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang, term, source, n, lang_n`` of terms in enough documents of the language."""
    whole = W.partitionBy("lang", "term")
    return (
        counts.withColumn("lang_docs", F.sum("docs").over(whole))
        .withColumn("lang_n", F.sum("n").over(whole))
        .where(F.col("lang_docs") >= min_docs)
        .select("lang", "term", "source", "n", "lang_n")
    )


def share(count: str, total: str, terms: str) -> Column:
    """Smoothed share in units of one to ``SCALE``, rounded down, at least 1.

    In decimals of 38 digits, so exact for any count of 64 bits.
    """
    return F.expr(
        f"1 + ({SCALE} * cast({count} + {SMOOTHING} as decimal(20, 0)))"
        f" div cast({total} + {SMOOTHING} * {terms} as decimal(20, 0))"
    )


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per occurring group: ``total``, the language's ``lang_total`` and ``terms`` (kept),
    ``zero`` (the share of count zero) and ``place`` (from 0 among the language's sources).
    """
    groups = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")
    ).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = (
        kept.groupBy("lang", "term")
        .agg(F.first("lang_n").alias("lang_n"))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    )
    filled = (
        groups.join(totals, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .na.fill(0, ["total", "terms", "lang_total"])
    )
    order = W.partitionBy("lang").orderBy("source")
    return filled.select(
        "*",
        F.when(F.col("terms") > 0, share("0", "total", "terms")).otherwise(F.lit(0)).alias("zero"),
        (F.row_number().over(order) - 1).alias("place"),
    )


# -- the two parts of the report -------------------------------------------------------


def distinctive_terms(shares: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: terms a group uses more than its language does.

    The cut by rank is applied per task before anything is shuffled.
    """
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        shares.withColumn("q", share("lang_n", "lang_total", "terms"))
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
    )


def _cells() -> Column:
    """The cells (pairs of blocks, low before high) that a block takes part in."""
    return F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("block", j).alias("low"), F.greatest("block", j).alias("high")),
    )


def source_distances(shares: DataFrame, groups: DataFrame, size: int = BLOCK) -> DataFrame:
    """``lang, a, b, value`` (``a < b`` are places): sums of absolute differences of shares.

    Terms of a language are dealt to ``PARTS`` parts and its sources to blocks of ``size``. A task takes
    one part and two blocks: of a term that some of these sources use it has a row each, and
    adds all differences at once; terms that none uses differ by the shares of count zero.
    """
    whole = W.partitionBy("lang")
    located = groups.select(
        "lang", "source", "place", "zero", "terms",
        F.floor(F.col("place") / size).cast("int").alias("block"),
        F.ceil(F.count(F.lit(1)).over(whole) / size).cast("int").alias("blocks"),
    )
    # the shares of count zero go before the terms of every cell
    first = located.withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    ).select(
        "lang", "part", F.explode(_cells()).alias("cell"), F.lit(None).cast("string").alias("term"),
        "place", F.col("zero").alias("p"),
    )
    rest = (
        shares.join(located.select("lang", "source", "place", "block", "blocks"), ["lang", "source"])
        .withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
        .select("lang", "part", F.explode(_cells()).alias("cell"), "term", "place", "p")
    )
    rows = (
        first.unionByName(rest)
        .select("lang", "part", F.col("cell.low").alias("low"), F.col("cell.high").alias("high"),
                "term", "place", "p")
        .repartition("lang", "part", "low", "high")
        .sortWithinPartitions("lang", "part", "low", "high", F.asc_nulls_first("term"))
    )
    sums = (
        rows.mapInArrow(_comparing(size), "lang string, a int, b int, value long, seen long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    )
    zeros = groups.select("lang", "place", "zero", "terms")
    a = zeros.select("lang", F.col("place").alias("a"), F.col("zero").alias("za"), "terms")
    b = zeros.select("lang", F.col("place").alias("b"), F.col("zero").alias("zb"))
    unused = (F.col("terms") - F.col("seen")) * F.abs(F.col("za") - F.col("zb"))
    return (
        sums.join(a, ["lang", "a"])
        .join(b, ["lang", "b"])
        .select("lang", "a", "b", (F.col("value") + unused).alias("value"))
    )


class _Cell:
    """Two blocks of sources of a language and one part of its terms."""

    def __init__(self, lang: str, low: int, high: int, size: int) -> None:
        self.lang, self.low, self.high, self.size = lang, low, high, size
        self.zero = np.zeros(2 * size, np.int64)
        self.known = np.zeros(2 * size, bool)
        self.sums = np.zeros((size, size), np.int64)
        self.seen = 0

    def spot(self, place: np.ndarray) -> np.ndarray:
        """Below ``size`` in the low block, from there on in the high one."""
        return place % self.size + (place // self.size != self.low) * self.size

    def sources(self, place: np.ndarray, zero: np.ndarray) -> None:
        spot = self.spot(place)
        self.zero[spot], self.known[spot] = zero, True

    def terms(self, term: np.ndarray, place: np.ndarray, p: np.ndarray) -> None:
        """Rows of whole terms; ``term`` numbers them in order."""
        spot = self.spot(place)
        step = 64
        for first in range(0, int(term[-1]) + 1, step):
            lo, hi = np.searchsorted(term, [first, first + step])
            count = int(min(step, term[-1] + 1 - first))
            shares = np.repeat(self.zero[None], count, axis=0)
            shares[term[lo:hi] - first, spot[lo:hi]] = p[lo:hi]
            left = shares[:, : self.size]
            right = left if self.low == self.high else shares[:, self.size :]
            used_left = int(np.flatnonzero(self.known[: self.size])[-1]) + 1
            for at in range(used_left):
                self.sums[at] += np.abs(right - left[:, at : at + 1]).sum(axis=0)
            self.seen += count

    def result(self) -> pa.RecordBatch:
        half = slice(0, self.size) if self.low == self.high else slice(self.size, None)
        a, b = np.nonzero(np.outer(self.known[: self.size], self.known[half]))
        if self.low == self.high:
            a, b = a[a < b], b[a < b]
        columns = [
            pa.array([self.lang] * len(a), pa.string()),
            pa.array(a + self.low * self.size, pa.int32()),
            pa.array(b + self.high * self.size, pa.int32()),
            pa.array(self.sums[a, b], pa.int64()),
            pa.array(np.full(len(a), self.seen), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value", "seen"])


def _comparing(size: int) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells of a sorted partition. The rows of a term are held till its last has come: at
        most one a source of the two blocks."""
        cell, name, held = None, None, None

        def add(rows: list) -> None:
            terms = np.array([r[4] for r in rows], object)
            place, p = (np.array([r[k] for r in rows], np.int64) for k in (5, 6))
            number = np.concatenate(([0], np.cumsum(terms[1:] != terms[:-1])))
            cell.terms(number, place, p)

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            first = 0
            while first < len(rows):
                key = rows[first][:4]
                last = first
                while last < len(rows) and rows[last][:4] == key:
                    last += 1
                part = rows[first:last]
                first = last
                if key != name:
                    if cell is not None:
                        if held:
                            add(held)
                        yield cell.result()
                    cell, name, held = _Cell(key[0], key[2], key[3], size), key, []
                sources = [r for r in part if r[4] is None]
                if sources:
                    cell.sources(*(np.array([r[k] for r in sources], np.int64) for k in (5, 6)))
                held = held + part[len(sources) :]
                cut = len(held)  # the last term may go on in the next batch
                while cut and held[cut - 1][4] == held[-1][4]:
                    cut -= 1
                if cut:
                    add(held[:cut])
                    held = held[cut:]
        if cell is not None:
            if held:
                add(held)
            yield cell.result()

    return compare


def divergence_audit(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: every other source of the language, by the sum of differences of their
    shares, all ranks. Part ``term``: the ``top`` terms a group uses more than its language.
    Ranks go by value from the largest, then by item. The pairs of sources are the result
    asked for; no document is ever paired.
    """
    kept = stage(kept_terms(term_counts(docs), min_docs), "terms")
    groups = stage(group_sizes(docs, kept), "groups")
    shares = kept.join(
        groups.select("lang", "source", "total", "lang_total", "terms"), ["lang", "source"]
    ).withColumn("p", share("n", "total", "terms"))
    distances = source_distances(shares.select("lang", "source", "term", "p"), groups, block)
    both = distances.select("lang", "a", "b", "value").union(
        distances.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    )
    own = groups.select("lang", F.col("place").alias("a"), "source")
    other = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("item"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = (
        both.join(own, ["lang", "a"])
        .join(other, ["lang", "b"])
        .select("lang", "source", "item", "value")
        .withColumn("rank", F.row_number().over(order))
    )
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        pairs.withColumn("part", F.lit("pair"))
        .select(*columns)
        .union(distinctive_terms(shares, top).withColumn("part", F.lit("term")).select(*columns))
    )


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source, coalesce(text, '') AS text
    FROM documents
), tokens AS (
    SELECT doc, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), kept AS (
    SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), vocabulary AS (
    SELECT lang, count(*) AS v FROM kept GROUP BY lang
), occurring AS (
    SELECT DISTINCT lang, source FROM docs
), used AS (
    SELECT lang, source, term, count(*) AS n
    FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS (
    SELECT o.lang, o.source, k.term, coalesce(u.n, 0) AS n
    FROM occurring o JOIN kept k USING (lang) LEFT JOIN used u USING (lang, source, term)
), totals AS (
    SELECT *, sum(n) OVER (PARTITION BY lang, source) AS group_total,
        sum(n) OVER (PARTITION BY lang, term) AS lang_n,
        sum(n) OVER (PARTITION BY lang) AS lang_total
    FROM cells
), shares AS (
    SELECT lang, source, term, n,
        (1 + (1000000000::HUGEINT * (n + 5)) // (group_total + 5 * v))::BIGINT AS p,
        (1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v))::BIGINT AS q
    FROM totals JOIN vocabulary USING (lang)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
    FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
        SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value
        FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
        GROUP BY ALL
    ) d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
), terms AS (
    SELECT lang, source, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value FROM terms
)
SELECT lang, source, part, item, value::BIGINT AS value,
    (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked
QUALIFY part = 'pair' OR rank <= 50
"""
