"""Source divergence audit: how far the vocabularies of the sources of a language lie apart, in exact integers.

1. Tasks fold the terms of the texts they read into counts by language, source
   and term, and into numbers of documents, before anything is shuffled.
2. Terms in enough documents of a language are kept.  They are dealt to chunks
   of about ``CHUNK_TERMS`` by hash and numbered inside their chunk.
3. A group (language, source) has one packed row per chunk: the numbers of its
   terms there and their counts.  Groups of a language are dealt to blocks of
   about ``BLOCK_GROUPS``; each block is replicated to one task for every other
   block, and for every slab of ``SLAB_CHUNKS`` chunks.
4. A task reads its rows sorted by chunk, so it holds one chunk of two blocks at
   a time and adds to the submatrix of its pairs.  Submatrices of slabs are
   added in Spark.

Neither a vocabulary nor all groups of a language are ever in one task: a task
holds ``2 * BLOCK_GROUPS`` rows of ``CHUNK_TERMS`` numbers, about, whatever the
size of the corpus.  A frequent word or a large source is counted before it
moves and is then as long as any other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkstrata.llm.common import materialise, text_of

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Terms of a chunk, groups of a block, chunks of a slab: all but the last on average, as they are dealt by hash.
CHUNK_TERMS = 2048
BLOCK_GROUPS = 8
SLAB_CHUNKS = 16
#: Distinct (language, source, term) that a task folds before it hands them on.
FOLD_TERMS = 500_000
WORD = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``: long division by thousands, exact to totals of 9 * 10^15."""
    below, rest, out = (totals + 2 * terms)[:, None], counts + 2, 0
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _share_sql(count: str, total: str, terms: str) -> str:
    """The same in Spark's whole numbers."""
    below = f"({total} + 2 * {terms})"
    first = f"({count} + 2) * 1000"
    second = f"({first} % {below}) * 1000"
    third = f"({second} % {below}) * 1000"
    return f"(1 + ({first}) div {below} * 1000000 + ({second}) div {below} * 1000 + ({third}) div {below})"


def term_counts(docs: DataFrame, fold_terms: int = FOLD_TERMS) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): partial counts of each task, one row per key and fold."""
    schema = "lang string, source string, term string, n long, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter[str]] = {}
        holders: dict[tuple[str, str], Counter[str]] = {}
        held = 0

        def folded() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in counts.items():
                in_docs, terms = holders[lang, source], list(own)
                for at in range(0, len(terms), 50_000):
                    some = terms[at : at + 50_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(some), pa.string()), "source": pa.array([source] * len(some), pa.string()), "term": pa.array(some, pa.string()),
                        "n": pa.array([own[t] for t in some], pa.int64()), "d": pa.array([in_docs[t] for t in some], pa.int64()),
                    })

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                terms = _WORD.findall(text.translate(_LOWER))
                own = counts.setdefault((lang, source), Counter())
                before = len(own)
                own.update(terms)
                holders.setdefault((lang, source), Counter()).update(set(terms))
                held += len(own) - before + 1
                if held > fold_terms:
                    yield from folded()
                    counts, holders, held = {}, {}, 0
        yield from folded()

    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), text_of().alias("text"))
    return filled.mapInArrow(run, schema)


def dealt(column: str, parts: str, seed: int) -> str:
    """Which of ``parts`` parts a value falls to, by hash."""
    return f"CAST(pmod(xxhash64({column}, {seed}), {parts}) AS int)"


class Audit:
    """The tables of an audit: groups, kept terms and their counts."""

    def __init__(self, docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> None:
        filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")))
        counts = materialise(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "terms")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("d").alias("d")).where(F.col("d") >= least_documents).drop("d")
        kept = materialise(kept, "kept")
        #: lang, terms (V), lang_total: one row a language with kept terms
        self.langs = materialise(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total")), "langs")
        # numbers inside a chunk; a chunk is bounded, so is each window
        chunked = kept.join(self.langs.select("lang", "terms"), "lang").withColumn("chunk", F.expr(dealt("term", f"greatest(1, terms div {CHUNK_TERMS})", 11))).drop("terms")
        numbered = chunked.withColumn("number", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
        #: lang, source, term, n, lang_n, chunk, number: occurring kept terms of each group
        self.counts = materialise(counts.drop("d").join(numbered, ["lang", "term"]), "counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = filled.distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"])
        sizes = groups.groupBy("lang").agg(F.count("*").alias("groups"))
        groups = groups.join(sizes, "lang").join(self.langs, "lang", "left").fillna(0, ["terms", "lang_total"])
        #: lang, source, total (N), groups, terms, lang_total, blocks, block: every occurring group
        self.groups = materialise(groups.withColumn("blocks", F.expr(f"CAST((groups + {BLOCK_GROUPS} - 1) div {BLOCK_GROUPS} AS int)")).withColumn("block", F.expr(dealt("source", "blocks", 13))), "groups")

    def packed(self) -> DataFrame:
        """lang, source, block, blocks, total, terms, chunk, width, numbers, counts: one row per group and chunk, also where the group has no term."""
        widths = self.counts.groupBy("lang", "chunk").agg((F.max("number") + 1).alias("width"))
        own = self.counts.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("number", "n")).alias("cells"))
        # a group's row for each chunk of its language: as many rows as the dense vectors have chunks
        wanted = self.groups.select("lang", "source", "block", "blocks", "total", "terms").join(widths, "lang")
        return wanted.join(own, ["lang", "source", "chunk"], "left").select("lang", "source", "block", "blocks", "total", "terms", "chunk", "width", F.expr("transform(cells, x -> CAST(x.number AS int))").alias("numbers"), F.expr("transform(cells, x -> x.n)").alias("counts"))

    def pair_sums(self) -> DataFrame:
        """lang, source, other, value of all ordered pairs of different sources with kept terms, by tiles of blocks."""
        tiles = self.packed().withColumn("side", F.expr("explode(sequence(0, blocks - 1))")).withColumns({"low": F.expr("least(block, side)"), "high": F.expr("greatest(block, side)"), "slab": F.expr(f"chunk div {SLAB_CHUNKS}")}).drop("side", "blocks")
        dealt_out = tiles.repartition("lang", "low", "high", "slab").sortWithinPartitions("lang", "low", "high", "slab", "chunk", "source")
        parts = dealt_out.mapInArrow(submatrices, "lang string, source string, other string, value long")
        return parts.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """Part ``pair``: every other source of the language with its value; 0 where the language keeps no term."""
        found = self.pair_sums()
        # a language without kept terms has the pairs of its sources all the same: an equi-join on the language, as large as the result
        bare = self.groups.where("terms = 0").select("lang", "source")
        none = bare.join(bare.select("lang", F.col("source").alias("other")), "lang").where("source <> other").withColumn("value", F.lit(0).cast("long"))
        every = found.unionByName(none)
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("other")))
        return every.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", rank.alias("rank"))

    def terms(self, top: int = TOP_TERMS) -> DataFrame:
        """Part ``term``: the kept terms that a group uses more than its language, those of the first ranks."""
        rows = self.counts.join(self.groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
        rows = rows.withColumns({"p": F.expr(_share_sql("n", "total", "terms")), "q": F.expr(_share_sql("lang_n", "lang_total", "terms"))}).where("p > q")
        rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
        return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def submatrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over successive chunks of the pairs of two blocks.

    Rows come sorted by tile and chunk; a tile's rows of one chunk are held at a
    time, and its sums by pair.
    """
    key: tuple | None = None
    chunk: int | None = None
    rows: list[dict] = []
    value: dict[tuple[str, str], int] = {}

    def add() -> None:
        """One chunk of a tile: each group of its lower block against those of its higher block."""
        if not rows:
            return
        counts = np.zeros((len(rows), rows[0]["width"]), np.int64)
        for i, r in enumerate(rows):
            if r["numbers"]:
                counts[i, r["numbers"]] = r["counts"]
        p = shares(counts, np.array([r["total"] for r in rows], np.int64), rows[0]["terms"])
        low, high = key[1], key[2]
        for i, a in enumerate(rows):
            if a["block"] == low:
                others = [j for j, b in enumerate(rows) if b["block"] == high and (low != high or j > i)]
                for j, v in zip(others, apart(p[i][None, :], p[others]).sum(1).tolist(), strict=True):
                    pair = (a["source"], rows[j]["source"])
                    value[pair] = value.get(pair, 0) + v

    def done() -> pa.RecordBatch:
        a, b = [x for x, _ in value], [y for _, y in value]
        lang = [key[0]] * (2 * len(value)) if key else []
        return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "source": pa.array(a + b, pa.string()), "other": pa.array(b + a, pa.string()), "value": pa.array([*value.values()] * 2, pa.int64())})

    for batch in batches:
        for r in batch.to_pylist():
            mine = (r["lang"], r["low"], r["high"], r["slab"])
            if mine != key or r["chunk"] != chunk:
                add()
                rows = []
                if mine != key:
                    yield done()
                    value = {}
                key, chunk = mine, r["chunk"]
            rows.append(r)
    add()
    yield done()


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank (see the module's text).

    Null text, lang and source are empty texts; a group of empty texts alone is a
    group all the same, a language that keeps no term has pairs of value 0, and
    an empty table gives no row.  Every row counts as a document, repeated ones
    too.  Ties go by the item's bytes.  Very long texts are read whole.  Other
    columns are not read.
    """
    audit = Audit(docs, least_documents)
    return audit.pairs().unionByName(audit.terms(top))


def oracle_sql(least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> str:
    """The same rows from dense vectors of every group."""
    p = "1 + ({n} + 2)::HUGEINT * " + str(SCALE) + " // ({total} + 2 * terms)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS t FROM documents),
said AS (SELECT id, lang, source, unnest(t) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM said GROUP BY lang, term HAVING count(DISTINCT id) >= {least_documents}),
langs AS (SELECT lang, count(*) AS terms, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM said SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counted GROUP BY lang, source),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format(n='coalesce(c.n, 0)', total='coalesce(t.total, 0)')} AS p, {p.format(n='k.n', total='l.total')} AS q
    FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= {top}"""
