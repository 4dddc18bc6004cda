"""How far the sources of a language are apart in their terms: a frequent-pattern tree of term rows adds up pairs of sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, remove

#: A term is kept in a language where so many of its documents have it; parts of a probability; added to each count.
LEAST, SCALE, ADDED, TOP = 30, 1_000_000_000, 5, 50
#: Terms, and pairs of sources, that a task adds up before it hands them on.
HELD, PAIRS = 1 << 19, 1 << 20
#: Bytes that are part of no term become a space, A-Z become a-z.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and rows that have the term; added up within tasks, so a group may come several times.

    The term '' stands for the group itself, so that groups without terms are known.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                fixed = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*fixed, terms, pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, df = held.setdefault((lang, source), (Counter({b"": 0}), Counter()))
                own = Counter(text.encode().translate(TERM_BYTES).split())
                size += len(own)
                n.update(own)
                df.update(own.keys())
                if size >= HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    return docs.select(*text).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each kept term of a language: lang, term, n, per (an array of source and n); and one for the term '' of each language."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per"))
    return rows.filter((F.col("docs") >= least) | (F.col("term") == "")).drop("docs")


def probability(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / total), exact for counts of any size."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")
    return F.call_function("div", top, total.cast("decimal(20,0)")).cast("long") + 1


def groups_of(kept: DataFrame) -> DataFrame:
    """lang, source, at, kept, total, all: each group's number in its language (sources by code point), kept terms, N + ADDED * V, and the language's."""
    langs = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"), F.sum("n").alias("words"))
    per = kept.select("lang", F.explode("per").alias("per")).groupBy("lang", "per.source").agg(F.sum("per.n").alias("n"))
    at = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at")
    more = ADDED * F.col("kept")
    return per.join(langs, "lang").select("lang", "source", at, "kept", (F.col("n") + more).alias("total"), (F.col("words") + more).alias("all"))


def tree_corrections(paths: DataFrame) -> DataFrame:
    """lang, a, b, value: for sources a < b (numbers), the sum over terms that both have of |p - q| - |p - y| - |x - q| + |x - y|.

    paths has lang, path (an array of at, p, x: a source's number, its p for the term and for a term that it lacks; by number) and terms, the
    number of terms with that path. In the frequent-pattern tree of the paths a node is a first part of paths, and its multiplicity
    the terms that run through it, so that what two sources have in common is added once for each node and ancestor. Paths come
    in order, so only the branch of the last one is held: a node is complete when a path leaves it. Ranges of paths go to
    different tasks, each with a tree of its own, and pairs are added up within tasks.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branch: list[tuple[int, int, int]] = []
        terms: list[int] = []
        lang, found, size = None, [], 0

        def leave(depth: int) -> None:
            """Take the nodes below a depth off the branch; the terms of each also run through all nodes above it."""
            nonlocal size
            if len(branch) > depth:
                at, p, x = np.array(branch, dtype=np.int64).T
                runs = np.cumsum(terms[:depth:-1] + [terms[depth]])[::-1]
                if depth:
                    terms[depth - 1] += int(runs[0])
                above, node = np.nonzero(np.arange(len(at))[:, None] < np.arange(depth, len(at))[None, :])
                q, y = p[depth:][node], x[depth:][node]
                both = np.abs(p[above] - q) - np.abs(p[above] - y) - np.abs(x[above] - q) + np.abs(x[above] - y)
                found.append((at[above] << 32 | at[depth:][node], runs[node] * both))
                size += len(node)
                del branch[depth:], terms[depth:]

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal found, size
            if found:
                pair, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                total = np.zeros(len(pair), dtype=np.int64)
                np.add.at(total, where, np.concatenate([f[1] for f in found]))
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(pair)), *map(pa.array, (pair >> 32, pair & 0xFFFFFFFF, total))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])
            found, size = [], 0

        for batch in batches:
            for own, path, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items = [(i["at"], i["p"], i["x"]) for i in path]
                common = 0
                if own == lang:
                    while common < min(len(items), len(branch)) and items[common] == branch[common]:
                        common += 1
                leave(common)
                if own != lang or size >= PAIRS:
                    yield from told()
                    lang = own
                branch += items[common:]
                terms += [0] * (len(items) - common)
                terms[-1] += n
        leave(0)
        yield from told()

    sums = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(grow, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def pair_distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (numbers), value: for each ordered pair of sources of a language, the sum over all kept terms of |p - q|.

    rows has lang, at, term, p, x. Terms that neither has give kept * |x - y|; those that one has are corrected by sums of p above
    and below y over its distinct p, and those that both have by the tree.
    """
    paths = cut(rows.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("at", "p", "x"))).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("terms")))
    both = tree_corrections(paths)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    own, other = (groups.select("lang", F.col("at").cast("long").alias(s), F.col("x").alias(f"x_{s}"), *(["kept"] if s == "a" else [])) for s in "ab")
    pairs = cut(own.join(other, "lang").filter("a != b"))
    # A source's distinct p, with the other sources' y among them: a window in order of p gives the sums below each y.
    times = rows.groupBy("lang", F.col("at").cast("long").alias("a"), "p").agg(F.count("*").alias("m"))
    marks = pairs.select("lang", "a", F.col("x_b").alias("p"), F.lit(0).cast("long").alias("m"), "b", "x_a", "kept")
    line = times.withColumns({"b": F.lit(None).cast("long"), "x_a": F.lit(None).cast("long"), "kept": F.lit(None).cast("long")}).unionByName(marks)
    whole = Window.partitionBy("lang", "a")
    below = whole.orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    m, y = F.sum("m"), F.col("p")
    sums = line.withColumns({"less": m.over(below), "less_p": F.sum(F.col("m") * F.col("p")).over(below), "all": m.over(whole), "all_p": F.sum(F.col("m") * F.col("p")).over(whole)})
    one = F.col("all_p") - 2 * F.col("less_p") + y * (2 * F.col("less") - F.col("all")) - F.col("all") * F.abs(F.col("x_a") - y)
    single = sums.filter("b is not null").select("lang", "a", "b", one.alias("one"))
    backward = single.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("one").alias("other"))
    joined = pairs.join(single, ["lang", "a", "b"]).join(backward, ["lang", "a", "b"]).join(both, ["lang", "a", "b"], "left")
    value = F.col("kept") * F.abs(F.col("x_a") - F.col("x_b")) + F.col("one") + F.col("other") + F.coalesce("value", F.lit(0))
    return joined.select("lang", "a", "b", value.alias("value"))


def audit_sources(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each group of lang and source its distance from each other source of the language, and its terms.

    A term is a run of letters or of anything beyond ASCII, A-Z lower-cased, and is kept in a language where at least `least` of its rows
    have it. p is 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)). Part `pair`: item is the other source, value the sum of
    |p - q| over all kept terms. Part `term`: item is a term that the group has and that is likelier there than in the
    language, value the difference, the `top` highest. rank is from 1 by value descending, then item.

    Null lang, source and text are ''; groups without terms count, and those of a language without kept terms are 0 apart; repeated rows count
    each; an empty table gives an empty result; other columns of docs are left out.
    """
    spark = docs.sparkSession
    kept = cut(kept_terms(docs, least))
    groups = cut(groups_of(kept)).withColumns({"x": F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"))).otherwise(F.lit(0).cast("long"))})
    each = kept.filter("term != ''").select("lang", "term", F.col("n").alias("words"), F.explode("per").alias("per")).select("lang", "term", "words", "per.source", "per.n").filter("n > 0")
    rows = each.join(groups, ["lang", "source"])
    rows = cut(rows.select("lang", "source", "at", "term", "x", probability(F.col("n"), F.col("total")).alias("p"), probability(F.col("words"), F.col("all")).alias("q")))
    names = groups.select("lang", F.col("at").cast("long").alias("at"), "source")
    named = pair_distances(rows, groups).join(names.withColumnsRenamed({"at": "a"}), ["lang", "a"]).join(names.withColumnsRenamed({"at": "b", "source": "item"}), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = named.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    likelier = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = likelier.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    out = cut(pairs.unionByName(terms))
    for done in (kept, rows):
        remove(spark, done)
    return out


#: The same in SQL: every group by every kept term, and every pair.
AUDIT_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), e AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d
), kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}
), counts AS (SELECT lang, source, term, count(*) AS n FROM e JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM d
), every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS words FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS MATERIALIZED (
  SELECT lang, source, term, n,
    1 + {SCALE} * (n + {ADDED})::HUGEINT // (sum(n) OVER g + {ADDED} * count(*) OVER g) AS p,
    1 + {SCALE} * (words + {ADDED})::HUGEINT // (sum(words) OVER g + {ADDED} * count(*) OVER g) AS q
  FROM every WINDOW g AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) v
    ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP}
"""
