"""Mixing sources to target weights by Poisson replication. DataFrame operations only.

Each source gets a mean repetition rate: its share of the target divided by its share of the corpus, in characters. A
document's count inverts the Poisson distribution with that mean at a number hashed from the seed and the document, so
the same input gives the same mix on any cluster. Rows are exploded by count and put in the order of another hash, whose
leading bits choose the partition: a global order without sampling.

The distribution is a table of cumulative probabilities for each source, built once, in one way for every mean: from 12 standard
deviations and 20 below the mean to as much above it. What lies outside has less probability than the hashed number resolves.

Cases: rows of a null source form one source, whose weight is that of the key None. Null or empty texts have no
characters; a source that has none at all is repeated by its share of rows. Repeated rows share their draw unless they
differ in doc_id or text. A source without a weight gets default_weight; one of weight 0 goes. Extra columns are kept, whatever
their names; mix() replaces those called replica or shuffle_key, repeated() doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5, the same in any engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(mean: Column, low: Column) -> Column:
    """The cumulative probabilities of a Poisson distribution with this mean, from low on."""
    high = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["all"], F.array(s["sum"] + p)).alias("all"))

    one = F.lit(1.0)
    start = F.struct(one.alias("p"), one.alias("sum"), F.array(one).alias("all"))
    return F.aggregate(F.sequence(low + 1, high), start, step, lambda s: F.transform(s["all"], lambda c: c / s["sum"]))


def rates(docs: DataFrame, weights: dict[str | None, float], default_weight: float, size: float) -> DataFrame:
    """source_name, low, table: a row for each source. size: rows wanted as a multiple of those that are there, by characters."""
    weight = F.lit(float(default_weight))
    for source, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    by = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.count("*").alias("rows"))
    scratch = Scratch(docs.sparkSession, "mix")
    by = scratch.write(by.withColumn("w", weight), "sources")
    total = by.agg(F.sum("chars").alias("chars"), F.sum("rows").alias("rows"), F.sum("w").alias("w")).first()
    share = F.when(F.col("chars") > 0, F.lit(total["chars"]) / F.col("chars")).otherwise(F.lit(total["rows"]) / F.col("rows"))
    rate = by.select("source", (F.lit(float(size)) * F.col("w") / F.lit(total["w"]) * share).alias("mean")).filter("mean > 0")
    rate = rate.withColumn("low", F.greatest(F.lit(0), F.floor(F.col("mean") - 12 * F.sqrt("mean") - 20)).cast("int"))
    return scratch.write(rate.select(F.col("source").alias("source_name"), "low", cumulative(F.col("mean"), F.col("low")).alias("table")), "tables")


def _repeat(docs: DataFrame, weights: dict[str | None, float] | None, default_weight: float, size: float, seed: int) -> DataFrame:
    """The columns of docs by number (c0, c1, ...), then replica and shuffle_key."""
    doc_id, text, source = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text", "source"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    table = rates(docs.select("source", "text"), weights or {}, default_weight, size)
    digest = F.md5(F.coalesce(text, F.lit("")))
    # below the join, so that each is computed once for a row
    rows = docs.toDF(*names).withColumn("digest", digest).withColumn("u", unit(F.lit(seed), F.lit("count"), doc_id, F.col("digest"), F.lit(1)))
    # the table of sources is small or not: Spark measures it, and splits a hot source if it must join by shuffle
    rows = rows.join(table, source.eqNullSafe(F.col("source_name")))
    count = F.col("low") + F.size(F.filter("table", lambda c: c <= F.col("u")))
    rows = rows.select(*names, "digest", F.posexplode_outer(F.array_repeat(F.lit(True), count)).alias("replica", "there")).filter("there")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("~")), "replica", "digest"))
    rows = rows.select(*names, "replica", key.alias("shuffle_key"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.conv(F.substring("shuffle_key", 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52)) * n).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, default_weight: float = 1.0, size: float = 1.0, seed: int = 17) -> DataFrame:
    """The columns of docs, then replica (from 0) and shuffle_key, in the order of shuffle_key."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("replica", "shuffle_key")])
    return _repeat(docs, weights, default_weight, size, seed).toDF(*docs.columns, "replica", "shuffle_key")


def repeated(docs: DataFrame, weights: dict[str | None, float] | None = None, default_weight: float = 1.0, size: float = 1.0, seed: int = 17) -> DataFrame:
    """The columns of docs alone, in the order of the same hash."""
    return _repeat(docs, weights, default_weight, size, seed).drop("replica", "shuffle_key").toDF(*docs.columns)


def oracle(seed: int = 17) -> str:
    """DuckDB SQL for mix() of documents at equal weights and the size that is there."""
    return f"""
WITH RECURSIVE by_source AS (SELECT source, sum(length(coalesce(text, ''))) AS chars, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT source, (1.0 * 1.0) / (SELECT CAST(count(*) AS DOUBLE) FROM by_source)
    * CASE WHEN chars > 0 THEN CAST((SELECT sum(chars) FROM by_source) AS DOUBLE) / chars ELSE CAST((SELECT sum(n) FROM by_source) AS DOUBLE) / n END AS mean FROM by_source),
pmf AS (SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM rate
    UNION ALL SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM pmf WHERE k < ceil(mean + 12 * sqrt(mean) + 20)),
drawn AS (SELECT d.*, CAST(('0x' || substr(md5('{seed}|count|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || md5(coalesce(text, '')) || '|1'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS n FROM drawn d JOIN pmf ON pmf.source IS NOT DISTINCT FROM d.source AND pmf.c <= d.u
    GROUP BY ALL),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(n)) AS INTEGER) AS replica FROM counted)
SELECT *, md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '~') || '|' || replica || '|' || md5(coalesce(text, ''))) AS shuffle_key FROM copies"""
