"""The table operators on the given tables themselves: orders, lineitem, customer, nation and labels.

Every query reads the columns it names by parameter; each has its DuckDB SQL beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.functions.numeric import stable6
from retentia.operators import evaluation as EV
from retentia.operators import prep as PR
from retentia.operators import segments as SG
from retentia.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f
    return register


def _r(x: str, digits: int = 6) -> str:
    return f"CAST(round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits} AS DOUBLE)"


_LINES = "(SELECT *, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS cut FROM lineitem)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem").withColumn("cut", (F.col("l_discount") >= 0.05).cast("int"))


@_query(f"SELECT l_returnflag, count(*) AS n, {_r('avg(cut)')} AS rate FROM {_LINES} GROUP BY 1")
def t_rate_by_returnflag(spark, sf):
    return SG.rate_by(_lines(spark, sf), "l_returnflag", "cut")


_DIMS = ("l_returnflag", "l_linestatus", "l_linenumber")
_ALL = " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n, {_r('avg(cut)')} AS rate FROM {_LINES} GROUP BY 2"
                          for d in ("l_returnflag", "l_linestatus", "l_linenumber"))


@_query(_ALL)
def t_rate_all_dims(spark, sf):
    return SG.rate_all_dims(_lines(spark, sf), list(_DIMS), "cut")


@_query(f"SELECT dimension, min(rate) AS min_rate, max(rate) AS max_rate, {_r('max(rate) - min(rate)')} AS spread FROM ({_ALL}) GROUP BY 1")
def t_spread_of_rates(spark, sf):
    return SG.spread_of_rates(_lines(spark, sf), list(_DIMS), "cut")


def _sales(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


_SALES = "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


@_query(f"SELECT c_mktsegment, {_r('avg(o_totalprice)')} AS mean FROM {_SALES} GROUP BY 1")
def t_mean_price_by_segment(spark, sf):
    return SG.mean_by(_sales(spark, sf), "c_mktsegment", "o_totalprice")


@_query(f"SELECT o_orderpriority, count(*) AS n, {_r('count(*) / sum(count(*)) OVER ()')} AS share FROM orders GROUP BY 1")
def t_priority_share(spark, sf):
    return SG.value_counts(read_table(spark, sf, "orders"), "o_orderpriority")


@_query("SELECT c_mktsegment, " + ", ".join(f"{_r(f'avg(o_totalprice) FILTER (WHERE o_orderstatus = {s!r})')} AS \"{s}\"" for s in "FOP")
        + f" FROM {_SALES} GROUP BY 1")
def t_pivot_segment_status(spark, sf):
    return SG.pivot_mean(_sales(spark, sf), "c_mktsegment", "o_orderstatus", ["F", "O", "P"], "o_totalprice", 1.0)


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {_r(f'avg({c})', 3)} AS mean, {_r(f'stddev_samp({c})', 3)} AS std, {_r(f'min({c})', 3)} AS min, "
    + ", ".join(f"{_r(f'quantile_cont({c}, {q})', 3)} AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + f", {_r(f'max({c})', 3)} AS max FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def t_describe_lineitem(spark, sf):
    return SG.describe(read_table(spark, sf, "lineitem"), _MEASURES)


@_query(" UNION ALL ".join(f"SELECT 'o_totalprice' AS \"column\", {q} AS q, {_r(f'quantile_cont(o_totalprice, {q})')} AS value FROM orders"
                           for q in ("0.1e0", "0.5e0", "0.9e0")))
def t_price_quantiles(spark, sf):
    return SG.quantiles_long(read_table(spark, sf, "orders"), ["o_totalprice"], [0.1, 0.5, 0.9]).withColumn("value", stable6(F.col("value")))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'corr({c}, l_extendedprice)')} AS corr FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def t_corr_with_price(spark, sf):
    return SG.corr_with(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@_query(f"""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
c AS (SELECT CAST(least(floor((o_totalprice - lo) * (50.0 / (hi - lo))), 49) AS INTEGER) AS bin, count(*) AS n FROM orders, r GROUP BY 1)
SELECT CAST(b.range AS INTEGER) AS bin, {_r('lo + b.range * ((hi - lo) / 50.0)')} AS bin_lo, {_r('lo + (b.range + 1) * ((hi - lo) / 50.0)')} AS bin_hi,
  coalesce(n, 0) AS count FROM range(50) b CROSS JOIN r LEFT JOIN c ON c.bin = b.range""")
def t_histogram_price(spark, sf):
    return SG.histogram(read_table(spark, sf, "orders"), "o_totalprice", 50)


@_query(f"""
WITH r AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer GROUP BY 1),
c AS (SELECT c_mktsegment, CAST(least(floor((c_acctbal - lo) * (40.0 / (hi - lo))), 39) AS INTEGER) AS bin, count(*) AS k
      FROM customer JOIN r USING (c_mktsegment) GROUP BY 1, 2)
SELECT r.c_mktsegment, CAST(b.range AS INTEGER) AS bin, {_r('lo + b.range * ((hi - lo) / 40.0)')} AS bin_lo,
  {_r('lo + (b.range + 1) * ((hi - lo) / 40.0)')} AS bin_hi, coalesce(k, 0) AS count, {_r('coalesce(k, 0) / (n * ((hi - lo) / 40.0))')} AS density
FROM r CROSS JOIN range(40) b LEFT JOIN c ON c.c_mktsegment = r.c_mktsegment AND c.bin = b.range""")
def t_balance_density_40(spark, sf):
    return SG.grouped_density(read_table(spark, sf, "customer"), "c_mktsegment", "c_acctbal", 40)


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")


@_query("SELECT c_custkey, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def t_nation_lookup(spark, sf):
    return SG.lookup(read_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), _nations(spark, sf), "c_nationkey")


@_query("SELECT n_name, n_nationkey, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def t_suppliers_by_nation(spark, sf):
    counts = read_table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    dim = read_table(spark, sf, "nation").select("n_nationkey", "n_name")
    return SG.complete_ordered(counts, dim, "n_nationkey", "n_name", fill={"n": 0})


@_query("""
WITH e AS (SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS code
           FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_nationkey <> 3 AND c_mktsegment <> 'BUILDING'))
SELECT c_custkey, c_mktsegment, coalesce(code, -1) AS c_mktsegment_code FROM customer LEFT JOIN e ON s = c_mktsegment""")
def t_encode_segments(spark, sf):
    """Fitted without one segment: its rows are unseen and get -1."""
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    codes = PR.fit_label_encoder(customer.where("c_nationkey <> 3 and c_mktsegment <> 'BUILDING'"), ["c_mktsegment"])
    return PR.transform_labels(customer.drop("c_nationkey"), codes, "_code", ["c_mktsegment"])


@_query(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'avg({c})')} AS mean, {_r(f'stddev_pop({c})')} AS std FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def t_scaler_lineitem(spark, sf):
    p = PR.fit_scaler(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return p.select("feature", stable6(F.col("mean")).alias("mean"), stable6(F.col("std")).alias("std"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a score: the share that a document's length has of itself and 2,000."""
    docs = read_table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"))
    return read_table(spark, sf, "labels").join(docs, "doc_id").select("quality", "toxic", "score")


_JUDGED = "(SELECT toxic, quality, n_chars / (n_chars + 2000.0e0) AS s FROM labels JOIN documents USING (doc_id))"
_BY_SCORE = f"(SELECT s, sum(toxic) AS pos, sum(1 - toxic) AS neg FROM {_JUDGED} GROUP BY 1)"


@_query(f"SELECT {_r('sum(neg * (cp - pos / 2.0)) / (sum(pos) * sum(neg))')} AS auc FROM (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp FROM {_BY_SCORE})")
def t_auc_length_for_toxic(spark, sf):
    return EV.auc(_judged(spark, sf), "toxic", "score")


@_query(f"SELECT {_r('sum(pos * cp / (cp + cn)) / sum(pos)')} AS average_precision "
        f"FROM (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn FROM {_BY_SCORE})")
def t_average_precision_toxic(spark, sf):
    return EV.average_precision(_judged(spark, sf), "toxic", "score")


_CELLS = (f"(SELECT count(*) FILTER (WHERE quality = 1 AND s >= 0.4) AS tp, count(*) FILTER (WHERE quality = 0 AND s >= 0.4) AS fp, "
          f"count(*) FILTER (WHERE quality = 1 AND s < 0.4) AS fn, count(*) FILTER (WHERE quality = 0 AND s < 0.4) AS tn FROM {_JUDGED})")


@_query(f"SELECT tp, fp, fn, tn, {_r('tp / (tp + fp)')} AS precision, {_r('tp / (tp + fn)')} AS recall, {_r('2 * tp / (2 * tp + fp + fn)')} AS f1, "
        f"{_r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM {_CELLS}")
def t_threshold_metrics_quality(spark, sf):
    return EV.threshold_metrics(_judged(spark, sf), "quality", "score", 0.4)


@_query(f"SELECT unnest([0, 0, 1, 1]) AS actual, unnest([0, 1, 0, 1]) AS predicted, unnest([tn, fp, fn, tp]) AS n FROM {_CELLS}")
def t_confusion_quality(spark, sf):
    return EV.confusion_matrix(_judged(spark, sf), "quality", "score", 0.4)


@_query(f"SELECT {_r('avg((s - quality) ^ 2)')} AS brier FROM {_JUDGED}")
def t_brier_quality(spark, sf):
    return EV.brier(_judged(spark, sf), "quality", "score")
