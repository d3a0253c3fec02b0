"""Clusters against gold labels: everything follows from the contingency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: n * (n - 1) / 2 without the product, which overflows earlier than the result.
_PAIRS = "CASE WHEN {0} % 2 = 0 THEN {0} div 2 * ({0} - 1) ELSE {0} * (({0} - 1) div 2) END"


def contingency(assigned: DataFrame, check_ids: bool = True) -> DataFrame:
    """center_id, label_name, n of assigned rows (id, center_id, label_name). An id twice is an error; check_ids=False
    saves the shuffle that looks for one where ids are known to be unique."""
    if not check_ids:
        return assigned.groupBy("center_id", "label_name").agg(F.count("*").alias("n"))
    once = assigned.groupBy("id").agg(F.count("*").alias("times"), F.min("center_id").alias("center_id"), F.min("label_name").alias("label_name"))
    checked = F.when(F.col("times") == 1, F.col("center_id")).otherwise(F.raise_error(F.concat(F.lit("assigned twice: "), F.col("id"))))
    return once.select(checked.alias("center_id"), "label_name").groupBy("center_id", "label_name").agg(F.count("*").alias("n"))


def evaluate(assigned: DataFrame, check_ids: bool = True) -> DataFrame:
    """One row: counts, purities, pair counts with precision, recall and F1, Rand indexes, and information
    measures in nats. Ratios stay within [0, 1]; the adjusted index may be negative. No rows: an error."""
    cells = contingency(assigned, check_ids)
    by_cluster = cells.groupBy("center_id").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    by_label = cells.groupBy("label_name").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    pairs = F.expr(f"sum({_PAIRS.format('n')})")
    logs = F.sum(F.col("n") * F.log("n"))
    c = by_cluster.agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_items"), F.sum("top").alias("top_c"), pairs.alias("pairs_c"), logs.alias("log_c"))
    l = by_label.agg(F.count("*").alias("n_labels"), F.sum("top").alias("top_l"), pairs.alias("pairs_l"), logs.alias("log_l"))  # noqa: E741
    x = cells.agg(pairs.alias("tp"), logs.alias("log_x"))
    n = F.col("n_items")
    rows = c.crossJoin(l).crossJoin(x).withColumn("n_items", F.when(n > 0, n).otherwise(F.raise_error(F.lit("no assigned rows")).cast("long")))
    rows = rows.withColumn("total", F.expr(_PAIRS.format("n_items"))).withColumn("fp", F.col("pairs_c") - F.col("tp")).withColumn("fn", F.col("pairs_l") - F.col("tp"))
    rows = rows.withColumn("tn", F.col("total") - F.col("tp") - F.col("fp") - F.col("fn"))

    def share(a: Column, b: Column, otherwise: float = 1.0) -> Column:
        return F.when(b != 0, a / b).otherwise(otherwise)

    def within(a: Column) -> Column:
        return F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))

    def mean(a: Column, b: Column) -> Column:
        return F.when(a + b > 0, F.lit(2.0) * a * b / (a + b)).otherwise(0.0)

    tp = F.col("tp")
    precision, recall = share(tp, tp + F.col("fp")), share(tp, tp + F.col("fn"))
    expected = F.col("pairs_c").cast("double") * F.col("pairs_l") / F.greatest(F.col("total"), F.lit(1))
    most = (F.col("pairs_c") + F.col("pairs_l")) / F.lit(2.0)
    ari = F.when((F.col("total") == 0) | (most - expected == 0), F.lit(1.0)).otherwise((tp - expected) / (most - expected))
    h_c, h_l = F.log(n) - F.col("log_c") / n, F.log(n) - F.col("log_l") / n
    mi = F.greatest(F.log(n) + (F.col("log_x") - F.col("log_c") - F.col("log_l")) / n, F.lit(0.0))
    rows = rows.withColumn("h_c", F.when(F.col("n_clusters") > 1, h_c).otherwise(0.0)).withColumn("h_l", F.when(F.col("n_labels") > 1, h_l).otherwise(0.0)).withColumn("mi", F.when((F.col("n_clusters") > 1) & (F.col("n_labels") > 1), mi).otherwise(0.0))
    hom, com = within(share(F.col("mi"), F.col("h_l"))), within(share(F.col("mi"), F.col("h_c")))
    nmi = F.when(F.col("h_c") + F.col("h_l") > 0, F.lit(2.0) * F.col("mi") / (F.col("h_c") + F.col("h_l"))).otherwise(1.0)
    return rows.select(
        "n_items", "n_clusters", "n_labels", (F.col("top_c") / n).alias("purity"), (F.col("top_l") / n).alias("inverse_purity"),
        "tp", "fp", "fn", "tn", within(precision).alias("pairwise_precision"), within(recall).alias("pairwise_recall"), within(mean(precision, recall)).alias("pairwise_f1"),
        within(share(tp + F.col("tn"), F.col("total"))).alias("rand_index"), ari.alias("adjusted_rand_index"), F.col("mi").alias("mutual_information"),
        within(nmi).alias("normalized_mutual_information"), hom.alias("homogeneity"), com.alias("completeness"), mean(hom, com).alias("v_measure"),
    )
