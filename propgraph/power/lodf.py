"""Outage distribution factors, flows after single outages, and verdicts on them.

An outage of branch k shifts flow to branch l by LODF[l, k] = B[l, k] / (1 - B[k, k]), where B is the
sensitivity of l to a transfer between k's ends. All of it is joins and aggregates over the long
table; a matrix of branches by outages is the result, not a step on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..operators.common import cut
from .ptdf import Ptdf, with_rel_values

TOLERANCE = 1e-6
LEAST_RATING = 1e-3
#: Overloads above which an outage counts as not viable.
MOST_OVERLOADS = 2
WARN_PCT = 90.0


class Lodf:
    def __init__(self, ptdf: Ptdf, flows: DataFrame, ratings: DataFrame | None = None, tolerance: float = TOLERANCE, most_overloads: int = MOST_OVERLOADS, bridges: DataFrame | None = None):
        """``flows``: label, flow. ``ratings``: label, rating. Missing values are flow 0 and rating 1."""
        self.ptdf, self.most = ptdf, most_overloads
        base = ptdf.labels.join(flows.select(F.col("label").alias("branch"), F.col(flows.columns[1]).alias("flow")).dropDuplicates(["branch"]), "branch", "left")
        if ratings is not None:
            base = base.join(ratings.select(F.col("label").alias("branch"), F.col(ratings.columns[1]).alias("rating")).dropDuplicates(["branch"]), "branch", "left")
            rating = F.coalesce(F.nanvl("rating", F.lit(0.0)), F.lit(0.0))
        else:
            rating = F.lit(1.0)
        base = base.select("branch", F.coalesce(F.nanvl("flow", F.lit(0.0)), F.lit(0.0)).alias("flow"), F.when(rating > LEAST_RATING, rating).otherwise(1.0).alias("rating"))
        self.base = cut(base)
        ends = ptdf.endpoints()
        table = ptdf.table
        one = ends.join(table.select("bus", F.col("branch").alias("affected"), "ptdf"), F.col("from_bus") == F.col("bus")).select("affected", F.col("branch").alias("outage"), F.col("ptdf").alias("v"))
        two = ends.join(table.select("bus", F.col("branch").alias("affected"), "ptdf"), F.col("to_bus") == F.col("bus")).select("affected", F.col("branch").alias("outage"), (-F.col("ptdf")).alias("v"))
        transfer = cut(one.unionByName(two).groupBy("affected", "outage").agg(F.sum("v").alias("bsf")))
        own = transfer.filter("affected = outage").select(F.col("outage").alias("branch"), (1 - F.col("bsf")).alias("denom"))
        bridge = (ptdf.bridge_labels() if bridges is None else bridges.select("branch")).distinct().withColumn("bridge", F.lit(True))
        located = F.col("from_bus").isNotNull() & F.col("to_bus").isNotNull()
        status = ends.join(own, "branch", "left").join(bridge, "branch", "left").withColumn("denom", F.when(located, F.coalesce("denom", F.lit(1.0))))
        verdict = F.when(F.col("bridge"), "puente").when(~located, "no_encontrado").when(F.abs("denom") < tolerance, "singular").otherwise("ok")
        self.status = cut(status.select("branch", "denom", verdict.alias("status")))
        good = self.status.filter("status = 'ok'").select(F.col("branch").alias("outage"), "denom")
        every = ptdf.labels.select(F.col("branch").alias("affected")).crossJoin(good)  # the matrix itself
        self.matrix = cut(every.join(transfer, ["affected", "outage"], "left").select("affected", "outage", (F.coalesce("bsf", F.lit(0.0)) / F.col("denom")).alias("lodf")))

    # outages
    def after(self) -> DataFrame:
        """``outage, affected, flow, loading`` of every defined outage; the lost branch carries nothing."""
        k = self.base.select(F.col("branch").alias("outage"), F.col("flow").alias("lost"))
        rows = self.matrix.join(self.base.withColumnRenamed("branch", "affected"), "affected").join(k, "outage")
        flow = F.when(F.col("affected") == F.col("outage"), 0.0).otherwise(F.col("flow") + F.col("lodf") * F.col("lost"))
        return rows.select("outage", "affected", flow.alias("flow"), (F.abs(flow) / F.col("rating")).alias("loading"))

    def contingencies(self, viable_only: bool = True) -> DataFrame:
        """``outage, max_loading_pct, n_overloads``."""
        rows = self.after().groupBy("outage").agg(F.round(100 * F.max("loading"), 2).alias("max_loading_pct"), F.sum(F.when(F.col("loading") > 1.0, 1).otherwise(0)).alias("n_overloads"))
        return rows.filter(F.col("n_overloads") <= self.most) if viable_only else rows

    def flows_after(self, outage: str) -> DataFrame | None:
        """``branch, flow`` after an outage; None if it is not defined or not viable."""
        if not self.contingencies().filter(F.col("outage") == outage).limit(1).count():
            return None
        return self.after().filter(F.col("outage") == outage).select(F.col("affected").alias("branch"), "flow")

    def ptdf_after(self, outage: str) -> DataFrame | None:
        """``branch, bus, ptdf`` after an outage."""
        if not self.contingencies().filter(F.col("outage") == outage).limit(1).count():
            return None
        column = self.matrix.filter(F.col("outage") == outage).select(F.col("affected").alias("branch"), "lodf")
        lost = self.ptdf.branch_row(outage).withColumnRenamed("ptdf", "lost")
        rows = self.ptdf.table.join(column, "branch").join(lost, "bus", "left")
        value = F.when(F.col("branch") == outage, 0.0).otherwise(F.col("ptdf") + F.col("lodf") * F.coalesce("lost", F.lit(0.0)))
        return rows.select("branch", "bus", value.alias("ptdf"))

    def column(self, outage: str) -> DataFrame | None:
        rows = self.matrix.filter(F.col("outage") == outage).select(F.col("affected").alias("branch"), "lodf")
        return rows if rows.limit(1).count() else None

    def ranking(self, top_n: int = 20) -> DataFrame:
        """``rank, outage, max_loading_pct, n_overloads``, worst first, with the verdict."""
        rows = self.contingencies().orderBy(F.desc("max_loading_pct"), "outage").limit(top_n)
        rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("max_loading_pct"), "outage")))
        return rows.select("rank", "outage", "max_loading_pct", "n_overloads", self._verdict().alias("verdict"))

    @staticmethod
    def _verdict():
        return F.when(F.col("n_overloads") > 2, "critico").when((F.col("n_overloads") >= 1) | (F.col("max_loading_pct") > WARN_PCT), "advertencia").otherwise("seguro")

    def verdicts(self) -> DataFrame:
        """``branch, verdict, max_loading_pct, n_overloads, overloaded`` of every branch; overloaded: the five worst."""
        worst = Window.partitionBy("outage").orderBy(F.desc("loading"), "affected")
        hit = self.after().filter("loading > 1.0").withColumn("k", F.row_number().over(worst)).filter("k <= 5")
        top = hit.groupBy("outage").agg(F.array_sort(F.collect_list(F.struct("k", "affected", F.round(100 * F.col("loading"), 2).alias("loading_pct")))).alias("overloaded"))
        rows = self.status.join(self.contingencies(False).join(top, "outage", "left"), F.col("branch") == F.col("outage"), "left")
        return rows.select("branch", F.when(F.col("status") != "ok", F.col("status")).otherwise(self._verdict()).alias("verdict"), "max_loading_pct", "n_overloads", "overloaded")

    def verdict(self, branch: str) -> dict:
        r = self.verdicts().filter(F.col("branch") == branch).first()
        return r.asDict(recursive=True) if r else {"branch": branch, "verdict": "no_encontrado", "max_loading_pct": None, "n_overloads": None, "overloaded": None}

    def summary(self) -> DataFrame:
        c = self.contingencies(False)
        s = self.status.groupBy().agg(F.count("*").alias("n_branches"), *[F.sum(F.when(F.col("status") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("ok", "puente", "no_encontrado", "singular")])
        v = c.agg(F.sum(F.when(F.col("n_overloads") <= self.most, 1).otherwise(0)).alias("n_viable"), F.max("max_loading_pct").alias("worst_pct"), F.avg("max_loading_pct").alias("mean_pct"))
        return s.crossJoin(v)  # one row each

    def contingency_n1(self, monitored: str) -> DataFrame:
        """``outage, delta_flow_pct, verdict``: what each outage does to one branch, as a share of its flow."""
        base = self.base.filter(F.col("branch") == monitored).select("branch", F.col("flow").alias("before"))
        rows = self.after().filter(F.col("affected") == monitored).join(base, F.col("affected") == F.col("branch")).drop("branch")
        delta = F.when(F.abs("before") > 0, 100 * (F.col("flow") - F.col("before")) / F.abs("before"))
        return rows.select("outage", delta.alias("delta_flow_pct")).join(self.verdicts().select(F.col("branch").alias("outage"), "verdict"), "outage")

    def worst_case_outage(self, monitored: str) -> dict | None:
        r = self.contingency_n1(monitored).filter(F.col("outage") != monitored).orderBy(F.desc(F.abs("delta_flow_pct")), "outage").first()
        return r.asDict() if r else None

    def persist_critical(self, top_n: int = 20, impacted: int = 5) -> PropertyGraph:
        """The graph with loading, overloads and most impacted branches on the worst outages' relationships."""
        order = Window.partitionBy("outage").orderBy(F.desc(F.abs("lodf")), "affected")
        near = self.matrix.filter("affected <> outage").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= impacted)
        top = near.groupBy("outage").agg(F.to_json(F.array_sort(F.collect_list(F.struct("k", "affected", F.round("lodf", 6).alias("lodf"))))).alias("lodf_top_impacted"))
        rows = self.ranking(top_n).join(top, "outage", "left").join(self.ptdf.label_map(), F.col("outage") == F.col("branch"))
        values = rows.select("rel_id", F.col("max_loading_pct").alias("lodf_max_loading_pct"), F.col("n_overloads").alias("lodf_n_overloads"), "lodf_top_impacted")
        return with_rel_values(self.ptdf.graph, self.ptdf.rel_type, values)


def contingency_screening(lodf: Lodf, n_top: int = 20) -> DataFrame:
    """The ranking with each outage's verdict."""
    return lodf.ranking(n_top)
