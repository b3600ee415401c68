"""Log-scaled metrics, their maxima, and the composite score c."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# the six metrics of the composite, in published order
COMPOSITE_METRICS = ("nc", "h", "hm", "ncs", "ncsf", "ncsfl")
# c is rounded before ranking so that last-bit differences of ln() between
# platforms cannot reorder tied authors
C_DIGITS = 10

# Published maxima of ln(x+1), with self-citations first, then
# without, in the order nc, h, hm, ncs, ncsf, ncsfl (career to 2019 and single
# year 2019 tables of the 2020 edition).
PUBLISHED_MAXIMA = {
    "career_2019": (
        12.72619888417912, 5.645446897643238, 4.752253158267069,
        11.933686327637512, 12.172588248212824, 12.284856099137546,
        12.665956492066586, 5.594711379601839, 4.708950125153382,
        11.933686327637512, 12.163478247897753, 12.27893734514078,
    ),
    "single_year_2019": (
        11.114222442341186, 4.605170185988092, 3.846603216619153,
        9.505841793480096, 10.249556450687637, 10.748668888951572,
        11.093234649598083, 4.59511985013459, 3.7582943840908785,
        9.50554408582681, 10.248423867569471, 10.742335527267628,
    ),
}


def _src(metric: str, v: str) -> str:
    # h/hm/nc are stored per variant; positions per variant too
    return {"nc": f"nc_{v}", "h": f"h_{v}", "hm": f"hm_{v}", "ncs": f"ncs_{v}", "ncsf": f"ncsf_{v}", "ncsfl": f"ncsfl_{v}"}[metric]


def maxima_columns() -> list[str]:
    return [f"max_l{m}_{v}" for v in ("ws", "ns") for m in COMPOSITE_METRICS]


def log_metrics(m: DataFrame) -> DataFrame:
    """ln(x + 1) of the six composite metrics, ns and ws."""
    return m.withColumns(
        {f"l{k}_{v}": F.ln(F.col(_src(k, v)).cast("double") + 1.0) for v in ("ns", "ws") for k in COMPOSITE_METRICS}
    )


def log_maxima(logs: DataFrame) -> DataFrame:
    """One row: the maxima of the 12 logs over all given authors."""
    return logs.agg(*[F.max(f"l{k}_{v}").alias(f"max_l{k}_{v}") for v in ("ws", "ns") for k in COMPOSITE_METRICS])


def composite(logs: DataFrame, maxima: DataFrame) -> DataFrame:
    """c = sum over the six metrics of ln(x+1) / max ln(x+1), for ns and ws (0..6).

    ``maxima`` is one aggregate row (checked); its 12 values are fetched once and
    enter the projection as literals, so the composite is a narrow per-row
    expression over the metrics, with no join at all."""
    rows = maxima.select(*maxima_columns()).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("maxima must have exactly one row")
    mx = rows[0].asDict()
    cols = {}
    for v in ("ns", "ws"):
        parts = [
            F.try_divide(F.col(f"l{k}_{v}"), F.lit(mx[f"max_l{k}_{v}"]).cast("double")) for k in COMPOSITE_METRICS
        ]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        cols[f"c_{v}"] = F.round(total, C_DIGITS)
    return logs.withColumns(cols)


def published_maxima(spark: SparkSession, table: str = "career_2019") -> DataFrame:
    vals = PUBLISHED_MAXIMA[table]
    return spark.createDataFrame([tuple(float(x) for x in vals)], ", ".join(f"{c} double" for c in maxima_columns()))


def read_maxima(spark: SparkSession, path: str) -> DataFrame:
    """Read a maxima CSV (header, 12 numeric columns: with-self block first, then
    the (ns) block, each in composite order) and name the columns by position."""
    from ..sources.io import read_report

    schema = ", ".join(f"c{i} double" for i in range(12))
    df = read_report(spark, path, schema)
    return df.toDF(*maxima_columns())
