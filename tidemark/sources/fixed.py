"""Hand-kept series, factor specifications and small universes. They must equal their source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: series -> id, weight, inverted, window, (label, value) in order.
MANUAL = {
    "marginDebt": ("margindebt", 10, False, 6, [("2025-06", 1007961), ("2025-07", 1022548), ("2025-08", 1059723), ("2025-09", 1126494), ("2025-10", 1183654), ("2025-11", 1214321), ("2025-12", 1225597), ("2026-01", 1279042), ("2026-02", 1253192), ("2026-03", 1220922), ("2026-04", 1304281), ("2026-05", 1415557), ("2026-06", 1502072)]),
    "fundFlows": ("fundflows", 10, False, 4, [("2026-06-24", -16482), ("2026-07-01", -29914), ("2026-07-08", -9664), ("2026-07-15", -18104), ("2026-07-22", -36490)]),
    "forwardPE": ("forwardpe", 10, False, 2, [("2026-06-30", 20.4), ("2026-07-17", 20.3), ("2026-07-24", 20.1)]),
}
#: id -> weight, inverted, window, whether it is in the composite's history, rows of the mean its value is shown against; in the order
#: in which components are listed.
FACTORS = {
    "credit": (18, False, 50, True, None),
    "breadthadline": (6, False, 50, True, None),
    "breadthhilo": (6, False, 50, True, None),
    "breadthpct200": (6, False, 50, True, None),
    "putcall": (10, True, 10, False, None),
    "momentum": (10, False, 50, True, 90),
    "vix": (7, True, 50, True, None),
    "realizedvol": (7, True, 50, True, None),
    "margindebt": (10, False, 6, False, None),
    "fundflows": (10, False, 4, False, None),
    "forwardpe": (10, False, 2, False, None),
}
#: Lengths of windows, and of means shown, that the specifications name.
WINDOWS, SHOWN = (2, 4, 6, 10, 50), (90,)
PERIODS = {"margindebt": "month", "fundflows": "week", "forwardpe": "reading"}
BENCHMARK = ("SPY", "S&P 500")
SECTORS = [("XLK", "Technology"), ("XLF", "Financials"), ("XLV", "Health Care"), ("XLE", "Energy"), ("XLI", "Industrials"), ("XLY", "Consumer Discretionary"), ("XLP", "Consumer Staples"), ("XLU", "Utilities"), ("XLB", "Materials"), ("XLRE", "Real Estate"), ("XLC", "Communication Services")]
REGIONS = [("SPY", "US", "region"), ("EWJ", "Japan", "region"), ("EWU", "UK", "region"), ("EWG", "Germany", "region"), ("EWQ", "France", "region"), ("EWN", "Netherlands", "region"), ("EWC", "Canada", "region"), ("EWA", "Australia", "region"), ("EFA", "Developed ex-US", "region"), ("IVE", "Value", "style"), ("IVW", "Growth", "style")]


def manual_series(spark: SparkSession) -> DataFrame:
    rows = [(s, k, label, float(v)) for s, (*_, points) in MANUAL.items() for k, (label, v) in enumerate(points)]
    return spark.createDataFrame(rows, "series string, ord int, label string, value double")


def manual_specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i, w, inv, n) for s, (i, w, inv, n, _) in MANUAL.items()], "series string, id string, weight int, invert boolean, window int")


def factor_specs(spark: SparkSession) -> DataFrame:
    rows = [(i, k, *v, PERIODS.get(i, "day"), i in PERIODS) for k, (i, v) in enumerate(FACTORS.items())]
    return spark.createDataFrame(rows, "id string, ord int, weight int, invert boolean, window int, charted boolean, shown int, period_label string, exact boolean")


def sectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *s) for k, s in enumerate(SECTORS)], "ord int, sym string, name string")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *s) for k, s in enumerate(REGIONS)], "ord int, sym string, name string, type string")
