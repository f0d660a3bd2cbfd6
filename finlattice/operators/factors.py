"""The factor library: named expressions over declared inputs, and the frame that feeds them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import growth, safe_divide


@dataclass(frozen=True)
class Factor:
    name: str
    categories: tuple[str, ...]
    inputs: tuple[str, ...]
    build: Callable[..., Column]

    def column(self) -> Column:
        return self.build(*map(F.col, self.inputs)).cast("double").alias(self.name)


FACTORS: dict[str, Factor] = {}


def register(name: str, categories: str, inputs: str, build: Callable[..., Column] | None = None) -> None:
    """Add a factor; without an expression it passes its input through."""
    if name in FACTORS:
        raise ValueError(f"factor {name!r} is registered already")
    FACTORS[name] = Factor(name, tuple(categories.split()), tuple(inputs.split()), build or (lambda x: x))


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


register("pe_ttm", "value", "pe_ttm")
register("pb", "value", "pb")
register("ps", "value", "ps")
register("ev_ebitda", "value", "enterprise_value ebitda", lambda ev, e: safe_divide(ev, _positive(e)))
register("fcf_yield", "value", "free_cash_flow total_mv", safe_divide)
register("roe", "quality", "roe")
register("roic", "quality", "roic")
register("gross_margin", "quality", "gross_margin")
register("operating_margin", "quality", "operating_margin")
register("cfo_to_net_profit", "quality", "cfo net_profit", safe_divide)
register("debt_to_equity", "quality", "interest_bearing_debt equity", safe_divide)
register("revenue_growth", "growth", "revenue_yoy")
register("profit_growth", "growth", "profit_yoy")
register("eps_growth", "growth", "eps_yoy")
register("fcf_growth", "growth", "free_cash_flow free_cash_flow_prev", growth)
register("roe_trend", "growth", "roe roe_prior_year", lambda a, b: a - b)
register("dividend_yield", "dividend value", "dv_ttm")
register("dividend_growth", "dividend", "dps dps_prior_year", growth)
register("payout_ratio", "dividend", "dps eps", safe_divide)
register("dividend_stability", "dividend", "dividend_years dividend_years_total", safe_divide)
for _months in (1, 3, 6, 12):
    register(f"momentum_{_months}m", "momentum", f"ret_{_months}m")
register("volatility_6m", "risk", "vol_6m")
register("volatility_12m", "risk", "vol_12m")
register("max_drawdown_12m", "risk", "max_dd_12m")


def of_category(category: str) -> list[str]:
    return [n for n, f in FACTORS.items() if category in f.categories]


def compute(frame: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The frame with the factors' columns; inputs that it lacks are an error."""
    chosen = [FACTORS[n] for n in names or FACTORS]
    missing = sorted({i for f in chosen for i in f.inputs} - set(frame.columns))
    if missing:
        raise ValueError(f"columns missing for factors: {', '.join(missing)}")
    return frame.withColumns({f.name: f.column() for f in chosen})


#: Inputs that are put together from others.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "enterprise_value": (("total_mv", "interest_bearing_debt", "cash"), lambda: F.col("total_mv") + F.col("interest_bearing_debt") - F.col("cash")),
}


def needed(names: list[str] | None = None, extra: list[str] = ()) -> set[str]:
    """Inputs of some factors, with what derived ones are made of."""
    wanted = {i for n in names or FACTORS for i in FACTORS[n].inputs} | set(extra)
    return wanted | {part for d in wanted & set(DERIVED) for part in DERIVED[d][0]}


def build_frame(universe: DataFrame, sources: list[DataFrame], names: list[str] | None = None, extra: list[str] = ()) -> DataFrame:
    """One row per ts_code of the universe with the inputs that the factors need: only the sources and columns that give one are read.

    Inputs that no source gives are null; a code that the universe has twice, or a source twice, stops the query.
    """
    wanted, frame, have = needed(names, extra), universe, set(universe.columns)
    for source in sources:
        columns = [c for c in source.columns if c in wanted - have and c != "ts_code"]
        if columns:
            frame, have = frame.join(source.select("ts_code", *columns), "ts_code", "left"), have | set(columns)
    frame = with_absent_inputs(frame, names, wanted - set(DERIVED))
    frame = frame.withColumns({d: build().cast("double") for d, (_, build) in DERIVED.items() if d in wanted})
    once = F.assert_true(F.count(F.lit(1)).over(Window.partitionBy("ts_code")) == 1, F.lit("a code occurs twice in the factor frame"))
    frame = frame.withColumn("_once", once).where("_once is null")
    return frame.select(*universe.columns, *sorted(wanted - set(universe.columns)))


def with_absent_inputs(frame: DataFrame, names: list[str] | None = None, wanted: set[str] | None = None) -> DataFrame:
    """Null columns for the inputs that no source feeds."""
    wanted = wanted if wanted is not None else {i for n in names or FACTORS for i in FACTORS[n].inputs}
    return frame.withColumns({c: F.lit(None).cast("double") for c in sorted(wanted - set(frame.columns))})


def coverage(frame: DataFrame, names: list[str]) -> DataFrame:
    """factor, percent of rows with a value, tier: ready from 50, sparse above 0, else none."""
    one = frame.agg(*(F.avg(F.col(n).isNotNull().cast("double")).alias(n) for n in names))
    rows = one.unpivot([], names, "factor", "share").select("factor", (F.col("share") * 100).alias("coverage"))
    return rows.withColumn("tier", F.when(F.col("coverage") >= 50, "ready").when(F.col("coverage") > 0, "sparse").otherwise("none"))
