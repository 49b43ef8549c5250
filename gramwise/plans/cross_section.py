"""Cross-section: patents per head on research, inequality, growth, emissions, income and trade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramwise.functions.columns import interaction, log_ratio, rescaled
from gramwise.operators.gram import Moments, Term, gram_table
from gramwise.operators.ols import OlsFit, fit_moments, vif

# Variables of the summary table and of the two models, as the columns are named here.
SUMMARY = (
    "grants_patents", "randd_perc_gdp", "gini_coeff", "gdp_real_growthrate", "emissions_percapita", "trade_pc_gdp",
    "population_mil",
)
LABEL = "log_patents_millions"
FULL = (
    "randd_perc_gdp", "gini_coeff", "gdp_real_growthrate", "emissions_percapita", "gdppc_thousands", "trade_pc_gdp",
    "interraction_gdppc_trade",
)
REDUCED = (
    "randd_perc_gdp", "gini_coeff", "gdp_real_growthrate", "emissions_percapita", "gdp_percapita", "trade_pc_gdp",
)


def derive(df: DataFrame) -> DataFrame:
    thousands = rescaled(F.col("gdp_percapita"), 1000.0)
    return df.withColumns(
        {
            LABEL: log_ratio(F.col("grants_patents"), F.col("population_mil")),
            "gdppc_thousands": thousands,
            "interraction_gdppc_trade": interaction(F.col("trade_pc_gdp"), thousands),
        }
    )


@dataclass(frozen=True)
class CrossSectionModel:
    """A fitted model with the cross products that its diagnostics need."""

    fit: OlsFit
    moments: Moments

    @classmethod
    def estimate(cls, df: DataFrame, regressors=FULL) -> CrossSectionModel:
        moments = gram_table(df, [*regressors, LABEL]).moments()
        return cls(fit_moments(moments, LABEL, [Term(c) for c in regressors]), moments)

    def vif(self, df: DataFrame) -> DataFrame:
        return vif(df.sparkSession, self.moments, self.fit.model.terms)
