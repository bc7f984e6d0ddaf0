"""The risk index itself: its domains, phases and signals, and the locked build over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.operators import compose as C
from compindex.operators import ranking as R
from compindex.operators import scale as N

# Domain, phase, in composite, design confidence, signals as (table, column).
DESIGN = [
    ("economic-precarity", "recruitment", True, "ok", [
        ("recruitment_econprecarity", "ep_poverty_headcount_685"),
        ("recruitment_econprecarity", "ep_informal_employment_share"),
        ("recruitment_econprecarity", "ep_agrarian_employment_share"),
        ("recruitment_econprecarity", "ep_income_volatility"),
        ("worldbank", "wb_gini"),
    ]),
    ("debt-financialized-dependency", "recruitment", True, "low_confidence", [
        ("findex", "findex_account_exclusion"),
        ("findex", "findex_informal_borrowing"),
        ("findex", "findex_borrow_prevalence"),
    ]),
    ("constrained-mobility", "recruitment", True, "low_confidence", [
        ("vdem", "v2xcl_dmove"),
        ("static_indices", "henley_passport_access"),
        ("unhcr", "unhcr_refugees_by_coo"),
    ]),
    ("ascriptive-exclusion", "recruitment", True, "low_confidence", [("epr", "epr_excluded_pop_share")]),
    ("legal-non-recognition", "recruitment", True, "ok", [
        ("legal_non_recognition", "lnr_birth_registration_incompleteness"),
        ("legal_non_recognition", "lnr_statelessness_prevalence"),
    ]),
    ("gender-structuring", "recruitment", True, "ok", [
        ("gender_structuring", "gs_lfp_gender_gap"),
        ("gender_structuring", "gs_gender_inequality_index"),
        ("gender_structuring", "gs_mobility_constraint"),
        ("gender_structuring", "gs_sex_sector_channel_share"),
    ]),
    ("age-childhood-structuring", "recruitment", True, "low_confidence", [
        ("age_childhood", "age_child_labor_prevalence"),
        ("age_childhood", "age_out_of_school_rate"),
        ("age_childhood", "age_child_cohort_share"),
        ("age_childhood", "age_child_marriage_rate"),
    ]),
    ("structural-disruption", "recruitment", True, "ok", [
        ("aux_emdat", "aux_emdat_disaster_shock"),
        ("ndgain", "ndgain_climate_vulnerability"),
        ("aux_ucdp", "ucdp_conflict_intensity"),
        ("unhcr", "unhcr_idps_by_country"),
        ("unhcr", "unhcr_refugees_by_coo"),
    ]),
    ("foreclosed-exit-structural", "exploitation", True, "insufficient_data", [
        ("ilostat", "LAI_INDE_NOC_RT_A"),
        ("ilostat", "ILR_CBCT_NOC_RT_A"),
        ("ilostat", "ILR_TUMT_NOC_RT_A"),
    ]),
    ("economic-structure-demand", "exploitation", True, "low_confidence", [
        ("econ_structure_demand", "esd_d1_hazardous_sector_share"),
        ("econ_structure_demand", "esd_d2_informal_employment_share"),
        ("aux_unctad", "aux_unctad_export_concentration"),
    ]),
    ("state-production-of-unfreedom", "exploitation", True, "insufficient_data", [
        ("vdem", "v2xcl_slave"),
        ("vdem", "v2xnp_client"),
        ("static_indices", "trace_bribery_total"),
        ("worldbank", "wb_bribery_incidence"),
    ]),
    ("domain-a-transnational-concealment", "monetization", False, "low_confidence", [
        ("basel_fatf", "basel_fatf_me_effectiveness"),
        ("basel_fatf", "basel_tjn_fsi"),
        ("basel_fatf", "basel_fatf_listing_flag"),
    ]),
    ("domain-b-cash-informal-retention", "monetization", False, "low_confidence", [
        ("monetization_b", "monet_b_shadow_economy"),
        ("monetization_b", "monet_b_financial_exclusion"),
    ]),
]
# Anchors of the signals as (signal, floor, ceiling, direction).
ANCHORS = [
    ("ep_poverty_headcount_685", 0.0, 100.0, "high_risk"),
    ("ep_informal_employment_share", 0.0, 100.0, "high_risk"),
    ("ep_agrarian_employment_share", 0.0, 80.0, "high_risk"),
    ("ep_income_volatility", 0.0, 8.0, "high_risk"),
    ("wb_gini", 20.0, 65.0, "high_risk"),
    ("wb_lower_secondary_completion", 0.0, 100.0, "low_risk"),
    ("wb_remittances_pct_gdp", 0.0, 35.0, "high_risk"),
    ("wb_labor_productivity", 785.0, 119601.0, "low_risk"),
    ("wb_bribery_incidence", 0.0, 60.0, "high_risk"),
    ("wb_wgi_rule_of_law", -2.5, 2.5, "low_risk"),
    ("findex_account_exclusion", 0.0, 1.0, "high_risk"),
    ("findex_informal_borrowing", 0.0, 1.0, "high_risk"),
    ("findex_borrow_prevalence", 0.0, 1.0, "high_risk"),
    ("v2xcl_dmove", 0.0, 1.0, "low_risk"),
    ("v2xcl_slave", 0.0, 1.0, "low_risk"),
    ("v2xnp_client", 0.0, 1.0, "high_risk"),
    ("v2x_rule", 0.0, 1.0, "low_risk"),
    ("henley_passport_access", 0.0, 227.0, "low_risk"),
    ("trace_bribery_total", 0.0, 100.0, "high_risk"),
    ("epr_excluded_pop_share", 0.0, 0.5, "high_risk"),
    ("lnr_birth_registration_incompleteness", 0.0, 100.0, "low_risk"),
    ("gs_lfp_gender_gap", 0.0, 50.0, "high_risk"),
    ("gs_gender_inequality_index", 0.0, 1.0, "high_risk"),
    ("gs_mobility_constraint", 0.0, 100.0, "low_risk"),
    ("gs_sex_sector_channel_share", 0.0, 0.70, "high_risk"),
    ("age_child_labor_prevalence", 0.0, 40.0, "high_risk"),
    ("age_out_of_school_rate", 0.0, 60.0, "high_risk"),
    ("age_child_cohort_share", 10.0, 50.0, "high_risk"),
    ("age_child_marriage_rate", 0.0, 60.0, "high_risk"),
    ("disaster_mortality_intensity", 0.0, 100.0, "high_risk"),
    ("disaster_affected_intensity", 0.0, 1.0, "high_risk"),
    ("ndgain_climate_vulnerability", 0.0, 1.0, "high_risk"),
    ("ucdp_conflict_intensity", 0.0, 100.0, "high_risk"),
    ("unhcr_refugees_by_coo", 0.0, 5000.0, "high_risk"),
    ("unhcr_idps_by_country", 0.0, 5000.0, "high_risk"),
    ("LAI_INDE_NOC_RT_A", 0.0, 3.0, "low_risk"),
    ("ILR_CBCT_NOC_RT_A", 0.0, 100.0, "low_risk"),
    ("ILR_TUMT_NOC_RT_A", 0.0, 100.0, "low_risk"),
    ("SDG_F881_SEX_MIG_RT_A", 0.0, 20.0, "high_risk"),
    ("esd_d1_hazardous_sector_share", 0.0, 60.0, "high_risk"),
    ("esd_d2_informal_employment_share", 0.0, 100.0, "high_risk"),
    ("unctad_export_concentration", 0.0, 1.0, "high_risk"),
    ("basel_fatf_me_effectiveness", 0.0, 10.0, "high_risk"),
    ("basel_tjn_fsi", 0.0, 10.0, "high_risk"),
    ("basel_fatf_listing_flag", 0.0, 1.0, "high_risk"),
    ("monet_b_shadow_economy", 8.0, 50.0, "high_risk"),
    ("monet_b_financial_exclusion", 0.0, 1.0, "high_risk"),
]
# Weights of excluded groups by status.
STATUS_WEIGHTS = {"DISCRIMINATED": 1.0, "POWERLESS": 0.7, "SELF-EXCLUSION": 0.5}
# The modulating signal, signals that repeat an outcome, and the composite's phases.
MODULATOR = ("worldbank", "wb_wgi_rule_of_law")
CIRCULAR = [("vdem", "v2xcl_slave")]
PHASES = ["recruitment", "exploitation"]


def anchors(spark: SparkSession) -> DataFrame:
    """The anchor table, validated."""
    return N.anchor_spec(
        spark, [{"series": name, "floor": lo, "ceiling": hi, "direction": way} for name, lo, hi, way in ANCHORS]
    )


def locked_build(signals: DataFrame, universe: DataFrame, attenuated: bool = True) -> DataFrame:
    """Scores of the locked build: key, one column per phase, composite and rank.

    ``signals`` is (tbl, col, key, value) as scanned from the processed tables; ``universe`` is
    (key, ord), whose order breaks ties.
    """
    domains = C.domain_scores(signals, DESIGN, universe)
    if attenuated:
        hit = (F.col("tbl") == MODULATOR[0]) & (F.col("col") == MODULATOR[1]) & F.col("value").isNotNull()
        domains = C.attenuate(domains, signals.where(hit).select("key", F.col("value").alias("g")))
    phases = C.phase_scores(domains, C.phase_totals(DESIGN)).where("in_composite")
    scores = C.composite(phases, PHASES).join(universe, "key")
    ranks = R.rank_scored(scores.select("key", "ord", "composite"), "composite", ["ord"]).select("key", "rank")
    return scores.join(ranks, "key", "left")
