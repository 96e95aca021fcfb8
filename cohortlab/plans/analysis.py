"""The notebooks' analyses on the clinical analysis tables, one call each.

* :func:`blood_group_associations` — one-vs-rest blood-group logistic models: outcome (with its inclusion
  rule) x blood-group indicator (each ABO, Rh and joint level) x formula (univariate / multivariate),
  all fitted by one batched IRLS (keys = outcome, blood_group_type, blood_group, formula).
* :func:`standardised_risk_grid` — the bootstrapped standardised-risk grid on the time-to-event table:
  prevalence (linear probability model) and Fine-Gray intubation / death, ABO and Rh exposures,
  unadjusted and race/ethnicity-adjusted.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agg as A
from ..operators import glm
from ..operators import reshape as R
from . import cohort as C
from . import risk

# Fixed values of the reference analyses: levels, reference categories, formulas, inclusion rules
ABO_LEVELS = ["A", "AB", "B", "O"]
RH_LEVELS = ["neg", "pos"]
OUTCOME_RULES = {"cov_pos": None, "intubated": "cov_pos = 1", "died": "cov_pos = 1"}
MULTIVARIATE = ["age_normed", "male_sex", "ethnicity_hs", "ethnicity_other", "ethnicity_missing",
                "race_asian", "race_black_aa", "race_other", "race_missing",
                "risk_factor_cardiovascular_disorders", "risk_factor_diabetes_mellitus", "risk_factor_hypertension",
                "risk_factor_obesity", "risk_factor_respiratory_disorders", "had_blood_group"]
FORMULAS = {"univariate": ["had_blood_group"], "multivariate": MULTIVARIATE}


def _v1_design(wide: DataFrame, outcomes=OUTCOME_RULES) -> DataFrame:
    """Shared preprocessing of the v1 wide table: z-scored age, 0/1 flags, dummy columns."""
    # outcome flags are BOOLEAN in the declared table; as numbers (R uses them as 0/1) the rules and y work
    base = wide.withColumn("age", F.col("age").cast("double"))
    for o in outcomes:
        base = base.withColumn(o, F.col(o).cast("int"))
    df = A.zscore(base, "age", out="age_normed")
    df = df.withColumn("abo_rh", F.concat_ws("_", "abo", "rh"))
    df = R.one_hot(df, "ethnicity", ["hs", "other", "missing"], prefix="ethnicity")
    df = R.one_hot(df, "race", ["asian", "black_aa", "other", "missing"], prefix="race")
    df = R.one_hot(df, "abo", ABO_LEVELS, prefix="abo")
    df = R.one_hot(df, "rh", RH_LEVELS, prefix="rh")
    df = R.one_hot(df, "abo_rh", [f"{a}_{r}" for a in ABO_LEVELS for r in RH_LEVELS], prefix="abo_rh")
    for c in C.RISK_FACTORS:
        df = df.withColumn(f"risk_factor_{c}", F.col(f"risk_factor_{c}").cast("double"))
    return df.withColumn("male_sex", F.col("male_sex").cast("double"))


def blood_group_associations(wide: DataFrame, formulas=FORMULAS, outcomes=OUTCOME_RULES) -> tuple[DataFrame, DataFrame]:
    """N1 one-vs-rest associations on the v1 wide table; returns (coefficients, fits)."""
    df = _v1_design(wide, outcomes)
    # outcome rows (inclusion rule per outcome) and one row per blood-group indicator, in one explode each
    passed = [F.when(F.lit(True) if rule is None else F.expr(rule), F.lit(o)) for o, rule in outcomes.items()]
    df = df.withColumn("outcome", F.explode(F.array_compact(F.array(*passed))))
    joint = [f"{a}_{r}" for a in ABO_LEVELS for r in RH_LEVELS]
    groups = [("abo", g, F.col("abo") == g) for g in ABO_LEVELS] + [("rh", g, F.col("rh") == g) for g in RH_LEVELS] \
        + [("abo_rh", g, F.col("abo_rh") == g) for g in joint]
    df = df.withColumn("__g", F.explode(F.array(*[F.struct(F.lit(t).alias("blood_group_type"),
                                                          F.lit(g).alias("blood_group"),
                                                          c.cast("double").alias("had_blood_group"))
                                                 for t, g, c in groups])))
    df = df.select("*", "__g.*").drop("__g")
    ycase = None
    for o in outcomes:
        ycase = F.when(F.col("outcome") == o, F.col(o).cast("double")) if ycase is None else \
            ycase.when(F.col("outcome") == o, F.col(o).cast("double"))
    df = df.withColumn("__y", ycase)
    terms = []
    for ts in formulas.values():
        for t in ts:
            if t not in terms:
                terms.append(t)
    df = df.withColumn("formula", F.explode(F.array(*[F.lit(f) for f in formulas])))
    for t in terms:
        in_f = [f for f, ts in formulas.items() if t in ts]
        df = df.withColumn(t, F.when(F.col("formula").isin(in_f), F.col(t).cast("double")).otherwise(0.0))
    keys = ["outcome", "blood_group_type", "blood_group", "formula"]
    return glm.logit_grouped(df.select(*keys, "__y", *terms), keys, "__y", terms)


RF = MULTIVARIATE[:-1]


def _indicators() -> list[tuple[str, str, str]]:
    """(type, level, 0/1 column) of every ABO, Rh and joint level."""
    return [("abo", a, f"abo_{a}") for a in ABO_LEVELS] + [("rh", r, f"rh_{r}") for r in RH_LEVELS] \
        + [("abo_rh", f"{a}_{r}", f"abo_rh_{a}_{r}") for a in ABO_LEVELS for r in RH_LEVELS]


def blood_group_risk_factors(wide: DataFrame) -> DataFrame:
    """Which risk factors go with a blood group: every ABO, Rh and joint level regressed on the risk factors.

    One pattern table serves all 14 responses. Returns blood_group_type, blood_group and the coefficient columns."""
    responses = _indicators()
    coefs, _ = glm.logit_responses(_v1_design(wide), [c for *_, c in responses], RF)
    names = F.create_map(*[x for t, g, c in responses for x in (F.lit(c), F.struct(F.lit(t).alias("blood_group_type"), F.lit(g).alias("blood_group")))])
    return coefs.withColumn("__g", names[F.col("response")]).select("__g.*", *[c for c in coefs.columns if c != "response"])


RACE_LEVELS = ["white", "asian", "black_aa", "other", "missing"]
ETHNICITY_LEVELS = ["nonhs", "hs", "other", "missing"]
STRATIFIED_FORMULAS = {"univariate": ["had_blood_group"],
                       "multivariate": ["age_normed", "male_sex", *[x for x in RF if x.startswith("risk_factor_")], "had_blood_group"]}


def race_stratified_associations(wide: DataFrame, formulas=STRATIFIED_FORMULAS, outcomes=OUTCOME_RULES) -> tuple[DataFrame, DataFrame]:
    """One-vs-rest blood-group models within each race and each ethnicity, three outcomes: (coefficients, fits).

    Persons are compressed once to patterns (outcome, groups, race, ethnicity, covariates); patterns, not persons, are
    repeated per stratum, blood-group level and formula. Keys: outcome, race_ethnicity, blood_group_type, blood_group, formula."""
    base = wide.withColumn("__race", F.col("race")).withColumn("__ethnicity", F.col("ethnicity"))
    df = _v1_design(base, outcomes)
    covariates = [t for t in dict.fromkeys(t for ts in formulas.values() for t in ts) if t != "had_blood_group"]
    ycase = F.coalesce(*[F.when(F.col("outcome") == o, F.col(o).cast("double")) for o in outcomes])
    passed = [F.when(F.lit(True) if rule is None else F.expr(rule), F.lit(o)) for o, rule in outcomes.items()]
    df = df.withColumn("outcome", F.explode(F.array_compact(F.array(*passed)))).withColumn("__yy", ycase)
    pats = glm.compress(df.filter("abo is not null and rh is not null"), ["outcome", "__race", "__ethnicity", "abo", "rh"], "__yy", covariates)
    strata = F.array(F.concat(F.lit("race_"), "__race"), F.concat(F.lit("ethnicity_"), "__ethnicity"))
    groups = [("abo", a, F.col("abo") == a) for a in ABO_LEVELS] + [("rh", r, F.col("rh") == r) for r in RH_LEVELS] \
        + [("abo_rh", f"{a}_{r}", (F.col("abo") == a) & (F.col("rh") == r)) for a in ABO_LEVELS for r in RH_LEVELS]
    cell = F.array(*[F.struct(F.lit(t).alias("blood_group_type"), F.lit(g).alias("blood_group"), c.cast("double").alias("had_blood_group")) for t, g, c in groups])
    x = pats.withColumn("race_ethnicity", F.explode(strata)).filter("race_ethnicity is not null").withColumn("__g", F.explode(cell)) \
        .withColumn("formula", F.explode(F.array(*[F.lit(f) for f in formulas])))
    terms = [*covariates, "had_blood_group"]
    uses = {t: F.col("formula").isin([f for f, ts in formulas.items() if t in ts]) for t in terms}
    x = x.select("outcome", "race_ethnicity", "__g.*", "formula", *covariates, "__y", "__n")
    x = x.select(*[c for c in x.columns if c not in terms], *[F.when(uses[t], F.col(t)).otherwise(0.0).alias(t) for t in terms])
    keys = ["outcome", "race_ethnicity", "blood_group_type", "blood_group", "formula"]
    x = x.groupBy(*keys, *terms).agg(F.sum("__y").alias("__y"), F.sum("__n").alias("__n"))
    return glm.logit_grouped(x, keys, "__y", terms, compressed=True)


def stratified_effect_frame(coefs: DataFrame, terms: str = "had_blood_group") -> DataFrame:
    """The published stratified effects: odds ratios with Wald intervals of the blood-group term for ABO (without AB) and
    Rh-negative, without the strata that are too small, and declared orders of type and outcome as columns."""
    keep = (F.col("term") == terms) & F.col("blood_group_type").isin("abo", "rh") & ~F.col("blood_group").isin("pos", "AB") \
        & ~F.col("race_ethnicity").isin("race_asian", "ethnicity_other")
    order = lambda c, levels: F.array_position(F.array(*map(F.lit, levels)), F.col(c)).cast("int")
    return glm.odds_ratio(coefs.filter(keep)).select(
        "outcome", "race_ethnicity", "blood_group_type", "blood_group", "formula", "odds_ratio", "conf_low", "conf_high", "p_value",
        order("blood_group_type", ["abo", "rh"]).alias("type_order"), order("outcome", list(OUTCOME_RULES)).alias("outcome_order"))


FIT_FORMULAS = {
    "null": [],
    "Risk factors": RF,
    "ABO": ["abo_A", "abo_B", "abo_AB"],
    "ABO + Risk factors": RF + ["abo_A", "abo_B", "abo_AB"],
    "ABO/Rh": ["abo_rh_A_neg", "abo_rh_A_pos", "abo_rh_B_neg", "abo_rh_B_pos", "abo_rh_AB_pos", "abo_rh_O_neg"],
    "ABO/Rh + Risk factors": RF + ["abo_rh_A_neg", "abo_rh_A_pos", "abo_rh_B_neg", "abo_rh_B_pos", "abo_rh_AB_pos",
                                   "abo_rh_O_neg"],
    "Rh(D)": ["rh_neg"],
    "Rh(D) + Risk factors": RF + ["rh_neg"],
}
FIT_COMPARISONS = {
    "Risk factors vs Null": ("null", "Risk factors"),
    "ABO + Risk factors vs Risk factors": ("Risk factors", "ABO + Risk factors"),
    "ABO/Rh + Risk factors vs Risk factors": ("Risk factors", "ABO/Rh + Risk factors"),
    "Rh(D) + Risk factors vs Risk factors": ("Risk factors", "Rh(D) + Risk factors"),
}


def model_fit_comparisons(wide: DataFrame, formulas=FIT_FORMULAS, comparisons=FIT_COMPARISONS,
                          outcomes=OUTCOME_RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """N1 analysis of deviance: every (outcome, formula) model in one batched IRLS, then the nested
    comparisons' test rows (R ``anova(test = 'Chisq')`` filtered to rows with a Df). Returns
    (deviance tests, coefficients, fits)."""
    df = _v1_design(wide, outcomes)
    grid, terms = glm.model_grid(df, {o: (o, rule) for o, rule in outcomes.items()}, formulas)
    coefs, fits = glm.logit_grouped(grid, ["outcome", "model"], "__y_val", terms)
    tests = glm.deviance_table(fits, comparisons, keys=["outcome"]).filter(F.col("row") == 2).drop("row")
    return tests, coefs, fits


ABO_V2 = ["O", "A", "AB", "B"]          # O is the reference level
RACE_V2 = ["white", "missing", "black", "other", "asian"]   # white is the reference level
RISK_EXPOSURES = {"abo": ["abo_A", "abo_AB", "abo_B"], "rh": ["rh"]}
RISK_STRATA = {"abo": {f"abo{g}": {f"abo_{h}": (1.0 if h == g else 0.0) for h in ABO_V2[1:]} for g in ABO_V2},
               "rh": {"rh1": {"rh": 1.0}, "rh0": {"rh": 0.0}}}
RISK_REFERENCES = {"abo": "aboO", "rh": "rh0"}
RISK_ADJUSTMENTS = {"unadjusted": [], "adjusted": ["race_asian", "race_black", "race_missing", "race_other", "hispanic"]}


def _v2_dummies(df: DataFrame) -> DataFrame:
    out = R.dummy(df, "abo", ABO_V2, ref="O", prefix="abo", drop=False)
    out = R.dummy(out, "race", RACE_V2, ref="white", prefix="race", drop=False)
    return out.withColumn("rh", (F.col("rh") == "neg").cast("double"))


def standardised_risk_grid(basic: DataFrame, tests: DataFrame, n_boot: int = 1000, seed: int = 0,
                           latest: str = "2020-08-01", entry_limit: str = "2020-07-31") -> DataFrame:
    """N2 on the v2 tables (``build_basic_v2``): adults only, prevalence within 96 h of the first test,
    Fine-Gray intubation (death competing) and death (recovery competing)."""
    adults = basic.filter(F.col("age") >= 18)
    prev = C.prevalence_v2(tests).select("pat_mrn_id", "initial_cov_pos")
    prevalence = _v2_dummies(adults).join(prev, "pat_mrn_id").filter(F.col("initial_cov_pos").isNotNull())
    comp = {k: _v2_dummies(C.competing_risk_v2(adults, k, latest, entry_limit)) for k in ("intubation", "death")}
    comp = {k: v.filter(F.col("status").isNotNull()) for k, v in comp.items()}
    return risk.risk_grid(prevalence, comp, "pat_mrn_id", RISK_EXPOSURES, RISK_STRATA, RISK_REFERENCES,
                          RISK_ADJUSTMENTS, n_boot=n_boot, seed=seed)


# Published external site counts used by the meta-analysis (patients, controls per blood group;
# the Wuhan controls serve both Wuhan hospitals)
EXTERNAL_SITE_COUNTS = [
    ("A", "Wuhan Jinyintan", 670, 1188), ("B", "Wuhan Jinyintan", 469, 920),
    ("AB", "Wuhan Jinyintan", 178, 336), ("O", "Wuhan Jinyintan", 458, 1250),
    ("A", "Wuhan Renmin", 45, 1188), ("B", "Wuhan Renmin", 25, 920),
    ("AB", "Wuhan Renmin", 15, 336), ("O", "Wuhan Renmin", 28, 1250),
    ("A", "Shenzhen", 82, 6728), ("B", "Shenzhen", 83, 5880),
    ("AB", "Shenzhen", 39, 1712), ("O", "Shenzhen", 81, 9066),
]


def meta_analysis(local_counts: DataFrame, site: str = "local", extra_sites: DataFrame | None = None,
                  include_external: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K17/K18 as in the second notebook: per blood group, target vs the other groups at each site,
    patients vs controls, random-effects pooled across sites. ``local_counts``: blood_group, patients,
    controls. Returns (studies, pooled, heterogeneity)."""
    from ..operators import meta
    spark = local_counts.sparkSession
    frames = [local_counts.select("blood_group", F.lit(site).alias("site"),
                                  F.col("patients").cast("double").alias("patients"),
                                  F.col("controls").cast("double").alias("controls"))]
    if include_external:
        frames.append(spark.createDataFrame(EXTERNAL_SITE_COUNTS, "blood_group string, site string, patients long, "
                                                                  "controls long")
                      .select("blood_group", "site", F.col("patients").cast("double"), F.col("controls").cast("double")))
    if extra_sites is not None:
        frames.append(extra_sites.select("blood_group", "site", F.col("patients").cast("double"),
                                         F.col("controls").cast("double")))
    counts = frames[0]
    for f in frames[1:]:
        counts = counts.unionByName(f)
    studies = meta.meta_counts(counts, "site", "blood_group", "patients", "controls")
    return meta.meta_binary(studies)
