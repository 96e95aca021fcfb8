"""Published result tables used as goldens (fixed values, copied as data).

Fixed values: per-group counts of the 2020-04-12 release (input) and the statistics published for it.
Columns of COUNTS_0412: abo, rh, intubation_binary_covid_pos, intubation_binary, died_binary_covid_pos,
died_binary, covid_result_binary, total_tested, num_general. The 'unknown' row is excluded as in the analysis.
"""

COUNTS_0412 = [
    ("A", "neg", 3, 18, 2, 3, 22, 61, 3438),
    ("A", "pos", 90, 174, 47, 69, 337, 641, 32070),
    ("AB", "neg", 0, 3, 0, 0, 0, 5, 394),
    ("AB", "pos", 15, 26, 11, 14, 36, 86, 4174),
    ("B", "neg", 4, 8, 1, 3, 17, 33, 1417),
    ("B", "pos", 49, 81, 31, 40, 170, 330, 14760),
    ("O", "neg", 7, 16, 0, 5, 35, 74, 4792),
    ("O", "pos", 128, 241, 81, 106, 472, 1037, 47440),
]

COMPARISONS = {
    "positive_vs_general": ["covid_positive", "general_pop"],
    "positive_vs_negative": ["covid_positive", "covid_negative"],
    "intubated_covid_positive_vs_not_intubated_covid_positive": ["intubated_covid_positive",
                                                                 "not_intubated_covid_positive"],
    "died_covid_positive_vs_alive_covid_positive": ["died_covid_positive", "alive_covid_positive"],
}

# abo_chisq.tsv (statistic, p.value, parameter, comparison)
ABO_CHISQ_0412 = [
    (6.373452796494556, 0.09478906287484734, 3, "positive_vs_general"),
    (9.654821192568843, 0.02174010152695639, 3, "positive_vs_negative"),
    (4.317683551486963, 0.22914047558456443, 3, "intubated_covid_positive_vs_not_intubated_covid_positive"),
    (7.3555845917779905, 0.061387546625035136, 3, "died_covid_positive_vs_alive_covid_positive"),
]

# abo_rh_chisq.tsv (groups with total_tested > 5)
ABO_RH_CHISQ_0412 = [
    (13.264277562226031, 0.03902597201755122, 6, "positive_vs_general"),
    (14.506278387860316, 0.02446468514732381, 6, "positive_vs_negative"),
    (7.15310403875115, 0.3069201395449693, 6, "intubated_covid_positive_vs_not_intubated_covid_positive"),
    (16.666130441436596, 0.010591848761678766, 6, "died_covid_positive_vs_alive_covid_positive"),
]

# abo_fisher_exact.tsv (blood_group, comparison, estimate, conf.low, conf.high, p.value)
ABO_FISHER_0412 = [
    ("A", "positive_vs_general", 1.0107249732667671, 0.8876897500144628, 1.1491382184851098, 0.8711321011639517),
    ("A", "positive_vs_negative", 1.1970920107049134, 0.997709006469011, 1.4365262294510266, 0.050612840231165),
    ("A", "intubated_covid_positive_vs_not_intubated_covid_positive", 0.907694710074685, 0.6732183149648391, 1.2188211856334419, 0.5154619483979609),
    ("A", "died_covid_positive_vs_alive_covid_positive", 0.7726544898464256, 0.5281933623708955, 1.1171188548762103, 0.18577048647583078),
    ("AB", "positive_vs_general", 0.7777383645339594, 0.5409828037752707, 1.085449258764738, 0.14907510971826915),
    ("AB", "positive_vs_negative", 0.6981694546705324, 0.44154571555394795, 1.092123293136802, 0.10843346548744753),
    ("AB", "intubated_covid_positive_vs_not_intubated_covid_positive", 1.9610945883722186, 0.9264066543388307, 4.054545423329214, 0.0563837057679788),
    ("AB", "died_covid_positive_vs_alive_covid_positive", 2.417459250898861, 1.0520422802195195, 5.213589350086521, 0.02049535801359521),
    ("B", "positive_vs_general", 1.182953033200479, 1.0042431535041665, 1.3875912851165209, 0.040204201894060466),
    ("B", "positive_vs_negative", 1.1802044000945433, 0.9367802154863646, 1.4873068423768983, 0.15218665266698525),
    ("B", "intubated_covid_positive_vs_not_intubated_covid_positive", 1.0725587961896306, 0.7399354519878852, 1.5391830966097668, 0.7181140750606766),
    ("B", "died_covid_positive_vs_alive_covid_positive", 1.1141230975061178, 0.7067951144398484, 1.717433291653196, 0.6600994203723095),
    ("O", "positive_vs_general", 0.9381761241647932, 0.830726248427532, 1.059303185255946, 0.30023283156451835),
    ("O", "positive_vs_negative", 0.8279397692439158, 0.6994991840357749, 0.9797826036706025, 0.025879332638895407),
    ("O", "intubated_covid_positive_vs_not_intubated_covid_positive", 0.9489808554661638, 0.7190658552178353, 1.2514154776150601, 0.7329593466022067),
    ("O", "died_covid_positive_vs_alive_covid_positive", 1.0126969362975426, 0.7208491854614146, 1.4208086692582123, 1.0),
]

# abo_rh_fisher_exact.tsv, first two groups
ABO_RH_FISHER_0412 = [
    ("A-neg", "positive_vs_general", 0.6276293917566519, 0.3911107847656795, 0.9568960338654671, 0.029196880823945164),
    ("A-neg", "positive_vs_negative", 0.5996593664416462, 0.33625994777732043, 1.044561801579306, 0.06832174283956965),
    ("A-neg", "intubated_covid_positive_vs_not_intubated_covid_positive", 0.4173688682135047, 0.07852426076494984, 1.4332612791946318, 0.22427075946437622),
    ("A-neg", "died_covid_positive_vs_alive_covid_positive", 0.5242302104421777, 0.05888248002710193, 2.1904886354518074, 0.5582497656204896),
    ("A-pos", "positive_vs_general", 1.0622967401087942, 0.9307996561164179, 1.2103725639380933, 0.36813373600140725),
    ("A-pos", "positive_vs_negative", 1.2808755375554213, 1.0620663152315524, 1.5453502775475187, 0.008906996767808324),
    ("A-pos", "intubated_covid_positive_vs_not_intubated_covid_positive", 0.9657905972645803, 0.7136234742508571, 1.301388632749262, 0.8255436534687807),
    ("A-pos", "died_covid_positive_vs_alive_covid_positive", 0.8053727129183481, 0.547395820794564, 1.170068337946158, 0.2818255152213777),
]

# outcome_regression_coefficients.tsv rows 'abo_only' (outcome, term, estimate, std.error, statistic, p.value)
ABO_ONLY_COEF_0412 = [
    ("covid_result_binary", "(Intercept)", -0.4238141741016932, 0.21436322573489847, -1.9770843280079264, 0.048032098955267236),
    ("covid_result_binary", "A", 0.46940611542401456, 0.227271994752867, 2.0653935648096082, 0.038885776970537356),
    ("covid_result_binary", "B", 0.4844387959179957, 0.2387069402481773, 2.0294290371881836, 0.04241461004468557),
    ("covid_result_binary", "O", 0.2487509799674256, 0.22266473977591716, 1.1171547871376528, 0.2639281484797823),
    ("died_binary", "(Intercept)", -0.8209805520689062, 0.3618134599321618, -2.269071339200139, 0.023263987956935534),
    ("died_binary", "A", -1.023771447298792, 0.39311947667455854, -2.6042246900585764, 0.009208236729531664),
    ("died_binary", "B", -0.7567086620506146, 0.41062220164357816, -1.8428342623018736, 0.06535321267770648),
    ("died_binary", "O", -0.8390096395280268, 0.38157840169555585, -2.1987870272527497, 0.02789306936325995),
    ("intubation_binary", "(Intercept)", -0.3364722366212129, 0.3380617014172384, -0.9952982997205478, 0.3195912044907019),
    ("intubation_binary", "A", -0.7144245790042354, 0.35888407038634645, -1.9906834489341974, 0.04651569944653512),
    ("intubation_binary", "B", -0.5910756497755406, 0.37498838661108647, -1.5762505476964699, 0.11496807346922433),
    ("intubation_binary", "O", -0.6771468392106722, 0.35267729865765357, -1.9200182200215377, 0.05485559802010888),
]

# null model intercept for covid_result_binary
NULL_INTERCEPT_COV_0412 = (-0.07855824127776119, 0.042037716808270384)

# outcome_regression_anova.tsv rows 'abo_vs_null': (outcome, resid_df_null, resid_dev_null, resid_df, resid_dev, df, dev, p)
ABO_VS_NULL_0412 = [
    ("covid_result_binary", 2266, 3139.2343735707786, 2263, 3129.5551183552534, 3, 9.679255215525245, 0.021498898252177337),
    ("died_binary", 1088, 953.4780659687495, 1085, 947.0609478489971, 3, 6.417118119752445, 0.09298909879907188),
    ("intubation_binary", 1088, 1274.2385112752752, 1085, 1270.2354014517136, 3, 4.0031098235615445, 0.26112852093540573),
]
