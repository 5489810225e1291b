import pytest
from pyspark.sql import functions as F

from attesta.functions import effects, text, vocab
from attesta.operators import questions


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.out for r in df.select("i", f(F.col("s")).alias("out")).orderBy("i").collect()]


def test_effect_texts(spark):
    full = "OR 0.295 (95% CI 0.094-0.925), p=0.036; AUC: 0.99 (95% CI 0.97-1.00); Sensitivity: 0.99; Specificity: 0.96; PPV: 0.94; NPV: 0.98; Cut-off: 90.95"
    texts = (full, "AUROC 0.74 (95%CI 0.73–0.76); cut-off ≥2: sensitivity 98%, specificity 10%", "aHR 1.5 (95% CI 1.1 to 2.0)", None, "M 64.06 (SD 16.12) vs 71.04, t=-8.40, p<0.001", "threshold 5, cut-off 2.5 mg, p = 0.2; C-index: 0.7, p value <1e-4", "Mean Difference -1.5 (95% CI -2.0 to -1.0); NPV 7 %")
    a, b, c, d, e, f, g = (r.p for r in effects.with_parsed(spark.createDataFrame(list(enumerate(texts)), "i int, s string"), "s", "p").orderBy("i").collect())
    assert (a.effect_type, a.effect_value, a.ci_lo, a.ci_hi, a.p_value, a.auc, a.auc_ci_hi, a.sens, a.npv, a.cutoff) == ("OR", 0.295, 0.094, 0.925, 0.036, 0.99, 1.0, 0.99, 0.98, "90.95")
    assert (b.effect_type, b.effect_value, b.ci_lo, b.sens, b.spec) == ("AUC", 0.74, 0.73, 0.98, 0.1)
    assert (c.effect_type, c.effect_value, c.ci_hi) == ("HR", 1.5, 2.0)
    assert all(v is None for v in d) and e.effect_type is None and e.p_value == 0.001 and b.cutoff == "≥2: sensitivity 98%, specificity 10%"[:2]
    assert (f.cutoff, f.c_index, f.p_value) == ("2.5 mg", 0.7, 0.2) and (g.effect_type, g.effect_value, g.ci_lo, g.ci_hi, g.npv) == ("mean_diff", -1.5, -2.0, -1.0, 0.07)


def test_vocabularies(spark):
    assert one(spark, vocab.canonical_predictor, "Lactate", "quick sofa", "septic shock", "LDH level", None, " ") == ["lactate", "qSOFA", "septic shock", "LDH", None, None]
    assert one(spark, vocab.predictor_category, "SOFA ", None, "GCS", "foo") == ["score", "other", "physiologic", "other"]
    assert one(spark, vocab.method_name, "Cox regression and random forest", "qSOFA", None, "APACHE II") == ["Cox PH", "qSOFA", "other", "APACHE-II"]
    assert one(spark, vocab.care_setting, "PICU patients", "the ED", None) == ["pediatric ICU", "ED", "unknown"]
    assert one(spark, vocab.outcome_class, "In-hospital mortality", "28 day mortality.", "death at 1-year", "", "other") == ["HOSPITAL", "28D", "1Y", "", "other"]
    assert one(spark, vocab.expand, "SAPS II and DBP", "care") == ["simplified acute physiology score ii and diastolic blood pressure", "care"]
    assert one(spark, vocab.timing_bucket, "within 24 hours of ICU admission", "Day 3") == ["FIRST_24H_ICU", "day 3"]


def test_text_forms(spark):
    assert one(spark, text.norm_anchor, "A – b 1,388", None, "Ｌactate ﬁt ², e\u0301") == ["a - b 1388", "", "lactate fit 2, \xe9"]
    assert one(spark, text.norm_field, "２019 to 2021;") == ["2019-2021"]
    assert one(spark, text.norm_id_loose, "Seymour 2016 ALERTS (Hagel et al., 2013)    Overall") == ["seymour2016alertsoverall"]
    assert one(spark, text.bbox_text, "[1, 2, 3, 4]", "1,2,3", None) == ["1.00,2.00,3.00,4.00", None, None]
    assert one(spark, text.year_of_stem, "Author_2019_x", "x_1800", None) == [2019, None, None]
    assert one(spark, text.cohort_size, "n = 1,388", None, "none") == [1388, 0, 0]
    assert one(spark, text.group_label, "non-survivors", "Survivors", "all", None) == ["Non-survivors", "Survivors", None, None]


def test_questions(spark):
    asked = ["What predicts 27-day mortality in septic shock?", "sepsis", "Show qSOFA evidence from Seymour 2016", "Procalcitonin vs CRP", "studies from 2021", "best model in Wang 2023", "AUC at the optimal cutoff", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, question string")
    rows = questions.route_ranking(questions.answerable(questions.intents(df))).withColumns({"m": questions.metric(), "mode": questions.mode()}).orderBy("i").collect()
    assert (rows[0].outcome_type, rows[0].outcome_window_days, rows[0].condition) == ("mortality", 27, "septic shock")
    assert not rows[1].answerable and rows[0].answerable and not rows[7].answerable
    assert (rows[2].predictor, rows[2].paper_ref, rows[2].mode) == ("qSOFA", "Seymour 2016", "paper_evidence")
    assert rows[3].predictor == "PCT" and rows[4].paper_ref is None and rows[5].mode == "lookup" and rows[6].m == "auc"


@pytest.mark.parametrize(("gold", "found", "want"), [("OR 1.20 (95% CI 1.10-1.32)", "OR: 1.21 (95%CI 1.10–1.32)", (3, 3)), ("AUC 0.8", "AUC 0.9", (0, 1)), (None, "OR 2", (0, 0))])
def test_label_match(spark, gold, found, want):
    df = spark.createDataFrame([(gold, found)], "g string, f string")
    assert tuple(effects.with_label_match(df, "g", "f").select("hit", "total").first()) == want


def test_stable_characters_need_no_normal_form():
    import re
    import unicodedata

    kept = [chr(i) for i in range(0x3000) if re.fullmatch(f"[{text.STABLE}]", chr(i))]
    assert len(kept) > 370 and all(unicodedata.normalize("NFKC", c) == c for c in kept)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in "aeAÉßž" for b in kept)
