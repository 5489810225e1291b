"""Closed vocabularies: predictors, methods, settings, outcomes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import norm_field, text_of

# The categories, names, patterns and synonyms below define results.

CATEGORIES = {
    "biomarker": ("lactate", "il-6", "il6", "interleukin-6", "crp", "c-reactive protein", "procalcitonin", "pct", "presepsin", "lymphocyte count", "lymphocytes", "neutrophil count", "neutrophils", "platelets", "white blood cells", "wbc", "creatinine", "bilirubin", "ddimer", "d-dimer", "ferritin"),
    "score": ("sofa", "apache ii", "apache-ii", "apacheii", "saps", "saps ii", "qsofa", "news", "news2", "mews", "sirs"),
    "demographic": ("age", "sex", "gender", "race", "ethnicity", "bmi"),
    "physiologic": ("heart rate", "hr", "respiratory rate", "rr", "blood pressure", "map", "mean arterial pressure", "temperature", "spo2", "oxygen saturation", "gcs", "glasgow coma scale"),
}

METHODS = (
    (r"\blogistic\s+regression\b", "regression", "logistic regression"),
    (r"\b(cox\s+(proportional\s+hazards?|ph)|cox\s+regression)\b", "survival", "Cox PH"),
    (r"\bkaplan[\s-]meier\b", "survival", "Kaplan-Meier"),
    (r"\blinear\s+regression\b", "regression", "linear regression"),
    (r"\b(elastic[\s-]?net|lasso|ridge)\b", "regression", "regularized regression"),
    (r"\bxgboost\b", "ml", "XGBoost"),
    (r"\b(gradient\s+boost(ing|ed)?(\s+(tree|machine|model)s?)?|gbm|lightgbm)\b", "ml", "gradient boosting"),
    (r"\brandom\s+forest\b", "ml", "random forest"),
    (r"\b(neural\s+network|deep\s+learning|mlp|cnn|rnn|lstm|transformer)\b", "ml", "neural network"),
    (r"\bsupport\s+vector\b", "ml", "SVM"),
    (r"\bnaive\s+bayes\b", "ml", "naive Bayes"),
    (r"\bk[\s-]?nearest\s+neighbo(u)?rs?\b", "ml", "KNN"),
    (r"\bdiscriminant\s+analysis\b", "ml", "discriminant analysis"),
    (r"\bdecision\s+tree\b", "ml", "decision tree"),
    (r"\b(roc\s+analysis|receiver\s+operating)\b", "other", "ROC analysis"),
    (r"\bsofa\b", "score", "SOFA"),
    (r"\bapache[\s-]?ii\b", "score", "APACHE-II"),
    (r"\bqsofa\b", "score", "qSOFA"),
    (r"\bsaps\b", "score", "SAPS"),
    (r"\bnews2\b", "score", "NEWS2"),
    (r"\bnews\b", "score", "NEWS"),
)

SETTINGS = (
    (r"\b(picu|pediatric\s+(icu|intensive\s+care)|paediatric\s+(icu|intensive\s+care))\b", "pediatric ICU"),
    (r"\b(nicu|neonatal\s+(icu|intensive\s+care))\b", "neonatal ICU"),
    (r"\b(icu|intensive\s+care\s+unit|critical\s+care)\b", "ICU"),
    (r"\b(ed|emergency\s+department|emergency\s+room|er)\b", "ED"),
    (r"\b(operating\s+room|or\s+suite|perioperative)\b", "OR"),
    (r"\b(prehospital|pre[\s-]?hospital|ambulance|ems)\b", "prehospital"),
    (r"\b(general\s+ward|hospital\s+ward|ward\b|inpatient\s+ward)\b", "ward"),
    (r"\bmixed\b", "mixed"),
)

PREDICTORS = {
    "lactate": ("lactate", "lac", "serum lactate", "blood lactate"),
    "qSOFA": ("qsofa", "quick sofa", "q-sofa"),
    "SOFA": ("sofa", "sofa score", "sequential organ failure assessment"),
    "APACHE_II": ("apache ii", "apache 2", "apache-ii", "apache ii score"),
    "APACHE_IV": ("apache iv", "apache 4", "apache-iv"),
    "SAPS_II": ("saps ii", "saps 2", "saps-ii", "simplified acute physiology score ii"),
    "APS_III": ("aps iii", "aps 3", "aps-iii"),
    "OASIS": ("oasis",),
    "SIRS": ("sirs", "systemic inflammatory response syndrome"),
    "LODS": ("lods", "logistic organ dysfunction"),
    "MEWS": ("mews",),
    "NEWS": ("news",),
    "SMRS": ("smrs",),
    "age": ("age",),
    "sex": ("sex", "gender", "male", "female"),
    "race": ("race", "ethnicity"),
    "DBP": ("dbp", "diastolic blood pressure"),
    "SBP": ("sbp", "systolic blood pressure"),
    "MAP": ("map", "mean arterial pressure"),
    "respiratory_rate": ("respiratory rate", "resp rate", "rr"),
    "ALP": ("alp", "alkaline phosphatase"),
    "LDH": ("ldh", "lactate dehydrogenase"),
    "CK": ("ck", "creatine kinase"),
    "RBC": ("rbc", "red blood cell"),
    "albumin": ("albumin",),
    "hemoglobin": ("hemoglobin", "hb", "hgb"),
    "potassium": ("potassium", "k+"),
    "calcium": ("calcium", "ca2+"),
    "mechanical_ventilation": ("mechanical ventilation", "mech vent", "ventilation"),
    "vasopressor": ("vasopressor", "vasopressors", "noradrenaline", "norepinephrine"),
    "EDV": ("edv", "end-diastolic velocity", "end diastolic velocity"),
    "PSV": ("psv", "peak systolic velocity"),
    "RI": ("resistive index",),
    "IL-6": ("il-6", "il 6", "il_6", "interleukin-6", "interleukin 6", "interleukin6"),
    "IL-8": ("il-8", "il 8", "il_8", "interleukin-8", "interleukin 8"),
    "IL-10": ("il-10", "il 10", "il_10", "interleukin-10", "interleukin 10"),
    "PCT": ("pct", "procalcitonin"),
    "CRP": ("crp", "c-reactive protein", "c reactive protein"),
    "WBC": ("wbc", "white blood cell", "white blood cell count", "leukocyte"),
}

WINDOWS = (("28-day", 28), ("28 day", 28), ("30-day", 30), ("30 day", 30), ("60-day", 60), ("90-day", 90), ("180-day", 180), ("1-year", 365), ("one-year", 365), ("365-day", 365))

OUTCOMES = {
    "ICU": ("in-icu", "in icu", "icu", "icu mortality", "in-icu mortality", "in icu mortality"),
    "HOSPITAL": ("in-hospital", "in hospital", "hospital mortality", "in-hospital mortality", "in hospital mortality"),
    "28D": ("28-day", "28 day", "28d", "28-day mortality", "28 day mortality"),
    "30D": ("30-day", "30 day", "30d", "30-day mortality", "30 day mortality"),
    "90D": ("90-day", "90 day", "90d", "90-day mortality", "90 day mortality"),
    "1Y": ("1-year", "1 year", "one-year", "one year", "365-day", "1-year mortality", "one-year mortality", "one year mortality"),
}

ABBREVIATIONS = {
    "dbp": "diastolic blood pressure", "sbp": "systolic blood pressure", "rbc": "red blood cell", "wbc": "white blood cell",
    "ck": "creatine kinase", "ldh": "lactate dehydrogenase", "alp": "alkaline phosphatase",
    "saps ii": "simplified acute physiology score ii", "saps": "simplified acute physiology score",
    "apache ii": "acute physiology and chronic health evaluation ii", "apache iv": "acute physiology and chronic health evaluation iv",
    "sofa": "sequential organ failure assessment", "edv": "end-diastolic velocity", "psv": "peak systolic velocity", "ri": "resistive index",
    "bun": "blood urea nitrogen", "ne": "norepinephrine", "hr": "heart rate", "rr": "respiratory rate",
    "inr": "international normalized ratio", "ca": "calcium", "spo2": "oxygen saturation",
}

TIMINGS = (r"within\s+24\s*h(?:our)?s?\s+of\s+icu\s+admission", r"first\s+24\s*h(?:our)?s?", r"icu\s+day\s+1\b", r"day\s+1\s+of\s+icu", r"first\s+day\s+(?:in|of)\s+icu", r"24\s*h(?:our)?s?\s+after\s+icu\s+admission")


def _bounded(word: str) -> str:
    body = r"\s+".join(re.escape(w) for w in word.split(" "))
    return rf"(?<![a-z0-9]){body}(?![a-z0-9])"


def predictor_category(c: Column) -> Column:
    key = F.lower(F.trim(text_of(c)))
    out = F.when(key == "", "other")
    for name, words in CATEGORIES.items():
        out = out.when(key.isin(*words), name)
    return out.otherwise("other")


def _first(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    out = F.when(c.isNull(), None)
    for pattern, label in table:
        out = out.when(c.rlike(f"(?i){pattern}"), label)
    return out


def method_family(c: Column) -> Column:
    return F.coalesce(_first(c, tuple((p, f) for p, f, _ in METHODS)), F.lit("other"))


def method_name(c: Column) -> Column:
    return F.coalesce(_first(c, tuple((p, n) for p, _, n in METHODS)), F.lit("other"))


def care_setting(*texts: Column) -> Column:
    return F.coalesce(*[_first(t, SETTINGS) for t in texts], F.lit("unknown"))


def any_synonym(words: tuple[str, ...]) -> str:
    """Pattern that finds any of the words, bounded by other characters than letters and digits."""
    return "|".join(_bounded(w) for w in words)


def mentioned_predictor(c: Column) -> Column:
    """The first predictor of the vocabulary with a synonym in the text."""
    low = F.lower(text_of(c))
    out = F.when(low == "", None)
    for canon, words in PREDICTORS.items():
        out = out.when(low.rlike(any_synonym(words)), canon)
    return out


def canonical_predictor(c: Column) -> Column:
    """Exact name, else the first predictor mentioned, else the text in lower case; NULL for no text."""
    key = F.lower(F.trim(text_of(c)))
    exact = F.when(key == "", None)
    for canon in PREDICTORS:
        exact = exact.when(key == canon.lower(), canon)
    return F.when(key != "", F.coalesce(exact, mentioned_predictor(key), key))


def outcome_class(c: Column) -> Column:
    """Class of the whole text, of it without 'mortality', or of the first alias in it; else the text."""
    n = norm_field(c)
    short = F.trim(F.regexp_replace(n, r"\s*mortality\s*$", ""))
    whole, trimmed, part = F.when(n == "", ""), F.when(n == "", ""), F.when(n == "", "")
    for name, words in OUTCOMES.items():
        whole, trimmed = whole.when(n.isin(*words), name), trimmed.when(short.isin(*words), name)
        part = part.when(n.rlike("|".join(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])" for w in words)), name)
    return F.coalesce(whole, trimmed, part, n)


def expand(c: Column) -> Column:
    """Abbreviations written out, longest first, one after the other."""
    order = sorted(ABBREVIATIONS, key=len, reverse=True)
    return reduce(lambda s, a: F.regexp_replace(s, rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", ABBREVIATIONS[a]), order, norm_field(c))


def timing_bucket(c: Column) -> Column:
    n = norm_field(c)
    return F.when(n.rlike("|".join(TIMINGS)), "FIRST_24H_ICU").otherwise(n)
