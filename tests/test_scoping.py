import random

from attesta.functions import effects
from attesta.operators import filters, scoring


def test_scope_equals_testing_every_name(spark):
    rng = random.Random(61)
    word = lambda n: "".join(rng.choices("abcÄ ", k=n))
    rows = [(i, rng.choice([word(6), None]), rng.choice([word(4).upper(), None]), rng.choice(["r1", "r2", None])) for i in range(200)]
    refs, out = [word(n) for n in (3, 4, 5, 9) for _ in range(3)] + [word(2), None], ["ab", "cab", ""][:2]
    frame = spark.createDataFrame(rows, "row_id int, paper_ref string, cohort_id string, run_id string")
    asked, held = (spark.createDataFrame([(r,) for r in x], "ref string") for x in (refs, out))

    def want(held_out, run):
        kept = set()
        for i, p, c, r in rows:
            name = " ".join(x for x in (p, c) if x is not None).lower()
            if (run is None or r == run) and any(x is not None and x.lower() in name for x in refs) and not any(x in name for x in held_out):
                kept.add(i)
        return kept

    assert {r.row_id for r in filters.scope_rows(frame, asked).collect()} == want([], None)
    assert {r.row_id for r in filters.scope_rows(frame, asked, held, "r1").collect()} == want(out, "r1") != set()


def test_best_match_equals_all_pairs(spark):
    rng = random.Random(62)
    tokens = ["lactate", "score", "age", "il-6", "heart", "rate", "sofa", "x", "map"]
    name = lambda: rng.choice([" ".join(rng.choices(tokens, k=rng.randint(1, 7))), "", "--"])
    gold = [(f"g{i}", rng.choice(["C1", "C2 (Hagel, 2013)", "c3.", "zz"]), name()) for i in range(60)] + [("gn", None, None)]
    found = [(f"f{i:02d}", rng.choice(["C1", "c2", "C3", "C4"]), rng.choice([name(), None, ""]), name()) for i in range(60)]
    g = spark.createDataFrame(gold, "gold_id string, cohort_id string, predictor string")
    f = spark.createDataFrame(found, "found_id string, cohort_id string, predictors string, predictor_canonical string")
    named = scoring._named(f, scoring.F.coalesce(scoring.F.nullif("predictors", scoring.F.lit("")), "predictor_canonical"))
    gw = {r.gold_id: (r.cohort, set(r.name.split())) for r in scoring._by_cohort(scoring._named(g, scoring.F.col("predictor")), named, "cohort_id")[0].collect()}
    fw = [(r.found_id, r.cohort, set(r.name.split())) for r in scoring._by_cohort(g, named, "cohort_id")[1].collect()]

    def f1(a, b):
        return 1.0 if not a and not b else 0.0 if not a or not b else 2 * len(a & b) / (len(a) + len(b))

    for least in (0.0, 0.5):
        want = {}
        for k, (cohort, a) in gw.items():
            met = sorted((-f1(a, b), i) for i, c, b in fw if c == cohort and f1(a, b) > 0 and f1(a, b) >= least)
            if met:
                want[k] = (round(-met[0][0], 9), met[0][1])
        got = {r.gold_id: (round(r.f1, 9), r.found_id) for r in scoring.best_match(g, f, least=least).collect()}
        assert got == want and len(want) > 20


def test_the_scoping_query_keeps_rows_of_every_page(spark):
    from attesta.plans import registry
    from attesta.plans.evidence import evidence

    sf = "/root/testdata/sf0.001"
    got = registry.queries()["p16_scope_rows"](spark, sf)
    name = "lower(concat_ws(' ', paper_ref, cohort_id))"
    want = evidence(spark, sf).filter(f"({name} LIKE '%nation_3%' OR {name} LIKE '%c12%') AND {name} NOT LIKE '%c121%'")
    assert {r.row_id for r in got.collect()} == {r.row_id for r in want.collect()}
    assert not want.filter("anchor_page >= 8").isEmpty()
    assert "anchor_page" not in registry.oracle_sql()["p16_scope_rows"].rpartition("WHERE")[2]


def test_best_match_meets_equal_names_before_postings(spark):
    g = spark.createDataFrame([("g1", "c1", "heart rate", "OR 2"), ("g2", "c1", "heart", "x"), ("g3", "c9", "heart", "y")], "gold_id string, cohort_id string, predictor string, effect string")
    f = spark.createDataFrame([("f2", "c1", "heart rate"), ("f1", "c1", "rate heart"), ("f0", "c1", "heart rate score"), ("f3", "c2", "heart")], "found_id string, cohort_id string, predictors string")
    out = scoring.best_match(g, f, least=0.5, keep=("effect",), how="left")
    got = {r.gold_id: (r.effect, r.f1 and round(r.f1, 6), r.found_id) for r in out.collect()}
    assert got == {"g1": ("OR 2", 1.0, "f1"), "g2": ("x", 0.666667, "f1"), "g3": ("y", None, None)}


def test_lists_and_words_find_the_same_best_rows(spark, monkeypatch):
    rng = random.Random(63)
    tokens = ["lactate", "score", "age", "heart", "rate", "sofa", "x"]
    name = lambda: " ".join(rng.choices(tokens, k=rng.randint(0, 4)))
    ids = ["C1", "c1.", "C 1 (Hagel, 2013)", "ﬁve", "five", "Ｃ１", "2001 to 2005", "2001-2005", "2001to2005", "zz", None, "é"]
    g = spark.createDataFrame([(f"g{i:03d}", rng.choice(ids), name(), "e") for i in range(240)], "gold_id string, cohort_id string, predictor string, effect string")
    f = spark.createDataFrame([(f"f{i:03d}", rng.choice([*ids[:7], *ids[9:]]), name(), f"t{i}") for i in range(240)], "found_id string, cohort_id string, predictors string, effect string")
    gn, fn = scoring._by_cohort(scoring._named(g, scoring.F.col("predictor")), scoring._named(f, scoring.F.col("predictors")), "cohort_id")
    own, held = {r.gold_id: r.cohort for r in gn.collect()}, [(r.found_id, r.cohort, set(r.name.split())) for r in fn.collect()]
    want = {}
    for r in gn.collect():
        a = set(r.name.split())
        met = sorted((-(2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0), i) for i, c, b in held if c == own[r.gold_id])
        hit = met and met[0][0] <= -0.5
        want[r.gold_id] = ("e", bool(met), round(-met[0][0], 9) if hit else None, met[0][1] if hit else None, f"t{int(met[0][1][1:])}" if hit else None)
    for most in (scoring.CROWD, 30, 0):
        monkeypatch.setattr(scoring, "CROWD", max(most, 1))
        rows = scoring.best_match(g, f, least=0.5, keep=("effect",), how="left", seen=("effect",))
        got = {r.gold_id: (r.effect, r.has_cohort, r.f1 and round(r.f1, 9), r.found_id, r.found_effect) for r in rows.collect()}
        assert got == want and len({w[3] for w in want.values()}) > 50
        inner = scoring.best_match(g, f, least=0.5, seen=("effect",))
        assert {(r.gold_id, r.found_id, r.found_effect) for r in inner.collect()} == {(k, w[3], w[4]) for k, w in want.items() if w[3]}


def test_found_rows_are_moved_to_their_key_once(spark):
    g = spark.createDataFrame([("g", "C1", "heart rate")], "gold_id string, cohort_id string, predictor string")
    f = spark.createDataFrame([("f", "c1", "heart rate", "OR 2")], "found_id string, cohort_id string, predictors string, effect string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.best_match(g, f, least=0.5, seen=("effect",))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Join") == 3 and "ArrowEvalPython" not in plan  # each side to its names, and both to one another


def test_equal_texts_agree_without_reading_both(spark):
    rows = spark.createDataFrame([("OR 2.5, p<0.01", "OR 2.5, p<0.01"), ("OR 2.5", "HR 2.6"), ("none", "none"), (None, None), ("OR 2", None), ("9" * 400, "9" * 400)], "g string, f string")
    got = effects.with_label_match(rows, "g", "f").withColumn("ok", scoring.strict_numbers(scoring.F.col("g"), scoring.F.col("f")))
    assert [(r.hit, r.total, bool(r.ok)) for r in got.collect()] == [(2, 2, True), (0, 0, False), (0, 0, False), (0, 0, False), (0, 0, False), (0, 0, False)]
