import hashlib
import random
import re

from attesta.llm.decontaminate import clean_documents, contamination_report, slot_bits
from tests.llm.common import empty, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, n=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall((text or "").translate(FOLD)), set(), set()
        for item, t in items:
            b = WORD.findall((t or "").translate(FOLD))
            k = min(n, len(b))
            grams = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "cé", "d1", "É", "zz", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 14])))) for i in range(12)] + [(90, None), (91, "... !")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))]
        if i % 3 == 0:
            parts.insert(0, (rng.choice(items)[1] or "").upper() if i % 2 else rng.choice(items)[1] or "")
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (7, "other text under the same id")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, contamination_report(d, b).collect()), key=repr) == brute(docs, items)
    clean = {r.doc_id for r in clean_documents(d, b).collect()}
    assert {x[0] for x in brute(docs, items) if not x[5]} - {7} == clean - {7}


def test_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(None, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert contamination_report(odd(spark), none).count() == 9
    rows = contamination_report(odd(spark), some).filter("contaminated").collect()
    assert [(r.doc_id, r.n_hit, r.n_items) for r in rows] == [(None, 6, 0)]
    assert contamination_report(empty(spark), some).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "one two three", "k", 1, "h")], "doc_id long, text string, __text_key string, hit_id int, hit_key string")
    items = spark.createDataFrame([(1, "not there at all")], "item_id long, text string")
    assert [tuple(r) for r in clean_documents(docs, items).collect()] == [(1, "one two three", "k", 1, "h")]


def test_the_bit_set_grows_with_the_windows():
    assert slot_bits(0) == 14 and slot_bits(100_000) == 15 and slot_bits(10**9) == 17
