"""Ball-tree search, online packing and spelling groups against brute force."""

import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attesta.llm import ball_search, online_packing, oracles, queries, spelling
from tests.llm.common import empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def twin(name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(oracles.ORACLES[name])
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["op11_ball_search", "op13_spelling"])
def test_queries_equal_their_sql(spark, name):
    columns, want = twin(name)
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert want and Counter(map(tuple, got)) == Counter(want)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(docs, items, k):
    """Every document scored for every item."""
    bags = [Counter(TERM.findall(fold(t))) for _, t in docs]
    n_docs, n_terms = sum(map(bool, bags)), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), b in zip(docs, bags, strict=True):
            s = 0
            for t in TERM.findall(fold(text)):
                if b[t]:
                    m = 100 - 25 + 25 * sum(b.values()) * n_docs // n_terms
                    s += floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Ärger", "漢字", "É"]
    docs = [(i, " ".join(rng.choices(vocabulary[: rng.choice([20, 123])], k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(i + n, docs[i % 7][1]) for i in range(40)] + [(None, docs[0][1]), (None, docs[0][1]), (3, docs[3][1]), (9999, None), (9998, ""), (9997, "!?")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(12)] + [(None, "w1 w1 w2"), (5, "w3"), (77, None), (78, "nowhere"), (79, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("tree_docs", [4096, 100])
def test_search_equals_scoring_all_documents(spark, tree_docs):
    docs, items = corpus(11)
    got = ball_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=7, block_items=5, tree_docs=tree_docs)
    assert Counter(map(tuple, got.collect())) == Counter(ranked(docs, items, 7))


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    n, terms = 2000, 400
    topic = rng.integers(0, 20, n)
    rows, cols, vals = [0], [], []
    for i in range(n):
        t = np.unique(np.concatenate((rng.integers(0, 20, 4), topic[i] * 19 + 20 + rng.integers(0, 19, 6))))
        cols += t.tolist()
        vals += rng.integers(1, 500_000, len(t)).tolist()
        rows.append(len(cols))
    rows, cols, vals = np.array(rows), np.array(cols), np.array(vals)
    tree = ball_search.Tree.build(np.arange(n), np.ones(n, bool), rows, cols, vals, terms)
    tree.by_coordinate(terms)
    leaves = int((tree.right == 0).sum())
    for topic_no in range(5):
        q_terms = np.unique(topic_no * 19 + 20 + rng.integers(0, 19, 5))
        q = rng.integers(100, 9000, len(q_terms))
        dense = np.zeros(terms, np.int64)
        dense[q_terms] = q
        scores = np.array([(dense[tree.terms[a:z]] * tree.values[a:z]).sum() for a, z in zip(tree.rows[:-1], tree.rows[1:], strict=True)])
        bounds = tree.bounds(q_terms, q)
        assert all(scores[lo:hi].max() <= b for lo, hi, b in zip(tree.lo, tree.hi, bounds, strict=True))
        best: list = []
        scored = tree.search(q_terms, q, dense, best, 10)
        want = sorted(((int(s), 1, -int(i)) for s, i in zip(scores, tree.ids, strict=True) if s), reverse=True)[:10]
        assert sorted(best, reverse=True) == want and scored < leaves / 2


def test_search_odd_rows(spark):
    docs = odd(spark)
    items = spark.createDataFrame([("a", "wort001 WORT002 alpha", 1), ("b", None, 2)], "item_id string, text string, doc_id long")
    want = ranked([(r.doc_id, r.text) for r in docs.collect()], [("a", "wort001 WORT002 alpha"), ("b", None)], 20)
    assert Counter(map(tuple, ball_search.search(docs, items).collect())) == Counter(want)
    assert ball_search.search(empty(spark), items).count() == 0 and ball_search.search(docs, items.limit(0)).count() == 0


def check_packing(docs, rows, capacity, tokenizer):
    """Each id of each document lies in one piece, sequences have no gaps and little padding."""
    want = Counter()
    for doc, text in docs:
        want[(doc, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [0]))] += 1
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False)) and sum(r.length for r in own) <= capacity
    seen = Counter()
    for (doc, ids), times in want.items():
        mine = [r for r in by_doc[doc, len(ids)] if r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.start + r.length <= len(ids)]
        seen[doc, ids] = sum(r.length for r in mine) / len(ids)
        assert seen[doc, ids] >= times
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    return len(by_sequence)


def test_tokens_are_packed_once(spark):
    rng = random.Random(12)
    syllables = ["the ", "ion", "é", "Straße ", "12", "...", "\n\n", "  ", "'s", "漢字", "🙂", "<|endoftext|>", "\t", "_", "²", "\x85"]
    docs = [(i, "".join(rng.choices(syllables[: rng.choice([9, 16])], k=rng.randint(0, 400)))) for i in range(250)] + [(1, None), (None, "a b"), (None, ""), (7, "x " * 9000), (8, "same"), (8, "same")]
    tokenizer = Tokenizer.from_file(PATH)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    for least_cut in (8, 128):
        rows = online_packing.pack_tokens(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), PATH, capacity=128, open_windows=4, least_cut=least_cut, merge_partitions=2).collect()
        n = check_packing(docs, rows, 128, tokenizer)
        assert n <= total / 128 * (1.04 if least_cut == 8 else 1.2) + 3


def test_ids_are_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    safe = [chr(c) for c in [9, 10, 13, *range(32, 0x2028)] if online_packing.SAFE.fullmatch(chr(c))]
    assert len(safe) > 500
    texts = [f"a{c}b {c}{c}1{c} {c} " for c in safe] + ["don't we'll", "x" * 50 + "  \n y", " <|endoftext|> ", "", "   ", "a1b2_c"]
    ids = online_packing.Ids(PATH, remembered=40)
    assert ids.of(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    long = ("wort und " * 300_000) + "Ende"
    assert ids.of([long]) == [np.array(tokenizer.encode(long, add_special_tokens=False).ids, "<u4").tobytes()]


def test_packing_odd_tables(spark):
    docs = odd(spark)
    check_packing([(r.doc_id, r.text) for r in docs.collect()], online_packing.pack_tokens(docs, PATH).collect(), 1024, Tokenizer.from_file(PATH))
    assert online_packing.pack_tokens(empty(spark), PATH).count() == 0


def grouped(docs, least_length=6, least_count=5, ratio=5, slips=199):
    """Spelling groups by comparing all words with each other."""
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least_length
    n = {w: c for w, c in n.items() if c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, count = {}, {}
    for w in n:
        own = [x for x in n if near(w, x)]
        count[w] = len(own)
        best = min(own, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n[w], count[w], forms[w], n[forms[w]] if forms[w] else None, root))
    return out


def misspelt(seed):
    rng = random.Random(seed)
    words = ["straße", "Straßen", "grüßend", "letters", "letter", "ßßßßßß", "École-écoles", "aaaaaaa", "aaaaaaaa", "zzzzzzz", "x" * 300]
    docs = []
    for i in range(120):
        text = []
        for _ in range(30):
            w = rng.choices(words, weights=range(len(words), 0, -1))[0]
            at = rng.randrange(len(w))
            text.append(rng.choice([w, w, w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("eßÿ") + w[at:], w[:at] + rng.choice("ab") + w[at + 1 :]]))
        docs.append((i * 37, " ".join(text)))
    docs += [(1000 + i, w * n) for w, n, times in (("kettedc ", 20, 20), ("ketteac ", 12, 5), ("ketteab ", 3, 2)) for i in range(times)]
    return docs + [(None, docs[0][1]), (5, None), (5, ""), (5, docs[1][1]), (5, docs[1][1])]


@pytest.mark.parametrize("round_words", [1 << 22, 11])
def test_spelling_groups_equal_all_pairs(spark, round_words):
    docs = misspelt(13)
    got = spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"), slips=19, round_words=round_words).collect()
    want = grouped(docs, slips=19)
    assert len(got) == len(want) and {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want
    assert sum(r.form is not None for r in got) > 10 and any(r.form and r.root != r.form for r in got)


def test_filters_travel_in_bounded_rounds():
    plan = spelling.rounds({6: 10, 7: 25, 8: 3}, 10)
    assert all(sum(n for n, _, _ in r.values()) <= 10 for r in plan)
    assert sorted((length, x[2]) for r in plan for length, x in r.items()) == [(6, 0), (7, 0), (7, 1), (7, 2), (8, 0)]
    assert spelling.rounds({}, 10) == []


def test_filters_let_few_others_through():
    words = [f"{i:07d}" for i in range(20_000)]
    own = spelling.Filter(10_000)
    h = spelling.Letters(words, 7).hash
    _, block, mask = own.places(h[:10_000])
    np.bitwise_or.at(own.bits, block, mask)
    assert own.may_hold(h[:10_000]).all() and own.may_hold(h[10_000:]).mean() < 0.02


def test_spelling_odd_rows(spark):
    docs = odd(spark)
    got = spelling.spelling_groups(docs, least_count=1).collect()
    assert {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == grouped([(r.doc_id, r.text) for r in docs.collect()], least_count=1)
    assert spelling.spelling_groups(empty(spark)).count() == 0
