import hashlib
import math
import random
import re
import time

import pyarrow as pa
import xxhash

from attesta.llm import _shared, fingerprints, packing, token_counts, urls
from attesta.llm._text import Bytes, Words, shingles
from tests.llm.common import empty, odd


def test_words_and_shingles():
    w = Words(Bytes(pa.array(["Foo, bar", "foo BAR baz", "", "é—x"])))
    assert w.at.tolist() == [0, 2, 5, 5, 6] and w.hash[0] == w.hash[2] and w.hash[1] == w.hash[3]
    _, at = shingles(w, 2)
    assert at.tolist() == [0, 1, 3, 3, 4]


def minima(text):
    """The signature of a text, one permutation and shingle at a time, in whole numbers."""
    words = Words(Bytes(pa.array([text], pa.large_string())))
    h, _ = shingles(words, 5)
    out = []
    for a, b in zip(fingerprints.A.tolist(), fingerprints.B.tolist(), strict=True):
        out.append(min((((x >> 32) * a + b) % 2**64 >> 32 for x in h.tolist()), default=fingerprints.EMPTY))
    return out


def check_report(docs, rows):
    """Every row against its own texts; docs are (doc_id, text) in the order of the operator."""
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for i, (k, t) in enumerate(docs):
        t, following = t or "", docs[(i + 1) % len(docs)][1] or ""
        cut = len(t) // 3
        new = t[: len(t) - cut] + following[:cut]
        mine, its, nxt = minima(t), minima(new), minima(following)
        want = (len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(f"{x:08x}" for x in mine), "".join(f"{x:08x}" for x in its))
        want += (sum(x == y for x, y in zip(mine, its, strict=True)) / 64, sum(x == y for x, y in zip(mine, nxt, strict=True)) / 64)
        assert want in [(r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got[k]]


def test_fingerprint_report(spark):
    rng = random.Random(4)
    docs = [(rng.randrange(10**12), " ".join(rng.choices(["ä", "bb", "ccc", "𝒳"], k=rng.randint(0, 60)))) for _ in range(150)] + [(5, None), (7, "x"), (7, "a b c"), (None, "b"), (None, "a a a a a a")]
    rows = fingerprints.fingerprint_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert len(rows) == len(docs)
    check_report(sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or "")), rows)


def test_alike_documents_against_all_pairs(spark):
    rng = random.Random(5)
    words, docs = [f"w{i}" for i in range(4000)], []
    for _ in range(40):
        base = rng.choices(words, k=80)
        for _ in range(rng.randint(1, 5)):
            new = list(base)
            for _ in range(rng.randint(0, 2)):
                new[rng.randrange(80)] = rng.choice(words)
            docs.append((len(docs) * 1009, " ".join(new)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.alike_id for r in fingerprints.fingerprint_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d[0]: docs[find(i)][0] for i, d in enumerate(docs)} and len(set(got.values())) < len(docs)


def test_fingerprints_odd_rows(spark):
    rows = fingerprints.fingerprint_report(odd(spark)).collect()
    assert len(rows) == 9 and {r.doc_id: r.alike_id for r in rows} == {1: 1, 2: 2, None: None, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert fingerprints.fingerprint_report(empty(spark)).count() == 0
    one = fingerprints.fingerprint_report(odd(spark).filter("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_url_rules_and_hosts(spark):
    rows = [
        (1, "https://a.EXAMPLE.com/en/71?x"), (2, "http://com/en/"), (3, "http://x.example.net/de/8/9#y"), (4, "http://x.net/de/1"), (5, "ftp://y.org/es/"),
        (6, None), (7, "no scheme"), (8, "http://spam-mails.example.org/en/1"), (9, "http://blog.thether.example.org/fr/1"), (10, "http://a://b/c"), (11, "http://notexample.com/en/7"),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(1, 6)] == [("example.com/en/7", "allow"), ("com/en/", "block"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got[1].host == "a.example.com" and got[1].path == "/en/71" and (got[6].host, got[7].path) == ("", "")
    assert got[8].verdict == "block" and got[9].verdict == "allow" and got[10].host == "a:" and got[11].rule == "com/en/"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_scores_by_hand(spark):
    weights, bias = urls.fit(spark, urls.LABELLED[::9], rounds=5)
    given = ["https://www.Free-Pills.test/En/7?x", "http://library.test/", None, "http://ünï.test/ä/1"]
    rows = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    got = {r.page_id: r.score for r in urls.judge(rows, model=(weights, bias)).collect()}
    for i, url in enumerate(given):
        host, path = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url).groups() if url else ("", "")
        total, n = 0.0, 0
        for name, text in (("host", re.sub("[A-Z]", lambda m: m[0].lower(), host)), ("path", path)):
            framed = f"^{text}$"
            for size in (3, 4):
                for at in range(len(framed) - size + 1):
                    h = xxhash.xxh64_intdigest(framed[at : at + size].encode(), seed=xxhash.xxh64_intdigest(name.encode(), seed=42))
                    total, n = total + weights[h % urls.BUCKETS], n + 1
        assert abs(got[i] - 1 / (1 + math.exp(-bias - total / math.sqrt(max(1, n))))) < 1e-9


def test_url_model_tells_other_names(spark):
    bad = ["casino-lucky", "xxx-films", "spam-robot", "free-pills", "ads-network", "warez-world"]
    good = ["botany", "sailing-club", "old-maps", "river-history", "tax-office", "children-books"]
    rows = spark.createDataFrame([(i, f"http://www.{h}.test/en/{i}") for i, h in enumerate(bad + good)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judge(rows).collect()}
    assert sum(got[i] == ("block" if i < 6 else "allow") for i in range(12)) >= 10


def test_rollup_is_idempotent(spark):
    rollup = token_counts.Rollup(spark)
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    one = spark.createDataFrame([("insert", "s", "en", "t", 10, 0), ("insert", "s", "en", "t", 5, 0), ("insert", None, None, "t", 1, 0)], kind)
    two = spark.createDataFrame([("delete", "s", "en", "t", 5, 0), ("revise", "s", "en", "t", 4, 10)], kind)
    assert rollup.commit("a", one) and not rollup.commit("a", one) and rollup.commit("b", two) and not rollup.commit("b", one)
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "t", 1, 4), (None, None, "t", 1, 1)}
    one.write.parquet(f"{rollup.folder}/data/lost")
    rollup.vacuum(hours=0)
    assert rollup.totals().count() == 2
    assert rollup.fold() and not rollup.commit("a", one) and rollup.commit("c", one) and rollup.fold()
    rollup.vacuum(hours=0)
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", "en", "t", 3, 19), (None, None, "t", 2, 2)}
    assert len(_shared.names(spark, f"{rollup.folder}/data")) == 2  # the snapshot and its list


def test_many_batches_are_folded(spark):
    rollup = token_counts.Rollup(spark, fold_every=2)
    kind = "op string, source int, lang string, tokenizer string, n_tokens long, old_tokens long"
    for i in range(4):
        assert rollup.commit(f"b{i}", spark.createDataFrame([("insert", 7, "en", "t", i, 0)], kind))
    assert _shared.names(spark, f"{rollup.folder}/snapshots") == ["1"] and [tuple(r) for r in rollup.totals().collect()] == [("7", "en", "t", 4, 6)]


def test_corpus_rollup_counts_whole_documents(spark):
    rows = token_counts.corpus_rollup(odd(spark)).collect()
    words = [r for r in rows if r.tokenizer == "words-1"]
    assert sum(r.n_docs for r in words) == 9 and sum(r.unique_docs for r in words) == 7  # null and empty text are alike
    assert sum(r.n_tokens for r in words) == 6 + 80 + 80 + 82 + 5 + 16000 and sum(r.n_tokens - r.unique_tokens for r in words) == 80
    assert sum(r.n_tokens for r in rows if r.tokenizer == "spaces-1") == 6 + 80 + 80 + 82 + 6 + 16000 + 3
    assert token_counts.corpus_rollup(empty(spark)).count() == 0


def totals(frame):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.unique_docs, r.unique_tokens) for r in frame.collect()}


def test_corpora_add_to_one_folder(spark, monkeypatch):
    kind = "doc_id long, text string, lang string, source string"
    one = spark.createDataFrame([(2, "a b c", "en", "s"), (1, "a b c", "en", "t"), (3, "a-b", None, "s")], kind)
    two = spark.createDataFrame([(7, "a b c", "en", "u"), (8, "new", "en", "u"), (8, "new", "en", "u")], kind)
    folder = _shared.shared_dir(spark)
    first = totals(token_counts.corpus_rollup(one, folder))
    assert first[("s", "en", "spaces-1")] == (1, 3, 0, 0) and first[("t", "en", "words-1")] == (1, 3, 1, 3) and first[("s", None, "words-1")] == (1, 2, 1, 2)
    assert totals(token_counts.corpus_rollup(one, folder)) == first  # the same again

    real, calls = token_counts.Rollup.commit, []

    def breaks(self, batch, changes):
        calls.append(batch)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(self, batch, changes)

    monkeypatch.setattr(token_counts.Rollup, "commit", breaks)
    try:
        token_counts.corpus_rollup(two, folder)
        raise AssertionError("it should have broken off")
    except RuntimeError:
        pass
    monkeypatch.setattr(token_counts.Rollup, "commit", real)
    both = totals(token_counts.corpus_rollup(two.repartition(3), folder))
    assert {k: v for k, v in both.items() if k in first} == first and both[("u", "en", "words-1")] == (3, 5, 1, 1)
    assert totals(token_counts.corpus_rollup(one, folder)) == both


def test_repeated_rows_have_bins_of_their_own(spark):
    rows = [(7, 5000, "s", 1)] * 3 + [(None, 2048, None, None)] * 3 + [(8, 30, "s", 2)] * 50 + [(None, 30, "s", None)] * 50 + [(2**60 + 1, 9, None, -(2**62) - 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster long").repartition(3), max_per_source=4, part_rows=40).collect()
    held = {}
    for r in got:
        held.setdefault(r.bin_id, []).append(r)
    assert all(sum(r.n_tokens for r in own) <= 2048 for own in held.values()) and sum(r.n_tokens for r in got) == sum(r[1] for r in rows)
    assert all(sum(r.doc_id == 8 for r in own) <= 1 and sum(r.n_tokens == 30 for r in own) <= 4 for own in held.values()) and any(r.doc_id == 2**60 + 1 for r in got)


def test_a_run_of_like_items_is_not_quadratic():
    start = time.perf_counter()
    bins, _ = packing.best_fit([30] * 20_000, [0] * 20_000, [0] * 20_000, 2048, 4)
    assert bins == list(range(20_000)) and time.perf_counter() - start < 5
    bins, _ = packing.best_fit([30] * 20_000, [0] * 20_000, [-1] * 20_000, 2048, 4)
    assert bins == [i // 4 for i in range(20_000)] and time.perf_counter() - start < 10


def test_best_fit_takes_the_tightest_compatible_bin(spark):
    rng = random.Random(6)
    docs = [(i, rng.randint(0, 300), f"s{rng.randrange(4)}", rng.choice([None, rng.randrange(30)])) for i in range(400)] + [(None, 5, None, None)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, n_tokens long, source string, cluster long"), capacity=128, max_per_source=2, part_rows=100).collect()
    by = {}
    for r in got:
        if r.bin_id:
            by.setdefault(r.bin_id, []).append(r)
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d[0]: d[1] for d in docs}
    info = {d[0]: d for d in docs}
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert sum(r.n_tokens for r in rows) <= 128 and all(a.offset + a.n_tokens == b.offset for a, b in zip(rows, rows[1:], strict=False))
        for k, most in ((2, 2), (3, 1)):
            names = [info[r.doc_id][k] for r in rows if info[r.doc_id][k] is not None]
            assert all(names.count(x) <= most for x in names)


def test_best_fit_equals_search_over_all_bins():
    rng = random.Random(8)
    lengths = sorted((rng.randint(1, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rng.randrange(3) for _ in lengths], [rng.choice([-1, rng.randrange(9)]) for _ in lengths]
    bins, _ = packing.best_fit(lengths, sources, clusters, 100, 2)
    state = []
    for i, n in enumerate(lengths):
        fits = [(b["room"], k) for k, b in enumerate(state) if b["room"] >= n and b["s"].count(sources[i]) < 2 and (clusters[i] < 0 or clusters[i] not in b["c"])]
        k = min(fits)[1] if fits else len(state)
        if not fits:
            state.append({"room": 100, "s": [], "c": []})
        state[k]["room"] -= n
        state[k]["s"].append(sources[i])
        state[k]["c"].append(clusters[i])
        assert bins[i] == k


def test_packing_odd_rows(spark):
    rows = packing.pack(packing.document_lengths(odd(spark)), capacity=64).collect()
    assert sum(r.n_tokens for r in rows if r.doc_id == 7) == 16000 and len({r.bin_id for r in rows if r.doc_id == 4 and r.piece == 1}) == 2
    assert packing.pack(packing.document_lengths(empty(spark))).count() == 0
