import hashlib
import random
from collections import Counter

import pyarrow as pa

from attesta.llm import suffix_dedup as S
from attesta.llm._text import Bytes
from tests.llm.common import empty, odd


def brute(docs, n):
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(2)

    def text(k):
        return " ".join(rng.choice(["alpha", "béta", "gamma", "漢字", "x", "delta"]) + str(rng.randrange(999)) for _ in range(k))

    shared = [text(40) for _ in range(4)]
    docs = []
    for i in range(80):
        parts = [text(rng.randint(0, 60)) for _ in range(2)]
        if i % 2:
            parts.insert(1, rng.choice(shared)[rng.randrange(40) :])
        docs.append((i, "\n".join(parts)))
    docs += [(200, "ab" * 400), (201, "ab" * 150), (202, docs[3][1]), (3, docs[3][1]), (203, None), (204, "")]
    return docs


def test_against_brute_force(spark):
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.without_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 200)


def test_large_groups_are_compared_by_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 2)
    docs = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = S.without_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 200)


def test_long_texts_are_read_in_pieces():
    rng = random.Random(7)
    text = "".join(rng.choices("abcdef ", k=4000)).encode()
    own = Bytes(pa.array([text.decode()]))
    whole, cut = S.entries(own), S.entries(own, most=700)
    strings = [sorted((int(lo) + i, int(a)) for a, lo, n in zip(e[1], e[3], e[4], strict=True) for i in range(int(n))) for e in (whole, cut)]
    assert strings[0] == strings[1] and len(strings[0]) == 4000 - 199  # every string once, with its anchor
    assert len(cut[0]) > len(whole[0])


def test_cut_runs_give_the_same_result(spark, monkeypatch):
    entries = S.entries
    monkeypatch.setattr(S, "entries", lambda own, length=200, most=300: entries(own, length, most) if len(own.at) == 2 else entries(own, length))
    monkeypatch.setattr(S, "slices", lambda batch, column, limit=0: (batch.slice(i, 1) for i in range(batch.num_rows)))
    docs = corpus()
    got = S.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, 200)


def test_odd_rows(spark):
    got = {r.doc_id: r for r in S.without_repeats(odd(spark)).collect()}
    assert got[1].n_bytes == 0 and got[4].n_removed == got[4].n_bytes and got[5].n_removed == got[4].n_bytes
    assert got[7].n_removed == got[7].n_bytes
    assert S.without_repeats(empty(spark)).count() == 0


def test_levels_merge_geometrically(spark):
    family, d = S.IndexFamily(spark), spark.createDataFrame([(i, "y" * 250 + str(i)) for i in range(8)], "doc long, text string")
    for i in range(6):
        family.append(d.filter(f"doc = {i}"))
    assert [size for size, _ in family.levels] == [4, 1, 1] or [size for size, _ in family.levels] == [2, 2, 1, 1]
    family.drop()
