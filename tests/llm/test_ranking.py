"""Ranked search against scores of every pair, and packing against the library and a plain look at every sequence."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from driftledger.llm import packing as P
from driftledger.llm import ranking as R
from driftledger.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def scores(docs, items, k):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            found += [(-s, d is None, d or 0)] * (s > 0)
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_search_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    common, rare = [f"w{k}" for k in range(12)], [f"Ü{k}" for k in range(300)]
    text = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.6 else rnd.choice(rare) for _ in range(n))
    docs = [(k, text(rnd.randint(1, 60)).title()) for k in range(500)] + [(600 + k, "w1 w2 Ü7") for k in range(80)] + [(None, "w1 Ü7"), (3, "w2"), (3, "w2"), (700, None), (701, ""), (702, "W1 " * 4000 + "Ü9")]
    items = [(k, text(12)) for k in range(20)] + [(1, "Ü1 Ü2"), (90, None), (91, ""), (92, "unseen"), (None, "w1"), (93, "w1 w2 Ü7"), (94, "W1! w1, Ü7")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "2 as id", "'x' as term", "3 as item", "4 as score").repartition(3)
    asked = R.terms(spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as term"), "item_id", "text")
    index = R.build(table, asked if seed else None)
    for k in (1, 7, 50):
        assert sorted((tuple(r) for r in R.ranked(index, asked, k).collect()), key=repr) == scores(docs, items, k)


def test_searches_in_passes(spark, monkeypatch):
    monkeypatch.setattr(R, "PASS_TERMS", 5)
    docs, items = [(k, f"a{k % 7} b{k % 3} c") for k in range(60)], [(k, f"a{k} b{k} c") for k in range(6)]
    asked = R.terms(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    index = R.build(spark.createDataFrame(docs, "doc_id long, text string"), asked)
    assert sorted((tuple(r) for r in R.ranked(index, asked, 50).collect()), key=repr) == scores(docs, items, 50)
    with pytest.raises(ValueError):
        R.ranked(index, asked, R.HEAD + 1)


def test_nothing_to_search(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = R.terms(some.withColumnRenamed("doc_id", "item_id"), "item_id", "text")
    assert R.ranked(R.build(none, asked), asked).count() == 0
    assert R.ranked(R.build(some, asked.limit(0)), asked.limit(0)).count() == 0


def test_search_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL["op12_ranked_search"]).fetchall()
    assert sorted(tuple(r) for r in QUERIES["op12_ranked_search"](spark, DATA).collect()) == sorted(want)


def in_sequences(rows, capacity=2048):
    """The number of sequences of (sequence, offset, length), which must be without gaps and within capacity."""
    sequences = defaultdict(list)
    for s, o, n in rows:
        sequences[s].append((o, n))
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("low, high, n, most", [(1, 2048, 20_000, 1.006), (300, 700, 3_000, 1.01), (600, 1300, 20_000, 1.006), (1, 60, 5_000, 1.001)])
def test_plans(low, high, n, most):
    lengths = np.random.default_rng(low).integers(low, high, n)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    slots, sequences = P.plan(counts)
    rows, taken = [], Counter()
    for s in slots.tolist():
        length, first, count, per_bin, at, offset = s
        assert first == taken[length]
        taken[length] += count
        rows += [(at + j // per_bin, offset + j % per_bin * length, length) for j in range(count)]
    assert taken == counts and in_sequences(rows) == sequences
    assert sequences <= most * -(-int(lengths.sum()) // 2048) + 1
    assert len(slots) < 8 * 2048


def test_small_plans():
    for counts, want in (({}, 0), ({1: 1}, 1), ({2048: 3}, 3), ({1025: 10}, 10), ({700: 2, 648: 1}, 1), ({1: 4096}, 2), ({683: 9}, 5)):
        assert P.plan(counts)[1] == want


def test_packed_documents_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(5)
    texts = [None, "", "<|endoftext|>", "it's  a\n\n test<|endoftext|> !", " " * 9000 + "x", "a" * 30_000, "日本語" * 3000, "\u0085\x1c é" * 700]
    texts += ["".join(rnd.choice("abc  \n'é日1") for _ in range(rnd.randint(0, 9000))) for _ in range(60)]
    docs = [*enumerate(texts), (3, texts[3]), (None, "no id")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as place", "3 as task", "4 as number").repartition(4)
    rows = P.packed(P.pieces(table, with_ids=True)).collect()
    whole = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
    for doc, text in docs:
        whole[doc, tuple([*library.encode(text or "", add_special_tokens=False).ids, 0])] += 1
    for doc, own in by_doc.items():
        if doc == 3:
            assert len(own) == 2 and len({tuple(r.ids) for r in own}) == 1
            continue
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 2048 for r in own[1:])
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert whole[doc, tuple(t for r in own for t in r.ids)] == 1
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) for r in own)
    assert in_sequences([(r.sequence_id, r.offset, r.length) for r in rows]) <= 1.02 * -(-sum(r.length for r in rows) // 2048)
    assert P.packed(P.pieces(table.limit(0))).count() == 0


def test_packing_query(spark):
    rows = QUERIES["op13_best_fit_packing"](spark, DATA).collect()
    assert len({r.doc_id for r in rows}) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert in_sequences([(r.sequence_id, r.offset, r.length) for r in rows]) <= -(-sum(r.length for r in rows) // 2048) + 1
