"""Queries that SQL can't express, against plain versions of what they compute."""

import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from driftledger.llm import langid, licences, mixing, toxicity
from driftledger.llm.queries import QUERIES

SAID = {"aa": "ba bo bi bu be bam bom bim", "cc": "ka ko ki ku ke kam kom kim", "ee": "ßa ßo ßi ßu ße ßam"}


@pytest.fixture(scope="module")
def languages(spark, tmp_path_factory):
    rnd = random.Random(1)
    make = lambda lang, n: " ".join(rnd.choice(SAID[lang].split()) + rnd.choice(SAID[lang].split()) for _ in range(n))
    rows = [(k, make(lang, 20 + k % 90), lang, "s", 0) for k, lang in enumerate(["aa", "cc", "ee"] * 40)]
    rows += [(500, None, "aa", "s", 0), (501, "12 3", "cc", "s", 0), (502, make("aa", 5000), None, "s", 0), (503, make("cc", 9) + make("ee", 9), "cc", "t", 0)]
    folder = str(tmp_path_factory.mktemp("languages"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder, rows


def test_language_query_against_plain_compression(spark, languages):
    folder, rows = languages
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    learned = langid.dictionaries(docs.where(~langid.held_out("doc_id")))
    assert len(got) == len(rows) and all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, *_ in rows)
    packers = [zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in learned.values()]
    for k, text, *_ in rows:
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        raw = (" " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " ").encode()
        sizes = [sum(len(p.compress(raw[i : i + 2048])) for i in range(0, len(raw), 2048)) for p in packers]
        best, second = sorted(sizes)[:2]
        # the library may pack with a prepared dictionary a little differently: where it is close either may win
        if best < 0.97 * second:
            assert got[k].lang_pred == list(learned)[sizes.index(best)]
            assert math.isclose(got[k].score, 1 - best / second, abs_tol=0.03)
    none = docs.limit(0)
    assert langid.identify(none, learned).count() == 0 and langid.identify(docs, learned).count() == len(rows)


def test_toxicity_scores_against_a_plain_sum(spark):
    rnd = random.Random(11)
    texts = [" ".join([rnd.choice(["wort", "haus", "baum", "licht", "weg"]) + str(rnd.randint(0, 9)) for _ in range(25)] + ["vilexy"] * (k % 5 == 0) + ["&&&"] * (k % 7 == 0)) for k in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 == 0), int(k % 5 == 0)) for k in range(300)], "doc_id long, junk int, bad int")
    chain, _ = toxicity.train(docs, labels, ("junk", "bad"))
    got = {r.doc_id: (r.p_junk, r.p_bad) for r in toxicity.score(docs, chain).collect()}
    for k, text in [*enumerate(texts), (900, None), (901, "")]:
        own = [chain.index[f] for f in toxicity.features(text) if f in chain.index]
        odds: list[float] = []
        for w in chain.weights:
            n = len(chain.index)
            odds.append(sum(w[f] for f in own) + sum(a * b for a, b in zip(odds, w[n:-1], strict=True)) + w[-1])
        assert got[k] == pytest.approx([1 / (1 + math.exp(-o)) for o in odds], abs=1e-9)
    assert toxicity.score(docs.limit(0), chain).count() == 0 and toxicity.keep_clean(docs.limit(0), chain, "bad").count() == 0


def test_mixture_draws_against_a_plain_walk_over_blocks(spark):
    rows = [(k, s, "w " * n) for k, (s, n) in enumerate([("big", 9)] * 200 + [("mid", 6)] * 80 + [("small", 4)] * 25 + [("tail", 50_000)])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mixture(docs, target_entropy=0.95, block_tokens=120, seed=3).drawn(docs).collect()}
    size = {k: len(t.split()) for k, _, t in rows}
    total, of = sum(size.values()), {}
    for k, s, _ in rows:
        of.setdefault(s, []).append(k)
    hashed = lambda df, *c: {tuple(r[:-1]): r[-1] for r in df.select("*", F.xxhash64(*c).alias("h")).collect()}
    ids = spark.createDataFrame([(k,) for k in size], "id long")
    dealt = hashed(ids, F.lit(3), "id")
    for source, members in of.items():
        tokens, bought = sum(size[k] for k in members), got[members[0]].weight * total
        passes, blocks = math.floor(bought / tokens + 1e-9), max(1, math.ceil(tokens / 120))
        room = math.floor(bought - passes * tokens + 1e-6)
        block = {k: dealt[(k,)] % blocks for k in members}
        frame = spark.createDataFrame([(f"={source}", passes, b) for b in sorted(set(block.values()))], "key string, passes long, block long")
        turn = {b: h for (_, _, b), h in hashed(frame, F.lit(3), "key", "passes", "block").items()}
        within = hashed(ids.withColumn("p", F.lit(passes).cast("long")), F.lit(3), "p", "id")
        want = dict.fromkeys(members, passes)
        for b in sorted(turn, key=lambda b: (turn[b], b)):
            own = [k for k in members if block[k] == b]
            if sum(size[k] for k in own) > room:
                for k in sorted(own, key=lambda k: (within[(k, passes)], k)):
                    room -= size[k]
                    if room < 0:
                        break
                    want[k] += 1
                break
            room -= sum(size[k] for k in own)
            for k in own:
                want[k] += 1
        assert {k: got[k].n_copies for k in members} == want


def words_of(text):
    return [w for w in re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())]


def test_licences_against_plain_templates(spark):
    rnd = random.Random(8)
    prose = lambda n: " ".join(rnd.choice("the a of in work version public general house stone red is under".split()) for _ in range(n))
    granted = [rnd.choice(licences.TEMPLATES) for _ in range(60)]
    texts = [f"{prose(30)}\n\n{t}\n\n{prose(20)}" for _, t in granted] + [prose(120) for _ in range(60)] + ["word " * 40_000 + licences.TEMPLATES[4][1], None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs, licences.train(docs)).collect()}
    templates = [(f, " ".join(words_of(t))) for f, t in licences.TEMPLATES]
    # plainly: the longest template that a text holds in full tells its family
    for k, text in enumerate(texts):
        flat = f" {' '.join(words_of(text or ''))} "
        held = [(len(t), f) for f, t in templates if f" {t} " in flat]
        assert (got[k].family in {f for n, f in held if n == max(held)[0]}) if held else got[k].family is None, (k, text and text[:300])
    assert np.mean([got[k].family is not None for k in range(60)]) == 1
