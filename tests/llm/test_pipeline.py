"""The pipeline: what each stage drops and keeps, and that its parts hang together."""

import corpus_pipeline as P
import __spark_entry__ as entry
from driftledger.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, rows = docs, {}
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        rows[name] = (before.count(), after.count())
        before = after
    last = P.mix_sources(spark, before, DATA)
    assert last.columns == [*docs.columns, "weight", "n_copies"] and last.count() == before.count()
    assert last.where("n_copies < 1").count() == 0
    assert rows["secret scans"][0] == rows["secret scans"][1]
    # nothing toxic by its label, no two copies of a text
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").count()
    left = before.join(labels.where("toxic = 1"), "doc_id").count()
    assert left <= 0.3 * toxic
    assert before.select("text").distinct().count() == before.count()


def test_repeated_and_odd_documents(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    passage = benchmark.orderBy("item_id").first().text
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, None, None, None, None), (None, "x", "en", "a", 1), (None, "x", "en", "a", 1)]
    # an id with a clean and a contaminated text, a contaminated text without an id, a very long text
    rows += [(5, passage, "en", "a", 1), (5, "a clean text of its own words", "en", "a", 1), (None, passage + " and", "en", "b", 1), (4, "token = abcdefghijklmnop", "en", None, 9), (6, "long words " * 60_000, "en", "b", 1)]
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    made = spark.createDataFrame(rows, schema)
    made.repartition(3).write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        got = P.drop_near_duplicates(spark, docs, DATA)
        assert got.columns == docs.columns
        assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in got.collect()) == sorted([(1, text[:9]), (3, ""), (0, "x"), (5, passage[:9]), (5, "a clean t"), (4, "token = a"), (6, "long word")])
        clean = P.drop_contaminated(spark, docs, DATA)
        assert clean.columns == docs.columns
        assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in clean.collect()) == sorted((d or 0, (t or "")[:9]) for d, t, *_ in rows if not (t or "").startswith(passage))
        masked = {r.doc_id: (r.text, r.n_chars) for r in P.mask_secrets(spark, docs, DATA).collect()}
        assert masked[4] == ("[REDACTED]", 10) and masked[3] == (None, None)
        kept = P.drop_toxic(spark, docs, DATA)
        assert kept.columns == docs.columns and kept.count() <= len(rows)
    for _, stage in P.STAGES:
        assert stage(spark, made.limit(0), DATA).count() == 0


def test_further_columns_stay(spark):
    """Columns whose names the operators use inside."""
    docs = spark.createDataFrame([(k, f"text {k} of several words for all", "en", "a", 9) for k in range(6)], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    wide = docs.selectExpr("*", "1 as id", "2 as fp", "3 as key", "4 as component_id", "'x' as hits", "5 as n_copies_", "6 as same")
    for stage in (P.drop_near_duplicates, P.drop_contaminated, P.mask_secrets, P.drop_toxic):
        got = stage(spark, wide, DATA)
        assert got.columns == wide.columns and got.where("id = 1 and fp = 2 and hits = 'x'").count() == got.count()


def test_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{k}" for k in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and "pipeline" not in entry.oracle_sql()
