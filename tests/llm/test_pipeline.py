import corpus_pipeline
from sigmill.llm import decontamination, langid, neardup, packing, queries, toxicity

from .helpers import ODD, docs as table_of
from .test_neardup import fixture, shingles

SF = "/root/testdata/sf0.001"


def test_stages_are_the_operators_decisions(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns, name
        before, after = ({r["doc_id"] for r in x.collect()} for x in (docs, kept))
        if name == "toxicity":
            lexicon = toxicity.learn(corpus_pipeline.learning_rows(docs), corpus_pipeline.learning_rows(queries.table(spark, SF, "labels")))
            expected = {r["doc_id"] for r in toxicity.score(docs.select("doc_id", "text"), lexicon).collect() if r["score"] < 0.3}
        elif name == "language_id":
            model = langid.learn(corpus_pipeline.learning_rows(docs))
            expected = {r["doc_id"] for r in langid.identify(docs.select("doc_id", "text"), model).collect() if r["lang_pred"] != "und" and r["score"] >= 0.3}
        elif name == "near_dedup":
            expected = {r["doc_id"] for r in neardup.near_duplicates(docs, percent=corpus_pipeline.NEAR_PERCENT).collect() if r["kept"]}
        else:
            expected = before - {r["doc_id"] for r in decontamination.contamination(docs, queries.table(spark, SF, "benchmark")).collect()}
        assert after == expected and after <= before, name
        assert len(after) >= 0.6 * len(before), name
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    last = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pack(docs, queries.tokenizer_path()).collect())
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) == last


def smallest_of_groups(rows, percent):
    """The smallest doc_id of each group of rows (doc_id, text) linked at `percent`, by comparing all pairs."""
    sets, group = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = sorted((group[a], group[b]))
                group = {i: x if g == y else g for i, g in group.items()}
    return sorted(set(group.values()))


def test_near_duplicates_from_a_similarity_of_80_percent(spark):
    rows = fixture(300)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, table_of(spark, rows), SF).collect())
    expected = smallest_of_groups(rows, 80)
    assert kept == expected and len(expected) < len(smallest_of_groups(rows, 85))


def test_run_is_its_stages(spark):
    found = queries.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, found, SF).collect()
        if name == "near_dedup":
            assert sorted(r["doc_id"] for r in kept) == smallest_of_groups([(r["doc_id"], r["text"]) for r in found.collect()], 80)
        found = spark.createDataFrame(kept, found.schema)
    last = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pack(found, queries.tokenizer_path()).collect())
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) == last


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_stages_on_odd_rows_and_clashing_columns(spark):
    """Nulls, empty texts, repeats and columns named like those that stages make."""
    odd = table_of(spark, ODD)
    every = ids(odd)
    stages = dict(corpus_pipeline.STAGES)
    results = {name: stages[name](spark, odd, SF) for name in ("toxicity", "near_dedup", "decontamination")}
    assert all(df.columns == odd.columns for df in results.values())
    assert ids(results["toxicity"]) == every and ids(results["decontamination"]) == every
    assert ids(results["near_dedup"]) == sorted((i for i in every if i != 8), key=str)  # 8 is a copy of 5
    with_langs = table_of(spark, [*ODD, *[(100 + k, "some words of a language", "en") for k in range(8)]])
    named = stages["language_id"](spark, with_langs, SF)
    assert named.columns == odd.columns and not {1, 2, 3} & set(ids(named)) and {4, 5, 6, 7} <= set(ids(named))
    packed = stages["packing"](spark, odd, SF)
    assert ids(packed.where("piece = 0")) == every and {r["length"] for r in packed.where("doc_id in (1, 2)").collect()} == {1}


def test_stages_on_an_empty_table(spark):
    none = table_of(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.collect() == [] and (name == "packing" or out.columns == none.columns), name


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    for folder, rows in (("odd", [*ODD, *[(100 + k, f"some words of a language and the number {k} {k}", "en") for k in range(8)]]), ("empty", [])):
        where = str(tmp_path / folder)
        table_of(spark, rows, extra=False).write.parquet(f"{where}/documents.parquet")
        for name in ("labels", "benchmark"):
            queries.table(spark, SF, name).write.parquet(f"{where}/{name}.parquet")
        found = {r["doc_id"] for r in corpus_pipeline.run(spark, where).collect()}
        assert found <= {i for i, *_ in rows} and (folder == "empty" or {4, 5, 100} <= found and not {1, 2, 3, 8} & found)


def test_entry_has_all_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
