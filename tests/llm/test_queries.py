"""The queries on the small tables: SQL where there is some, contracts otherwise."""

import pytest

from pyspark.sql import functions as F

from lodestrata.llm import mixing, near_dup, token_counts
from lodestrata.llm import queries as Q
from lodestrata.llm.common import settle
from tests.oracle import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    assert spark_rows(df) == duck_rows(Q.oracle_sql()[name], sf_dir, df.columns)


COLUMNS = {
    "op4_quality_classifier": ["doc_id", "held_out", "score", "predicted"], "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op8_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op10_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_each_document(spark, sf_dir, name):
    df = Q.queries()[name](spark, sf_dir)
    assert set(COLUMNS[name]) <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    scored = Q.op4_quality_classifier(spark, big).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.95 * len(scored)
    kept = Q.op10_quality_rules(spark, big).where("not base_failed").join(labels, "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in kept) >= 0.97 * len(kept)


def test_tokens_of_all_documents_equal_the_library(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    t = token_counts.load_tokenizer(token_counts.TOKENIZER)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    assert sum(len(x) > token_counts.CHUNK + token_counts.OVERLAP for x in texts.values()) > 30  # spliced ones
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in Q.op5_token_counts(spark, big).collect()}
    want = {i: len(t.encode(x, add_special_tokens=False)) for i, x in texts.items()}
    assert got == {i: (len(x.encode()), want[i], want[i] > 512) for i, x in texts.items()}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables with rows whose way through the pipeline is known."""
    import random

    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(n))
    sheet = lambda n: "\n".join(words(12) for _ in range(n))
    good = {i: sheet(10) for i in range(60)}
    bad = {i: "\n".join(["BUY!!! NOW!!! ### $$$ cheap cheap cheap"] * 3 + [words(30).upper() + " !!! ###"] * 2) for i in range(100, 160)}
    item = words(30)
    special = {200: good[0], 201: good[1].replace(good[1].split()[7], "changed", 1) + " more", 202: sheet(4) + "\n" + good[2].split("\n")[0] + "\n" + good[2].split("\n")[1] + "\n" + sheet(4), 203: f"{sheet(6)} {item} {words(20)}", 204: "too short"}
    docs = [(i, x, "en", "s" + str(i % 3), len(x)) for i, x in {**good, **bad, **special}.items()]
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*good, *bad]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, good, bad, special


def test_pipeline_stages_on_planted_rows(spark, planted):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder, good, bad, special = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = {}
    for name, stage in pipeline.STAGES:
        docs = settle(stage(spark, docs, folder))
        after[name] = {r.doc_id: r.asDict() for r in docs.collect()}
    assert set(after["quality rules"]) == {*good, 200, 201, 202, 203}
    lines = after["line dedup"]
    assert set(lines) == set(after["quality rules"]) - {200}  # a copy as a whole
    assert lines[202]["text"] == "\n".join(x for n, x in enumerate(special[202].split("\n")) if n not in (4, 5)) and lines[202]["n_chars"] == len(lines[202]["text"])
    assert all(lines[i]["text"] == good[i] for i in good)
    assert set(after["near-dedup"]) == set(lines)  # what the line stage left of 201 is no near copy
    assert set(after["decontamination"]) == set(lines) - {203}
    mixed = docs.groupBy("source").agg(F.sum("words").alias("words")).collect()
    sizes = {s: sum(len(r["text"].split()) for r in after["decontamination"].values() if r["source"] == s) for s in ("s0", "s1", "s2")}
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert {r.source: r.words for r in mixed} == {s: int(t + 0.5) for s, t in targets.items()}


def test_near_copies_go_before_lines_are_cut(spark, planted):
    folder, good, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 or doc_id in (200, 201)")
    assert {r.doc_id for r in near_dup.drop_near_duplicates(docs).collect()} == set(good)


def test_pipeline_on_empty_tables(spark, planted, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        assert docs.count() <= before
    out = pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "epoch", "words"} <= set(out.columns) and out.count() > 0


def test_no_later_copy_of_a_long_line_stays(spark, sf_dir):
    left = {}
    for r in sorted(Q.op6_line_dedup(spark, sf_dir).collect(), key=lambda r: (r.doc_id is None, r.doc_id)):
        for line in (r.text or "").split("\n"):
            if len(line.split()) >= 20:
                left[line] = left.get(line, 0) + 1
    assert left and max(left.values()) == 1
