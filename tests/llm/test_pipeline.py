"""Each stage of the pipeline against a plain version over what the stage got."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from starmill.llm import quality
from starmill.llm.stored import stored
from tests.conftest import DATA
from tests.llm.test_decontaminate import brute as leaks_by_hand
from tests.llm.test_mixing import by_hand as targets_by_hand
from tests.llm.test_near_dup import brute as classes_by_hand


@pytest.fixture(scope="module")
def stages(spark):
    made = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], DATA), name))
    return made


def test_all_but_the_last_return_documents(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for made in stages[1:-1]:
        assert made.columns == stages[0].columns and made.count() > 0


def test_quality_drops_what_it_rejects(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = quality.predict(stages[0], quality.fit(stages[0], labels)).collect()
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in scores if r.predicted)
    marked = {r.doc_id: r.quality for r in labels.collect()}
    kept = [marked[r.doc_id] for r in scores if r.doc_id in marked and r.predicted]
    assert sum(kept) / sum(marked.values()) > 0.9


def test_one_of_each_group_stays(stages):
    classes = classes_by_hand([(r.doc_id, r.text) for r in stages[1].collect()], 5, 80)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(k for k, (_, c) in classes.items() if k == c)


def test_leaks_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in stages[2].collect()]
    gone = {k for k, _ in leaks_by_hand(docs, items)}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(k for k, _ in docs if k not in gone)


def test_mix_meets_its_targets(stages):
    rows, used = stages[3].collect(), stages[4].collect()
    sizes, words = {}, {}
    for group, table in ((rows, sizes), (used, words)):
        for r in group:
            table[r.source] = table.get(r.source, 0) + len((r.text or "").split())
    longest = max(len((r.text or "").split()) for r in rows)
    for source, target in targets_by_hand(sizes).items():
        assert abs(words.get(source, 0) - target) <= longest


def test_tokens(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = sorted((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in stages[4].collect())
    digest = sorted(stages[5].collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in digest] == counts
    assert [r.start for r in digest] == [sum(n for _, n in counts[:k]) for k in range(len(counts))]


def test_run_equals_its_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, stages[5].collect()))


def odd_documents(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 90")
    one = base.where("doc_id = 3").first()
    more = spark.createDataFrame(
        [(None, one.text, "en", "src1", 1), (None, None, None, None, None), (None, "", "en", None, 0), (3, one.text, one.lang, one.source, 1),
         (4, "another text of the same id", "en", "src2", 5), (9000, None, "en", "src3", None), (9001, " \n\t ", None, "src3", 4),
         (9002, "one", "en", "src3", 3), (9003, "long " * 60_000, "en", None, 300_000)], base.schema)
    odd = base.unionByName(more).withColumn("n_chars", quality.F.lit("many"))
    for name, value in (("node", 1), ("bands", "b"), ("draw", 0.5), ("part", "p"), ("item", 7), ("start", "s"), ("size", -1), ("row", "r")):
        odd = odd.withColumn(name, quality.F.lit(value))
    return odd


def test_odd_rows_pass_every_stage(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        assert after.count() > 0
        if name == "near_duplicates":
            counts = {(r.doc_id, r.text) for r in after.collect()}
            assert len(counts) == after.where("doc_id is not null").distinct().count() + after.where("doc_id is null").distinct().count()
            assert after.where("doc_id = 3").count() <= 1
            before = docs.where("doc_id is null").count()
            assert after.where("doc_id is null").count() == before  # linked with nothing
        if name == "mixing":
            assert after.where("text is null or trim(text) = ''").count() == 0
        docs = after
    digest = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert digest.count() == docs.count()


def test_an_empty_table_passes_every_stage(spark):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA), name)
        assert docs.count() == 0
