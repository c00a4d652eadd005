"""The stored full-text index: what it shuffles, and that it finds what a search of the texts finds."""

import glob

import pytest

from graphlake.operators import fulltext

DOCS = [(i, " ".join(f"w{(i * 7 + j) % 97}" if j % 5 else "to be or not to be," for j in range(300)) + (" the END" if i % 3 else "")) for i in range(40)] + [(40, ""), (41, None), (42, "... --- ...")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "key long, text string").repartition(3)


def stages(spark) -> list:
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    out = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [out.apply(i) for i in range(out.size())]


def last_stage(spark) -> int:
    return max([-1, *(s.stageId() for s in stages(spark))])


def shuffled(spark, after: int) -> int:
    """Records written to shuffles by stages after one."""
    return sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() > after)


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_changes_and_compaction_shuffle_no_words(spark, docs, tmp_path):
    index = fulltext.StoredIndex(spark, str(tmp_path / "v7" / "entries"), 4).build({"Doc": docs, "Other": docs})
    index.change("Doc", spark.createDataFrame([(1, "new words"), (99, "w3 new")], "key long, text string"), spark.createDataFrame([("2",)], "key string"))
    index.change("Doc", spark.createDataFrame([(1, "newer words, new")], "key long, text string"))
    now = spark.createDataFrame([d for d in DOCS if d[0] not in (1, 2)] + [(1, "newer words, new"), (99, "w3 new")], "key long, text string")

    def agrees():
        for word in ("w3", "new", "newer", "words", "to"):
            assert plain(index.lookup_word("Doc", "text", word)) == plain(fulltext.lookup_word(now, "text", word))
            assert plain(index.lookup_word("Other", "text", word)) == plain(fulltext.lookup_word(docs, "text", word))
        for value in ("", "NEW words", "w3 NEW"):
            assert plain(index.lookup_value("Doc", "text", value)) == plain(fulltext.lookup_value(now, "text", value))

    agrees()
    before = last_stage(spark)
    index.compact()
    assert shuffled(spark, before) == 0
    assert index._versions() == [3] and not glob.glob(f"{tmp_path}/v7/entries/v*/keys")
    agrees()


def test_building_shuffles_texts_and_no_words(spark, docs, tmp_path):
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    before = last_stage(spark)
    index = fulltext.StoredIndex(spark, str(tmp_path / "index"), 4).build({"Doc": docs})
    assert 0 < shuffled(spark, before) <= len(DOCS)
    for word in ("TO", "w96", "end", "absent"):
        assert plain(index.lookup_word("Doc", "text", word)) == plain(fulltext.lookup_word(docs, "text", word))
        assert plain(index.count_word("Doc", "text", word)) == plain(fulltext.count_word(docs, "text", word))


def test_words_of_a_text_are_not_aggregated_and_phrases_agree(spark, docs, tmp_path):
    index = fulltext.StoredIndex(spark, str(tmp_path / "index"), 4)
    rows = fulltext.texts(docs).selectExpr("'Doc' AS kind", "key", "attr", "text")
    assert "Aggregate" not in index._entries(rows)._jdf.queryExecution().executedPlan().toString()
    index.build({"Doc": docs})
    for phrase in ("to be or not to be", "be, to be", "not TO", "w7 w8 w9", "the end", "end the", "be be", "to", "absent to", ""):
        assert plain(index.lookup_phrase("Doc", "text", phrase)) == plain(fulltext.lookup_phrase(docs, "text", phrase)), phrase
