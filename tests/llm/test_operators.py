"""Small fixtures against brute force, for every operator; each fixture has nulls, empty and long texts, repeated rows."""

import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlake.llm import decontaminate, gsaca, license_scan, line_dedup, lm_score, minhash_forest, mixing, pii, quality_rules, suffix_dedup, token_counts
from graphlake.llm.common import shared_dir, ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, "\n\n", "en", "a", 2),
    (3, "é " * 4000 + "ünd so weiter", "de", "b", None),
    (4, "x", "en", None, 1),
    (None, "no id at all, but a text of some length that nothing else has\nand a second line to it", "en", "a", 80),
]


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = list(AWKWARD)
    shared = "This very line is found in many of the documents"
    for i in range(10, 10 + n):
        kind = rng.random()
        if kind < 0.3 and i > 12:
            text = rows[rng.randrange(6, len(rows))][1] or ""
            words = text.split(" ")
            for _ in range(rng.randrange(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = f"v{rng.randrange(9)}"
            text = " ".join(words)
        else:
            text = prose(rng, rng.randrange(1, 160))
        if rng.random() < 0.3:
            text += "\n" + rng.choice([shared, " " + shared.upper() + "\t", shared[:15]])
        if rng.random() < 0.2:
            text += "\n" + text.split("\n")[0]
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["hot"] * 5 + ["a", "b"]), len(text)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def blank_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


def same_as_sql(df, sql, rows, drop_null_ids=True):
    import pandas as pd

    con = duckdb.connect()
    table = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con.register("t", table)
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source, n_chars::BIGINT AS n_chars FROM t")
    want = con.sql(sql).fetchall()
    names = [d[0] for d in con.sql(sql).description]
    got = [tuple(r[n] for n in names) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# --- 1 ---


def test_license_base_and_spans(spark, docs):
    mit = license_scan.TEMPLATES[1][1]
    broken = " ".join(w for i, w in enumerate(mit.split()) if i % 17 != 5)
    rows = [(100, "Foo. Released under the MIT License.", None, None, None), (101, mit.upper(), None, None, None), (102, "bar baz " + broken + " end", None, None, None), (103, "apache license MIT  license apache-license", None, None, None)]
    extra = spark.createDataFrame(rows * 2, SCHEMA)
    out = license_scan.query(docs.unionByName(extra)).collect()
    assert len(out) == docs.count() + 8
    got = {r["doc_id"]: r for r in out}
    assert got[100]["labels"] == "mit" and got[100]["base_labels"] == "mit" and got[100]["score"] == 1.0
    assert got[101]["labels"] == "mit" and got[101]["n_base"] == 0 and got[101]["score"] == 1.0
    assert got[102]["labels"] == "mit" and 0.6 <= got[102]["score"] < 1
    assert (got[103]["n_base"], got[103]["first_word"], got[103]["last_word"], got[103]["base_labels"]) == (3, 0, 4, "apache,mit")
    for d, text, *_ in corpus():
        assert got[d]["n_words"] == len(license_scan.words_of(text or ""))
        assert got[d]["n_base"] == 0 and got[d]["first_word"] is None and got[d]["labels"] == ""


def votes_brute(text, templates, k, slack, coverage, gap):
    """Diagonal voting by plain loops."""
    words, out = license_scan.words_of(text or ""), []
    for t, (label, said) in enumerate(templates):
        tw = license_scan.words_of(said)
        hits = [(p - q, p, q) for p in range(len(words) - k + 1) for q in range(len(tw) - k + 1) if words[p : p + k] == tw[q : q + k]]
        groups = []
        for d, p, q in sorted(hits):
            if not groups or d - groups[-1][-1][0] > slack:
                groups.append([])
            groups[-1].append((d, p, q))
        spans = sorted((min(p for _, p, _ in g), max(p for _, p, _ in g) + k, frozenset(q for _, _, q in g)) for g in groups)
        chains = []
        for i, (a, z, qs) in enumerate(spans):
            if not chains or a - spans[i - 1][1] > gap or min(qs) <= min(spans[i - 1][2]):
                chains.append([])
            chains[-1].append((a, z, qs))
        for c in chains:
            covered = {q + x for _, _, qs in c for q in qs for x in range(k)}
            if len(covered) >= coverage * len(tw):
                out.append((label, t, min(a for a, _, _ in c), max(z for _, z, _ in c), round(len(covered) / len(tw), 9)))
    return sorted(out)


def test_license_votes_match_brute_force(spark):
    ship(spark)
    rng = random.Random(17)
    pool = [f"t{i}" for i in range(14)]
    templates = [("one", " ".join(rng.choice(pool) for _ in range(25))), ("two", " ".join(rng.choice(pool) for _ in range(40)))]
    rows = list(AWKWARD)
    for i in range(80):
        words = [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(1, 4)):
            said = rng.choice(templates)[1].split()
            for _ in range(rng.randrange(0, 4)):
                x = rng.randrange(len(said))
                said[x : x + rng.randrange(0, 2)] = [rng.choice(pool) for _ in range(rng.randrange(0, 8))]
            words += said + [rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        rows.append((100 + i, " ".join(words), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: sorted((s.label, s.template, s.start, s.end, round(s.score, 9)) for s in r.spans) for r in license_scan.scan(docs, templates, 3, 2, 0.5, 6).collect()}
    want = {d: votes_brute(t, templates, 3, 2, 0.5, 6) for d, t, *_ in rows}
    assert got == want and sum(map(len, want.values())) > 60
    mit = license_scan.TEMPLATES[1][1].split()
    for more in (4, 12, 20):  # words put in at the middle
        text = " ".join([*mit[: len(mit) // 2], *(f"x{i}" for i in range(more)), *mit[len(mit) // 2 :]])
        assert license_scan.query(spark.createDataFrame([(1, text, "en", "a", 0)], SCHEMA)).first().labels == "mit"
    assert license_scan.query(docs.limit(0)).count() == 0
    clash = docs.withColumns({"row": F.lit(1), "t": F.lit(2), "n_words": F.lit(3), "hits": F.lit(4)})
    assert license_scan.query(clash).count() == len(rows)


# --- 2 ---


def test_token_counts_match_sql_and_are_idempotent(spark, docs):
    same_as_sql(token_counts.query(docs), token_counts.QUERY_SQL, corpus())
    roll = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-test-{random.random()}")
    first = spark.createDataFrame([("a b", "x", "en", "insert"), ("c", "x", None, None)], "text string, source string, lang string, op string")
    assert roll.commit("b1", token_counts.changes(first, ["words-v1"])) and not roll.commit("b1", token_counts.changes(first, ["words-v1"]))
    second = spark.createDataFrame([("a b c d", "x", "en", "revise", "a b"), ("c", "x", None, "delete", None)], "text string, source string, lang string, op string, old_text string")
    assert roll.commit("b2", token_counts.changes(second, ["words-v1"]))
    assert [tuple(r) for r in roll.totals().collect()] == [("x", "en", "words-v1", 1, 4)]
    assert roll.committed() == ["b1", "b2"]
    bad = spark.createDataFrame([("a", "x", "en", "upsert")], "text string, source string, lang string, op string")
    with pytest.raises(Exception, match="unknown op"):
        token_counts.changes(bad, ["words-v1"]).collect()
    lone = spark.createDataFrame([("a", "x", "en", "revise")], "text string, source string, lang string, op string")
    with pytest.raises(Exception, match="old_text"):
        token_counts.changes(lone, ["words-v1"]).collect()
    blank = spark.createDataFrame([(None, "x", "en", "insert", 1), ("", None, "en", None, 2)], "text string, source string, lang string, op string, n long")
    assert sorted(tuple(r) for r in token_counts.changes(blank, ["utf8-v1"]).collect() if r.source) == [("x", "en", "utf8-v1", 1, 0)]
    assert token_counts.query(docs.limit(0)).count() == 0


def test_token_counts_survive_a_torn_marker(spark):
    roll = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-torn-{random.random()}")
    rows = spark.createDataFrame([("a b", "x", "en")], "text string, source string, lang string")
    assert roll.commit("b1", token_counts.changes(rows, ["words-v1"]))
    folder = roll.path.removeprefix("file://") + "/_commits"
    name = f"v00000001-{hashlib.md5(b'b2').hexdigest()}"
    open(f"{folder}/{name}", "w").close()  # as if the writer had died in the middle
    open(f"{folder}/_aside", "w").close()
    assert roll.committed() == ["b1"] and roll.totals().first().n_tokens == 2
    assert roll.commit("b2", token_counts.changes(rows, ["words-v1"])) and not roll.commit("b2", token_counts.changes(rows, ["words-v1"]))
    assert roll.committed() == ["b1", "b2"] and roll.totals().first().n_tokens == 4


def test_token_counts_by_vocabulary(spark, tmp_path):
    ship(spark)
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abab"]
    path = tmp_path / "ranks.txt"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    rows = spark.createDataFrame([("ababab", "x", "en"), (None, "x", "en"), ("", "x", "en")], "text string, source string, lang string")
    assert [tuple(r) for r in token_counts.changes(rows, ["bpe-v1"], {"bpe-v1": str(path)}).collect()] == [("x", "en", "bpe-v1", 3, 2)]


# --- 3 ---


def quality_brute(text):
    words = blank_words(text or "")
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for x in lines:
        if blank_words(x):
            dup += x in seen
            seen.add(x)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    rep = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep)


def test_quality_base_numbers_and_verdict(spark, docs):
    rng = random.Random(3)
    good = [(1000 + i, prose(rng, 120), "en", "a", 0) for i in range(40)]
    junk = [(2000 + i, " | ".join(prose(rng, 120).upper().split()), "en", "a", 0) for i in range(40)]
    every = docs.unionByName(spark.createDataFrame(good + junk, SCHEMA))
    labels = spark.createDataFrame([(r[0], int(r[0] < 2000), 0) for r in (good + junk)[::2]] + [(None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.query(every, labels))
    for d, text, *_ in corpus() + good + junk:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_brute(text), d
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert all(got[r[0]].kept for r in good if not got[r[0]].base_failed) and not any(got[r[0]].kept for r in junk)
    none = quality_rules.query(every, labels.limit(0))
    assert all(r.kept == (not r.base_failed) for r in none.collect())
    clash = every.withColumns({"kept": F.lit("k"), "score": F.lit(1), "n_words": F.lit(2)})
    assert quality_rules.filter_documents(clash, labels).columns == clash.columns
    assert quality_rules.query(docs.limit(0), labels.limit(0)).count() == 0


def bytes_sent(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])


def test_quality_sends_texts_in_bounded_batches(spark):
    ship(spark)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('a word ', 15000) AS text")
    quality_rules.filter_documents(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    sent = [r.n for r in docs.mapInArrow(bytes_sent, "n long").collect()]
    assert sum(sent) > 20_000_000 and max(sent) < 5_000_000


def test_forest_sends_texts_in_bounded_batches(spark):
    ship(spark)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    minhash_forest.query(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"))
    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('a word ', 15000) AS text")
    assert max(r.n for r in docs.mapInArrow(bytes_sent, "n long").collect()) < 5_000_000


def test_quality_texts_come_back_only_where_asked_for(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "a b " * 40), (2, None), (None, "c d e")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = np.arange(quality_rules.BUCKETS, dtype=np.float32)
    batch = pa.RecordBatch.from_pylist([{"d": {"doc_id": 1, "text": "a b c"}}, {"d": {"doc_id": 2, "text": None}}])
    flat = pa.RecordBatch.from_pylist([{"d": 1, "t": "a b c"}, {"d": 2, "t": None}])
    one, two = (pa.Table.from_batches(quality_rules._score(table, text)([b])) for text, b in (("text", batch), (None, flat)))
    assert two.column_names == ["d", *one.column_names[1:]] and one.drop_columns("d").equals(two.drop_columns("d"))
    whole, ids = (quality_rules.score_documents(docs, labels, keep).drop("__doc").collect() for keep in (docs.columns, ["doc_id"]))
    assert sorted(map(str, whole)) == sorted(map(str, ids)) and len(whole) == 3


def test_quality_learns_from_every_label(spark):
    ship(spark)
    rng = random.Random(12)
    rows = [(d, " ".join(f"w{rng.randrange(3000)}" for _ in range(55)), "en", "a", 0) for d in range(21_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    labelled = lambda quality: spark.createDataFrame([(d, quality(d), 0) for d in range(21_000)], "doc_id long, quality int, toxic int")
    assert {r.llr for r in quality_rules.query(docs, labelled(lambda d: 1)).select("llr").distinct().collect()} == {0.0}  # the target is the corpus
    got = quality_rules.query(docs, labelled(lambda d: int(d % 3 > 0))).collect()
    good, bad = (np.sort([r.llr for r in got if (r.doc_id % 3 > 0) == x]) for x in (True, False))
    cut = good[int(quality_rules.FALSE_REJECTS * len(good))]
    cut = (bad[bad < cut].max() + cut) / 2
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} == {r.doc_id for r in got if r.llr < cut and not r.base_failed} != set()


# --- 4 ---


def edits_anywhere(a, t):
    row = [0] * (len(t) + 1)
    for i in range(1, len(a) + 1):
        new = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            new[j] = min(row[j - 1] + (a[i - 1] != t[j - 1]), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_decontamination_matches_brute_force(spark):
    ship(spark)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny")]
    rows = list(AWKWARD)
    for i in range(60):
        text = " ".join(word() for _ in range(40))
        if i % 2:
            item = list(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(0, 9)):
                p = rng.randrange(len(item))
                item[p] = rng.choice(["", "q", item[p] + "z"])
            text = text[: rng.randrange(len(text))] + " " + rng.choice(["".join(item), "".join(item).upper()]) + "! " + text
        rows.append((100 + i, text, "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find(docs, bench).collect()}
    index = decontaminate.Index(items)
    want = {}
    for d, text, *_ in rows:
        t = decontaminate.normalised(text).decode("latin-1")
        for (i, p), k in zip(index.items, index.edits):
            e = edits_anywhere(p.tobytes().decode("latin-1"), t) if len(t) < 2000 else 99
            if e <= k:
                want[d, i] = e
    assert want and got == want
    assert {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench, limit=200).collect()} == set(got)  # in blocks
    kept = {r.doc_id for r in decontaminate.clean_documents(docs.withColumn("edits", F.lit(1)), bench).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in got}
    assert decontaminate.find(docs.limit(0), bench).count() == 0 and decontaminate.clean_documents(docs, bench.limit(0)).count() == len(rows)


# --- 5 ---


def test_lm_scores(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(f"a{k % 7}" if rng.random() < 0.9 else f"b{rng.randrange(50)}" for k in range(300)), "en", "a", 0) for i in range(40)]
    train = spark.createDataFrame(rows, SCHEMA)
    model = lm_score.train(train)
    text = lambda s: (np.frombuffer(s.encode(), np.uint8), np.array([0, len(s.encode())]))
    n, ordered = model.score(*text(" ".join(f"a{k % 7}" for k in range(200))))
    m, shuffled = model.score(*text(" ".join(f"a{rng.randrange(7)}" for _ in range(200))))
    assert n[0] == m[0] == 200 and ordered[0] / 200 > shuffled[0] / 200 + 0.5  # held out: order is learnt from both sides
    out = by_id(lm_score.score(docs, model))
    assert len(out) == len(corpus()) and out[1].n_words == 0 and out[1].pll == 0 and out[1].pll_per_word is None and out[0].n_words == 0
    for d, t, *_ in corpus():
        words = blank_words(lower(t or ""))
        assert out[d].n_words == len(words)
    # Brute force for one document.
    t = corpus()[10][1]
    cell = [int(lm_score._words(*text(w))[0][0]) for w in blank_words(t)]
    cls = [64, 64, *model.cls_of[cell], 64, 64]
    total = 0.0
    for k in range(2, len(cls) - 2):
        w = ((lm_score._FAR[cls[k - 2]] * lm_score.NEAR + lm_score._NEAR[cls[k - 1]]) * lm_score.NEAR + lm_score._NEAR[cls[k + 1]]) * lm_score.FAR + lm_score._FAR[cls[k + 2]]
        total += model.table[w, cls[k]] + model.inside[cell[k - 2]]
    assert math.isclose(total, out[corpus()[10][0]].pll, rel_tol=1e-4)
    assert lm_score.score(docs.limit(0)).count() == 0


# --- 6 ---


def components_brute(rows, words):
    sets = {}
    for d, text, *_ in rows:
        w = blank_words(lower(text or ""))
        s = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets[d] = s
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [d for d in sets if d is not None and sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), None if d is None else find(d)) for d in sets}


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    total = 0
    while files.hasNext():
        f = files.next()
        if f.getName().startswith("shuffle_"):
            total += f.length()
    return total


def test_forest_leaves_no_shuffle_files(spark):
    ship(spark)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    text = "concat_ws(' ', transform(sequence(1, 300), x -> sha2(concat(id div 2, '-', x), 256)))"
    docs = spark.range(100).selectExpr("id AS doc_id", f"concat({text}, ' w', id) AS text").localCheckpoint()
    before = shuffle_bytes(spark)
    minhash_forest.link(docs)
    for _ in range(50):  # files are removed in the background
        if (left := shuffle_bytes(spark) - before) < 200_000:
            break
        time.sleep(0.2)
    assert left < 200_000  # texts are 2 MB
    assert spark.conf.get(key, None) == setting


def test_keep_one_shuffles_rows_once(spark):
    ship(spark)
    text = "some words that make a text of which there are near copies or versions or none"
    rows = [(1, text), (2, text), (3, "a"), (3, "b"), (4, text + " more"), (4, text), (None, "c"), (None, "c"), (5, "")]
    out = minhash_forest.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(__id") == 1
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "None", "None"]


def test_near_duplicates_match_brute_force(spark):
    ship(spark)
    rows = corpus(4, 200)
    base = prose(random.Random(8), 150).split(" ")
    for i in range(120):  # a crowd: one text and its many variants
        w = list(base)
        for k in range(i % 4):
            w[(i * 7 + k * 31) % len(w)] = f"z{i}"
        rows.append((1000 + i, " ".join(w), "en", "hot", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for words in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.link(docs, words).collect()}
        assert got == components_brute(rows, words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_forest.link(docs, 5, region=6).collect()}
    assert got == components_brute(rows, 5)  # regions deepened down to all values
    kept = minhash_forest.keep_one(docs.withColumns({"root": F.lit(1), "n": F.lit(2)}).unionByName(docs.withColumns({"root": F.lit(1), "n": F.lit(2)})))
    want = sorted(d for d, (_, c) in components_brute(rows, 5).items() if d is not None and d == c)
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == want
    assert minhash_forest.query(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_hub_amid_its_variants(spark):
    """Variants resemble the original, but mostly not each other; the original's id is not the least."""
    ship(spark)
    rng = random.Random(9)
    base = [f"v{rng.randrange(5000)}" for _ in range(250)]
    rows = []
    for i in range(1500):
        w = list(base)
        if i != 700:
            for k in rng.sample(range(10, 240), 4):
                w[k] = f"z{i}x{k}"
        rows.append((i, " ".join(w), "en", "hot", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = components_brute([rows[700], *rows[:60], *rows[1440:]], 5)
    assert {c for _, c in want.values()} == {0}
    assert {r.component_id for r in minhash_forest.link(docs, 5).collect()} == {0}


def test_dense_regions_lose_no_pair_across_blocks(spark):
    ship(spark)
    rng = random.Random(3)
    base = [f"v{rng.randrange(900)}" for _ in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(80), rng.randrange(5)):
            w[k] = f"z{i}x{k}"
        rows.append((i, " ".join(w), "en", "hot", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = components_brute(rows, 5)
    tree = spark.createDataFrame([(d, n, 7) for d, (n, _) in want.items()], "cid long, n long, region long")
    for mass in (1 << 20, 4000):  # one block, and many
        links = minhash_forest.crowd_links(tree, spark.createDataFrame([], "node long, root long"), docs, 5, 80, 12, mass)
        joined = {r.node: r.root for r in minhash_forest.components(links).collect()}
        assert {d: joined.get(d, d) for d in want} == {d: c for d, (_, c) in want.items()}


def test_regions_are_deepened_where_they_are_dense(spark):
    word = lambda x: x.to_bytes(4, "big")
    rows = [(i, 1, word(i % 2) + word(i % 4) + word(i)) for i in range(40)] + [(100 + i, 2, word(0) * 3) for i in range(3)] + [(200, 3, word(0) * 3)]
    tree = spark.createDataFrame(rows, "cid long, region long, rest binary")
    parts = {}
    for r in minhash_forest.deepened(tree, 3, 12).collect():
        parts.setdefault(r.region, []).append(r.cid)
        assert r.head <= r.cid
    assert sorted(sorted(x) for x in parts.values()) == sorted([*(list(range(k, 40, 4)) for k in range(4)), [100, 101, 102]])
    deep = minhash_forest.deepened(tree, 3, 2).collect()
    assert {r.region for r in deep if r.cid >= 100} and not [r for r in deep if r.cid == 200]


def test_planted_links_in_a_crowd_are_found(spark):
    """Texts at a mutual similarity of about 0.74, some with a partner above 0.8."""
    ship(spark)
    rng = random.Random(31)
    base = [f"b{i}" for i in range(340)]
    rows = []
    for i in range(400):
        w = base + [f"u{i}x{k}" for k in range(60)]
        rows.append((2 * i, " ".join(w), "en", "hot", 0))
        if i % 8 == 0:
            v = base + [f"u{i}x{k}" for k in range(30)] + [f"v{i}x{k}" for k in range(30)]
            rows.append((2 * i + 1, " ".join(v), "en", "hot", 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.doc_id: r.component_id for r in minhash_forest.link(docs, 5).collect()}
    want = {d: c for d, (_, c) in components_brute(rows, 5).items()}
    assert len({c for c in want.values()}) == 400 and got == want


# --- 7 ---


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(600):
        s = [rng.randrange(1 + rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 40))] * rng.choice([1, 1, 2, 3])
        sa = gsaca.suffix_array(s)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        for k, h in enumerate(gsaca.lcp_array(s, sa)[1:], 1):
            a, b = s[sa[k - 1] :], s[sa[k] :]
            assert a[:h] == b[:h] and a[h : h + 1] != b[h : h + 1]
    assert gsaca.suffix_array([]) == []


def suffix_brute(rows, n=50):
    least = {}
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in texts:
        for i in range(len(b) - n + 1) if d is not None else ():
            least[b[i : i + n]] = min(d, least.get(b[i : i + n], d))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1) if d is not None else ():
            if least[b[i : i + n]] < d:
                gone[i : i + n] = True
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup_matches_brute_force(spark):
    ship(spark)
    rows = corpus(6, 150)
    phrase = "a passage that stands in very many of these documents, each time amid other words "
    rng = random.Random(9)
    rows += [(500 + i, prose(rng, 8) + phrase + prose(rng, 8), "en", "hot", 0) for i in range(60)]
    rows += [(10, rows[8][1], "en", "a", 0), (11, rows[-1][1], "en", "a", 0)]  # versions of one document
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in suffix_dedup.query(docs).collect()), key=repr)
    assert got == suffix_brute(rows)
    for small in ({"block": 300}, {"chunk": 500, "block": 200}, {"bucket": 1 << 11, "flush": 3000}, {"bucket": 400, "chunk": 600, "block": 150, "flush": 500}):  # anchors in several arrays, hot cells
        assert sorted((tuple(r) for r in suffix_dedup.dedup(docs, digest=True, **small).collect()), key=repr) == got, small
    assert len(suffix_dedup.spread_of(docs.withColumn("slot", F.lit(0)), 50, 400).hot)
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs.limit(3)).collect()}
    assert len(kept) == 3 and suffix_dedup.query(docs.limit(0)).count() == 0


def test_suffix_dedup_of_a_long_document(spark):
    ship(spark)
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh ") for _ in range((1 << 20) + 500))
    rows = [(1, long[(1 << 20) - 200 : (1 << 20) + 200], "en", "a", 0), (2, long, "en", "a", 0)]
    got = sorted(tuple(r)[:4] for r in suffix_dedup.query(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 400, 0, 0), (2, len(long), 400, 1)]


def test_suffix_dedup_asks_for_little_where_only_anchors_are_shared():
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    twice = letters(70)
    texts = [letters(80) + " a phrase in all of them " + letters(80) for _ in range(200)] + [letters(60) + twice + letters(60) for _ in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(202), pa.int64()), pa.array([0] * 202, pa.int32()), pa.array(texts)], ["doc_id", "slot", "text"])
    for hot in ([], range(16)):
        spread = suffix_dedup.Spread(1, 5, np.array(hot, np.uint64))
        told = pa.Table.from_batches(suffix_dedup._judge(spread)(suffix_dedup._contexts(spread, 50)(iter([batch])))).to_pydict()
        asked = [d for d, k in zip(told["doc_id"], told["key"]) if k & 1]
        lost = [d for d, k in zip(told["doc_id"], told["key"]) if not k & 1]
        assert set(lost) <= {201} and {200, 201} <= {*asked, *lost, 200} and len(asked) < 60, hot


def test_suffix_dedup_sends_one_blob_a_bucket_for_many_blocks():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(100_000)) for _ in range(10)]
    spread = suffix_dedup.Spread(64, 9, np.zeros(0, np.uint64))
    keys = []
    for x in texts:
        data = np.frombuffer(x.encode(), np.uint8)
        found = suffix_dedup.anchors(data, np.array([0, len(data)]), 50)
        keys.append((suffix_dedup._key(found[0], found[4]) | np.uint64(1)).view(np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10), pa.int64()), pa.array([0] * 10, pa.int32()), pa.array(texts), pa.array(keys)], ["doc_id", "slot", "text", "keys"])
    sent = pa.Table.from_batches(suffix_dedup._fetch(spread, 50)(iter([batch])))
    contexts = sum(len(suffix_dedup._unpack(b, "<u8", "<i8", "<u8", "<u4", "u1", "u1", "raw")[0]) for b in sent.column("blob").to_pylist())
    assert contexts == sum(map(len, keys)) and len(sent) <= 64


# --- 8 ---


def test_mixing_matches_sql_and_targets(spark, docs):
    same_as_sql(mixing.query(docs), mixing.QUERY_SQL, corpus())
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"), F.lit(5).alias("copy"))
    out = mixing.mix(many, {"hot": 3.0, "cold": 1.0, "absent": 2.0})
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(n["hot"] / total - 0.75) < 0.03
    assert "copy_mix" in out.columns and out.where("copy <> 5").count() == 0
    keys = [r.mix_key for r in out.select("mix_key").collect()]
    assert keys == sorted(keys)
    with pytest.raises(ValueError):
        mixing.mix(many, {"hot": -1.0})
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = mixing.mix(many.withColumns({"copy_mix": F.lit(1), "mix_key": F.lit(2)}))
    assert clash.columns[-2:] == ["copy_mix_mix", "mix_key_mix"]


def test_mixing_inverts_large_means(spark):
    us = [1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9]
    for mean in (599.5, 600.5, 746.0, 1200.0, 50000.0):
        rows = spark.createDataFrame([(mean, u) for u in us], "m double, u double")
        got = [r.k for r in rows.select("u", mixing.poisson(F.col("m"), F.col("u")).alias("k")).orderBy("u").collect()]
        c, want = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(int(mean * 1.2 + 300))]), []
        want = [int(np.searchsorted(c, u)) for u in us]
        assert got == want, mean
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "tiny").otherwise("big").alias("source"))
    sizes = [mixing.mix(many, {"tiny": 1.0, "big": 1.0}, seed=k, shuffle=False).where("source = 'tiny'").count() for k in range(4)]
    assert len(set(sizes)) > 1 and all(abs(n - 1000) < 160 for n in sizes)


# --- 9 ---


def test_line_dedup_matches_sql(spark, docs):
    same_as_sql(line_dedup.query(docs), line_dedup.QUERY_SQL, corpus())
    clean = line_dedup.clean_documents(docs.withColumns({"h": F.lit(1), "gone": F.lit(2)}))
    assert clean.columns == [*docs.columns, "h", "gone"] and clean.count() == docs.count()
    assert all(len(r.text) == r.n_chars for r in clean.collect())
    repeated = spark.createDataFrame([(1, "a line that is long enough to count", "", "", 0)] * 4 + [(2, "a line that is long enough to count", "", "", 0)], SCHEMA)
    assert {r.n_dropped for r in line_dedup.query(repeated).collect()} == {0}  # two documents only
    assert line_dedup.query(docs.limit(0)).count() == 0


def test_line_dedup_of_a_text_of_very_many_lines(spark):
    """300,000 lines of which half go: the cost must not be the product."""
    lines = [f"this line is number {i} of them" for i in range(300_000)]
    rows = [(9, "\n".join(lines), "", "", 0), (10, "\n".join(lines[::2]), "", "", 0), (11, "\n".join(lines[::2]), "", "", 0)]
    began = time.monotonic()
    got = by_id(line_dedup.query(spark.createDataFrame(rows, SCHEMA)))
    assert [(got[d].n_lines, got[d].n_dropped) for d in (9, 10, 11)] == [(300_000, 150_000), (150_000, 150_000), (150_000, 0)]
    assert got[9].kept_sha256 == hashlib.sha256("\n".join(lines[1::2]).encode()).hexdigest()
    assert time.monotonic() - began < 60


# --- 10 ---


def pii_brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii(spark, docs):
    rng = random.Random(4)
    texts = [t for t, _ in pii.training_set(60, 31)]
    texts += ["".join(rng.choice("a1.9 +-@25(0)\n") for _ in range(200)) for _ in range(60)]
    texts += ["a@b@c.de.f-g", "1.2.3.4.5.6.7.8", "+1 (974) 555-3436", "é@x.yz @ 4111 1111 1111 1111", "0001.2.3.255"]
    rows = [(2000 + i, t, "en", "a", 0) for i, t in enumerate(texts)]
    model = pii.SemiMarkovCRF().fit(pii.training_set())
    got = by_id(pii.find(docs.unionByName(spark.createDataFrame(rows, SCHEMA)), model))
    for d, t, *_ in corpus() + rows:
        base, spans = got[d].base, got[d].spans
        assert base == ",".join(pii_brute(t or "")), t
        assert set(filter(None, base.split(","))) <= set(spans.split(","))
    assert got[0].spans == "" and got[1].spans == ""
    clash = docs.withColumns({"__t": F.lit(1), "spans": F.lit(2), "base": F.lit(3)})
    assert pii.find(clash, model).count() == len(corpus()) and pii.query(docs.limit(0)).count() == 0
    r = by_id(pii.query(spark.createDataFrame(rows[:3], SCHEMA)))[2000]
    assert r.base_sha256 == hashlib.sha256(got[2000].base.encode()).hexdigest() and r.n_email == sum(s.startswith("email") for s in got[2000].base.split(","))
    assert r.n_spans == len([x for x in r.spans.split(",") if x])
    hit = found = truth = 0  # held out
    for t, gold in pii.training_set(150, 77):
        mine = set(model.decode(t, 0, len(t)))
        hit, found, truth = hit + len(mine & set(gold)), found + len(mine), truth + len(gold)
    assert hit / found > 0.93 and hit / truth > 0.93
    for said, kind in (("MT84 MALT 0110 0001 2345 MTLC AST0 01S", "iban"), ("jane.doe (at) mail.example (dot) co (dot) uk", "email")):  # the longest forms
        assert f"{kind}:9:{9 + len(said)}" in pii._join(pii.all_spans(f"write to {said} today", model)[1]), said
    assert pii.redact("call +1 (974) 555-3436 now", "phone:5:22") == "call <phone> now"


def test_crf_recursion_matches_enumeration():
    rng = np.random.default_rng(1)
    kinds, out = len(pii.KINDS), len(pii.KINDS)
    crf = pii.SemiMarkovCRF(rng.normal(0, 1, (kinds, pii.N_FEATURES)), rng.normal(0, 1, (kinds + 1, kinds + 1)))
    crf.t[out, out] = 0
    segments = [(i, j, rng.normal(0, 1, pii.N_FEATURES)) for i, j in ((0, 1), (0, 2), (1, 3), (2, 3))]

    def paths(at, last):
        if at == 3:
            yield 0.0, []
            return
        for s, x in paths(at + 1, out):
            yield s + crf.t[last, out], x
        for i, j, f in segments:
            if i == at:
                for k, score in enumerate(crf.w @ f):
                    for s, x in paths(j, k):
                        yield s + score + crf.t[last, k], [(i, j, k), *x]

    every = list(paths(0, out))
    z = np.log(sum(math.exp(s) for s, _ in every))
    for gold in ({(0, 1, 2), (2, 3, 4)}, {(0, 1, 2), (1, 3, 0)}, set()):
        value, grad, grad_t = crf.gradient(3, segments, gold)
        assert math.isclose(value, next(s for s, x in every if set(x) == gold) - z, rel_tol=1e-9)
        for array, g, at in ((crf.w, grad, (2, 0)), (crf.w, grad, (4, 1)), (crf.t, grad_t, (2, out)), (crf.t, grad_t, (out, 2)), (crf.t, grad_t, (2, 0))):
            array[at] += 1e-6
            assert math.isclose((crf.gradient(3, segments, gold)[0] - value) / 1e-6, g[at], rel_tol=1e-3, abs_tol=1e-5)
            array[at] -= 1e-6
    best = max(every, key=lambda x: x[0])
    found = [(i, j, crf.w @ f) for i, j, f in segments]
    assert crf._best(3, found) == best[1]


def test_decoding_in_pieces_changes_nothing():
    model = pii.SemiMarkovCRF().fit(pii.training_set(60, 5), epochs=3)
    rng = random.Random(3)
    for text, _ in pii.training_set(30, 9):
        text = " ".join([*rng.sample(text.split(" "), len(text.split(" "))), text, *text.split(" "), text])
        assert model.decode(text, 0, len(text), 40) == model.decode(text, 0, len(text), 1 << 20)


def test_pii_of_long_runs_takes_linear_time():
    began = time.monotonic()
    for text in ("7" * 1_000_000, "1." * 300_000, "a" * 1_000_000 + "@", "a@" * 300_000, "+1" * 100_000):
        spans = pii.base_spans(text)
        small = text[: 400]
        assert [f"{k}:{a}:{z}" for k, a, z in pii.base_spans(small)] == pii_brute(small)
        assert all(z <= len(text) for _, _, z in spans)
    model = pii.SemiMarkovCRF().fit(pii.training_set(40, 5), epochs=2)
    pii.all_spans("1 22 333 4444 " * 2000 + "7" * 200_000, model)
    assert time.monotonic() - began < 60
    assert pii.base_spans("x" + "a" * 300_000 + "@b.cd")[0] == ("email", 0, 300_006)


# --- texts over several blocks ---


def test_texts_longer_than_a_block(spark):
    """Texts of more than 256 KB, each a block of its own, give what shorter ones would."""
    ship(spark)
    rng = random.Random(21)
    long = prose(rng, 90_000, 5000)
    assert len(long) > 2 * (1 << 18)
    item = prose(random.Random(5), 30, 4000)
    mit = license_scan.TEMPLATES[1][1]
    near = long.split(" ")
    for k in rng.sample(range(len(near)), 800):
        near[k] = "zz"
    rows = [(1, long + " " + item + " " + mit + " write to me.now@example.com", "en", "a", 0), (2, " ".join(near), "en", "a", 0), (3, long, "en", "a", 0), (4, prose(rng, 50), "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    texts = {d: t for d, t, *_ in rows}
    licence = by_id(license_scan.query(docs))
    assert [licence[d].labels for d in (1, 2, 3)] == ["mit", "", ""] and licence[2].n_words == len(license_scan.words_of(texts[2]))
    quality = by_id(quality_rules.query(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert [quality[d].n_words for d in (1, 2, 3)] == [len(blank_words(texts[d])) for d in (1, 2, 3)]
    assert {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()} == {(1, 7, 0)}
    assert {d: r.n_words for d, r in by_id(lm_score.score(docs)).items()} == {d: len(blank_words(t)) for d, t in texts.items()}
    assert {d: r.component_id for d, r in by_id(minhash_forest.link(docs)).items()} == {1: 1, 2: 1, 3: 1, 4: 4}
    private = by_id(pii.query(docs))
    assert private[1].n_email == 1 and f"email:{texts[1].index('me.now')}:{len(texts[1])}" == private[1].spans
