from __future__ import annotations

import random

import corpus_pipeline
from recordlake.llm import quality, stages

from . import brute

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(texts):
    return [(i, t, "en", "src", len(t or "")) for i, t in texts]


def prose(r, n):
    words = [f"{a}{b}" for a in ("the", "re", "an", "st", "é") for b in ("a", "ing", "tion", "or", "ß", "un", "ble", "wh")]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", ", ", ". ", ".\n"]) for _ in range(n)) + "."


def test_stages_one_by_one(spark, tmp_path):
    r = random.Random(9)
    bench = [(i, prose(r, 14)) for i in range(5)]
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    base = [(i, prose(r, 150)) for i in range(30)]
    junk = [(100, "home | about | news | " * 40), (101, "word " * 200), (102, None), (103, ""), (104, "short text.")]
    copies = [(200 + i, base[i][1]) for i in range(5)] + [(None, base[3][1])]
    shared = prose(r, 30)
    repeats = [(300 + i, prose(r, 90) + shared + prose(r, 90)) for i in range(4)]
    leaks = [(400 + i, f"{prose(r, 80)}\n{bench[i][1]}\n{prose(r, 80)}") for i in range(3)]
    lines = [(500, prose(r, 150) + "\nhome | about | news | log in\n" + prose(r, 60))]
    docs = spark.createDataFrame(rows(base + junk + copies + repeats + leaks + lines), SCHEMA)
    path = str(tmp_path)

    one = stages.quality_rules(spark, docs, path)
    assert one.dtypes == docs.dtypes
    got = {x.doc_id: x.text for x in one.collect()}
    assert set(got) == {i for i, _ in base + copies + repeats + leaks + lines}
    assert "about" not in got[500] and got[0] == "\n".join(x for x in base[0][1].split("\n") if x.strip())

    two = stages.near_duplicate_groups(spark, one.unionByName(one.where("doc_id = 7")), path)
    assert two.dtypes == docs.dtypes
    kept = [x.doc_id for x in two.collect()]
    groups = {(d, c) for d, _, c in brute.near_groups([(x.doc_id, x.text) for x in one.collect()])}
    assert sorted(x for x in kept if x is not None) == sorted(d for d, c in groups if d == c)
    assert kept.count(None) == 1 and not {200, 201, 202, 203, 204} & set(kept)

    before = {x.doc_id: x.text for x in two.where("doc_id is not null").collect()}
    three = stages.repeated_strings(spark, two, path)
    assert three.dtypes == docs.dtypes
    want = {d: n for d, _, n, _, _ in brute.repeats([(x.doc_id, x.text) for x in two.collect()])}
    for x in three.where("doc_id is not null").collect():
        size = len(before[x.doc_id].encode()) - want[x.doc_id]
        assert size - 6 <= len(x.text.encode()) <= size and x.n_chars == len(x.text)
    assert want[301] > 50 and want[300] == 0

    four = stages.benchmark_passages(spark, three, path)
    assert four.dtypes == docs.dtypes
    left = [(x.doc_id, x.text) for x in four.collect()]
    assert dict(left)[0] == {x.doc_id: x.text for x in three.collect()}[0]
    assert sum(x[2] for x in brute.decontaminate(left, bench)) == 0
    assert sum(x[2] for x in brute.decontaminate([(x.doc_id, x.text) for x in three.collect()], bench)) > 30

    five = stages.packed_sequences(spark, four, path).collect()
    assert {x.doc_id for x in five} == {d for d, _ in left}


def test_run_and_empty_table(spark, tmp_path):
    r = random.Random(2)
    spark.createDataFrame([(1, prose(r, 12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(rows([(i, prose(r, 100)) for i in range(10)]), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(10))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_quality(text):
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1}
    hit = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base_counts(spark):
    r = random.Random(7)
    texts = [None, "", " \n\t\x0b", "a b a b a b", "x\nx\n x\n\nx", "日本 é ß nbsp em", "# * $ % & | < >\r\na|b", "w " * 60]
    texts += ["".join(r.choice("ab ")+ r.choice(["", " ", "\n", "\t", "x#"]) for _ in range(r.randrange(300))) for _ in range(60)] + [prose(r, 120) for _ in range(5)]
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, kept string")
    got = {x.doc_id: tuple(x)[1:7] for x in quality.op7_quality(d).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert quality.op7_quality(d.limit(0)).count() == 0


def test_columns_with_clashing_names(spark, tmp_path):
    """Helpers' names as columns of the documents change nothing and come out as they went in."""
    r = random.Random(4)
    spark.createDataFrame([(1, prose(r, 12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row_hash", "row", "carry_0", "kept", "clean_text", "text_key", "node", "component", "key", "root", "n_words", "lines", "w", "part", "id", "words", "hit", "start"]
    texts = [prose(r, 120) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t), *([f"c{i}"] * len(names))) for i, t in enumerate([*texts, texts[0]])], SCHEMA + "".join(f", {n} string" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, docs, str(tmp_path)), stage(spark, plain, str(tmp_path))
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert sorted((x.doc_id, x.text, x.n_chars) for x in rows) == sorted((x.doc_id, x.text, x.n_chars) for x in want.collect())
        assert all(x[n] == f"c{x.doc_id}" for x in rows for n in names)
    assert stages.packed_sequences(spark, docs, str(tmp_path)).count() == stages.packed_sequences(spark, plain, str(tmp_path)).count()
