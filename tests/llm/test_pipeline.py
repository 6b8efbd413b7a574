"""Stages of the pipeline on small tables, beside plain versions."""

import random

import corpus_pipeline as pipeline
from veilframe.llm import jaccard, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed):
    """(a text, a near copy of it, a near copy of that which is no near copy of the first) of 60 words."""
    rng = random.Random(seed)
    a = [f"w{seed}x{rng.randrange(10**6)}" for _ in range(60)]
    return " ".join(a), " ".join([*a[:-5], *"vwxyz"]), " ".join([*"abcde", *a[5:-5], *"vwxyz"])


def test_links_of_null_and_repeated_ids(spark):
    (a, b, c), (d, e, _), (f, g, _) = near_copies(1), near_copies(2), near_copies(3)
    rows = [(1, a), (None, b), (3, c), (None, d), (None, e), (7, f), (7, "other words " + d[::-1]), (8, g), (8, "more of these " + f[::-1])]
    for parts in (1, 4):
        got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), id_col="doc_id").collect()
        assert sorted(((r.doc_id or 0, r.component_id or 0) for r in got)) == [(0, 0), (0, 0), (0, 1), (1, 1), (3, 1), (7, 7), (7, 7), (8, 7), (8, 8)]


def test_one_row_of_each_group_stays(spark):
    (a, b, c), (d, e, _) = near_copies(1), near_copies(2)
    rows = [(5, a), (None, b), (4, c), (None, d), (None, e), (9, "all alone here with words"), (9, "all alone here with words"), (9, "something else altogether, again alone"), (None, "no id and no copy"), (1, None), (None, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs.repartition(3), None).collect()]
    kept = [x for x in got if x[1] in (d, e)]
    assert len(kept) == 1 and kept[0][0] is None
    want = [(4, c), (9, rows[5][1]), (9, rows[7][1]), (None, rows[8][1]), (1, None), (None, ""), (None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want + kept))
    assert pipeline.drop_near_duplicates(spark, docs.limit(0), None).count() == 0


def corpus(seed=5):
    """Documents of each kind that a stage has to deal with, their labels and a benchmark."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(3000)]
    say = lambda n=60: rng.choices(words, k=n)
    docs, toxic = [], {}
    for i in range(60):
        docs.append((i, " ".join(say()), "en", f"src{i % 5}"))
        toxic[i] = 0
    for i in range(100, 140):
        t = say(30)
        for k in range(0, 30, 3):
            t[k] = rng.choice(["vilest", "hateful", "scum", "loathsome"])
        docs.append((i, " ".join(t), "en", "src1"))
        toxic[i] = 1
    base = say(80)
    for i in range(200, 206):
        docs.append((i, " ".join([*base[:78], *say(2)]), "de", "src2"))
    item = " ".join(say(14))
    docs += [(300, " ".join([*say(20), item.upper(), *say(20)]), "en", "src3"), (301, f"mail me at ann.{seed}@ex.com or (415) 555-0134 " + " ".join(say(20)), "en", "src4"), (302, None, None, None), (303, "", "en", ""), (None, " ".join(say(25)), "fr", "src0")]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in docs], toxic, [("q1", item), ("q2", None)]


def written(spark, folder, docs, toxic, items):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, v) for k, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_and_run_like_plain_rules(spark, tmp_path):
    docs, toxic, items = corpus()
    folder = written(spark, tmp_path / "c", docs, toxic, items)
    now, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        now = pipeline.stored(stage(spark, now, folder))
        kept[name] = sorted(now.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    clean = [d[0] for d in docs if not (d[0] and 100 <= d[0] < 140)]
    assert ids["toxicity"] == clean
    assert ids["near_duplicates"] == [i for i in clean if i not in (201, 202, 203, 204, 205)]
    assert ids["decontamination"] == [i for i in ids["near_duplicates"] if i != 300]
    assert ids["pii"] == ids["decontamination"]
    before = {r.doc_id: r.text for r in kept["decontamination"]}
    for r in kept["pii"]:
        assert (r.text != before[r.doc_id]) == (r.doc_id == 301) and r.n_chars == (None if r.text is None else len(r.text))
    text = next(r.text for r in kept["pii"] if r.doc_id == 301)
    assert "ann.5@ex.com" not in text and "555-0134" not in text and text.split()[-20:] == before[301].split()[-20:]
    assert set(ids["mixing"]) <= set(ids["pii"]) and len(ids["mixing"]) > 30
    assert sorted(map(repr, pipeline.run(spark, folder).collect())) == sorted(map(repr, kept["mixing"]))


def test_run_on_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path / "c", *[x[:1] if isinstance(x, list) else {0: 1} for x in corpus()])
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/e/{t}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/e").count() == 0


def test_driver_gets_the_model_alone(spark, monkeypatch):
    """The bags of the classifier's sample stay on the cluster, where it is trained."""
    docs = spark.createDataFrame([(i, f"{'vile awful' if i % 2 else 'kind lovely'} words number {i}") for i in range(80)], "doc_id long, text string")
    kind, seen = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    weights, bias = toxicity.fit_by_id(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) label"), per_class=30)
    assert max(map(len, seen)) <= 2 and weights.shape == (1 << toxicity.BITS,)
    got = collect(toxicity.score(docs, (weights, bias)))
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got)
