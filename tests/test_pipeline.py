import json
import random
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline.operators import beliefs, fusion, graph, reports
from plumbline.plans import cutting, pipeline
from plumbline.sources import clustered, readers, snapshots, writers


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Review and metadata JSON, with exact copies."""
    where = tmp_path_factory.mktemp("json")
    pick = random.Random(5)
    mood = ["good", "great", "horrible", "not good", "", "plain"]
    reviews = [
        {
            "reviewerID": f"u{pick.randrange(40)}", "asin": f"p{pick.randrange(25)}", "overall": float(pick.randrange(1, 6)),
            "reviewerName": "N", "verified": True, "vote": pick.choice([None, "3", "1,200"]), "reviewTime": "01 1, 2015",
            "unixReviewTime": 1_400_000_000 + i, "summary": "s", "reviewText": pick.choice(mood),
        }
        for i in range(120)
    ]
    (where / "reviews.json").write_text("\n".join(json.dumps(r) for r in reviews + reviews[:10]))
    (where / "meta.json").write_text("\n".join(json.dumps({"asin": f"p{i}", "title": f"T{i}", "price": 1}) for i in range(20)))
    return where


def test_whole_chain_on_files(spark, files, folder):
    lexicon = spark.createDataFrame([("good", 1.9), ("great", 3.1), ("horrible", -2.5)], "token string, valence double")
    base = folder + "/games"
    pipeline.prepare(spark, str(files / "reviews.json"), str(files / "meta.json"), base, "G", lexicon)
    edges = readers.read_table(spark, writers.stage_path(base, "degrees"))
    assert edges.count() == 120 and edges.where("s is null").count() == 0
    vertices = readers.read_table(spark, writers.stage_path(base, "vertices"))
    sums = {r["type"]: r["n"] for r in vertices.groupBy("type").agg({"deg": "sum"}).toDF("type", "n").collect()}
    assert sums == {"u": 120, "p": 120}

    snapshots = folder + "/snapshots"
    labels = pipeline.infer(spark, base, 2, snapshot_dir=snapshots)
    assert labels.count() == 120 and labels.where("label is null").count() == 0
    assert tuple(fusion.unlabelled_edges(labels).first()) == (120, 0)
    shares = reports.label_shares(labels).collect()
    assert sum(r.share for r in shares) == pytest.approx(1.0)
    report = reports.review_label_distribution(labels, "bad").collect()
    assert sum(r.reviews for r in report) == 120
    as_map = fusion.with_mass_map(labels).first().masses
    assert set(as_map) == {"fake", "genuine", "uncertainty"}
    progress = readers.read_table(spark, writers.stage_path(base, "progress")).first()
    assert tuple(progress) == (120, 0)
    with pytest.raises(ValueError):
        pipeline.infer(spark, base, 1, start=3)


LEXICON = [("good", 1.9), ("good", 2.5), ("great", 3.1), ("horrible", -2.5)]


def prepared(spark, files, base, label, **options):
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    pipeline.prepare(spark, str(files / "reviews.json"), str(files / "meta.json"), base, label, lexicon, **options)


def test_narrow_tables_carried_columns_and_no_left_overs(spark, files, folder):
    base = folder + "/toys"
    before = set(Path(cutting.checkpoint_root(spark).removeprefix("file:")).glob("*-*"))
    prepared(spark, files, base, "T", boost=True, carry=("overall", "verified"))
    for name in ("sentiment", "degrees", "belief_edges"):
        assert not set(pipeline.TEXTS) & set(readers.read_table(spark, writers.stage_path(base, name)).columns)
    rejects = readers.read_table(spark, writers.stage_path(base, "rejects")).first()
    assert rejects.asDict() == {"reviews": 120, "bad_rating": 0, "bad_vote": 0, "null_score": 0, "zero_score": rejects.zero_score, "broken_reviews": 0, "broken_products": 0}
    enriched = readers.read_table(spark, writers.stage_path(base, "degrees"))
    assert rejects.zero_score == enriched.where("s = 0").count()
    assert not Path(writers.stage_path(base, "broken_reviews")).exists()

    labels = pipeline.infer(spark, base, 3, snapshot_dir=folder + "/rounds", carry=("overall",))
    assert labels.where("overall is not null").count() == 120
    masses = labels.selectExpr("abs(fake + genuine + uncertainty - 1) AS off")
    assert masses.where("off > 2e-4").count() == 0
    left = {p for p in set(Path(cutting.checkpoint_root(spark).removeprefix("file:")).glob("*-*")) - before if list(p.glob("*.parquet"))}
    assert not left


def test_resumed_run_gives_the_same_labels(spark, files, folder):
    bases = [folder + "/one", folder + "/two"]
    for base in bases:
        prepared(spark, files, base, "G")
    whole = pipeline.infer(spark, bases[0], 3, snapshot_dir=folder + "/a")
    edges = readers.read_table(spark, writers.stage_path(bases[1], "belief_edges"))
    beliefs.run_lbp(edges, 2, snapshot_dir=folder + "/b")
    resumed = pipeline.infer(spark, bases[1], 1, start=3, snapshot_dir=folder + "/b")
    rows = lambda df: sorted((r.edge_id, r.label, round(r.fake, 9)) for r in df.collect())
    assert rows(whole) == rows(resumed)


def test_merged_categories_can_be_labelled(spark, files, folder):
    parts = [(folder + "/games", "G"), (folder + "/toys", "T")]
    for base, tag in parts:
        prepared(spark, files, base, tag)
    merged = folder + "/all"
    pipeline.merge(spark, parts, merged)
    vertices = readers.read_table(spark, writers.stage_path(merged, "belief_vertices"))
    assert {(r.G, r.T) for r in vertices.collect()} == {(1, 1)}
    assert vertices.groupBy("type").sum("deg").select("sum(deg)").distinct().collect()[0][0] == 240
    assert pipeline.infer(spark, merged, 1).count() == 240


def test_texts_are_not_shuffled_after_the_sentiment(spark, files, folder):
    base = folder + "/plan"
    prepared(spark, files, base, "G")
    edges = readers.read_table(spark, writers.stage_path(base, "edges"))
    lexicon = spark.createDataFrame(LEXICON, "token string, valence double")
    plan = pipeline.add_sentiment(edges, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and "review_text" not in plan.splitlines()[0] + "".join(joins)


def test_broken_lines_are_set_aside(spark, files, folder):
    broken = ['{"reviewerID": "u1", "asin": "p1", "overall"', "no json", '{"reviewerID": "u2", "asin": "p2", "overall": "five"}']
    lines = (files / "reviews.json").read_text().split("\n")
    Path(folder, "reviews.json").write_text("\n".join([broken[0], *lines[:60], broken[1], "", *lines[60:], broken[2]]))
    Path(folder, "meta.json").write_text((files / "meta.json").read_text() + "\n[1, 2\n")
    base, lexicon = folder + "/games", spark.createDataFrame(LEXICON, "token string, valence double")
    pipeline.prepare(spark, folder + "/reviews.json", folder + "/meta.json", base, "G", lexicon)
    rejects = readers.read_table(spark, writers.stage_path(base, "rejects")).first()
    assert (rejects.reviews, rejects.bad_rating, rejects.broken_reviews, rejects.broken_products) == (120, 0, 3, 1)
    aside = readers.read_table(spark, writers.stage_path(base, "broken_reviews")).collect()
    assert {r.broken for r in aside} == set(broken) and all(r.file.endswith("reviews.json") for r in aside)
    assert [r.src for r in aside if r.broken == broken[2]] == ["u2"]  # what could be read
    assert readers.read_table(spark, writers.stage_path(base, "edges")).where("src is null").isEmpty()
    assert readers.read_reviews(spark, folder + "/reviews.json").count() == 130
    assert readers.read_products(spark, folder + "/meta.json").count() == 20


def test_clustered_edges_save_an_exchange(spark, files, folder):
    base = folder + "/games"
    prepared(spark, files, base, "G")
    path = writers.stage_path(base, "belief_edges")
    shuffles = {}
    for name, edges in (("plain", readers.read_table(spark, path)), ("clustered", clustered.read_clustered(spark, path))):
        step = beliefs.product_to_user(beliefs.user_to_product(edges))
        shuffles[name] = step._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert edges.count() == 120 and step.count() == 120
    assert shuffles == {"plain": 2, "clustered": 1}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(clustered.read_clustered(spark, path)) == rows(readers.read_table(spark, path))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("clustered_")]


def test_tables_with_a_heavy_key_are_not_clustered(spark, folder):
    df = spark.range(100).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS k", "id AS v")
    with_quote = folder + "/it's"
    assert clustered.write_clustered(df, with_quote, "k", buckets=3)
    assert clustered.read_clustered(spark, with_quote).agg(F.sum("v"), F.count("k")).first() == (4950, 66)
    assert not clustered.write_clustered(df, folder + "/plain", "k", limit=20)  # the rows without a key
    assert clustered.read_clustered(spark, folder + "/plain").count() == 100
    with pytest.raises(FileExistsError):
        clustered.write_clustered(df, with_quote, "k")


def jobs_of(spark, work):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counting_on_a_write_takes_no_job(spark, folder):
    df = spark.range(1000).selectExpr("id", "id % 7 AS s").repartition(5)
    found = {}
    plain = jobs_of(spark, lambda: writers.write_table(df, folder + "/plain"))
    counted = jobs_of(spark, lambda: found.update(writers.write_counted(df, folder + "/counted", beliefs.unscored_counts())))
    assert plain == counted and found == {"null_score": 0, "zero_score": 143}


def test_rounds_left_by_a_crash_do_not_count(spark, folder, monkeypatch):
    root, df = folder + "/rounds", spark.range(20).selectExpr("id", "id * 2 AS twice")
    assert snapshots.last_iteration(spark, root) is None
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshots(spark, root)
    for i in (9, 10):
        snapshots.write_snapshot(df.where(F.col("id") < i), root, i)
    # a round that was written in part, and one whose table is complete but not entered
    Path(root, "iteration=11").mkdir()
    Path(root, "iteration=11", "part-0.snappy.parquet").write_bytes(b"PAR1 half")
    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_commit", lambda *x: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            snapshots.write_snapshot(df, root, 12)
    assert snapshots.last_iteration(spark, root) == 10
    assert {r.iteration: r["count"] for r in snapshots.read_snapshots(spark, root).groupBy("iteration").count().collect()} == {9: 9, 10: 10}
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root, 12)
    for i in (11, 12):
        snapshots.write_snapshot(df.where(F.col("id") < i), root, i)
    assert {tuple(r) for r in snapshots.manifest(spark, root).collect()} == {(i, i) for i in (9, 10, 11, 12)}
    assert snapshots.read_snapshot(spark, root, 11).dtypes == df.dtypes
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot(df, root, 12)
    snapshots.write_snapshot(df, root, 12, mode="overwrite")
    assert snapshots.read_snapshot(spark, root, 12).count() == 20
    with pytest.raises(ValueError):
        snapshots.write_snapshot(df, root, 13, mode="append")


def test_resume_after_a_crash_gives_the_same_labels(spark, files, folder, monkeypatch):
    bases = [folder + "/one", folder + "/two"]
    for base in bases:
        prepared(spark, files, base, "G")
    whole = pipeline.infer(spark, bases[0], 3, snapshot_dir=folder + "/a")
    commit = snapshots._commit

    def lost(spark, root, iteration, entry):
        if iteration == 2:
            raise OSError("lost")
        commit(spark, root, iteration, entry)

    with monkeypatch.context() as patch:
        patch.setattr(snapshots, "_commit", lost)
        with pytest.raises(OSError):
            pipeline.infer(spark, bases[1], 3, snapshot_dir=folder + "/b")
    resumed = pipeline.infer(spark, bases[1], 3, start=None, snapshot_dir=folder + "/b")
    assert snapshots.committed(spark, folder + "/b") == [1, 2, 3]
    rows = lambda df: sorted((r.edge_id, r.label, round(r.fake, 9)) for r in df.collect())
    assert rows(whole) == rows(resumed)
    active = folder + "/three"
    prepared(spark, files, active, "G")
    assert rows(pipeline.infer(spark, active, 3, tolerance=0.0)) == rows(whole)


def test_tables_are_not_overwritten_unasked(spark, folder):
    df = spark.range(10).withColumnRenamed("id", "k")
    path = folder + "/t"
    writers.write_table(df, path, cluster_by=("k",))
    with pytest.raises(AnalysisException):
        writers.write_table(df, path)
    writers.write_table(df.selectExpr("k", "k % 2 as half"), path, mode="overwrite", partition_by=("half",))
    assert sorted(p.name for p in Path(path).glob("half=*")) == ["half=0", "half=1"]
    assert readers.read_table(spark, path).where("half = 1").count() == 5
    assert readers.read_spread(spark, path, "k").count() == 10


def test_degree_histogram_csv(spark, folder):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "src string, dst string")
    writers.write_degree_histogram(reports.degree_histogram(graph.degrees(edges)), "u", folder + "/csv")
    back = readers.read_degree_histogram(spark, folder + "/csv")
    assert {tuple(r) for r in back.collect()} == {(2, 1), (1, 1)}


def test_lexicon_file(spark, folder):
    Path(folder, "lexicon.txt").write_text("good\t1.9\t0.9\t[2, 1]\n:(\t-1.9\t1.1\t[-1]\n")
    got = readers.read_lexicon(spark, folder + "/lexicon.txt").collect()
    assert {tuple(r) for r in got} == {("good", 1.9), (":(", -1.9)}


def test_checkpoints_go_where_the_session_says(spark):
    root = cutting.checkpoint_root(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert root == (named or spark.sparkContext.getCheckpointDir())
    assert cutting.scratch_path(spark, "x").startswith(root.rstrip("/") + "/x-")
    df = cutting.cut(spark.range(5))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().toString()
