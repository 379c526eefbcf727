import json
import os

import pytest
from pyspark.sql import functions as F

from reelmill.params import FIRST
from reelmill.plans.training import prepare_reviews, train
from reelmill.sources import artifacts, files
from reelmill.streaming import feedback as FB


def test_review_parts_in_every_layout(spark, tmp_path):
    one = {"review": "first", "rating": 7, "movie": "A"}
    (tmp_path / "part-1.json").write_text(json.dumps(one) + "\n" + json.dumps({**one, "review": "second"}) + "\n")
    (tmp_path / "part-2.json").write_text(json.dumps([{"text": "third", "score": "8"}, {"text": "fourth", "score": 2}], indent=1))
    (tmp_path / "part-3.json").write_text(json.dumps({"0": {"content": "fifth {", "stars": 3}, "1": {"content": "sixth", "stars": 4}}))
    (tmp_path / "part-4.json").write_text(json.dumps({**one, "review": "seventh"}))
    (tmp_path / "other.json").write_text("{}")
    df = files.with_review_ids(files.read_reviews(spark, str(tmp_path)))
    from reelmill.plans.training import named_reviews

    rows = named_reviews(df).collect()
    assert sorted(r["review"] for r in rows) == sorted(["first", "second", "third", "fourth", "fifth {", "sixth", "seventh"])
    assert len({r["review_id"] for r in rows}) == 7 and {r["rating"] for r in rows} == {7.0, 8.0, 2.0, 3.0, 4.0}
    with pytest.raises(FileNotFoundError):
        files.read_reviews(spark, str(tmp_path / "nothing"))


def test_lines_with_an_object_first_are_lines(spark, tmp_path):
    rows = [{"helpful": {"yes": i}, "rating": i, "review": f"r{i}"} for i in range(5)]
    (tmp_path / "part-1.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
    df = files.read_reviews(spark, str(tmp_path))
    assert df.count() == 5 and {"helpful", "rating", "review"} == set(df.columns)


def test_dict_keeps_all_columns(spark, tmp_path):
    content = {str(i): {"Movie": f"m{i}", "Rating": i, "Review_Detail": "x", "extra": {"a": [i]}, **({"Late": "y"} if i == 3 else {})} for i in range(4)}
    (tmp_path / "part-1.json").write_text(json.dumps(content, indent=1))
    df = files.read_reviews(spark, str(tmp_path))
    assert set(df.columns) == {"movie", "rating", "review_detail", "extra", "late"}
    rows = {r["movie"]: r for r in df.collect()}
    assert len(rows) == 4 and rows["m2"]["rating"] == "2" and rows["m2"]["extra"] == '{"a":[2]}' and rows["m3"]["late"] == "y"


def test_broken_and_unclear_files_are_named(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-1.json").write_text('{"review": "a"}\n{"review": "b"\n{"review": "c"}\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        files.read_reviews(spark, str(tmp_path / "a")).collect()
    assert files.read_reviews(spark, str(tmp_path / "a"), on_broken="skip").count() == 2
    (tmp_path / "b").mkdir()
    big = {"first": {"x": "y" * files.HEAD}, "review": "a"}
    (tmp_path / "b" / "part-7.json").write_text(json.dumps(big, indent=1))
    with pytest.raises(ValueError, match="part-7.json"):
        files.read_reviews(spark, str(tmp_path / "b"))
    assert files.read_reviews(spark, str(tmp_path / "b"), layout="object").count() == 1
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part-1.json").write_text('{"1": {"review": "a"}, "2": broken}')
    with pytest.raises(Exception):
        files.read_reviews(spark, str(tmp_path / "c"), layout="dict").collect()


def test_layouts():
    assert files.layout_of('{"a": {"b": 1}}\n{"a": {"b": 2}}\n', True) == "lines"
    assert files.layout_of('{"a": {"b": 1}, "c": {"d": 1}}', True) == "dict"
    assert files.layout_of('{"a": 1}', True) == "lines" and files.layout_of('{"a":\n 1}', True) == "object"
    long = json.dumps({str(i): {"a": i} for i in range(99)})
    assert files.layout_of(long[:400], False) == "dict"
    for unclear in (json.dumps({"a": {"x": 1}, "b": 2, "c": {}})[:20], '{"a": {"x": "' + "y" * 99, '{"a": {"x": 1}, "b": {"y'):
        with pytest.raises(ValueError):
            files.layout_of(unclear, False)
    assert files.layout_of(' [\n{"a": 1}', False) == "array" and files.layout_of("", True) == "lines"


def test_rewritten_as_lines(spark, tmp_path):
    (tmp_path / "part-1.json").write_text(json.dumps([{"review": "a\nb", "rating": 1}, {"review": "c"}]))
    files.rewrite_as_lines(spark, str(tmp_path), str(tmp_path / "lines"))
    assert {r["review"] for r in spark.read.json(str(tmp_path / "lines")).collect()} == {"a\nb", "c"}


def test_catalogue_and_csv(spark, tmp_path):
    path = tmp_path / "titles.tsv"
    path.write_text('tconst\ttitleType\tprimaryTitle\toriginalTitle\tisAdult\tstartYear\nt1\tmovie\t"Odd\tNone\t0\t1999\nt2\tshort\t\\N\tX\t0\t\\N\n')
    rows = files.read_catalogue(spark, str(path)).orderBy("tconst").collect()
    assert [tuple(r) for r in rows] == [("t1", "movie", '"Odd', "None", "1999"), ("t2", "short", None, "X", None)]
    df = spark.createDataFrame([("a, \"b\"\nc", 7.0, "i")], "review string, rating double, item string")
    files.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == ["review", "rating", "item"] and back.first()["review"] == 'a, "b"\nc'


def test_metrics_and_runs(spark, tmp_path):
    out = str(tmp_path)
    artifacts.append_metrics(spark, out, "r1", {"accuracy": 0.9, "precision_5": 0.3})
    artifacts.append_metrics(spark, out, "r2", {"accuracy": 0.8})
    assert artifacts.read_metric(spark, out, "accuracy", "r2") == 0.8 and artifacts.read_metric(spark, out, "none") is None
    assert artifacts.read_metrics(spark, out).filter("metric = 'precision'").first()["k"] == 5
    artifacts.append_metrics(spark, out, "r3", {"precision_5": 0.1, "precision_10": 0.2})
    assert artifacts.read_metric(spark, out, "precision", k=10) == 0.2 and artifacts.read_metric(spark, out, "precision", k=5) == 0.1
    assert artifacts.read_metric(spark, out, "precision", "r1") == 0.3 and artifacts.read_metric(spark, out, "accuracy") == 0.8
    with pytest.raises(ValueError, match="which"):
        artifacts.read_metric(spark, out, "precision")
    artifacts.record_run(spark, out, "r1", {"seed": 42}, {"accuracy": 0.9})
    assert artifacts.read_runs(spark, out).first()["config"] == {"seed": "42"}
    with pytest.raises(FileNotFoundError, match="vocab"):
        artifacts.load_artifacts(spark, out)


EVENTS = [
    # event_id, ts, user, item, action, rating, review
    (1, 1, "u", "a", "like", None, None), (2, 2, "u", "b", "rate", 8, "good"), (3, 3, "u", "b", "unlike", None, None),
    (4, 4, "u", "c", "rate", 3, "bad"), (5, 5, "u", "c", "delete", None, None), (6, 6, "u", "c", "like", None, None),
    (7, 6, "u", "d", "unlike", None, None), (8, 7, "u", "e", "none", None, None), (9, 2, "u", "a", "unlike", None, None), (10, 2, "u", "a", "like", None, None),
]
STATE = {("a", True, None, None), ("b", False, 8, "good"), ("c", True, None, None), ("d", False, None, None)}
SCHEMA = "event_id long, ts int, user string, item string, action string, rating int, review string"


def test_feedback_in_any_order(spark):
    for rows in (EVENTS, EVENTS[::-1]):
        state = FB.fold_feedback(spark.createDataFrame(rows, SCHEMA))
        assert {(r["item"], r["favorite"], r["rating"], r["review"]) for r in state.collect()} == STATE
    nested = FB.nested_state(state).first()
    assert nested["favorites"] == ["a", "c"] and nested["ratings"] == {"b": 8}


def test_stream_equals_batch_with_late_and_replayed_events(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for part in (EVENTS[5:], EVENTS[:5]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        FB.stream_feedback(spark.readStream.schema(SCHEMA).parquet(src), out, log).awaitTermination()
    assert {(r["item"], r["favorite"], r["rating"], r["review"]) for r in FB.stream_state(spark, out).collect()} == STATE
    assert len([d for d in os.listdir(out) if d.startswith("batch_id=")]) >= 2


def test_state_lies_in_rocksdb_and_survives_a_restart(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    seen = []
    for part in (EVENTS[:5], EVENTS[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        query = FB.stream_feedback(spark.readStream.schema(SCHEMA).parquet(src), out, log)
        query.awaitTermination()
        seen.append(query.recentProgress[-1]["stateOperators"][0])
    assert all(any(name.startswith("rocksdb") for name in s["customMetrics"]) for s in seen)
    assert seen[1]["numRowsTotal"] >= seen[0]["numRowsTotal"] > 0  # keys of the first run are still there
    assert any(f.endswith(".changelog") for _, _, names in os.walk(os.path.join(log, "state")) for f in names)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert {(r["item"], r["favorite"], r["rating"], r["review"]) for r in FB.stream_state(spark, out).collect()} == STATE


def test_snapshots_replace_the_change_log(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for n, row in enumerate(EVENTS):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        FB.stream_feedback(stream, out, log, compact_every=3).awaitTermination()
        if n == 6:  # a snapshot that was cut off counts for nothing
            os.makedirs(os.path.join(out, FB.SNAPSHOTS, "upto=99"))
    assert {(r["item"], r["favorite"], r["rating"], r["review"]) for r in FB.stream_state(spark, out).collect()} == STATE
    assert len([d for d in os.listdir(out) if d.startswith("batch_id=")]) <= 2


def review_rows(spark):
    good, bad = "wonderful moving picture with great acting and lovely music", "dull boring mess with awful acting and tired jokes"
    rows = [(i, f"m{i % 4}", f"u{i % 9}", 9.0 if i % 2 else 2.0, f"{good if i % 2 else bad} number {'x' * (i % 7 + 2)}", 0) for i in range(120)]
    return spark.createDataFrame(rows, "review_id long, movie string, reviewer string, rating double, review string, spoiler int")


def test_train_end_to_end(spark, tmp_path):
    from dataclasses import replace

    params = replace(FIRST, svd_k=2, svd_iterations=2, svc_max_iter=15, min_words=5)
    metrics = train(review_rows(spark), str(tmp_path), None, params, with_cv=False)
    assert metrics["accuracy"] == 1.0 and metrics["roc_auc"] == 1.0 and 0 < metrics["explained_variance"] <= 1
    tables, model = artifacts.load_artifacts(spark, str(tmp_path))
    assert tables["item_vectors"].count() == 4 - 2 and model is not None  # odd ids only are good
    assert artifacts.read_metric(spark, str(tmp_path), "accuracy") == 1.0


def test_optional_columns(spark):
    bare = review_rows(spark).drop("movie", "reviewer")
    reviews, training = prepare_reviews(bare)
    assert "item" not in reviews.columns and training.count() == reviews.count()


def test_sample_size_reaches_the_classifier_only(spark):
    from dataclasses import replace

    reviews, training = prepare_reviews(review_rows(spark), params=replace(FIRST, sample_size=20, min_words=5))
    assert reviews.count() == 120 and training.count() == 20
    reviews, training = prepare_reviews(review_rows(spark), params=replace(FIRST, sample_size=20, min_words=5), published_order=True)
    assert reviews.count() == 20 and training.count() == 20


def test_second_configuration(spark, tmp_path):
    from dataclasses import replace

    from reelmill.params import SECOND

    params = replace(SECOND, svd_k=2, svd_iterations=2, svc_max_iter=10, min_words=5, svd_min_user_rows=3)
    metrics = train(review_rows(spark), str(tmp_path), None, params, with_cv=False, fit_on="train", published_order=True, exports=True)
    assert metrics["accuracy"] == 1.0 and metrics["n_items_profiled"] == 2 and metrics["seconds_factors"] > 0
    exported = spark.read.option("header", True).csv(str(tmp_path / "cleaned_reviews_csv"))
    assert "clean_text" in exported.columns and exported.count() == 120


def test_a_class_without_rows_is_named(spark):
    from reelmill.operators.models import fit_svm

    with pytest.raises(ValueError, match="class"):
        fit_svm(spark.createDataFrame([(1,)], "label int"))


def test_plans_stay_flat(spark):
    """Text filters clean once, key sets are broadcast, and no plan has a cross product."""
    from checks import queries as Q

    for name in ("known_items", "balanced_reviews", "recommended_by_query_plain", "user_ranking_metrics"):
        plan = Q.REGISTRY[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    plan = Q.REGISTRY["active_users"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan


def test_stream_has_work_for_every_core_in_six_batches(spark, monkeypatch):
    """Each micro-batch read one file, so one task parsed it."""
    import os

    from checks import queries as Q

    seen, start = {}, Q.FB.stream_feedback

    def stream(events, out, log, **options):
        seen["files"] = len(spark.read.parquet(os.path.join(os.path.dirname(out), "in")).inputFiles())
        seen["query"] = start(events, out, log, **options)
        return seen["query"]

    monkeypatch.setattr(Q.FB, "stream_feedback", stream)
    assert Q.streamed_feedback(spark, "/root/testdata/sf0.001").count() > 0
    batches = {p["batchId"] for p in seen["query"].recentProgress if p["numInputRows"]}
    assert seen["files"] == 6 * spark.sparkContext.defaultParallelism and len(batches) == 6
