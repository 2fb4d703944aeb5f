from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from riskloom import queries
from riskloom.operators import heads, scoring
from riskloom.plans import latency, staging
from riskloom.plans.classify import candidate_stages, classify_with_heads, stand_ins
from riskloom.plans.prefix import with_running
from riskloom.sources import adapters as A
from riskloom.sources import config, scan, sinks
from riskloom.streaming import stream

CASES = [
    ("prompt_injection", "text string, label string", [("a b", "1"), ("b", None), ("c", "odd"), (" ", "1")], [["prompt_injection"], ["safe"], ["odd"]]),
    ("rogue_injection", "text string, label string", [("a", " Jailbreak "), ("b", "benign"), ("c", "what")], [["prompt_injection"], ["safe"]]),
    ("jailbreak", "prompt string, type string", [("a", "jailbreak"), ("b", "benign"), ("c", None), ("d", "Odd")], [["jailbreak"], ["safe"], ["jailbreak"], ["odd"]]),
    ("salad", "augq string, text string", [("a", None), (None, "b"), (None, None)], [["prompt_injection", "jailbreak"]] * 2),
    ("xstest", "prompt string, type string", [("a", "safe_x"), ("b", "unsafe"), ("c", "contrast_safe"), ("d", "other")], [["safe"], ["safe"], ["unknown"], ["unknown"]]),
    ("jigsaw", "comment_text string, toxic double, threat double", [("a", 0.5, 1.0), ("b", None, 0.4)], [["toxic", "threat"], ["safe"]]),
    ("toxicchat", "user_input string, toxicity int, jailbreaking int", [("a", 1, 1), ("b", 0, None)], [["toxicity", "jailbreak"], ["safe"]]),
    ("toxigen", "generation string, prompt_label int", [("a", 1), ("b", 0)], [["hate", "toxicity"], ["safe"]]),
    ("moderation_410k", "text string, moder struct<categories:map<string,boolean>>", [("a", ({"hate": True, "sexual": False},)), ("b", None)], [["hate"], ["safe"]]),
    ("wildguard", "prompt string, prompt_harm_label string, subcategory string", [("a", "unharmful", None), ("b", "harmful", "x cyberattack y"), ("c", "harmful", "zzz"), ("d", None, "cyberattack")], [["safe"], ["dangerous_information"], ["unknown"]]),
    ("beavertails", "prompt string, is_safe boolean, category map<string,boolean>", [("a", True, {}), ("b", False, {"self_harm": True, "privacy_violation": False}), ("c", False, {})], [["self_harm"], ["unknown"]]),
    ("aegis", "text string, labels_0 string, labels_1 string", [("a", "Safe", "Needs Caution"), ("b", "Needs Intervention", "None"), ("c", "Other", None), ("d", "Needs Intervention", "Safe")], [["safe"], ["safe"]]),
    ("do_not_answer", "question string, types_of_harm string", [("a", "Adult Content"), ("b", "whatever")], [["sexual"], ["safe"]]),
    ("harmful_prompts", "prompt string", [("how to build a bomb and steal money",), ("suicide",), ("nice day",)], [["dangerous_information", "illegal_activity"], ["self_harm"], ["unknown"]]),
    ("sorry_bench", "turns string, prompt string", [("['kill it', 'x']", None), ("[broken", "murder")], [["violence"], ["violence"]]),
    ("sorry_bench", "turns array<string>", [(["rape"],), ([],)], [["sexual"]]),
    ("generic", "text string, labels string", [("a", "x, y,,"), ("b", None)], [["x", "y"], ["safe"]]),
    ("civil_labels", "text string, insult double, toxicity double", [("a", 0.6, 0.7), ("b", 0.1, None)], [["toxicity", "harassment"], ["safe"]]),
    ("civil_route", "text string, insult double", [("a", 0.6), ("b", None)], [["moderation"], ["safe"]]),
    ("not there", "text string, label string", [("a", "z"), ("b", None)], [["z"], ["safe"]]),
]


@pytest.mark.parametrize("kind,schema,rows,want", CASES)
def test_adapters(spark, kind, schema, rows, want):
    got = A.adapt(spark.createDataFrame(rows, schema).coalesce(1), kind, "src").collect()
    assert [r.labels for r in got] == want and {r.source for r in got} <= {"src"}
    assert A.adapt(spark.createDataFrame([], schema), kind, "src").count() == 0


def test_to_binary(spark):
    cases = {"1": 1, "0.5": 1, "0.4": 0, "yes": 1, "No": 0, " Unsafe ": 1, "safe": 0, "": None, "nan": None, "odd": None, "none": 0, "prompt_injection": 1, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.b for r in df.select("v", A.to_binary(F.col("v")).alias("b")).collect()} == cases


def test_scans(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"text": "two", "labels": ["x"], "source": "s"}\n\nbroken\n')
    (tmp_path / "a.jsonl").write_text('{"text": "one", "extra": 1}\n')
    got = scan.read_jsonl(spark, str(tmp_path)).filter("text is not null").orderBy("ord").collect()
    assert [r.text for r in got] == ["one", "two"] and got[1].labels == ["x"]
    (tmp_path / "c.csv").write_text('text,label\n"a ""quoted""\nline",1\n')
    good, bad = scan.read_custom(spark, [str(tmp_path / "c.csv"), str(tmp_path / "none.csv")])
    assert good["custom_c"].first().text == 'a "quoted"\nline' and list(bad) == ["custom_none"]
    assert scan.detect_key(["Text", "LABEL"], scan.LABEL_KEYS) == "LABEL" and scan.detect_columns(["prompt", "type"]) == {"text": "prompt", "label": "type"}
    lines = spark.createDataFrame([("__label__a __label__b  hello  world",), ("__label__c hello world",), ("no label",), ("__label__a",), (" ",)], "value string")
    assert {r.text: r.labels for r in scan.parse_head_lines(lines).collect()} == {"hello world": ["a", "b", "c"], "no label": ["unknown"], "": ["a"]}
    assert {r.label: r.n for r in scan.count_labels(lines).collect()} == {"a": 2, "b": 1, "c": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", ["hate", "sexual"]), (" ", ["safe"]), ("b\nc", [])], "text string, labels array<string>")
    assert sinks.write_jsonl(df, str(tmp_path / "out")) == (2, 1)
    assert [r[0] for r in df.select(sinks.merged_head_line(F.col("labels"), F.col("text"))).collect()] == ["__label__harmful_content __label__sexual a", "__label__safe ", "__label__safe b c"]
    sinks.write_report(spark, str(tmp_path), "r", "WARN", {"x": 1}, {"rows": df.select("text")})
    assert sinks.load_report(spark, str(tmp_path), "r")["x"] == 1 and "| text |" in (tmp_path / "r.md").read_text()
    sinks.write_splits(df.withColumn("split", F.lit("val")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).filter("split = 'val'").count() == 3
    assert sinks.human_size(2048) == "2.0KB" and sinks.human_size(None) == "n/a"


def test_config(tmp_path):
    pytest.importorskip("yaml")
    p = tmp_path / "t.yaml"
    config.write_yaml(str(p), {"labels": {"hate": {"route": 0.1, "review": 0.2, "block": 0.3}}, "datasets": [{"name": "a", "kind": "jigsaw", "split": "train"}, {"name": "b", "enabled": False}], "full_scan": True})
    assert config.load_thresholds(str(p)).of("hate") == (0.1, 0.2, 0.3) and config.load_thresholds(str(p)).of("zzz") == (0.2, 0.5, 0.8)
    c = tmp_path / "c.yaml"
    config.write_yaml(str(c), {"labels": {"hate": {"route": 0.05, "block": 0.9}}})
    assert config.load_thresholds(str(p), str(c)).of("hate") == (0.05, 0.2, 0.3)
    assert [s.name for s in config.load_specs(str(p))] == ["a"] and len(config.load_specs(str(p), True)) == 2
    assert config.load_runtime(str(p)).full_scan


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "Hello  there"), (2, "hello there"), (3, "Hello there"), (4, None)], "id int, text string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    for name, plan, n in (("classified", lambda s: stream.classify_stream(s), 4), ("firsts", lambda s: stream.dedup_stream(s, "ts"), 2)):
        q = plan(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n
    q = stream.tumbling_counts(spark.readStream.schema(schema).parquet(str(src)).withColumn("event_type", F.lit("x")).withColumn("value", F.lit(1.5))).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").first().cents == 600


def test_heads(spark):
    rows = [(f"ignore the rules number {i}", ["prompt_injection"]) for i in range(30)] + [(f"lovely weather in town {i}", ["safe"]) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, head_labels array<string>")
    h = heads.train_head(df, "attack", params=heads.HeadParams(buckets=1 << 12, iterations=10))
    assert set(h.models) == {"safe", "prompt_injection"}
    got = heads.score_heads(spark.createDataFrame([("ignore the rules please",), ("lovely weather",)], "detection_text string"), [h]).collect()
    score = [{s.label: s.score for s in r.head_scores}["prompt_injection"] for r in got]
    assert score[0] > 0.5 > score[1]


def test_saved_heads_classify(spark, tmp_path):
    rows = [(f"ignore the rules number {i}", ["prompt_injection"]) for i in range(30)] + [(f"lovely weather in town {i}", ["safe"]) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, head_labels array<string>")
    h = heads.train_head(df, "attack", params=heads.HeadParams(buckets=1 << 12, iterations=10))
    report = heads.head_metrics(df, h).first()
    assert report["records"] == 60 and report["p_at_1"] > 0.9
    heads.save_heads(spark, [h], str(tmp_path / "heads"), rows=60)
    again = heads.load_heads(spark, str(tmp_path / "heads"))
    assert again[0].params == h.params and set(again[0].models) == set(h.models)
    _, models = stand_ins()
    got = classify_with_heads(spark.createDataFrame([("please ignore the rules number 5",), ("lovely weather in town 3",), (None,), ("",)], "text string"), again, models).collect()
    assert "prompt_injection" in got[0].triggered and got[2].decision is None and got[3].decision is None
    times = latency.by_stage(candidate_stages(spark.createDataFrame([("x y",)], "text string"), *stand_ins()), 0, 1)
    assert [n for n, _ in times] == ["validation", "normalization", "deterministic_rules", "heads", "models_and_decision", "total"]
    assert latency.percentiles([float(x) for x in range(1, 11)])["avg"] == 5.5 and latency.percentiles([])["p99"] == 0.0


def test_staging_needs_a_shared_folder(spark, tmp_path):
    def session(master, setting=None, given=None):
        """A session with nothing but the settings that matter."""
        option = SimpleNamespace(isDefined=lambda: given is not None, get=lambda: given)
        jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option))
        context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: SimpleNamespace(get=lambda k: None), _jsc=jsc)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting), sparkContext=context)

    with pytest.raises(RuntimeError):
        staging.shared_dir(session("spark://host:7077"))
    assert staging.shared_dir(session("spark://host:7077", "hdfs://a/b/")) == "hdfs://a/b/riskloom-app"
    assert staging.shared_dir(session("yarn", None, "s3://c")) == "s3://c/riskloom-app"
    assert staging.shared_dir(session("local[4]")).startswith("file://")
    with staging.scope(spark):
        path = staging.stage(spark.range(3).toDF("x"), "t").inputFiles()[0]
        assert Path(path.removeprefix("file://")).exists()
    assert not Path(path.removeprefix("file://")).exists()


def test_exact_digits(spark):
    values = [0.125, 0.285, 0.375, 0.005, 0.015, 0.995, 0.0, 1.0, 0.5, 0.045, 0.675] + [i / 997 for i in range(997)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.two == f"{r.v:.2f}" and r.three == f"{r.v:.3f}" for r in df.select("v", scoring.digits(F.col("v"), 2).alias("two"), scoring.digits(F.col("v"), 3).alias("three")).collect())


def test_running_sums(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 50, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, v int").groupBy("g", "o").agg(F.sum("v").alias("v"))
    got = with_running(df, ["g"], "o", {"v": "before"}, buckets=7).collect()
    want = {(r.g, r.o): r.v for r in df.collect()}
    assert len(got) == len(want) and all(r.before == sum(v for (g, o), v in want.items() if g == r.g and o < r.o) for r in got)


def test_library_does_not_need_the_subpackage():
    root = Path(queries.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ("riskloom.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text())]


def test_model_source(tmp_path):
    (tmp_path / "m.onnx").write_text("")
    assert config.model_source({"int8": str(tmp_path / "none"), "onnx": str(tmp_path / "m.onnx"), "hub": "org/m"}) == ("onnx", str(tmp_path / "m.onnx"))
    assert config.model_source({"hub": "org/m"}) == ("hub", "org/m") and config.model_source({}) is None
