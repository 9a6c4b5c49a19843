import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import catalog as C
from tallymark.operators import labels as L
from tallymark.operators import latency as A
from tallymark.session import shared_folder
from tallymark.sources import readers as R
from tallymark.sources import writers as W
from tallymark.sources.split_csv import split_records


def test_label_csv(spark, tmp_path):
    path = tmp_path / "labels.csv"
    header = ",".join(f"h{i}" for i in range(30))
    text = "﻿" + header + "\n" + 'a.jpg,"1\n2",x\n' + ",".join(str(i) for i in range(35)) + "\n" + '"q""uote", é \n'
    path.write_text(text, encoding="utf-8")
    got = {r.csv_row: r for r in R.read_labels(spark, str(path)).collect()}
    assert sorted(got) == [2, 3, 4]
    assert got[2].c1 == "1\n2" and got[2].c3 is None
    assert got[3].c0 == "0" and got[3].c29 == "29"
    assert got[4].c0 == 'q"uote'
    cleaned = L.clean_cells(R.read_labels(spark, str(path))).filter("csv_row = 4").first()
    assert cleaned.c1 == "é"


def expected_cells(text):
    """Records after the header, as the csv module reads them."""
    rows = list(csv.reader(io.StringIO(text, newline="")))[1:]
    return [[(r[i] or None) if i < len(r) else None for i in range(30)] for r in rows]


@pytest.mark.parametrize("seed", [1])
def test_split_csv(spark, tmp_path, seed):
    """Files cut into tiny blocks: records of many lines, quotes in odd places, both line
    ends, blank records."""
    rng = random.Random(seed)
    files = {}
    for name in ("a", "b"):
        lines = [",".join(f'"h\n{i}"' if i == 3 else f"h{i}" for i in range(30))]
        for n in range(400):
            cells = []
            for _ in range(rng.choice([0, 1, 3, 29, 31])):
                cells.append(rng.choice(["", "x", " é ", 'five" inch', '"a\nb"', '"\n\n,\n"', '"q ""uote"""', '"a" tail', '"\r\n"', '""', f"{n}", '"' + "long\n" * rng.randrange(40) + '"']))
            lines.append(",".join(cells))
        ends = [rng.choice(["\n", "\r\n"]) for _ in lines]
        ends[-1] = rng.choice(["", "\n"])
        files[name] = "".join(x + e for x, e in zip(lines, ends, strict=True))
        (tmp_path / f"{name}.csv").write_bytes(("\ufeff" + files[name]).encode())
    settings = {"spark.sql.files.maxPartitionBytes": "2801", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        scanned = R.read_labels(spark, str(tmp_path))
        rows = scanned.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name, text in files.items():
        got = sorted((r.csv_row, [r[f"c{i}"] for i in range(30)]) for r in rows if r.file_name.endswith(f"{name}.csv"))
        want = expected_cells(text)
        assert [n for n, _ in got] == list(range(2, len(want) + 2))
        assert [cells for _, cells in got] == want


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "labels.csv"
    path.write_text("h\n" + "".join(f'"{i}\nsecond ""line""",y\n' for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        text = spark.read.option("lineSep", "\n").text(str(path))
        assert text.rdd.getNumPartitions() >= 8
        got = {r.csv_row: r.c0 for r in R.read_labels(spark, str(path)).select("csv_row", "c0").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i + 2: f'{i}\nsecond "line"' for i in range(20_000)}


def test_an_unclosed_quote_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\na,"b\n' + "c\n" * 100)
    with pytest.raises(ValueError, match="record 2 of .*a.csv has no closing quote"):
        split_records(spark, str(tmp_path), max_chars=50)
    assert R.read_labels(spark, str(tmp_path)).collect()[0].c1.startswith("b\nc\nc")


def test_ordinals_over_many_blocks(spark, tmp_path):
    for name, count in (("a", 5000), ("b", 17)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" for i in range(count)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = R.read_json_lines(spark, str(tmp_path))
        wrong = lines.filter(F.get_json_object("text", "$.n").cast("long") + 1 != F.col("line_number"))
        assert lines.count() == 5017 and wrong.count() == 0
        assert lines.rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inventory_lists_every_file(spark, tmp_path):
    """Empty files, nested folders, odd names; nothing is opened, unreadable files too."""
    want = {}
    for i, folder in enumerate(["", "a", "a/b", "a/b/c", "a/b/c/d", "x=1", "e e"]):
        (tmp_path / folder).mkdir(exist_ok=True, parents=True)
        for name, size in ((f"f{i}.jpg", i), ("empty", 0), ("B b.png", 4), ("_under", 1)):
            (tmp_path / folder / name).write_bytes(b"1" * size)
            want[str(tmp_path / folder / name)] = size
        (tmp_path / folder / ".hidden").write_bytes(b"1")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        files = R.read_inventory(spark, path)
        assert {r.path.removeprefix("file:"): r.length for r in files.collect()} == want
        # A partition for each folder of the upper levels.
        assert files.rdd.getNumPartitions() >= 4
    (tmp_path / "none").mkdir()
    assert R.read_inventory(spark, str(tmp_path / "none")).count() == 0


def test_run_reports(spark, tmp_path):
    for day, avg in (("02", 2.0), ("01", 1.0)):
        report = {"model": "m", "endpoint": "e", "num_requests": 1, "successful": 1, "avg_latency_s": avg, "min_latency_s": 0.0,
                  "max_latency_s": 0.0, "timestamp": day, "details": [{"request_id": 1, "status_code": 200, "latency_s": avg}]}
        (tmp_path / f"benchmark_m_{day}.json").write_text(json.dumps(report, indent=2))
    (tmp_path / "other.json").write_text("{}")
    reports = R.read_run_reports(spark, str(tmp_path))
    assert [r.timestamp for r in A.run_report(reports).collect()] == ["01", "02"]
    assert A.distinct_models(reports).count() == 1
    out = str(tmp_path / "csv")
    W.write_csv(A.run_report(reports), out)
    assert spark.read.option("header", True).csv(out).columns == A.REPORT_COLUMNS


def test_sidecars(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "sub").mkdir()
    for other in ("a/config.json", "a/sub/model.json", "a/weights.bin"):
        (tmp_path / other).write_text('{"id": "no entry"}')
    entries = {"b": {"id": "b", "format": "gguf", "serving_target": "ollama"}, "a": {"id": "a", "serving_targets": ["vllm", "mlx"], "format": "gguf"}, "c": None}
    for name, entry in entries.items():
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "model.json").write_text(json.dumps(entry, indent=1) if entry else "broken")
    read = R.read_sidecars(spark, str(tmp_path))
    assert {r.entry: r.error for r in read.collect()} == {"a": None, "b": None, "c": "document is not a JSON object"}
    good = read.filter("error is null").drop("error")
    full = {r.id: r for r in C.normalize_entries(good).collect()}
    assert sorted(full) == ["a", "b"]
    assert full["a"].serving_target == "vllm" and full["b"].serving_targets == ["ollama"]
    status = {r.id: r.check_status for r in C.check_catalog(C.normalize_entries(good)).collect()}
    assert status == {"a": "WARN: gguf incompatible with target(s): vllm, mlx; allowed: llama.cpp, ollama", "b": "OK"}


def test_ordinals_survive_other_splits(spark, tmp_path):
    out = str(tmp_path / "lines")
    W.write_lines(spark.range(20_000).selectExpr("cast(id AS string) AS line").coalesce(1), out)
    setting = "spark.sql.files.minPartitionNum"
    spark.conf.set(setting, "4")
    try:
        numbered = R.read_json_lines(spark, out)
        spark.conf.set(setting, "9")
        rows = numbered.collect()
    finally:
        spark.conf.unset(setting)
    assert len(rows) == 20_000 and all(r.line_number == int(r.text) + 1 for r in rows)


def test_shared_folder_is_named_on_a_cluster():
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, name, default=None):
            return self.values.get(name, default)

        def set(self, name, value):
            self.values[name] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(Session("spark://host:7077"))
    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(Session("local-cluster[2,1,1024]"))
    assert shared_folder(Session("local[2]"))


def test_settings(spark):
    lines = spark.createDataFrame(
        [("s", 0, 1, 'A = "x" '), ("s", 0, 2, "# A=c"), ("s", 1, 1, "A='y=z'"), ("s", 0, 3, "B=1"), ("s", 0, 4, "B=2"), ("s", 0, 5, "junk")],
        "service string, layer int, line_no int, text string",
    )
    assert {r.key: r.value for r in C.overlay_merge(C.parse_settings(lines)).collect()} == {"A": "y=z", "B": "2"}


def test_conversion_keeps_order(spark):
    entry = spark.createDataFrame([("a", ["vllm", "ollama"], ["q4"])], "id string, serving_targets array<string>, quantizations array<string>")
    row = C.add_quantization(entry, "q4").first()
    assert row.serving_targets == ["vllm", "ollama", "llama.cpp"] and row.quantizations == ["q4"]


def test_lines_and_scrapes(spark, tmp_path):
    out = str(tmp_path / "m")
    W.write_lines(spark.createDataFrame([("é 1",), ("a 2",)], "line string"), out)
    assert sorted(r.line for r in R.read_scrapes(spark, out).collect()) == ["a 2", "é 1"]


def test_documents_are_written_by_tasks(spark, tmp_path):
    """Many folders from one partition: lines in order, names as Spark reads them, no commit by the driver."""
    rows = [(f"a/{i % 50}" if i % 50 else None, f"{i}") for i in range(200)] + [("é =", "x")]
    frame = spark.createDataFrame(rows, "entry string, value string").coalesce(1)
    W.write_documents(frame, str(tmp_path / "new"), "entry")
    frame.write.partitionBy("entry").text(str(tmp_path / "old"))
    names = [{p.name: [f.read_text() for f in p.glob("part-*")] for p in (tmp_path / o).glob("entry=*")} for o in ("new", "old")]
    assert len(names[0]) == 51 and names[0] == names[1]
    assert (tmp_path / "new" / "entry=1").exists() is (tmp_path / "old" / "entry=1").exists()
    assert {p.name for f in (tmp_path / "new").glob("entry=*") for p in f.iterdir()} == {"part-00000.txt"}
    read = spark.read.text(str(tmp_path / "new"))
    assert {r.entry for r in read.select("entry").distinct().collect()} == {r[0] for r in rows}
    W.write_documents(frame.limit(0), str(tmp_path / "none"), "entry")
    assert R.read_sidecars(spark, str(tmp_path / "none"), "part-*").count() == 0
