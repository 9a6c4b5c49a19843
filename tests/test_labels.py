import json

from pyspark.sql import functions as F

from tallymark.operators import labels as L
from tallymark.sources import writers as W
from tallymark.sources import readers as R


def rows(spark, items):
    """Label rows from {column index: text}."""
    data = [(n + 2, *[item.get(i) for i in range(30)]) for n, item in enumerate(items)]
    return spark.createDataFrame(data, "csv_row bigint, " + ", ".join(f"c{i} string" for i in range(30)))


def inventory(spark, names):
    return spark.createDataFrame([(n, 1) for n in names], "name string, length bigint")


CASES = [
    {0: "a.jpg", 1: " 001 ", 2: "Ánh"},  # front, exact
    {0: "B.JPG", 9: "scar", 13: "99"},  # back, normalised
    {0: "a.jpg", 1: "1", 9: "2"},  # both sides
    {0: " ", 11: "c.jpg", 1: "x"},  # second name column
    {0: " ", 1: "x"},  # no name
    {0: "zz.jpg", 9: "x"},  # no file
    {0: "a.jpg", 11: "c.jpg"},  # no data
    {1: "  "},  # neither data nor name: the name comes first
    {0: "zz.jpg", 1: "1", 29: "2"},  # both sides before the name
]


def test_reasons_and_precedence(spark):
    tagged = L.tagged_labels(rows(spark, CASES), inventory(spark, ["a.jpg", "b.jpg", "c.jpg", "d.jpg"]))
    got = {r.csv_row - 2: r for r in tagged.collect()}
    assert [got[i].reason for i in range(len(CASES))] == [
        None, None, "mixed_side", None, "blank_name", "missing_file", "no_side_data", "blank_name", "mixed_side",
    ]
    assert (got[0].side, got[1].side) == ("front", "back")
    assert (got[0].resolution, got[1].resolution, got[1].path_name) == ("exact_match", "normalized_match", "b.jpg")
    assert got[3].path_name == "c.jpg"


def test_payload_and_record(spark):
    tagged = L.tagged_labels(rows(spark, CASES[:2]), inventory(spark, ["a.jpg", "b.jpg"]))
    record = {r.side: r for r in L.chat_records(L.build_payload(tagged)).collect()}
    front = json.loads(record["front"].messages[2].content)
    assert list(front["fields"])[:2] == ["id_number", "full_name"] and front["fields"]["full_name"] == "Ánh"
    assert "Ánh" in record["front"].messages[2].content and " " not in record["front"].messages[2].content
    back = json.loads(record["back"].messages[2].content)
    assert len(back["fields"]["mrz"]) == 18 and back["fields"]["mrz"]["document_number"] == "99"
    assert [m.role for m in record["back"].messages] == ["system", "user", "assistant"]
    assert record["back"].messages[1].content.startswith("<image>\nExtract the BACK side")
    assert record["back"].images == ["images/b.jpg"]


def test_report_and_rejects(spark):
    files = inventory(spark, ["a.jpg", "b.jpg", "c.jpg", "d.jpg"])
    tagged = L.tagged_labels(rows(spark, CASES), files)
    report = L.qc_report(tagged, files)
    row = report.first()
    assert (row.csv_data_rows, row.front_train_records, row.back_train_records) == (9, 2, 1)
    assert (row.discarded_rows, row.unused_images, row.rejected_mixed_side) == (6, 1, 2)
    text = json.loads(L.qc_document(report).first().report)
    assert text["discarded_reason_counts"] == {
        "blank_name": 2, "missing_file": 1, "mixed_side": 2, "no_side_data": 1,
    }
    assert [r.name for r in L.unused_items(tagged, files).collect()] == ["d.jpg"]
    rejected = {r.csv_row: r for r in L.rejected_rows(tagged).collect()}
    assert rejected[4].error == "mixed front/back record is not supported" and rejected[7].side == "back"


def test_ambiguous_names(spark):
    found = L.ambiguous_keys(inventory(spark, ["A.jpg", "a.jpg", "ａ.jpg", "b.jpg"])).collect()
    assert [(r.key, r.names) for r in found] == [("a.jpg", 3)]


def test_whole_build(spark, tmp_path):
    files = inventory(spark, ["a.jpg", "b.jpg", "c.jpg", "d.jpg"])
    parts = W.build_dataset(rows(spark, CASES), files, str(tmp_path / "out"))
    records = R.read_chat_records(spark, parts["records"])
    assert records.count() == 3 and records.filter(F.size("messages") == 3).count() == 3
    assert spark.read.json(parts["rejected"]).count() == 6
    assert json.loads("\n".join(r.value for r in spark.read.text(parts["report"]).collect()))["counts"]["csv_data_rows"] == 9


def test_ambiguous_names_name_no_file(spark):
    """Two files share a normalised key: only exact names are resolved."""
    files = inventory(spark, ["A.jpg", "a.JPG", "b.jpg"])
    cases = [{0: "A.jpg", 1: "x"}, {0: "a.jpg", 1: "x"}, {0: "B.jpg", 1: "x"}]
    got = {r.csv_row - 2: (r.path_name, r.resolution, r.reason) for r in L.tagged_labels(rows(spark, cases), files).collect()}
    assert got == {
        0: ("A.jpg", "exact_match", None), 1: (None, "ambiguous_name", "ambiguous_name"), 2: ("b.jpg", "normalized_match", None),
    }
