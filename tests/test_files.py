"""Extract files: names, headers, repeats, broken lines, batches."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from carecycle.functions.vocab import ANNOTATION_FEATURES, ANNOTATION_IDS, STAY_COLUMNS
from carecycle.operators.joins import bucket_members
from carecycle.operators.pick import batches
from carecycle.plans.annotations import pending_notes, reconcile, unsure_export, unsure_remaining, unsure_texts
from carecycle.sources import files, schemas
from carecycle.session import ADAPTIVE, files_dir
from carecycle.sources.tables import own_name, replace_bucketed, replace_table


def write(path, rows, header=None, sep=","):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, delimiter=sep)
        if header:
            out.writerow(header)
        out.writerows(rows)


def result_row(hadm, unsure=0):
    ids = [1, hadm, hadm * 2, "dis", "2010-01-01", "Discharge", "01/01/2010"]
    return ids + [0] * (len(ANNOTATION_FEATURES) - 1) + [unsure]


def results_folder(tmp_path):
    folder = tmp_path / "results"
    os.mkdir(folder)
    header = [c.upper() for c in ANNOTATION_IDS + ANNOTATION_FEATURES]
    write(folder / "ABCdis16Mar16Results.csv",
          [result_row(5), result_row(5), result_row(6, 1)], header)
    write(folder / "XYZDIS16MAR16Results.csv", [result_row(5)], header)
    return str(folder)


def test_results_take_operator_and_batch_from_the_name(spark, tmp_path):
    got = files.read_results(spark, results_folder(tmp_path))
    assert got.columns[-2:] == ["operator", "batch_id"]
    rows = {(r.operator, r.batch_id, r.hadm_id, r.unsure) for r in got.collect()}
    assert got.count() == 3
    assert rows == {("ABC", "dis16mar16", 5, 0), ("ABC", "dis16mar16", 6, 1),
                    ("XYZ", "dis16mar16", 5, 0)}


def notes_layouts(tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    os.mkdir(one)
    os.mkdir(two)
    write(one / "jjdis16Mar16.csv",
          [[1, 5, "Discharge", 'He said "go".\nThen left, alone', 1]] * 2,
          ["subject_id", "hadm_id_x", "category", "text", "cohort"])
    write(two / "jjDIS16FEB16.csv", [[0, "two", 6, "Discharge", 2]],
          ["cohort", "text", "HADM", "category", "SUBJECT"])
    return {
        "subject_id bigint, hadm_id bigint, category string, text string, cohort int": [str(one)],
        "cohort int, text string, hadm_id bigint, category string, subject_id bigint": [str(two)],
    }


def test_notes_of_different_layouts(spark, tmp_path):
    got = files.read_notes(spark, notes_layouts(tmp_path)).collect()
    assert {(r.subject_id, r.hadm_id, r.text, r.cohort, r.batch_id) for r in got} == {
        (1, 5, 'He said "go".\nThen left, alone', 1, "dis16mar16"),
        (2, 6, "two", 0, "dis16feb16"),
    }
    assert len(got) == 2


def test_reconcile_pending_and_export(spark, tmp_path):
    results = files.read_results(spark, results_folder(tmp_path))
    notes = files.read_notes(spark, notes_layouts(tmp_path))
    assert reconcile(notes, results).count() == 2  # admission 5, two operators
    late = results.filter("hadm_id = 6").replace("dis16mar16", "late", "batch_id")
    both = reconcile(notes, results, late)
    assert {(r.hadm_id, r.batch_id) for r in both.collect()} == {
        (5, "dis16mar16"), (6, "late")}
    pending = pending_notes(results, notes.filter("hadm_id = 6")).collect()
    assert [(r.hadm_id, r.in_missing_batch) for r in pending] == [(6, True)]
    adjudicated = spark.createDataFrame([(10,)], "icu_id long")
    remaining = unsure_remaining(results, adjudicated)
    export = unsure_export(both, remaining).collect()
    assert len(export) == 1 and export[0].hadm_id_3 == 6 and export[0].text == "two"
    assert len(set(export[0].asDict())) == 8


def test_headerless_and_separated_extracts(spark, tmp_path):
    path = str(tmp_path / "First_hadm.csv")
    row = {c: "" for c in STAY_COLUMNS} | {
        "icustay_id": 11, "subject_id": 1, "dob": "1950-01-01", "hospital_seq": 1,
        "icustay_intime": "2001-01-01 10:00:00", "sofa_first": "(null)", "hospital_los": 20.5}
    write(path, [[0, *row.values()]])
    got = files.read_stay_extracts(spark, [path], schemas.STAYS_EXTRACT).collect()
    assert len(got) == 1 and got[0].icustay_id == 11 and got[0].hadm_id is None
    assert got[0].icustay_intime.hour == 10 and got[0].sofa_first == "(null)"
    semi = str(tmp_path / "codes.csv")
    write(semi, [["428.0", 7], ["broken", "x"]], ["code", "frequency"], sep=";")
    rows = files.read_csv(spark, semi, "code string, frequency int", sep=";", corrupt=True)
    assert {(r.code, r.frequency, r._corrupt) for r in rows.collect()} == {
        ("428.0", 7, None), ("broken", None, "broken;x")}


def test_batch_files_round_trip(spark, tmp_path):
    rows = batches(spark.range(65).withColumnRenamed("id", "note"), "note", 30)
    path = files.write_batches(rows, str(tmp_path / "out"))
    assert sorted(d for d in os.listdir(path) if d.startswith("batch=")) == [
        "batch=1", "batch=2", "batch=3"]
    back = spark.read.schema("note long, batch int").option("header", True).csv(path)
    sizes = {r.batch: r["count"] for r in back.groupBy("batch").count().collect()}
    assert sizes == {1: 30, 2: 30, 3: 5}


def test_numbered_batch_files(spark, tmp_path):
    """Every file holds exactly its batch, in key order, ties and line breaks included."""
    rows = [(f"k{i // 7:03}", f'text {i}, "quoted"\nsecond line') for i in range(100)]
    df = spark.createDataFrame(rows, "k string, text string").repartition(6)
    path = files.write_numbered_batches(df, str(tmp_path / "batches"), ["k", "text"], 30)
    names = [f for _, _, fs in os.walk(path) for f in fs if f.endswith(".csv")]
    assert len(names) == 4
    back = files.read_numbered_batches(spark, path, "k string, text string").collect()
    assert sorted((r.k, r.text) for r in back) == sorted(rows)
    sizes = {b: [r for r in back if r.batch == b] for b in (1, 2, 3, 4)}
    assert [len(sizes[b]) for b in (1, 2, 3, 4)] == [30, 30, 30, 10]
    assert all(len({r.file for r in rs}) == 1 for rs in sizes.values()) and len({r.file for r in back}) == 4
    assert all(max(r.k for r in sizes[b]) <= min(r.k for r in sizes[b + 1]) for b in (1, 2, 3))


def test_lines_are_all_accounted_for(spark, tmp_path):
    lines = ["ID;Name;Day", "1;a;2001-02-03", "", "x;b;2001-02-03", '2;"c;d";', "3;e", "4;f;2001-02-03;g", ";;", "5;g;soon", "id;name;day"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    found = files.read_lines(spark, str(tmp_path / "a.csv"), "id bigint, name string, day date", ";", header="id;name;day")
    got = [(r.kind, r.reason, r.line, r.source) for r in found.collect()]
    assert [x[2] for x in got] == lines and {x[3] for x in got} == {"a.csv"}
    assert [x[:2] for x in got] == [
        ("header", None), ("row", None), ("blank", None), ("bad", "id is not of type bigint"), ("row", None),
        ("bad", "not 3 columns"), ("bad", "not 3 columns"), ("row", None), ("bad", "day is not of type date"), ("header", None)]
    rows = [(r.id, r.name, str(r.day)) for r in files.good_rows(found).collect()]
    assert rows == [(1, "a", "2001-02-03"), (2, "c;d", "None"), (None, None, "None")]
    assert files.quarantined(found).count() == 4
    assert {(r.kind, r.n_lines) for r in files.accounted(found).filter("kind <> 'bad'").collect()} == {
        ("header", 2), ("row", 3), ("blank", 1)}


def test_extract_round_trip(spark, tmp_path):
    rows = [(1, " spaced ", 0.1, None), (2, 'say "x"; y', None, "z"), (3, "", 1e-7, ",")]
    df = spark.createDataFrame(rows, "a long, b string, c double, d string")
    path = files.write_lines(df, str(tmp_path / "x"), ";", {"c": F.when(F.col("a") == 2, "?"), "": F.when(F.col("a") == 3, ";")})
    found = files.read_lines(spark, path, "a long, b string, c double, d string", ";")
    assert [tuple(r) for r in files.good_rows(found).collect()] == [rows[0]]
    assert {r.reason for r in files.quarantined(found).collect()} == {"c is not of type double", "not 4 columns"}


def test_notes_of_a_folder(spark, tmp_path):
    folder = tmp_path / "notes"
    os.mkdir(folder)
    write(folder / "jjdis16Mar16.csv", [[1, 5, "Discharge", "one\ntwo", 1]],
          ["Subject.ID", "HADM_ID_MIII", "category", "text", "cohort"])
    write(folder / "jjdis17Mar16.csv", [[0, "three, four", 6, 6, "Discharge", 2, 0.5]],
          ["cohort", "text", "hadm_id", "hadm_id_MIII", "category", "subject_id", "randomizer"])
    got = {(r.subject_id, r.hadm_id, r.text, r.cohort, r.batch_id) for r in files.read_notes(spark, str(folder)).collect()}
    assert got == {(1, 5, "one\ntwo", 1, "dis16mar16"), (2, 6, "three, four", 0, "dis17mar16")}
    write(folder / "jjdis18Mar16.csv", [[1, "x"]], ["hadm_id", "note"])
    layouts, unknown = files.note_layouts(spark, str(folder))
    assert len(layouts) == 2 and [(f[0].rsplit("/", 1)[1], f[1]) for f in unknown] == [("jjdis18Mar16.csv", ["hadm_id", "note"])]
    with pytest.raises(ValueError, match="unknown layout"):
        files.read_notes(spark, str(folder))


def test_bucketed_cohort_is_not_shuffled(spark):
    """Three extracts join the cohort table; only their own rows move."""
    name = own_name(spark, "buckets")
    cohort = replace_bucketed(spark.range(1000).withColumnRenamed("id", "subject_id"), name, "subject_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (3, 5, 7):
            extract = spark.range(5000).selectExpr(f"id % {n * 400} AS subject_id", "id AS hadm_id")
            found = bucket_members(extract, cohort)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
            assert found.count() == sum(i % (n * 400) < 1000 for i in range(5000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")


def test_replace_table(spark):
    name = own_name(spark, "numbers")
    assert replace_table(spark.range(5), name).count() == 5
    assert sorted(r.id for r in replace_table(spark.range(2), name).collect()) == [0, 1]
    spark.sql(f"DROP TABLE {name}")


def test_files_are_replaced(spark):
    path = files_dir(spark, "numbers")
    assert path.startswith(spark.conf.get("spark.sql.warehouse.dir")) and path == files_dir(spark, "numbers")
    for n in (5, 2):
        files.write_csv(spark.range(n), path)
    assert files.read_csv(spark, path, "id long").count() == 2


def test_lines_are_parsed_once(spark, tmp_path):
    """Filters on what a line is don't parse it anew for every column: two parsers, typed and text."""
    (tmp_path / "a.csv").write_text("\n".join(f"{i},{i},{i},{i}" for i in range(9)) + "\n5,x,5,5\n1,2\n")
    schema = "a int, b int, c int, d int"
    found = files.read_lines(spark, str(tmp_path / "a.csv"), schema)
    for rows, n in ((files.good_rows(found), 9), (files.quarantined(found), 2), (files.accounted(found), 3)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv(") == 2
        assert rows.count() == n


def test_groups_are_written_in_one_pass(spark, tmp_path):
    """Rows go to their group's folder or nowhere; a source row is computed once, not once for each group."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(100).selectExpr("id", "nullif(id % 5, 4) AS g", "'a\"b, c' AS t").mapInArrow(passing, "id long, g long, t string")
    groups = {"one": F.col("g") == 1, "more": F.col("g") >= 2, "none": F.col("g") > 50}
    path = files.write_groups(df, str(tmp_path / "groups"), groups)
    assert seen.value == 100
    assert sorted(d for d in os.listdir(path) if d.startswith("extract=")) == ["extract=more", "extract=one"]
    back = files.read_stay_extracts(spark, [path], "id long, g long, t string").collect()
    assert sorted((r.id, r.g, r.t, r.extract) for r in back) == [
        (i, i % 5, 'a"b, c', "one" if i % 5 == 1 else "more") for i in range(100) if 1 <= i % 5 < 4]
    files.write_groups(df.filter("g = 0"), path, groups)
    assert files.read_stay_extracts(spark, [path], "id long, g long, t string").count() == 0


def test_export_of_narrowed_results(spark):
    """Equal to the export of all reconciled rows: late, unknown and repeated ones; notes are read once."""
    results = spark.createDataFrame(
        [(h, i, b, t, o, f) for h, i in ((1, 2), (2, 4), (3, 6), (None, 8), (4, None))
         for b in ("a", "b", None) for t in ("d1", None) for o in ("L", "x", None) for f in (0, 1)],
        "hadm_id long, icu_id long, batch_id string, real_time string, operator string, unsure int")
    notes = spark.createDataFrame(
        [(9, h, "c", t, 1, b) for h in (1, 2, 4, 5, None) for b in ("a", "c", None) for t in ("one", "one", None)],
        "subject_id long, hadm_id long, category string, text string, cohort int, batch_id string")
    remaining = spark.createDataFrame([(2,), (6,), (8,), (None,)], "icu_id long")
    late = F.col("operator") == "L"
    whole = reconcile(notes, results.filter(~late), results.filter(late))
    want = unsure_export(whole, remaining)
    got = unsure_texts(notes, results, remaining, late)
    key = lambda r: tuple(map(str, r))
    assert got.schema == want.schema and len(want.collect()) == 4
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    logical = got._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("text#") > 0 and logical.count("LogicalRDD [subject_id#") + logical.count("LocalRelation [subject_id#") == 1


def test_partitions_are_merged_to_less_than_the_default():
    """Ids shrink in a shuffle; merged to Spark's 64 MB, a task of stays_cross_check unpacks over a gigabyte."""
    assert ADAPTIVE["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "16MB"
