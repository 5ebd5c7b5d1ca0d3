"""Rules over texts, outputs, decisions and settings, on inputs whose answers are known."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from driftline.functions import changes, text
from driftline.operators import sheets
from driftline.plans import settings
from driftline.sources import reports
from driftline.streaming import changes as streams


def answers(spark, values, function):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string")
    return [r.y for r in df.select("k", function(F.col("x")).alias("y")).orderBy("k").collect()]


def test_drawing_numbers(spark):
    known = {
        "S20-0002": "S20-0002", "S20.0002": "S20-0002", "S20_0002": "S20-0002", "S20 0002": "S20-0002", "s20-0002": "S20-0002", "도면번호: S20-0002 (3층 평면도)": "S20-0002", "S20-0001 referenced from S20-0002": "S20-0001",
        "아무 번호도 없는 도면": "", "": "", None: "", "S20-123456": "", "S20-0001A": "S20-0001A", "ABCD20-0001": "ABCD20-0001", "B30 1234A": "B30-1234A",
    }
    assert answers(spark, known, text.drawing_number) == list(known.values())


def test_file_identities(spark):
    found = answers(spark, ["S21-0031_P STRUCTURAL PLAN 3F.dwg", "S20-0001_P TEST.dwg", "S-101_REV60.dwg", "a/PLAN OLD final.dxf"], text.file_identity)
    assert [(r.drawing_number, r.sheet, r.revision) for r in found[:3]] == [("S21-0031", "3F", ""), ("S20-0001", "S20", ""), ("S101", "", "REV60")]
    assert found[3].key == "PLAN"


def test_canonical_texts(spark):
    known = {
        "H400×200×8×13 → H450×200×9×14": "H_BEAM_400_200_8_13 → H_BEAM_450_200_9_14", "H 400 × 200 × 8 × 13": "H_BEAM_400_200_8_13", "□400×400×16": "SQR_TUBE_400_400_16", "BOX 300×300": "SQR_TUBE_300_300", "Φ250×6": "ROUND_PIPE_250_6",
        "5500.5 mm": "DIM_5500_5_MM", "25cm": "DIM_25_CM", "3m": "DIM_3_M", "GRID A-1 변경": "GRID_A_1 변경", "Y2'": "GRID_Y_2_PRIME", "FAB-1 추가": "GRID_FAB_1 추가", "DET-03 참조": "DETAIL_03 참조", "SEC A-A": "DETAIL_A_A", "단면 A-A 추가": "DETAIL_A_A 추가",
        "보 단면 H400×200×8×13 변경": "보 단면 H_BEAM_400_200_8_13 변경", "단면 D13 배근": "단면 REBAR_13 배근", "EL+1.5 EL-0.3": "ELEV_PLUS_1_5 ELEV_MINUS_0_3", "B-1": "B-1", "Ｈ400x200x8x13": "H_BEAM_400_200_8_13", None: "",
    }
    assert answers(spark, known, text.canonical) == list(known.values())
    once = answers(spark, known, text.canonical)
    assert answers(spark, once, text.canonical) == once


def test_output_safety(spark):
    clean = '{"summary": {"answer": "two beams differ"}, "source": {"source_health": "parsed"}}'
    known = {
        clean: [], '{"a": {"Raw_Entities": []}}': ["raw_payload_key"], '{"note": "api_key = abcdefgh1"}': ["secret_like_marker"], '{"draft": {"body": "Approved, can proceed"}}': ["positive_action_language"] * 2,
        '{"basis": {"source_health": "FAILED"}, "summary": {"answer": "All clear, no issues found"}}': ["source_health_misleading_answer"], '{"basis": {"source_health": "ok"}, "summary": {"answer": "all clear"}}': [],
        '{"issue_suggestions": [{"title": "released"}, {"next_action": "x"}]}': ["positive_action_language"],
    }
    assert answers(spark, known, changes.safety_findings) == list(known.values())


def test_first_region_decision_wins(spark):
    ids = lambda *x: spark.createDataFrame([("p", i) for i in x], "pair string, id string")
    rows = [(1, "manual_match", "b1", "a1"), (2, "manual_match", "b1", "a2"), (3, "manual_match", "b2", "a2"), (4, "unmatched_after", None, "a2"), (5, "unmatched_before", "b3", None), (6, "manual_match", "b9", "a3"), (7, "manual_match", "b3", "a3"), (8, "other", "b4", "a3")]
    over = spark.createDataFrame([("p", *r) for r in rows], "pair string, ordinal long, status string, before_id string, after_id string")
    got = {r.ordinal: r.error for r in sheets.region_overrides(over, ids("b1", "b2", "b3", "b4"), ids("a1", "a2", "a3"), "pair").collect()}
    clash = "conflicts with an earlier one"
    assert got == {1: None, 2: clash, 3: None, 4: clash, 5: None, 6: "unknown region", 7: clash, 8: "unsupported status"}


def test_settings_and_plug_ins(spark):
    own = settings.NoiseSettings(min_changes_per_zone=3, cosmetic_attributes=("color",))
    assert settings.NoiseSettings.from_json(own.to_json()) == own
    assert settings.NoiseSettings.from_json("no json") == settings.NoiseSettings() == settings.NoiseSettings.from_json('{"unknown": 1}')
    profile = settings.RegionProfile.from_yaml("name: own\ntable_reject_keywords: [PARTS, ' ']\ntitle_layer_patterns: '*T*'")
    assert (profile.name, profile.table_reject_keywords, profile.title_layer_patterns) == ("own", ("PARTS",), ("*T*",))
    with pytest.raises(ValueError):
        settings.RegionProfile.from_yaml("- a")
    settings.READERS.add("range", lambda spark, folder: spark.range(len(folder)))
    assert settings.read_kind(spark, "range", "abc").count() == 3
    with pytest.raises(KeyError):
        settings.READERS.get("none")
    vector = spark.createDataFrame([("a b a",)], "x string").select(settings.embedded(F.col("x"), "hashed").alias("v")).first().v
    assert len(vector) == 64 and sum(vector) == 3
    seen = []
    run = settings.Progress([("read", 1), ("match", 3)], lambda share, stage: seen.append((share, stage)) or stage == "match")
    run.finish("read")
    with pytest.raises(InterruptedError):
        run.finish("match")
    assert seen == [(0.25, "read"), (1.0, "match")]
    with settings.cancellable(spark, "t") as cancel:
        assert spark.range(3).count() == 3 and cancel() == []


def test_workbooks(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>na</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>own</t></is></c><c r="B2" t="s"><v>1</v></c><c r="C2"/></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(book.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    rows = reports.read_workbooks(spark, str(tmp_path)).collect()
    assert sorted((r.row, r.column, r.value) for r in rows if r.error is None) == [(1, "A", "na"), (1, "B", "2.5"), (2, "A", "own"), (2, "B", "two parts")]
    assert [r.error for r in rows if r.error] == ["BadZipFile"]


def test_late_rows_of_a_stream(spark, tmp_path):
    """In append mode, rows behind the watermark are left out, and closed windows come once."""
    schema = "k string, at timestamp, v double"
    put = lambda rows, name: spark.createDataFrame(rows, "k string, at string, v double").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 05:00:00", 2.0)], "d=1")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = streams.windowed(rows, "at", "1 hour", "1 hour", None, ["k"], "v")
    found, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        query = streams.each_batch(out, lambda batch, n: batch.write.mode("append").parquet(found), checkpoint)
        query.awaitTermination()

    run()
    put([("a", "2024-01-01 00:20:00", 9.0), ("a", "2024-01-01 09:00:00", 3.0)], "d=2")  # the first is behind the watermark
    run()
    got = sorted((str(r.start), r.n, r.total) for r in spark.read.parquet(found).collect())
    assert got == [("2024-01-01 00:00:00", 1, 1.0), ("2024-01-01 05:00:00", 1, 2.0)]
