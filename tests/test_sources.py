"""Readers on files written by the tests."""

import datetime as dt
import gzip

import pytest

from spellwise.sources import readers as R


def test_event_csv(spark, tmp_path):
    head = "DATE_EVENT,EVENT,EVENT_CENSOR,Age_20080101,MALE,ID,FDR_AUD_ALL,FDR_OBESITY_CAT3,FDR_OBESITY_ALL,CP_DEP,CP_IMMI,CP_DIPL0,PROB_HOSP0813,CP_REG2,FDR_SMOKER,Date0_PATHOL1,FDR_AUD_CAT3,FDR_SMOKER_CAT3"
    for name, male, day in (("F.csv", 0, "1/5/2010"), ("M.csv", 1, "12/31/2011")):
        (tmp_path / name).write_text(f"{head}\n{day},STATE2_PDV,1,55.5,{male},{male + 7},0,1,1,06,0,2,0.5,A,0,NA,0,2\n")
    df = R.read_event_csv(spark, [str(tmp_path / "F.csv"), str(tmp_path / "M.csv")], source_column="file")
    rows = {r["id"]: r for r in df.collect()}
    assert rows[7]["date_event"] == dt.date(2010, 1, 5) and rows[8]["date_event"] == dt.date(2011, 12, 31)
    assert rows[7]["cp_dep"] == "06" and rows[7]["date0_pathol1"] is None and rows[7]["file"] == "F.csv"
    assert df.columns[:3] == ["date_event", "event", "event_censor"]


def test_csv2_and_pyramid(spark, tmp_path):
    (tmp_path / "p.csv").write_text("ANNEE;SEXE;AGE;POP\n2010;F;50;440000\n2010,5;M;51;NA\n")
    rows = R.read_csv2(spark, str(tmp_path / "p.csv"), R.PYRAMID_DDL).collect()
    assert [tuple(r) for r in rows] == [(2010.0, "F", 50, 440000), (2010.5, "M", 51, None)]


def test_wide_stats_gz(spark, tmp_path):
    path = str(tmp_path / "h.tsv.gz")
    with gzip.open(path, "wt") as f:
        f.write("unit,sex,indic_he,geo\\time\t2020 \t2019 \nYR,F,HLY_50,FR\t18.8 e\t: \nYR,M,HLY_65,FR\t10.1 \t9.5 b\n")
    rows = sorted(tuple(r) for r in R.read_wide_stats(spark, path, [2020, 2019]).collect())
    assert rows == [("YR", "F", "HLY_50", "FR", 2019, None, None), ("YR", "F", "HLY_50", "FR", 2020, 18.8, "e"),
                    ("YR", "M", "HLY_65", "FR", 2019, 9.5, "b"), ("YR", "M", "HLY_65", "FR", 2020, 10.1, None)]


def test_attrition(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'level ,criteria_en ,criteria_fr ,years ,pop_size ,percent ,pop_remain ,percent_of_total\n'
        '    0 ,"All" ,Tous ,2008-2013 ,18 440 022 ,100% ,18 440 022 ,100%\n'
        '    1 ,"Some, not all" ,Certains ,"2008,2009" ,4 610 005 ,"25,7%" ,4610005 ,"25,7%"\n')
    rows = R.read_attrition_csv(spark, str(tmp_path / "a.csv")).orderBy("level").collect()
    assert rows[0]["pop_size"] == 18440022 and rows[1]["pop_remain"] == 4610005
    assert abs(rows[1]["percent"] - 0.257) < 1e-12 and abs(rows[1]["share"] - 4610005 / 18440022) < 1e-12


def test_diagnosis_codes(spark):
    df = spark.createDataFrame([(1, "HIV", "B20 - B24 ; Z21 ; F02.4")], "level int, Variables string, icd10 string")
    rows = sorted((r["code_from"], r["code_to"]) for r in R.diagnosis_codes(df).collect())
    assert rows == [("B20", "B24"), ("F02.4", "F02.4"), ("Z21", "Z21")]


def test_write_and_read(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "if(id % 2 = 0, 'F', 'M') AS sex", "id * 2 AS x")
    path = str(tmp_path / "t")
    R.write_table(df, path, partition_by=["sex"])
    back = R.read_table(spark, path, ["id", "sex"])
    assert back.count() == 10 and back.columns == ["id", "sex"]
    plan = back.filter("sex = 'F'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_lookup(spark, tmp_path):
    (tmp_path / "l.csv").write_text("Level ,Name\n 1 , a\n")
    assert [tuple(r) for r in R.read_lookup(spark, str(tmp_path / "l.csv"), "Level INT, Name STRING").collect()] == [(1, "a")]


def test_event_csv_goes_by_header_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EVENT,id,extra,DATE_EVENT\nX,7,q,1/31/2010\nY,8,r,12/1/2011\n")
    (tmp_path / "b.csv").write_text("ID,DATE_EVENT,EVENT\n9,2/3/2012,Z\nNA,bad,W\n")
    ddl = "DATE_EVENT DATE, EVENT STRING, ID INT"
    one = [tuple(r) for r in R.read_event_csv(spark, f"{tmp_path}/a.csv", ddl).orderBy("id").collect()]
    assert [(str(d), e, i) for d, e, i in one] == [("2010-01-31", "X", 7), ("2011-12-01", "Y", 8)]
    both = R.read_event_csv(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], ddl, bad_column="bad")
    assert {r["bad"] for r in both.collect()} == {None, "NA,bad,W"}
    with pytest.raises(Exception):  # noqa: B017
        R.read_event_csv(spark, f"{tmp_path}/b.csv", ddl).collect()
    with pytest.raises(ValueError, match="no column"):
        R.read_event_csv(spark, f"{tmp_path}/a.csv", ddl + ", MALE STRING")
