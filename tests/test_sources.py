"""Readers and sinks on small generated text files."""

from __future__ import annotations

import datetime as dt

import pytest

from gridclime.sources import parameters, sinks, tables, text_files


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_series_drops_last_row_and_patches_the_one_before(spark, tmp_path):
    head = [f"preamble {n}" for n in range(41)]
    write(tmp_path / "S1" / "tmintmax" / "CA_N_tmax.csv", [*head, "10,x", "11,x", "12,x", "13,x", "NaN,x"])
    write(tmp_path / "S1" / "tmintmax" / "CA_N_tmin.csv", [*head[:34], "0", "1", "2", "3", "NaN"])
    rows = text_files.read_temperatures(spark, str(tmp_path)).orderBy("Date").collect()
    assert [r.Tmax for r in rows] == [10, 11, 12, 12]
    assert [r.Tmin for r in rows] == [0, 1, 2, 2]
    assert [r.Date for r in rows] == [dt.date(2006, 1, n) for n in (1, 2, 3, 4)]
    assert {(r.Scenario, r.load_zone) for r in rows} == {("S1", "CA_N")}
    assert [r.position for r in rows] == [1, 2, 3, 4]


def test_wide_export_names_follow_the_mapping_table(spark, tmp_path):
    header = '$Columns = Year,Timestep,Big Dam[Gigawatt Hour],"A, B & C[Gigawatt Hour]",3 Forks[Gigawatt Hour],Max[Gigawatt Hour],RMS[Gigawatt Hour]'
    lines = ["a", "b", "c", "d", "e", header, "2020,1,1.5,2,3,9,9", "2020,2,2.5,,4,9,9"]
    write(tmp_path / "RCP_85_Hydropower Generation.csv", lines)
    got = text_files.read_wide_export(spark, str(tmp_path / "*.csv")).collect()
    values = {(r.Month, r.object_name): r.GWh for r in got}
    assert values == {
        (1, "Big Dam"): 1.5,
        (2, "Big Dam"): 2.5,
        (1, "A  B   C"): 2.0,
        (2, "A  B   C"): None,
        (1, "X3 Forks"): 3.0,
        (2, "X3 Forks"): 4.0,
    }
    assert {(r.scenario, r.file_kind, r.Year) for r in got} == {("RCP_85", "Hydropower Generation", 2020)}


def catchment(skip):
    meta = "Area: 1000 m (1 200.5 ha), 2000 m (300 ha)"
    header = "$Columns = Year,Month,tavg C: Elevation 0 to 1000 m,tavg C: Elevation 1000 to 2000 m,Prcp mm: Elevation 0 to 1000 m,Prcp mm: Elevation 1000 to 2000 m"
    return [*["x"] * skip, meta, "x", "x", "x", "x", header, "2010,1,10,20,100,50"]


@pytest.mark.parametrize("scenario,skip", [("S1", 10), ("Hist", 11)])
def test_catchment_bands_and_data(spark, tmp_path, scenario, skip):
    write(tmp_path / scenario / "12 - WA_Skagit.csv", catchment(skip))
    glob = str(tmp_path / "*" / "*.csv")
    bands = {r.Elevation: r.area_ha for r in text_files.read_catchment_bands(spark, glob).collect()}
    assert bands == {"0.to.1000.m": 1200.5, "1000.to.2000.m": 300.0}
    data = text_files.read_catchment_data(spark, glob)
    got = {(r.Var_type, r.Elevation): r.value for r in data.collect()}
    assert got == {
        ("tavg.C", "0.to.1000.m"): 10,
        ("tavg.C", "1000.to.2000.m"): 20,
        ("Prcp.mm", "0.to.1000.m"): 100,
        ("Prcp.mm", "1000.to.2000.m"): 50,
    }
    row = data.first()
    assert (row.Scenario, row.Catchment_num, row.Catchment_name, row.State) == (scenario, "12", "WA_Skagit", "WA")

    from gridclime.plans.climate import catchment_climate

    monthly = catchment_climate(data, text_files.read_catchment_bands(spark, glob)).first()
    assert monthly.tavg_C == 15
    assert monthly.Precip_km3 == pytest.approx((100 * 1200.5 + 50 * 300) * 1e-8)
    assert monthly.total_catchment_area_km2 == pytest.approx(15.005)
    assert monthly.Region == "PacNW"
    # the only month is also the last one, which a scenario's moving mean leaves out
    assert monthly.avg_tavg_C == (15 if scenario == "Hist" else None)


def test_degree_day_files_and_result_directories(spark, tmp_path):
    write(tmp_path / "dd" / "CCSM" / "WA_E_CDD-HDD.csv", ["Date,Tmin,Tmax,HDD,CDD", "2030-01-01,1,3,16.33,0"])
    row = tables.read_degree_days(spark, str(tmp_path / "dd" / "*" / "*.csv")).first()
    assert (row.load_zone, row.Scenario, row.Date, row.HDD) == ("WA_E", "CCSM", dt.date(2030, 1, 1), 16.33)
    dims = parameters.scenario_dimension(spark, "base")
    assert dims.count() == 48
    for run in ("base", "base_CCSM_CDD_HDD", "other"):
        write(
            tmp_path / "runs" / run / "outputs" / "gen_cap.csv",
            ["x,PERIOD,GENERATION_PROJECT,gen_load_zone,gen_tech,gen_energy_source,GenCapacity", "9,2030,7,Z,Wind,Wind,5.5", "9,2030,8,Z,Wind,Wind,NA"],
        )
    only = dims.where("climate_impacts_included = 'Cooling Load Scenarios'")
    got = tables.read_results(spark, str(tmp_path / "runs"), "outputs/gen_cap.csv", only, complete=True).collect()
    assert {(r.Scenario, r.GenCapacity) for r in got} == {("Baseline no CC", 5.5), ("CCSM", 5.5)}


def test_demand_export_round_trip(spark, tmp_path):
    rows = [(1, 160, 7, "Z", dt.datetime(2030, 1, 1, 5), 2.5), (1, 161, 7, "Z", dt.datetime(2030, 1, 1, 5), 3.5)]
    names = "load_zone_id int, demand_scenario_id int, raw_timepoint_id int, load_zone_name string, timestamp_utc timestamp_ntz, demand_mw double"
    demand = spark.createDataFrame(rows, names)
    sinks.write_csv(demand, str(tmp_path / "load_ts"))
    back = tables.read_demand(spark, str(tmp_path / "load_ts"))
    assert sorted(map(tuple, back.collect())) == rows
    assert tables.load_data(back, 161).first().date == "2030-01-01"
    sinks.export_by_scenario(demand, str(tmp_path / "by_id"))
    assert sorted(p.name for p in (tmp_path / "by_id").glob("demand*")) == ["demand_scenario_id=160", "demand_scenario_id=161"]


def test_keyed_write(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.write_keyed(df, path, "id")
    with pytest.raises(sinks.KeyExistsError):
        sinks.write_keyed(df.where("id = 1"), path, "id")
    for _ in range(2):
        back = sinks.write_keyed(spark.createDataFrame([(1, "c")], "id int, v string"), path, "id", overwrite=True)
    assert sorted((r.id, r.v) for r in back.collect()) == [(1, "c"), (2, "b")]
    sinks.write_new(df, str(tmp_path / "new"))
    with pytest.raises(Exception):
        sinks.write_new(df, str(tmp_path / "new"))


def test_sampling_configuration(spark):
    config = {
        "study_timeframe": {"id": 39, "name": 2050, "description": "five periods\n"},
        "periods": {2030: {"start_year": 2028, "end_year": 2032, "length": 5}},
        "demand_scenario": 174,
        "sampling": {"id": 38, "tps_per_day": 6, "name": "n", "method": "M1", "description": "d\n"},
    }
    s = parameters.sampling_from_config(config)
    assert (s.delta_t, s.periods[0].length, s.demand_scenario_id) == (4, 5, 174)
    assert tuple(parameters.period_frame(spark, s).first()) == (39, 1, 2028, "2030", 5, 2032)
    assert parameters.time_sample_frame(spark, s).first().method == "M1"
    assert parameters.study_frame(spark, s).first().description == "five periods"


def test_csv_columns_are_read_by_each_files_own_header(spark, tmp_path):
    for name, text in {"1": "a,b\n1,x\n", "2": "b,a\ny,2\n", "3 c": "a,z\n3,w\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.csv").write_text(text)
    got = tables.read_columns(spark, f"{tmp_path}/*/t.csv", {"a": "int", "b": "string"})
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(ValueError):
        tables.read_columns(spark, f"{tmp_path}/*/t.csv", {"a": "int", "q": "string"})
