"""Daily CSV files: readers and batch ingest."""

import pytest

from tidemeter.sources import ingest, tables


@pytest.fixture()
def folder(tmp_path):
    ins, outs = tmp_path / "ins", tmp_path / "outs"
    ins.mkdir(), outs.mkdir()
    (ins / "20240109.csv").write_text(
        "Dispositivo,Fecha_Transaccion,Estacion_Parada,Numero_Tarjeta\n"
        "x,2024-01-09 06:00:10,(09104) Restrepo,c1\nx,2024-01-09 06:00:40,(09104) Restrepo,c2\n"
        "x,2024-01-09 06:03:00,(09104)Restrepo,c1\nx,2024-01-09 06:16:00,no code,c9\n"
    )
    (ins / "20240110.csv").write_text(
        "Dispositivo,Fecha_Transaccion,Estacion_Parada,Numero_Tarjeta\nx,2024-01-10 07:00:00,(02300) Portal Norte,c1\n"
    )
    (outs / "20240109.csv").write_text(
        "Fecha_Transaccion,Tiempo,Linea,Estacion,Salidas_S\n2024-01-09,06:00:00,L,(09104) Restrepo,4\n2024-01-09,06:00:00,L,(09104) Restrepo,5.5\n"
    )
    return str(ins), str(outs)


def test_readers(spark, folder):
    ins, outs = folder
    rows = tables.read_checkin_files(spark, ins)
    assert rows.count() == 5 and set(rows.columns) == {"ts", "station_field", "card", "file_id"}
    assert tables.select_files(rows, ["20240110"]).count() == 1
    exits = tables.read_checkout_files(spark, outs).orderBy("exits").collect()
    assert [(str(r["ts"]), r["exits"], r["file_id"]) for r in exits][0] == ("2024-01-09 06:00:00", 4.0, "20240109")


def test_ingest_twice_changes_nothing(spark, folder, tmp_path):
    ins, outs = folder
    store = ingest.empty_store(spark)
    store = ingest.ingest(store, tables.read_checkin_files(spark, ins), ingest.CHECKINS)
    store = ingest.ingest(store, tables.read_checkout_files(spark, outs), ingest.CHECKOUTS)
    ingest.save(store, str(tmp_path / "store"), 0)
    again = ingest.load(spark, str(tmp_path / "store"), 0)
    again = ingest.ingest(again, tables.read_checkin_files(spark, ins), ingest.CHECKINS)
    facts = {(r["station_id"], r["day"], r["time"]): r for r in again.facts.collect()}
    codes = {r["code"]: r["id"] for r in again.stations.collect()}
    assert set(codes) == {"09104", "02300"}
    first = facts[(codes["09104"], 9, 600)]
    # two spellings of one station add up: minutes 0 and 3 hold 2 and 1 taps
    assert (first["count_in"], first["count_out"], first["variance_in_1min"]) == (3, 9, 0.5)
    assert len(facts) == 2 and facts[(codes["02300"], 10, 700)]["count_out"] is None
    assert again.ledger.where("processed").count() == 3
