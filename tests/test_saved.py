from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import DAY, MILLIS_2017_04_04, column
from wildtally import schemas
from wildtally.plans import generate
from wildtally.plans import queries as Q
from wildtally.plans import registry
from wildtally.selector import InvalidSelector, selectors_frame
from wildtally.sources import inputs, sinks, tables
from wildtally.streaming import refresh
from wildtally.streaming.refresh import add_batch, refresh_stream

AREA = "ENVELOPE(-72,-70,43,42)"
FROGS, ALL, NONE = ("Anura", AREA, ""), ("", AREA, ""), ("Mammalia", AREA, "")
ODD = ("Anura", "POINT (1 2)", "")


def monitored(spark, base):
    sources = ("gbif", "idigbio", "inaturalist")
    return sorted(((s, r.occurrenceId, r.monitorUUID[:8]) for s in sources for r in tables.source_ids(spark, base, s).collect()), key=repr)


def loads(spark, base):
    return sorted({r.load.split(".")[0] for r in tables.current_loads(spark, base).collect()})


def folders(base, table=tables.OCCURRENCE):
    return sorted(f.name for f in Path(base, tables.LOADS[table]).glob("load=*"))


def counts(spark, base):
    return {(r.taxonSelector, r.wktString): (r.status, r.recordCount) for r in Q.monitors(spark, base).collect()}


@pytest.fixture(scope="module")
def base(spark, records, traits, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("monitors"))
    generate.save_all_occurrences(records, selectors_frame(spark, [FROGS, ALL, NONE, ODD]), folder, traits)
    generate.save_checklists(records, selectors_frame(spark, [FROGS, ALL, NONE]), folder, traits)
    return folder


def test_nothing_saved(spark, tmp_path):
    base = str(tmp_path / "none")
    assert Q.monitors(spark, base).count() == 0
    assert Q.checklist(spark, base, FROGS).count() == 0
    assert Q.occurrences(spark, base, FROGS).count() == 0
    assert Q.monitored_occurrences(spark, base, "gbif").count() == 0
    assert Q.monitored_occurrences(spark, base, "../x=1").count() == 0
    assert Q.status_of(spark, base, FROGS).count() == 0
    assert not Q.checklist_exists(spark, base, FROGS)


def test_monitors(spark, base):
    assert counts(spark, base) == {
        FROGS[:2]: ("ready", 3),
        ALL[:2]: ("ready", 6),
        NONE[:2]: ("ready", 0),
        ODD[:2]: ("unsupported area", 0),
    }
    uuid = Q.monitor_of(spark, base, FROGS).first().uuid
    by_uuid = Q.monitor_of(spark, base, uuid=uuid.upper()).first()
    assert (by_uuid.uuid, by_uuid.taxonSelector, by_uuid.status, by_uuid.recordCount) == (uuid, None, "ready", 3)
    asked = Q.monitors_of(spark, base, selectors_frame(spark, [FROGS, ("Aves", AREA, "")])).collect()
    assert [(r.taxonSelector, r.status, r.recordCount) for r in asked] == [("Anura", "ready", 3), ("Aves", None, None)]
    asked = Q.checklists_status(spark, base, selectors_frame(spark, [FROGS, NONE])).collect()
    assert {r.taxonSelector: r.status for r in asked} == {"Anura": "ready", "Mammalia": None}


def test_checklist(spark, base):
    rows = Q.checklist(spark, base, ALL).collect()
    assert [r.recordCount for r in rows] == [3, 1, 1, 1]
    assert Q.checklist(spark, base, ALL, limit=0).count() == 0
    assert Q.checklist_exists(spark, base, ALL)
    assert column(Q.checklist_tsv(spark, base, FROGS), "taxonName") == ["Rana"]
    json = Q.checklist_json(spark, base, FROGS).first().json
    assert json.endswith('"status":"ready","items":[{"taxon":"Animalia|Chordata|Amphibia|Anura|Rana","recordcount":3}]}')
    empty = Q.checklist_json(spark, base, NONE).first().json
    assert '"items":[]' in empty and "status" not in empty


def test_occurrences(spark, base):
    assert column(Q.occurrences(spark, base, FROGS), "id") == ["a1", "a1", "a2"]
    row = Q.occurrences(spark, base, FROGS).first()
    assert (row.lat, row.start, row.end, row.source) == (42.37, 1, 1, "gbif")
    assert column(Q.occurrences(spark, base, FROGS, added_after="2017-04-04"), "id") == ["a2"]
    assert column(Q.occurrences(spark, base, FROGS, added_before="2017-04-05", limit=1), "id") == ["a1"]
    assert Q.occurrences(spark, base, ODD).count() == 0
    json = Q.occurrences_json(spark, base, FROGS, added_after="2017-04-04").first().json
    assert json.endswith(
        '"items":[{"taxon":"Animalia|Chordata|Amphibia|Anura|Rana","lat":42.0,"lng":-71.0,"start":2,"end":2,'
        f'"id":"a2","added":{MILLIS_2017_04_04 + DAY},"source":"idigbio"}}]}}'
    )
    assert '"status":"unsupported area","items":[]' in Q.occurrences_json(spark, base, ODD).first().json
    assert '"items":[]' in Q.occurrences_json(spark, base, ("Aves", AREA, "")).first().json
    with pytest.raises(InvalidSelector):
        Q.occurrences(spark, base, ("1", AREA, ""))


def test_computed_on_the_spot(spark, base, records, traits):
    new = ("Insecta", AREA, "")
    assert Q.occurrences(spark, base, new).count() == 0
    assert column(Q.occurrences(spark, base, new, compute=(records, traits)), "id") == ["c1"]
    assert [r.recordCount for r in Q.checklist(spark, base, new, compute=(records, traits)).collect()] == [1]
    with pytest.raises(InvalidSelector):
        Q.checklist(spark, base, uuid="00000000-0000-5000-8000-000000000000", compute=(records, traits))


def test_monitored(spark, base):
    assert [r.occurrenceId for r in Q.monitored_occurrences(spark, base, "idigbio").collect()] == ["a2", "a2"]
    assert Q.monitored_occurrences(spark, base, "gbif", limit=0).count() == 0
    assert column(Q.monitored_occurrences(spark, base, "gbif", added_after="2017-04-05"), "occurrenceId") == ["b1"]


def test_reads_are_pruned(spark, base):
    uuid = Q.monitor_of(spark, base, FROGS).first().uuid
    rows = tables.selector_occurrences(spark, base, uuid, "2017-04-04", "2018-01-01")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1]
    assert f"EqualTo(uuid,{uuid})" in pushed and "GreaterThanOrEqual(added,1491350400000)" in pushed and "LessThan(added,1514764800000)" in pushed
    assert all(f"/u0={uuid[:2]}/" in f for f in rows.inputFiles())
    # One load, and in it a file per first digits of the selectors with records, or per archive.
    assert len(folders(base)) == 1
    assert len(list(Path(base, "occurrence-load").rglob("*.parquet"))) == 2 and len(list(Path(base, "monitored-load").rglob("*.parquet"))) == 2


def test_refresh_replaces_only_its_selectors(spark, records, traits, tmp_path):
    base = str(tmp_path)
    generate.save_all_occurrences(records, selectors_frame(spark, [FROGS, ALL]), base, traits)
    before = monitored(spark, base)
    # Fewer records: the folders of days without records go, for this selector only.
    generate.save_occurrences(records.filter("id = 'a2'"), FROGS, base, traits)
    assert counts(spark, base) == {FROGS[:2]: ("ready", 1), ALL[:2]: ("ready", 6)}
    assert column(Q.occurrences(spark, base, FROGS), "id") == ["a2"]
    assert Q.occurrences(spark, base, ALL).count() == 6
    frogs = Q.monitor_of(spark, base, FROGS).first().uuid[:8]
    assert monitored(spark, base) == [m for m in before if m[2] != frogs or m[1] == "a2"]
    # All of them again, twice the same.
    for _ in range(2):
        generate.refresh_all(records, base, traits)
        assert counts(spark, base) == {FROGS[:2]: ("ready", 3), ALL[:2]: ("ready", 6)}
        assert monitored(spark, base) == before
    generate.save_checklist(records, FROGS, base)
    generate.save_checklist(records.limit(0), FROGS, base)
    assert Q.checklist(spark, base, FROGS).count() == 0


def files_of(base):
    return {f: f.stat().st_mtime_ns for f in Path(base).rglob("*.parquet")}


def test_saving_one_leaves_the_files_of_others(spark, records, traits, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    generate.save_occurrences(records, ALL, first, traits)
    before = files_of(first)
    for _ in range(2):
        generate.save_occurrences(records, FROGS, first, traits)
    assert {f: t for f, t in files_of(first).items() if f in before} == before
    for selector in (FROGS, ALL):
        generate.save_occurrences(records, selector, second, traits)
    assert monitored(spark, first) == monitored(spark, second) and counts(spark, first) == counts(spark, second)


def test_no_refresh_without_traits(spark, records, traits, tmp_path):
    base, heavy = str(tmp_path), ("Anura", "ENVELOPE(-180,180,90,-90)", "mass > 1")
    generate.save_all_occurrences(records, selectors_frame(spark, [heavy, ALL]), base, traits)
    before = files_of(base)
    for refused in (
        lambda: generate.refresh_all(records, base),
        lambda: add_batch(records, base, "batch-0"),
        lambda: generate.save_all_occurrences(records, selectors_frame(spark, [heavy]), base),
        lambda: generate.save_checklists(records, selectors_frame(spark, [heavy]), base),
    ):
        with pytest.raises(InvalidSelector, match="trait list"):
            refused()
    assert files_of(base) == before


def test_a_save_that_is_broken_off_changes_nothing(spark, records, traits, tmp_path, monkeypatch):
    base = str(tmp_path)
    generate.save_all_occurrences(records, selectors_frame(spark, [FROGS, ALL]), base, traits)
    before, there = monitored(spark, base), counts(spark, base)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "save_summary", killed)
        for job in (
            lambda: generate.refresh_all(records.filter("id = 'a2'"), base, traits),
            lambda: add_batch(records, base, "batch-1", traits),
        ):
            with pytest.raises(KeyboardInterrupt):
                job()
    assert (monitored(spark, base), counts(spark, base)) == (before, there)
    assert Q.occurrences(spark, base, ALL).count() == 6 and len(folders(base)) == 3
    generate.refresh_all(records.filter("id = 'a2'"), base, traits)
    assert counts(spark, base) == {FROGS[:2]: ("ready", 1), ALL[:2]: ("ready", 1)}
    assert column(Q.occurrences(spark, base, ALL), "id") == ["a2"]


def test_batches_are_counted_without_older_loads(spark, records, traits, tmp_path):
    base = str(tmp_path)
    generate.save_all_occurrences(records.filter("source = 'gbif'"), selectors_frame(spark, [FROGS, ALL]), base, traits)
    full = folders(base)
    # What an older load holds is not looked at: it could be gone.
    hidden = Path(base, "occurrence-load", full[0])
    hidden.rename(tmp_path / "elsewhere")
    add_batch(records.filter("source <> 'gbif'"), base, "batch-1", traits)
    assert counts(spark, base) == {FROGS[:2]: ("ready", 3), ALL[:2]: ("ready", 6)}
    (tmp_path / "elsewhere").rename(hidden)
    assert column(Q.occurrences(spark, base, FROGS), "id") == ["a1", "a1", "a2"]
    # The batch again with fewer records, then with none.
    add_batch(records.filter("id = 'none'"), base, "batch-1", traits)
    assert counts(spark, base) == {FROGS[:2]: ("ready", 2), ALL[:2]: ("ready", 5)} and len(folders(base)) == 2
    with pytest.raises(ValueError):
        add_batch(records, base, "a.b", traits)


def test_compaction(spark, records, traits, tmp_path):
    base = str(tmp_path)
    generate.register_monitors(selectors_frame(spark, [FROGS, ALL, NONE]), base)
    for i, part in enumerate(["gbif", "idigbio", "inaturalist"]):
        add_batch(records.filter(F.col("source") == part), base, f"batch-{i}", traits)
    before, there = monitored(spark, base), counts(spark, base)
    generate.register_monitors(selectors_frame(spark, [FROGS, ALL]), base)
    assert loads(spark, base) == ["batch-0", "batch-1"] and there[ALL[:2]] == ("ready", 6)
    generate.compact_loads(spark, base, 2)
    assert loads(spark, base) == ["batch-0", "batch-1"]
    generate.compact_loads(spark, base)
    assert loads(spark, base) == ["compact"] and (monitored(spark, base), counts(spark, base)) == (before, there)
    assert [f.split(".")[0] for f in folders(base)] == ["load=batch-2", "load=compact"]
    assert column(Q.occurrences(spark, base, FROGS), "id") == ["a1", "a1", "a2"]


def test_tables_without_loads(spark, records, traits, tmp_path):
    base, uuid = str(tmp_path), Q.monitors_of(spark, str(tmp_path / "none"), selectors_frame(spark, [ALL])).first().uuid
    folder = f"{base}/occurrence/u0={uuid[0:2]}/u1={uuid[2:4]}/u2={uuid[4:6]}/uuid={uuid}"
    records.filter("id = 'a2'").write.parquet(f"{folder}/y=2017/m=04/d=05")
    ids = spark.createDataFrame([("http://example.org/1", None), ("a2", uuid)], "occurrenceId string, monitorUUID string")
    ids.write.parquet(f"{base}/source-of-monitored-occurrence/source=inaturalist/y=2017/m=04/d=05")
    assert tables.read_selector(spark, base, tables.OCCURRENCE, uuid).first().m == "04"
    assert sorted(tuple(r) for r in Q.monitored_occurrences(spark, base, "inaturalist").collect()) == [("a2", uuid), ("http://example.org/1", "")]
    row = spark.createDataFrame([(1, "ready", *ALL, uuid)], "itemCount long, status string, taxonSelector string, wktString string, traitSelector string, uuid string")
    row.drop("uuid").write.parquet(f"{base}/occurrence-summary/u0={uuid[0:2]}/u1={uuid[2:4]}/u2={uuid[4:6]}/uuid={uuid}")
    assert column(Q.occurrences(spark, base, ALL, added_after="2017-04-04"), "id") == ["a2"]
    plan = tables.selector_occurrences(spark, base, uuid, "2017-04-04")._jdf.queryExecution().executedPlan().toString()
    assert any("make_date" in part.split("PushedFilters")[0] for part in plan.split("PartitionFilters")[1:])
    # A batch comes on top of them; a full save takes their place.
    add_batch(records.filter("id = 'b1'"), base, "batch-0", traits)
    generate.compact_loads(spark, base)
    assert column(Q.occurrences(spark, base, ALL), "id") == ["a2", "b1"] and counts(spark, base)[ALL[:2]] == ("ready", 2)
    generate.save_occurrences(records, ALL, base, traits)
    assert Q.occurrences(spark, base, ALL).count() == 6 and counts(spark, base)[ALL[:2]] == ("ready", 6)
    assert [tuple(r) for r in Q.monitored_occurrences(spark, base, "inaturalist").collect()] == [("http://example.org/1", "")]


def test_hot_partition_is_written_by_many_tasks(spark, tmp_path):
    base = str(tmp_path)
    rows = spark.range(200000, numPartitions=8).selectExpr(
        "concat('A|', id) AS taxon", "1D AS lat", "2D AS lng", "id AS start", "CAST(id AS STRING) AS id", "0L AS added", "'s' AS source",
        "'00000000-0000-5000-8000-000000000000' AS uuid",
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        tables.write_occurrences(rows, base, "batch")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    saved = tables.read_loads(spark, base, tables.OCCURRENCE)
    assert saved.count() == 200000 and len(saved.inputFiles()) > 1


def test_stream_equals_one_pass_and_replays(spark, records, traits, tmp_path):
    base, arrivals = str(tmp_path / "base"), str(tmp_path / "arrivals")
    for i in range(3):
        records.filter(F.pmod(F.hash("id"), F.lit(3)) == i).coalesce(1).write.parquet(f"{arrivals}/{i}")
    generate.register_monitors(selectors_frame(spark, [FROGS, ALL, NONE]), base)
    running = refresh_stream(spark, arrivals, base, str(tmp_path / "progress"), "new", traits, 1)
    running.awaitTermination()
    expected = {FROGS[:2]: ("ready", 3), ALL[:2]: ("ready", 6), NONE[:2]: ("ready", 0)}
    assert counts(spark, base) == expected
    before = monitored(spark, base)
    assert loads(spark, base) == ["new-0", "new-1", "new-2"][: len(loads(spark, base))] and len(loads(spark, base)) > 1
    # A batch that runs again changes nothing.
    first = tables.current_loads(spark, base).filter("load LIKE 'new-0.%'").first().load
    ids = tables.read_loads(spark, base, tables.OCCURRENCE, [first]).select("id").distinct()
    add_batch(records.join(ids, "id", "left_semi").select(*schemas.OCCURRENCE.names), base, "new-0", traits)
    assert counts(spark, base) == expected and monitored(spark, base) == before
    # A full refresh takes the place of all batches, and of their folders.
    generate.refresh_all(records, base, traits)
    assert counts(spark, base) == expected and monitored(spark, base) == before
    assert loads(spark, base) == ["full"] and [f for f in folders(base) if "full" in f] and len(folders(base)) <= 2


def test_stream_compacts_before_a_batch(spark, records, traits, tmp_path):
    base, arrivals = str(tmp_path / "base"), str(tmp_path / "arrivals")
    for i in range(5):
        records.filter(F.pmod(F.hash("id"), F.lit(5)) == i).coalesce(1).write.parquet(f"{arrivals}/{i}")
    generate.register_monitors(selectors_frame(spark, [FROGS, ALL]), base)
    refresh_stream(spark, arrivals, base, str(tmp_path / "progress"), "new", traits, 1, compact_every=2).awaitTermination()
    assert counts(spark, base) == {FROGS[:2]: ("ready", 3), ALL[:2]: ("ready", 6)}
    assert "compact" in loads(spark, base) and len(loads(spark, base)) <= 3
    assert Q.occurrences(spark, base, ALL).count() == 6


def test_batches_share_the_index_until_monitors_change(spark, records, traits, tmp_path, monkeypatch):
    base, arrivals, made = str(tmp_path / "base"), str(tmp_path / "arrivals"), []
    for i in range(3):
        records.filter(F.pmod(F.hash("id"), F.lit(3)) == i).coalesce(1).write.parquet(f"{arrivals}/{i}")
    index = refresh.selector_index
    monkeypatch.setattr(refresh, "selector_index", lambda rows: made.append(1) or index(rows))
    heavy = ("", AREA, "mass > 100")
    generate.register_monitors(selectors_frame(spark, [FROGS, heavy]), base)
    refresh_stream(spark, arrivals, base, str(tmp_path / "progress"), "new", traits, 1).awaitTermination()
    assert counts(spark, base)[FROGS[:2]] == ("ready", 3) and counts(spark, base)[heavy[:2]] == ("ready", 1)
    assert made == [1]
    # Monitors that come between two batches are part of the next.
    base, known = str(tmp_path / "later"), refresh.KnownMonitors(traits)
    generate.register_monitors(selectors_frame(spark, [FROGS]), base)
    add_batch(records.filter("id <> 'b1'"), base, "batch-0", monitors=known)
    generate.register_monitors(selectors_frame(spark, [heavy]), base)
    add_batch(records.filter("id = 'b1'"), base, "batch-1", monitors=known)
    assert counts(spark, base) == {FROGS[:2]: ("ready", 3), heavy[:2]: ("ready", 1)} and made == [1] * 3


def test_arrivals_are_few_files_of_many_row_groups(spark, tmp_path):
    path, setting = str(tmp_path / "arrivals"), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(1000000).selectExpr("uuid() AS id", "id % 2 AS year")
    spark.conf.set(setting, "1MB")
    try:
        registry._arrive(spark, rows, path)
        assert spark.conf.get(setting) == "1MB"
    finally:
        spark.conf.unset(setting)
    files = [pq.ParquetFile(f) for f in Path(path).glob("year=*/*.parquet")]
    assert len(files) == 2 and sum(f.metadata.num_rows for f in files) == 1000000
    assert min(f.metadata.num_row_groups for f in files) > 1


def test_tsv_files_are_verbatim(spark, tmp_path):
    rows = spark.createDataFrame([(' a "q" | b\tc ', 3), ("", 1), (None, 2)], "taxonPath string, recordCount bigint")
    sinks.write_checklist_tsv(rows.coalesce(1), str(tmp_path / "t"))
    lines = column(spark.read.text(str(tmp_path / "t")), "value")
    assert lines == ["taxonName\ttaxonPath\trecordCount", ' b c \t a "q" | b c \t3', "\t\t2", "\t\t1"]


def test_tsv_files_of_several_parts(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('A|', id % 700) AS taxonPath", "id % 50 AS recordCount").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_checklist_tsv(rows, str(tmp_path / "t"))
        sinks.write_checklist_tsv(rows.limit(0), str(tmp_path / "none"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "t").glob("part-*"))
    lines = [line for part in parts for line in part.read_text().splitlines()]
    assert len(parts) > 1 and lines[0] == "taxonName\ttaxonPath\trecordCount" and len(lines) == 4001
    expected = sorted(((-r.recordCount, r.taxonPath) for r in rows.collect()))
    assert [(-int(x[2]), x[1]) for x in (line.split("\t") for line in lines[1:])] == expected
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == lines[0] + "\n"


def test_inputs(spark, records, traits, tmp_path):
    traits.write.option("header", True).csv(f"{tmp_path}/traitbank")
    read = inputs.read_traits(spark, f"{tmp_path}/traitbank/*.csv")
    assert sorted(map(str, read.collect())) == sorted(map(str, traits.collect()))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/t.csv").write_text("taxon,trait,value\nRana,mass,abc\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        inputs.read_traits(spark, f"{tmp_path}/bad/*.csv").collect()
    for source, text in {"gbif": "id1\nid2\n", "other": "id3\tuuid\n"}.items():
        folder = tmp_path / f"ids/source={source}/all.tsv"
        folder.mkdir(parents=True)
        (folder / "ids.tsv").write_text(text)
    got = sorted(inputs.read_id_lists(spark, f"{tmp_path}/ids").collect())
    assert [tuple(r) for r in got] == [("id1", None, "gbif"), ("id2", None, "gbif"), ("id3", "uuid", "other")]
    union = inputs.union_archives({"a": records.drop("source"), "b": records.drop("source", "start")})
    assert union.groupBy("source").agg(F.count("*"), F.count("start")).orderBy("source").collect() == [("a", 9, 9), ("b", 9, 0)]


def test_json_file(spark, base, tmp_path):
    sinks.write_json(Q.monitors_json(Q.monitors(spark, base)), str(tmp_path / "j"))
    rows = spark.read.json(str(tmp_path / "j")).select("selector.taxonSelector", "status", "recordCount").collect()
    assert sorted(map(tuple, rows)) == [("", "ready", 6), ("Anura", "ready", 3), ("Anura", "unsupported area", 0), ("Mammalia", "ready", 0)]
