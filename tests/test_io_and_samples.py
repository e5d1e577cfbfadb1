"""Files, streams and samples."""

import pytest
from pyspark.sql import functions as F, types as T

from tablemill.operators import encode, sampling, scale
from tablemill.sources import files
from tablemill.streaming.apply import apply_to_stream, read_stream


def test_ragged_lines(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text('a\tb\tc\n1\tx\ty\n2\tx\n3\tx\ty\tz\n4\t"q ""in"" q"\ty\n')
    rows = files.read_tolerant(spark, str(path)).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [("1", "x", "y"), ("2", "x", None), ("4", 'q "in" q', "y")]


def test_sniffing(spark, tmp_path):
    for sep, name in ((",", "c"), (";", "s"), ("\t", "t")):
        p = tmp_path / name
        p.write_text(sep.join(["id", "price"]) + "\n" + sep.join(["1", "2.5"]) + "\n")
        assert files.sniff_separator(spark, str(p)) == (sep, ["id", "price"])
    bad = tmp_path / "bad"
    bad.write_text("only\n1\n")
    with pytest.raises(ValueError):
        files.sniff_separator(spark, str(bad))


def test_sample_lines(spark, tmp_path):
    source = tmp_path / "lines.csv"
    source.write_text("id,name\n" + "".join(f'{i},"n {i}, x"\n' for i in range(3000)))
    target = files.sample_lines(spark, str(source), str(tmp_path / "out"), n=300)
    got = files.read_delimited(spark, target, sep=",", schema=T.StructType.fromDDL("id long, name string")).collect()
    assert 200 < len(got) < 400 and all(r["name"] == f"n {r['id']}, x" for r in got)
    assert files.sample_lines(spark, str(source), target, n=1) == target


def test_samples_repeat(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"c{i % 11}", float(i % 50)) for i in range(1000)], "id long, c string, x double")
    ids = lambda t: sorted(r["id"] for r in t.collect())
    first = ids(sampling.sample_exact(df, "id", 100))
    assert len(first) == 100 and first == ids(sampling.sample_exact(df.repartition(7), "id", 100))
    assert first != ids(sampling.sample_exact(df, "id", 100, seed=1))
    smart = sampling.smart_sample(df, "id", 200)
    assert smart.count() <= 200 and smart.select("c").distinct().count() == df.select("c").distinct().count()
    rep = sampling.representative_sample(df, "id", 0.2, ["c"], ["x"], min_size=5)
    assert rep.count() == 200 and rep.select("id").distinct().count() == 200


def test_stored_encoder(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    enc = encode.StoredEncoder(str(tmp_path / "enc"), "count")
    assert sorted(r["c_count"] for r in enc.encode(df, ["c"]).collect()) == [1, 2, 2]
    later = enc.encode(spark.createDataFrame([("a",), ("new",)], "c string"), ["c"])
    assert {r["c"]: r["c_count"] for r in later.collect()} == {"a": 2, "new": None}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id long, x double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    scaler = scale.fit_standard(df, ["x"])
    step = lambda t: scale.apply_scaler(t, scaler)
    out = apply_to_stream(read_stream(spark, str(tmp_path / "in")), step, str(tmp_path / "out"), str(tmp_path / "cp"))
    again = apply_to_stream(read_stream(spark, str(tmp_path / "in")), step, str(tmp_path / "out"), str(tmp_path / "cp"))
    key = lambda t: sorted(tuple(r) for r in t.collect())
    assert key(out) == key(step(df)) == key(again)


def test_cluster_needs_a_shared_folder():
    """Without spark.checkpoint.dir only local mode may use a folder of its own."""
    from types import SimpleNamespace as Named

    from tablemill import session

    context = Named(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.shared_root(Named(conf={}, sparkContext=context))


def test_work_tables_go(spark):
    import os

    from tablemill import session

    table = session.materialised(spark.range(3), "some")
    folder = session.work_folder(spark).removeprefix("file:")
    assert table.count() == 3 and any(x.startswith("some-") for x in os.listdir(folder))
    # a folder of its own, so that tables of other tests stay
    own = session.work_folder
    session.work_folder = lambda s: own(s) + "/gone"
    try:
        session.materialised(spark.range(3), "other")
        session.drop_work_tables(spark)
    finally:
        session.work_folder = own
    assert not os.path.exists(folder + "/gone") and table.count() == 3
