"""Readers, type detection, metadata, sample data, writers, command line."""

import os
import struct
import zlib
from functools import partial

import pytest
from pyspark.sql import functions as F

from tablevitals import session
from tablevitals.__main__ import main
from tablevitals.plans.audit import audit_dataset
from tablevitals.sources import listing, metadata, readers, writers
from tablevitals.sources.sample_data import create_sample_data, sample_rows


def rows(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]


def png(width, height):
    """A grey PNG image."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    pixels = zlib.compress((b"\x00" + b"\x7f" * width) * height)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", pixels) + chunk(b"IEND", b"")


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('i,f,b,s,day,gap,none,mix,big\n'
                    '1,1.5,True,"a, ""b""",2024-01-01,,NA,1,9223372036854775808\n'
                    '-2,inf,False,null,2024-01-02,7,,x,1\n'
                    '+3,1e3,true,,2024-01-03,NaN,n/a,2,2\n')
    frame = readers.scan_csv(spark, str(path))
    assert dict(frame.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "day": "string",
                                  "gap": "bigint", "none": "double", "mix": "string", "big": "double"}
    found = rows(frame)
    assert [r["i"] for r in found] == [1, -2, 3]
    assert [r["s"] for r in found] == ['a, "b"', None, None]
    assert [r["gap"] for r in found] == [None, 7, None]
    assert [r["f"] for r in found] == [1.5, float("inf"), 1000.0]
    assert [r["b"] for r in found] == [True, False, True]


def test_csv_line_breaks_in_cells(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n"x\ny",1\n')
    assert rows(readers.scan_csv(spark, str(path), multiline=True)) == [{"a": "x\ny", "b": 1}]


def test_json_array_and_lines(spark, tmp_path):
    array, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    array.write_text('[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    lines.write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    expected = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    assert rows(readers.scan_json(spark, str(array))) == expected
    assert rows(readers.scan_json(spark, str(lines), lines=True)) == expected
    assert rows(readers.load(spark, str(array)).data) == expected
    assert rows(readers.load(spark, str(lines), format="jsonl").data) == expected


@pytest.mark.parametrize("name", ["x.json", "x.jsonl", "folder"])
def test_load_tells_lines_from_documents(spark, tmp_path, name):
    expected = [{"a": i, "b": f"t{i}"} for i in range(100)]
    frame = spark.createDataFrame([(r["a"], r["b"]) for r in expected], "a long, b string")
    path = tmp_path / name
    writers.save_json(frame.repartition(2), str(path))
    if name == "folder":
        for part in path.glob("part-*"):
            part.rename(part.with_suffix(".json"))
    assert sorted(rows(readers.load(spark, str(path)).data), key=lambda r: r["a"]) == expected


def test_load_a_folder_of_both(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "lines.json").write_text('\n \n{"a": 1}\n{"a": 2}\n')
    (folder / "array.json").write_text('[{"a": 3},\n{"a": 4, "b": "x"}]')
    (folder / "pretty.json").write_text('{\n  "a": 5\n}\n')
    (folder / "blank.json").write_text("\n")
    found = readers.load(spark, str(folder)).data
    assert sorted((r["a"], r["b"] or "") for r in rows(found)) == [(1, ""), (2, ""), (3, ""), (4, "x"), (5, "")]


def test_broken_json_stops_the_scan(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.load(spark, str(path)).data.collect()


def test_csv_rows_with_too_many_cells(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(ValueError, match="1 rows"):
        readers.scan_csv(spark, str(path))
    path.write_text("a,b\n1,2\n3\n")
    assert rows(readers.scan_csv(spark, str(path))) == [{"a": 1, "b": 2}, {"a": 3, "b": None}]


def test_load_passes_multiline(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n"x\ny",1\nz,2\n')
    assert readers.load(spark, str(path), multiline=True).data.count() == 2


def test_audit_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    shared.mkdir()
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(shared))
    (tmp_path / "x.jsonl").write_text("".join(f'{{"id": {i}, "v": {i % 7}}}\n' for i in range(50)))
    result = audit_dataset(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "out"), ["id"])
    assert not any(shared.rglob("*.parquet")) and not any(shared.rglob("part-*"))
    assert result.report.count() == 1 and result.detection.rows.count() == 50 and result.profile.correlations.count() == 4
    kept = audit_dataset(spark, str(tmp_path / "x.jsonl"), key=["id"])
    assert kept.detection.rows.count() == 50
    kept.close()
    assert not any(shared.rglob("part-*"))
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        audit_dataset(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "out2"))
    assert not any(shared.rglob("part-*"))


def test_text_lines(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("  one \n\n\t\ntwo\n")
    loaded = readers.load(spark, str(path))
    assert loaded.kind == "text"
    assert [r["text"] for r in rows(loaded.data)] == ["one", "two"]


def test_text_folder(spark, tmp_path):
    for label, name, text in [("pos", "1.txt", " good\nday "), ("pos", "2.txt", "  \n"), ("n g", "3.txt", "bad")]:
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_text(text)
    (tmp_path / "readme.md").write_text("no sample")
    loaded = readers.load(spark, str(tmp_path))
    assert loaded.kind == "text"
    found = {(r["label"], r["text"]) for r in rows(loaded.data)}
    assert found == {("pos", "good\nday"), ("n g", "bad")}
    described = rows(metadata.dataset_metadata(loaded))[0]
    assert (described["n_samples"], described["n_classes"], described["dataset_type"]) == (2, 2, "text")
    assert len(rows(readers.scan_text_dir(spark, str(tmp_path), limit=1))) == 1


def test_image_folder(spark, tmp_path):
    for label, name, size in [("cat", "a.png", (3, 2)), ("dog", "b.PNG", (4, 4)), ("dog", "c.png", (1, 1))]:
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_bytes(png(*size))
    (tmp_path / "dog" / "broken.png").write_bytes(b"not an image")
    loaded = readers.load(spark, str(tmp_path))
    assert loaded.kind == "image"
    found = {(r["label"], r["width"], r["height"]) for r in rows(loaded.data.drop("data"))}
    assert found == {("cat", 3, 2), ("dog", 4, 4), ("dog", 1, 1)}
    assert rows(metadata.dataset_metadata(loaded))[0]["n_classes"] == 2


def test_folder_of_tables(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    loaded = readers.load(spark, str(tmp_path / "t"))
    assert loaded.kind == "tabular" and loaded.data.count() == 10


def test_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.load(spark, str(tmp_path))


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        readers.load(spark, str(tmp_path / "nowhere.parquet"))


def test_unknown_suffix_is_read_as_csv(spark, tmp_path):
    (tmp_path / "data.dat").write_text("a,b\n1,x\n")
    loaded = readers.load(spark, str(tmp_path / "data.dat"))
    assert loaded.kind == "tabular" and rows(loaded.data) == [{"a": 1, "b": "x"}]


def test_sample_data(spark):
    frame = create_sample_data(spark, 100, 5, 0.1)
    assert frame.count() == 100
    assert frame.columns == [f"feature_{i}" for i in range(5)] + ["category", "target"]
    big = create_sample_data(spark, 20000, 3).persist()
    shares = big.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in big.columns]).first()
    assert all(0.04 < s < 0.06 for s in shares)
    stats = big.agg(F.avg("target").alias("t"), F.stddev("feature_0").alias("sd"), F.avg("feature_0").alias("m"),
                    F.count_distinct("category").alias("k")).first()
    # A tenth of the rows has variance 1 + 25.
    assert abs(stats["t"] - 0.3) < 0.02 and abs(stats["sd"] - 3.5 ** 0.5) < 0.1 and abs(stats["m"]) < 0.05
    assert stats["k"] == 3


def test_sample_data_does_not_depend_on_partitions(spark):
    first = create_sample_data(spark, 500, 2).orderBy("feature_0", "feature_1").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        second = create_sample_data(spark, 500, 2).orderBy("feature_0", "feature_1").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == second


def test_sample_data_has_the_asked_number_of_anomalies(spark):
    """Rows differ from the run without anomalies exactly where anomalies were planted."""
    with_anomalies, without = (sample_rows(spark.range(3000), 3000, 1, ratio, keep=("id",)) for ratio in (0.1, 0.0))
    other = without.select("id", F.col("feature_0").alias("plain"))
    both = with_anomalies.join(other, "id").filter("feature_0 IS NOT NULL")
    changed = both.filter("feature_0 != plain").count()
    assert both.count() > 2700 and 260 <= changed <= 300


def test_csv_roundtrip_of_sample_data(spark, tmp_path):
    frame = create_sample_data(spark, 200, 3)
    writers.save_csv(frame, str(tmp_path / "s.csv"))
    back = readers.load(spark, str(tmp_path / "s.csv"))
    assert back.kind == "tabular" and back.data.count() == 200
    assert [r["feature_0"] for r in rows(back.data.orderBy("feature_0"))] == [
        r["feature_0"] for r in rows(frame.orderBy("feature_0"))]


def test_csv_tells_empty_from_null(spark, tmp_path):
    frame = spark.createDataFrame([("", 1), (None, 2), ('a "b", c', 3)], "s string, n int")
    writers.save_csv(frame, str(tmp_path / "c"))
    lines = sorted(line for part in (tmp_path / "c").glob("part*") for line in part.read_text().splitlines())
    assert [x for x in lines if x != "s,n"] == ['"",1', '"a ""b"", c",3', ",2"]
    assert readers.scan_csv(spark, str(tmp_path / "c")).filter("n = 3").first()["s"] == 'a "b", c'


def test_audit_of_a_text_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    result = audit_dataset(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert result.scores is None
    assert spark.read.json(result.paths["report"]).first()["n_samples"] == 1
    assert rows(spark.read.json(result.paths["labels"])) == [{"count": 1, "label": "in"}]
    single = audit_dataset(spark, str(tmp_path / "in" / "a.txt"), str(tmp_path / "out2"))
    assert set(single.paths) == {"report"}


def test_json_keeps_null_fields(spark, tmp_path):
    frame = spark.createDataFrame([(1, None)], "a long, b string")
    writers.save_json(frame, str(tmp_path / "j"))
    assert rows(writers.load_json(spark, str(tmp_path / "j"), frame.schema)) == [{"a": 1, "b": None}]


def test_preview(spark):
    frame = spark.range(100).repartition(7)
    assert [r["id"] for r in rows(metadata.preview(frame, 3, ["id"]))] == [0, 1, 2]
    assert metadata.preview(frame).count() == 5


def test_command_line(spark, tmp_path, capsys):
    sample, out = str(tmp_path / "sample.csv"), str(tmp_path / "out")
    assert main(["generate-sample", "-o", sample, "-n", "400", "-f", "4"], spark) == 0
    assert main(["audit", "-f", sample, "-o", out], spark) == 0
    printed = capsys.readouterr().out
    assert "Health score:" in printed and "Recommendations:" in printed
    report = spark.read.json(f"{out}/audit_report").first()
    assert report["metadata"]["n_samples"] == 400
    assert 0 <= report["scores"]["overall_score"] <= 100
    bins = spark.read.json(f"{out}/plots/anomaly_scores")
    assert bins.agg(F.sum("count")).first()[0] == 400
    flags = spark.read.parquet(f"{out}/anomaly_flags")
    assert flags.count() == 400
    assert flags.agg(F.sum("anomaly_label")).first()[0] == report["anomalies"]["n_anomalies"]


@pytest.fixture
def a_file_a_partition(spark):
    """Spark's weights of many small files, without writing so many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "1m")
    yield
    for n, v in zip(names, before):
        assert n == names[0] or spark.conf.get(n) == v
        spark.conf.set(n, v)


def test_many_small_files_share_tasks(spark, tmp_path, a_file_a_partition):
    for k in range(150):
        (tmp_path / "t" / f"of={k}").mkdir(parents=True)
        (tmp_path / "t" / f"of={k}" / "x.txt").write_text(f"text {k}")
        (tmp_path / "d.json" / f"of={k}").mkdir(parents=True)
        (tmp_path / "d.json" / f"of={k}" / "x").write_text(f'[{{"a": {k}}},\n {{"a": {k}, "b{k % 2}": "é"}}]')
    texts = readers.scan_text_dir(spark, str(tmp_path / "t"))
    assert texts.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism < 150
    assert {(r.label, r.text) for r in texts.collect()} == {(f"of={k}", f"text {k}") for k in range(150)}
    assert readers.list_files(spark, str(tmp_path / "t")).rdd.getNumPartitions() < 150
    found = readers.load(spark, str(tmp_path / "d.json")).data
    assert found.rdd.getNumPartitions() < 150
    assert found.dtypes == [("a", "bigint"), ("b0", "string"), ("b1", "string"), ("of", "int")]
    assert sorted((r.a, r.b0, r.b1) for r in found.collect() if r.b0 or r.b1) == [
        (k, *(("é", None) if k % 2 == 0 else (None, "é"))) for k in range(150)]


def test_documents_in_other_encodings_and_compressed(spark, tmp_path):
    import gzip

    body = '[{"a": 1,\n "b": "é"},\n {"a": 2.5}]'
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_bytes(body.encode("utf-16"))
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.json.gz").write_bytes(gzip.compress(body.encode()))
    for folder in ("w", "z"):
        assert rows(readers.scan_json(spark, str(tmp_path / folder), lines=False)) == [{"a": 1.0, "b": "é"}, {"a": 2.5, "b": None}]


def test_text_files_hold_what_spark_would_write(spark, tmp_path, monkeypatch):
    data = [(1, "a/b", "x\ny"), (1, "a/b", "z"), (2, None, None), (2, "", "é\r"), (3, 'q"%[^é', ""), (None, "p q", "k")]
    frame = spark.createDataFrame(data, "id long, lang string, text string")
    writers.save_text_files(frame, str(tmp_path / "own"), "text", "id", ["lang"])
    monkeypatch.setattr(writers, "local_folder", lambda *a: None)
    writers.save_text_files(frame, str(tmp_path / "spark"), "text", "id", ["lang"])

    def files(folder, place):
        return {place(f): sorted(f.read_bytes().split(b"\n")) for f in (tmp_path / folder).rglob("*.txt")}

    own = files("own", lambda f: (f.stem, f.parent.name))
    assert own == files("spark", lambda f: (f.parent.parent.name, f.parent.name)) and len(own) == 4
    assert sum(1 for _ in (tmp_path / "own").rglob("*")) <= 3 * 4  # a file and at most two folders for each
    assert not any(f.name.startswith(".") for f in (tmp_path / "own").rglob("*"))


def test_rows_that_are_alone_in_their_file_are_not_shuffled(spark, tmp_path):
    """Texts would be on the disk twice, as files and as shuffled rows."""
    tracker = spark.sparkContext.statusTracker()
    frame = spark.range(4000).selectExpr("id", "array_join(transform(sequence(1, 50), i -> md5(id || '-' || i)), '') AS text")
    manager = spark._jsc.sc().statusStore()

    def shuffled(rows, folder):
        spark.sparkContext.setJobGroup(folder, folder)
        writers.save_text_files(rows, str(tmp_path / folder), "text", "id")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for job in tracker.getJobIdsForGroup(folder) for s in tracker.getJobInfo(job).stageIds}
        return sum(manager.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s))

    try:
        assert shuffled(frame, "alone") < 500_000 < 4000 * 50 * 32 / 4
        shuffled(frame.union(frame.filter("id % 100 = 0").withColumn("text", F.lit("more"))), "some")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    files = {int(f.stem[3:]): f.read_text().split() for f in (tmp_path / "some").rglob("*.txt")}
    assert len(files) == 4000 == sum(1 for _ in (tmp_path / "alone").rglob("*.txt"))
    assert all(len(lines) == (1 if k % 100 else 2) and ("more" in lines) == (k % 100 == 0) for k, lines in files.items())


def same_files(spark, folder, monkeypatch):
    """The texts and files below a folder as tasks find them, and as Spark's readers do."""
    def found():
        texts, files = readers.scan_text_dir(spark, str(folder)), readers.list_files(spark, str(folder))
        return sorted(map(tuple, texts.collect())), sorted(map(tuple, files.collect()))

    own = found()
    with monkeypatch.context() as patch:
        patch.setattr(readers, "files_below", lambda *a: None)
        assert own == found()
    return own


def test_tasks_find_the_files_that_spark_finds(spark, tmp_path, monkeypatch):
    for name, body in [("a.txt", "top"), ("d é+%[x] #/b c.txt", " é\n"), ("d é+%[x] #/deep/er/z.txt", "z"), ("B.TXT", "no"),
                       ("k/_hidden.txt", "h"), ("k/_a=b.txt", "shown"), ("k/.dot.txt", "h"), ("k/x.txt._COPYING_", "h"),
                       ("k/_metadata.txt", "h"), ("_no/x.txt", "h"), ("_p=1/x.txt", "p"), ("_metadata/x.txt", "m"), (".no/x.txt", "h"),
                       ("k/empty.txt", ""), ("k/blank.txt", " \n\t"), ("k/data.csv", "1,2"), ("k/y.txt/in.txt", "folder")]:
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(body)
    (tmp_path / "t" / "k" / "bytes.txt").write_bytes(b"\xff\xfe\x00caf\xe9 ")
    (tmp_path / "t" / "k" / "gone.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "t" / "link").symlink_to(tmp_path / "t" / "k")
    texts, files = same_files(spark, tmp_path / "t", monkeypatch)
    assert len(texts) == 11 and len(files) == 16
    assert ("d é+%[x] #", "é") in {t[1:] for t in texts}
    (tmp_path / "none").mkdir()
    assert same_files(spark, tmp_path / "none", monkeypatch) == ([], [])


@pytest.mark.parametrize("walk", [1, 3, 10_000])
def test_folders_left_over_are_listed_in_further_rounds(spark, tmp_path, monkeypatch, walk):
    for k in range(30):
        (tmp_path / f"{k % 3}" / f"{k}" / "x").mkdir(parents=True)
        (tmp_path / f"{k % 3}" / f"{k}" / "x" / "a.txt").write_text(f"{k}")
        (tmp_path / f"{k % 3}" / f"{k}.txt").write_text(f"{k}")
    monkeypatch.setattr(listing, "_listed", partial(listing._listed, walk=walk))
    assert len(same_files(spark, tmp_path, monkeypatch)[0]) == 60


def test_names_in_other_encodings_are_read(spark, tmp_path):
    (tmp_path / "t" / "é").mkdir(parents=True)
    for folder, name in ((b"\xc3\xa9", b"caf\xe9.txt"), (b"f\xfcr", b"a.txt")):
        os.makedirs(inside := os.path.join(os.fsencode(tmp_path), b"t", folder), exist_ok=True)
        with open(os.path.join(inside, name), "wb") as file:
            file.write(folder)
    found = {(r.path.rsplit("/", 1)[-1], r.label) for r in readers.scan_text_dir(spark, str(tmp_path / "t")).collect()}
    assert found == {("caf\ufffd.txt", "é"), ("a.txt", "f\ufffdr")}
    listed = {r.path.rsplit("/", 1)[-1] for r in readers.list_files(spark, str(tmp_path / "t")).collect()}
    assert listed == {"caf\ufffd.txt", "a.txt"}


@pytest.fixture
def folder_of_texts(tmp_path):
    for k in range(300):
        (tmp_path / "t" / f"{k % 7}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / f"{k % 7}" / f"{k}.txt").write_text(f"text {k}")
    (tmp_path / "t" / "1" / "long.txt").write_text("x" * 50_000)
    return str(tmp_path / "t")


def test_the_driver_holds_no_text_file_of_a_folder(spark, folder_of_texts, monkeypatch):
    monkeypatch.setattr(listing, "TASK_BYTES", 10_000)
    texts = readers.scan_text_dir(spark, folder_of_texts)
    assert not any(f.endswith(".txt") for f in texts.inputFiles()) and len(texts.inputFiles()) < 100
    assert texts.count() == 301 and texts.agg(F.sum(F.length("text"))).first()[0] == 50_000 + 300 * 5 + 10 + 90 * 2 + 200 * 3


def test_the_driver_holds_no_file_whose_size_it_sums(spark, folder_of_texts):
    files = readers.list_files(spark, folder_of_texts)
    assert not any(f.endswith(".txt") for f in files.inputFiles()) and len(files.inputFiles()) < 100
    assert files.count() == 301
    described = rows(metadata.dataset_metadata(readers.load(spark, folder_of_texts, kind="text")))[0]
    assert (described["n_samples"], described["n_classes"], described["file_size_mb"]) == (301, 7, 0.05)
