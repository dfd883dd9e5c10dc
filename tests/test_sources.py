import lzma
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import quality
from ledgerspark.plans import ingest
from ledgerspark.sources import cache, files, sinks

HEADER = "transaction_id,date,description,amount,day_of_week,category\n"
LINES = [
    '1,2024-01-05,"CVS PHARMACY #1234, TX",12.50,Friday,Groceries\n',
    '2,01/06/2024,"say ""hi""",n/a,Saturday,Travel\n',
    "3,2024/01/07,  padded  ,7,Sunday,\n",
    "4,2024-01-08,,3.25,Monday,Shopping\n",
]


def text(lines=LINES):
    return HEADER + "".join(lines)


def as_rows(df):
    return {r["transaction_id"]: r for r in df.collect()}


def check_raw(df):
    rows = as_rows(df)
    assert [rows[i]["amount"] for i in (1, 2, 3, 4)] == [12.5, None, 7.0, 3.25]
    assert rows[1]["description"] == "CVS PHARMACY #1234, TX" and rows[2]["description"] == 'say "hi"'
    assert rows[3]["category"] is None and rows[4]["description"] is None and rows[3]["description"] == "  padded  "


@pytest.mark.parametrize("suffix", ["csv", "csv.gz", "csv.bz2", "csv.xz", "csv.zip"])
def test_csv_in_every_packing(spark, tmp_path, suffix):
    import bz2
    import gzip

    path = str(tmp_path / f"train.{suffix}")
    data = text().encode()
    if suffix == "csv.zip":
        with zipfile.ZipFile(path, "w") as archive:
            archive.writestr("train.csv", data)
    else:
        opener = {"csv": open, "csv.gz": gzip.open, "csv.bz2": bz2.open, "csv.xz": lzma.open}[suffix]
        with opener(path, "wb") as out:
            out.write(data)
    check_raw(files.read_transactions(spark, path))
    assert files.read_transactions(spark, path, nrows=2).count() == 2


def test_archived_csv_streams_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "CHUNK_ROWS", 7)
    with lzma.open(tmp_path / "a.csv.xz", "wb") as out:
        out.write((HEADER + "".join(f"{i},2024-01-01,d{i},1.0,Monday,Travel\n" for i in range(100))).encode())
    df = files.read_transactions(spark, str(tmp_path / "a.csv.xz"))
    assert df.agg(F.count_distinct("transaction_id")).first()[0] == 100


def test_encoding_is_chosen_per_file(spark, tmp_path):
    line = "{},2024-01-01,Café Zürich,1.0,Monday,Travel\n"
    (tmp_path / "a.csv").write_bytes((HEADER + line.format(1)).encode("utf-8"))
    (tmp_path / "b.csv").write_bytes((HEADER + line.format(2)).encode("latin-1"))
    probed = {os.path.basename(r["file"]): r["encoding"] for r in files.probe_encodings(spark, str(tmp_path)).collect()}
    assert probed == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1"}
    assert [r["description"] for r in files.read_transactions(spark, str(tmp_path)).collect()] == ["Café Zürich"] * 2


def test_load_repairs_everything(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    with open(path, "w") as out:
        out.write(text())
    rows = as_rows(ingest.load_transactions(spark, path))
    assert rows[2]["amount"] == 7.0  # the median of 12.5, 7 and 3.25
    assert rows[3]["description"] == "padded" and rows[4]["description"] == "" and rows[3]["category"] is None
    assert [rows[i]["date"].day for i in (1, 2, 3, 4)] == [5, 6, 7, 8]
    compat = as_rows(ingest.repair(files.read_transactions(spark, path), compat=True))
    assert compat[3]["category"] == ""


def test_cache_is_used_until_the_source_changes(spark, tmp_path):
    source, cached = str(tmp_path / "train.csv"), str(tmp_path / "cache")
    with open(source, "w") as out:
        out.write(text())
    assert not cache.is_cache_valid(spark, cached, source)
    assert ingest.load_transactions(spark, source, cache=cached).count() == 4
    assert cache.is_cache_valid(spark, cached, source)
    builds = []

    def build():
        builds.append(1)
        return spark.range(3)

    assert cache.cached_table(spark, source, cached, build).count() == 4 and not builds
    later = time.time() + 60
    os.utime(source, (later, later))
    assert not cache.is_cache_valid(spark, cached, source)
    assert cache.cached_table(spark, source, cached, build).count() == 3 and len(builds) == 1
    assert cache.cached_table(spark, source, str(tmp_path / "other"), build, force_reload=True).count() == 3


def test_load_metadata(spark, tmp_path):
    import hashlib

    path = str(tmp_path / "train.csv")
    with open(path, "w") as out:
        out.write(text())
    sections = cache.load_metadata(spark, files.read_transactions(spark, path), path)
    assert sections["load"].first()["n_rows"] == 4
    assert sections["files"].first()["md5"] == hashlib.md5(text().encode()).hexdigest()
    missing = {r["column_name"]: r["n_missing"] for r in sections["columns"].collect()}
    assert missing == {"transaction_id": 0, "date": 0, "description": 1, "amount": 1, "day_of_week": 0, "category": 1}


def test_report_keeps_nulls_and_drops_nan(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None)], "a int, b double, c string")
    sinks.write_report({"part": df}, str(tmp_path))
    written = [line for f in (tmp_path / "part").glob("*.json") for line in f.read_text().splitlines()]
    assert written == ['{"a":1,"b":null,"c":null}']


def test_required_columns_and_empty_table(spark, make):
    df = make([(1, "2023-01-01", "A", 1.0, "Sunday", "Travel")])
    assert quality.require_valid(df) is df
    with pytest.raises(ValueError, match="category"):
        quality.require_valid(df.drop("category"))
    quality.require_valid(df.drop("category"), is_train=False)
    with pytest.raises(ValueError, match="empty"):
        quality.require_valid(df.where("false"))


def dates_table(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "transaction_id long, date string")


def test_dates_day_first_and_failures(spark):
    good = dates_table(spark, ["13/02/2024"] * 99 + ["junk"])
    assert quality.choose_date_format(good) == "mixed"
    parsed = quality.parse_dates(good)
    assert parsed.where("date is null").count() == 1 and parsed.first()["date"].month == 2
    bad = dates_table(spark, ["2024-02-13"] * 95 + ["junk"] * 5)
    assert quality.choose_date_format(bad) is None
    assert dict(quality.parse_dates(bad).dtypes)["date"] == "string"
    mixed = dates_table(spark, ["02/03/2024", "13/02/2024", "2024-05-06 07:08:09"])
    assert [(r["date"].month, r["date"].day) for r in quality.parse_dates(mixed).orderBy("transaction_id").collect()] == [(2, 3), (2, 13), (5, 6)]


def test_single_class_is_balanced_and_narrowing(spark, make):
    df = make([(300, "2023-01-01", "A", 1.5, "Sunday", "Travel"), (2, "2023-01-01", "A", 2.5, "Sunday", "Travel")])
    row = quality.imbalance(df).first()
    assert (row["n_classes"], row["imbalance_ratio"], row["is_imbalanced"]) == (1, 1.0, 0)
    kinds = dict(quality.narrow_types(df).dtypes)
    assert (kinds["amount"], kinds["transaction_id"]) == ("float", "smallint")


def test_align_columns(make):
    train = make([(1, "2023-01-01", "A", 1.0, "Sunday", "Travel")])
    test = train.drop("category").withColumn("extra", F.lit(1))
    left, right = quality.align_columns(train, test)
    assert left.columns == train.columns and right.columns == train.drop("category").columns


def test_all_members_of_a_zip_file_are_read(spark, tmp_path, monkeypatch):
    with zipfile.ZipFile(tmp_path / "train.csv.zip", "w") as archive:
        archive.writestr("a/", "")
        archive.writestr("a/one.csv", text(LINES[:2]))
        archive.writestr("empty.csv", "")
        archive.writestr("two.csv", text(LINES[2:]))
    check_raw(files.read_transactions(spark, str(tmp_path / "train.csv.zip")))
    monkeypatch.setattr(files, "STREAM_BYTES", 1)  # every file is streamed by its path
    check_raw(files.read_transactions(spark, str(tmp_path / "train.csv.zip")))


def test_large_files_are_hashed_by_path(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "a.csv").write_text(text())
    monkeypatch.setattr(files, "STREAM_BYTES", 10)
    assert cache.file_hashes(spark, str(tmp_path)).first()["md5"] == hashlib.md5(text().encode()).hexdigest()


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '1,2024-01-05,"two\nlines, ""quoted""",12.50,Friday,Groceries\n')
    (tmp_path / "b.csv").write_text(text(LINES[1:]))
    rows = as_rows(files.read_transactions(spark, str(tmp_path)))
    assert len(rows) == 4 and rows[1]["description"] == 'two\nlines, "quoted"' and rows[1]["amount"] == 12.5
    assert files.read_transactions(spark, str(tmp_path), nrows=2).count() == 2


def test_a_partial_load_leaves_the_cache_whole(spark, tmp_path):
    source, cached = str(tmp_path / "train.csv"), str(tmp_path / "cache")
    with open(source, "w") as out:
        out.write(text())
    assert ingest.load_transactions(spark, source, cache=cached, nrows=3).count() == 3
    assert ingest.load_transactions(spark, source, cache=cached).count() == 4
    assert ingest.load_transactions(spark, source, cache=cached, nrows=1).count() == 1


def test_a_cache_counts_only_when_complete_and_of_its_kind(spark, tmp_path):
    source, cached = str(tmp_path / "train.csv"), str(tmp_path / "cache")
    with open(source, "w") as out:
        out.write(text())
    ingest.load_transactions(spark, source, cache=cached)
    test = ingest.load_transactions(spark, source, is_train=False, cache=cached)
    assert test.count() == 4 and not cache.is_cache_valid(spark, cached, source, "something else")
    os.remove(tmp_path / "cache" / "_SUCCESS")
    assert not cache.is_cache_valid(spark, cached, source)
    assert not [p for p in os.listdir(tmp_path) if "writing" in p]


def test_repeated_ids_are_refused(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    with open(path, "w") as out:
        out.write(text([*LINES, LINES[0]]))
    with pytest.raises(ValueError, match="transaction_id 1"):
        ingest.load_transactions(spark, path)


def test_only_decimal_numbers_are_amounts(spark):
    from ledgerspark.functions import amounts

    texts = ["1d", "12f", "0x1p3", "1_0", "", "-", ".", "e5", "1e", "1.5", " 2 ", "+3.", ".5", "1E3", "-inf", "Infinity", "nan", None]
    got = spark.createDataFrame([(t,) for t in texts], "amount string").select(amounts.number()).collect()
    assert [r[0] for r in got] == [None] * 9 + [1.5, 2.0, 3.0, 0.5, 1000.0, float("-inf"), float("inf"), None, None]
    assert spark.createDataFrame([(1.5,), (None,)], "amount double").select(amounts.number()).collect() == [(1.5,), (None,)]


def test_mixed_dates_with_names_and_times(spark):
    from datetime import datetime

    wanted = {
        "01/05/2024 10:30": (1, 5, 10, 30, 0), "Jan 5, 2024": (1, 5, 0, 0, 0), "5 January 2024": (1, 5, 0, 0, 0),
        "13/02/2024 23:59:58": (2, 13, 23, 59, 58), "JAN 5, 2024 1:05 pm": (1, 5, 13, 5, 0), "1/5/2024 12:00 AM": (1, 5, 0, 0, 0),
        "2024/3/4 7:08": (3, 4, 7, 8, 0), "2024-05-06T07:08:09": (5, 6, 7, 8, 9), "5-Jan-2024": (1, 5, 0, 0, 0),
    }
    table = dates_table(spark, [*wanted, "25:00", "Foo 5, 2024", "1/5/2024 25:00", None])
    got = [r["date"] for r in quality.parse_dates(table.where("transaction_id < 9")).orderBy("transaction_id").collect()]
    assert got == [datetime(2024, *w) for w in wanted.values()]
    from ledgerspark.functions import dates

    rest = table.where("transaction_id >= 9").select(dates.parse_with(F.col("date"), "mixed"))
    assert [r[0] for r in rest.collect()] == [None] * 4
